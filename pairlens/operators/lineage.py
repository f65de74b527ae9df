"""Lineages: identities of code families, clusters of entries, revisions, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import digest, identity
from .graph import components


def lineage_id(repo: Column, path: Column, function: Column) -> Column:
    return identity("lineage", repo, path, function)


def boundary_id(lineage: Column, fix: Column, vulnerable: Column, patched: Column) -> Column:
    return identity("boundary", lineage, fix, digest(vulnerable), digest(patched))


def cluster(entries: DataFrame, lineage: str = "lineage_id", order: list[str] | None = None, alias: list[str] | None = None) -> DataFrame:
    """Per lineage: the first member by ``order``, the sorted distinct aliases and the number of members."""
    order, alias = order or ["ghsa_id", "package", "cve_id", "osv_id"], alias or ["ghsa_id", "cve_id", "osv_id"]
    return entries.groupBy(lineage).agg(F.min(F.struct(*order)).alias("representative"), F.array_sort(F.collect_set(F.struct(*alias))).alias("aliases"), F.count(F.lit(1)).alias("members"))


def revision_links(boundaries: DataFrame, within: list[str] | None = None, boundary: str = "boundary_id", before: str = "vulnerable", after: str = "patched") -> DataFrame:
    """Edges (u, v) from a boundary to one that starts from its patched text, in the same lineage and language.

    A text shared by many boundaries links each to the text's own node, so edges stay linear;
    :func:`revision_components` contracts them.
    """
    within = within or ["lineage_id", "language"]
    node = F.concat(F.lit("text-"), digest(F.concat_ws("\x00", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in within], F.col("_t"))))
    ends = boundaries.select(F.col(boundary).alias("u"), *within, F.explode(F.array(F.struct(F.col(before).alias("_t"), F.lit(1).alias("b")), F.struct(F.col(after).alias("_t"), F.lit(0).alias("b")))).alias("_e")).select("u", *within, "_e.*")
    ends = ends.select("u", node.alias("v"), "b").where("v IS NOT NULL").distinct()
    # a text matters where some boundary ends and another begins
    shared = ends.groupBy("v").agg(F.min("b").alias("lo"), F.max("b").alias("hi"), F.countDistinct("u").alias("n")).where("lo < hi AND n > 1").select("v")
    return ends.join(shared, "v").select("u", "v").distinct()


def revision_components(boundaries: DataFrame, **columns) -> DataFrame:
    """(boundary, component): the least boundary that revisions lead to."""
    name = columns.get("boundary", "boundary_id")
    found = components(revision_links(boundaries, **columns), "revisions")
    roots = found.where(~F.col("node").startswith("text-")).groupBy("root").agg(F.min("node").alias("component"))
    linked = found.join(roots, "root").select(F.col("node").alias(name), "component")
    return boundaries.select(name).distinct().join(linked, name, "left").select(name, F.coalesce("component", name).alias("component"))


def confidence(score: Column) -> Column:
    return F.when(score >= 0.82, "high").when(score >= 0.68, "medium").when(score >= 0.55, "low").otherwise("none")


def upper_median(values: Column) -> Column:
    """The element at n div 2 of the sorted list, 0-based: of an even number, the upper one."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def lineage_scores(evidence: DataFrame, unit: str = "unit", lineage: str = "lineage", similarity: str = "similarity", structure: str = "structure") -> DataFrame:
    """Upper median of 0.60 similarity + 0.25 structure + 0.075 per lineage, with its confidence."""
    row = F.round(0.60 * F.col(similarity) + 0.25 * F.col(structure) + 0.075, 6)
    agg = evidence.groupBy(unit, lineage).agg(F.count(F.lit(1)).alias("observations"), upper_median(F.collect_list(row)).alias("score"))
    return agg.select("*", confidence(F.col("score")).alias("confidence"))


def unknown_applicabilities(aliases: DataFrame, unit: str = "unit", lineage: str = "lineage") -> DataFrame:
    """Distinct (unit, lineage, package, ecosystem) of the advisories of a lineage, before any project is looked at.

    ``aliases`` has a row per advisory with ``package, ecosystem``; without a package it names none, and an
    ecosystem that is null or empty is npm.
    """
    rows = aliases.where(F.coalesce("package", F.lit("")) != "")
    ecosystem = F.coalesce(F.nullif(F.col("ecosystem"), F.lit("")), F.lit("npm"))
    return rows.select(unit, lineage, "package", ecosystem.alias("ecosystem"), F.lit("unknown").alias("status")).distinct()
