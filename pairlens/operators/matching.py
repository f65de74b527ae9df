"""Hash matching of units against a two-sided reference, and the verdicts it gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import abstracted, fingerprint

KINDS = ("native", "exact", "abstracted")


def fingerprint_rows(units: DataFrame, text: str = "text", minimum: int = 50) -> DataFrame:
    """Every unit once per kind of fingerprint that it has: ``kind, length, digest`` beside its columns."""
    stacked = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"_f.{k}_length").alias("length"), F.col(f"_f.{k}").alias("digest")) for k in KINDS]))
    return units.select("*", fingerprint(F.col(text), minimum).alias("_f")).select(*[c for c in units.columns if c != text], stacked.alias("_s")).select(*[c for c in units.columns if c != text], "_s.*").where("digest IS NOT NULL")


def build_hash_index(reference: DataFrame, boundary: str = "boundary", side: str = "side", language: str = "language", text: str = "text", minimum: int = 50) -> DataFrame:
    """One row per (kind, length, digest, language, boundary): which sides have it, and how often.

    Copies collapse before any join, so a text that fills a third of the reference is one row.
    """
    rows = fingerprint_rows(reference.select(F.col(boundary).alias("boundary"), F.col(side).alias("side"), F.col(language).alias("language"), F.col(text).alias("text")), "text", minimum)
    return rows.groupBy("kind", "length", "digest", "language", "boundary").agg(
        F.max((F.col("side") == "vulnerable").cast("int")).alias("vulnerable"), F.max((F.col("side") == "patched").cast("int")).alias("patched"), F.count(F.lit(1)).alias("copies")
    )


def lookup(targets: DataFrame, index: DataFrame, unit: str = "unit", language: str = "language", text: str = "text", kinds: tuple = KINDS, by_language: bool = True, minimum: int = 50) -> DataFrame:
    """Equality join on kind, length and digest; native hits count as exact.

    Hits of another language are left out, but not for targets too short for more than a native digest:
    these are found in every language, and ``same_language`` tells.  The index side is planned by its size.
    """
    rows = targets.select(F.col(unit).alias("unit"), F.col(language).alias("language"), F.col(text).alias("text"))
    rows = rows.withColumn("short", F.length(abstracted(F.col("text"))) < minimum)
    rows = fingerprint_rows(rows, "text", minimum).where(F.col("kind").isin(*kinds))
    found = rows.join(index.withColumnRenamed("language", "_language"), ["kind", "length", "digest"])
    same = F.col("language").eqNullSafe(F.col("_language"))
    found = found.where(same | F.col("short")) if by_language else found
    return found.select("unit", "boundary", F.when(F.col("kind") == "abstracted", "abstracted").otherwise("exact").alias("match"), "vulnerable", "patched", "copies", same.alias("same_language"))


def hash_verdicts(hits: DataFrame) -> DataFrame:
    """Per unit and boundary: exact rows if any, else abstracted; both sides leave it uncertain."""
    exact, loose = F.col("match") == "exact", F.col("match") == "abstracted"
    agg = hits.groupBy("unit", "boundary").agg(
        F.max(exact.cast("int")).alias("has_exact"),
        F.max(F.when(exact, F.col("vulnerable")).otherwise(0)).alias("ev"),
        F.max(F.when(exact, F.col("patched")).otherwise(0)).alias("ep"),
        F.max(F.when(loose, F.col("vulnerable")).otherwise(0)).alias("av"),
        F.max(F.when(loose, F.col("patched")).otherwise(0)).alias("ap"),
        F.sum("copies").alias("match_count"),
    )
    by_exact = F.col("has_exact") == 1
    v, p = F.when(by_exact, F.col("ev")).otherwise(F.col("av")), F.when(by_exact, F.col("ep")).otherwise(F.col("ap"))
    rows = agg.select("unit", "boundary", v.alias("vulnerable_hit"), p.alias("patched_hit"), "match_count", F.when(by_exact, "exact").otherwise("abstracted").alias("match_level"))
    both = (F.col("vulnerable_hit") == 1) & (F.col("patched_hit") == 1)
    return rows.select(
        "*",
        F.when(both, "uncertain").when(F.col("vulnerable_hit") == 1, "vulnerable").otherwise("patched").alias("status"),
        F.when(both & (F.col("match_level") == "exact"), "CONTRADICTORY_EVIDENCE").when(both, "HASH_SIDE_AMBIGUOUS").alias("abstention_reason"),
    )


def unit_priority(verdicts: DataFrame, unit: str = "unit") -> DataFrame:
    """Priority over a unit's boundaries: a clean vulnerable one first, then any doubt, then patched lineage."""
    strong = F.col("abstention_reason") == "CONTRADICTORY_EVIDENCE"
    agg = verdicts.groupBy(unit).agg(
        F.max((F.col("status") == "vulnerable").cast("int")).alias("v"),
        F.max((F.col("status") == "patched").cast("int")).alias("p"),
        F.max(F.coalesce(strong, F.lit(False)).cast("int")).alias("s"),
        F.max((F.col("status") == "uncertain").cast("int")).alias("u"),
        F.count(F.lit(1)).alias("boundaries"),
    )
    return agg.select(
        unit,
        "boundaries",
        F.when(F.col("v") == 1, "automatic_vulnerability").when((F.col("p") == 1) & (F.col("s") == 0), "informational_lineage").when(F.col("u") == 1, "manual_review").otherwise("none").alias("priority"),
    )


def unmatched(targets: DataFrame, hits: DataFrame, unit: str = "unit") -> DataFrame:
    """Targets without any hash hit: the ones that go on to retrieval."""
    return targets.join(hits.select(F.col("unit").alias(unit)).distinct(), unit, "left_anti")
