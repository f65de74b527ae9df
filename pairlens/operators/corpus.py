"""Building the reference corpus: agreement of sources, filters with reasons, deduplication, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, digest, file_problem, tokens
from ..functions.versions import version_key


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The first rule that holds names the reason; null admits."""
    out = F.lit(None).cast("string")
    for condition, reason in reversed(rules):
        out = F.when(condition, reason).otherwise(out)
    return out


def advisory_agreement(advisories: DataFrame, osv: DataFrame) -> DataFrame:
    """Advisory rows (ghsa_id, package, ecosystem, affected_range, fixed_version) against OSV rows
    (ghsa_alias, package, ecosystem, introduced, fixed, versions array).

    Checks in order: alias, package, parseable versions, a range, a fix, the same fix.  Rows that
    agree keep the OSV versions inside their range, or an empty list where one falls outside.
    """
    o = osv.select(*[F.col(c).alias("osv_" + c) for c in ("ghsa_alias", "package", "ecosystem", "introduced", "fixed", "versions")])
    known = osv.select(F.col("ghsa_alias").alias("ghsa_id")).distinct().withColumn("has_alias", F.lit(True))
    rows = advisories.join(known, "ghsa_id", "left").join(
        o, (F.col("ghsa_id") == F.col("osv_ghsa_alias")) & (F.col("package") == F.col("osv_package")) & (F.col("ecosystem") == F.col("osv_ecosystem")), "left"
    )
    fixed, osv_fixed = version_key(F.col("fixed_version")), version_key(F.col("osv_fixed"))
    reason = first_reason(
        (F.col("has_alias").isNull(), "osv_alias_missing"),
        (F.col("osv_package").isNull(), "osv_package_missing"),
        (F.col("fixed_version").isNotNull() & fixed.isNull(), "version_unparseable"),
        (F.coalesce(F.col("affected_range"), F.lit("")) == "", "range_missing"),
        (F.col("fixed_version").isNull() | F.col("osv_fixed").isNull(), "fix_missing"),
        (~fixed.eqNullSafe(osv_fixed), "fix_disagrees"),
    )
    low = version_key(F.coalesce(F.col("osv_introduced"), F.lit("0.0.0")))
    inside = F.forall("osv_versions", lambda v: F.coalesce((version_key(v) >= low) & (version_key(v) < osv_fixed), F.lit(False)))
    versions = F.when(reason.isNull() & inside, F.col("osv_versions")).otherwise(F.array().cast("array<string>"))
    return rows.select(*advisories.columns, reason.alias("reason_code"), versions.alias("affected_versions"))


def release_boundary(versions: DataFrame, package: str = "package", version: str = "version", fixed: str = "first_fixed") -> DataFrame:
    """Per package and fix: the greatest version below the fix."""
    v, f = version_key(F.col(version)), version_key(F.col(fixed))
    return versions.where(v < f).groupBy(package, fixed).agg(F.max_by(version, v).alias("last_affected"))


def is_ancestor(older: Column, newer: Column, comparison: Column) -> Column:
    """Whether a commit is another one or comes before it, by the landed status of comparing both; null where there is none."""
    return F.when(older == newer, True).otherwise(comparison.isin("ahead", "identical"))


def resolved_boundaries(fixes: DataFrame, releases: DataFrame, comparisons: DataFrame) -> DataFrame:
    """The last affected and first fixed release of each fix with their commits, or the reason why there is none.

    ``fixes``: package, repo, fix, first_fixed, affected_versions (array).  ``releases``, one row per package and
    version: package, repo, version, tarball, artifact_name, artifact_version, artifact_sha256, git_head, tag_commit.
    ``comparisons``, one row per pair: repo, older, newer, status.  Both artifacts must be the package at that
    version, and the fix must lie between the commits of both.
    """
    below = F.filter("affected_versions", lambda v: version_key(v) < version_key(F.col("first_fixed")))
    last = F.array_max(F.transform(below, lambda v: F.struct(version_key(v).alias("k"), v.alias("v"))))["v"]
    rows = fixes.select("*", last.alias("last_affected"))
    known = releases.groupBy("package").agg(F.max("repo").alias("known_repo"))
    rows = rows.join(known, "package", "left")
    bare = lambda c: F.regexp_replace(F.trim(c), "^[vV=]+", "")
    problems = []
    for side, version in (("v", "last_affected"), ("f", "first_fixed")):
        commit = F.coalesce("git_head", "tag_commit")
        one = releases.select("package", F.col("version").alias(version), *[c.alias(f"{side}_{n}") for n, c in (("tarball", F.col("tarball")), ("name", F.col("artifact_name")), ("version", F.col("artifact_version")), ("sha256", F.col("artifact_sha256")), ("commit", commit))])
        rows = rows.join(one, ["package", version], "left")
        get = lambda n, side=side: F.col(f"{side}_{n}")
        problems += [
            (get("tarball").isNull(), "tarball_missing"),
            (get("name").isNull() | get("version").isNull(), "tarball_invalid"),
            ((get("name") != F.col("package")) | (bare(get("version")) != bare(F.col(version))), "tarball_identity_mismatch"),
            (get("commit").isNull(), "release_commit_unresolved"),
        ]
    for side, older, newer in (("v", "v_commit", "fix"), ("f", "fix", "f_commit")):
        status = comparisons.select("repo", F.col("older").alias(older), F.col("newer").alias(newer), F.col("status").alias(f"{side}_status"))
        rows = rows.join(status, ["repo", older, newer], "left")
        before = is_ancestor(F.col(older), F.col(newer), F.col(f"{side}_status"))
        problems += [(before.isNull(), "commit_ancestry_unresolved"), (~before, "fix_outside_release_boundary")]
    reason = first_reason(
        (~F.coalesce(F.lower("known_repo") == F.lower("repo"), F.lit(False)), "repository_mismatch"),
        (F.coalesce(F.size("affected_versions"), F.lit(0)) <= 0, "affected_versions_missing"),
        (F.col("last_affected").isNull(), "last_affected_unresolved"),
        *problems,
    )
    out = {"last_affected_commit": "v_commit", "first_fixed_commit": "f_commit", "vulnerable_artifact": "v_sha256", "fixed_artifact": "f_sha256"}
    return rows.select(*fixes.columns, reason.alias("reason_code"), *[F.when(reason.isNull(), F.col(c)).alias(n) for n, c in {"last_affected": "last_affected", **out}.items()])


def high_impact(rows: DataFrame) -> Column:
    """At least 100 dependents and 500 stars, not archived or disabled, and two of three signs of activity.

    Columns: dependents, stars, archived, disabled, days_since_release, days_since_commit, answered_share.
    """
    signs = sum(F.coalesce(c, F.lit(False)).cast("int") for c in (rows["days_since_release"] <= 548, rows["days_since_commit"] <= 180, rows["answered_share"] >= 0.7))
    alive = ~F.coalesce(rows["archived"], F.lit(False)) & ~F.coalesce(rows["disabled"], F.lit(False))
    return F.coalesce((rows["dependents"] >= 100) & (rows["stars"] >= 500) & alive & (signs >= 2), F.lit(False))


def diff_problem(files: DataFrame, commit: str = "sha") -> DataFrame:
    """Why a commit is no clean fix: exactly one parent, one to three production files, at most 150 changed lines.

    ``files``: one row per changed file with ``path, changed_lines, parents``.
    """
    ok = file_problem(F.col("path")).isNull()
    agg = files.groupBy(commit).agg(F.max("parents").alias("parents"), F.sum(ok.cast("int")).alias("production_files"), F.sum(F.when(ok, F.col("changed_lines")).otherwise(0)).alias("changed"))
    reason = first_reason(
        (F.col("parents") != 1, "not_single_parent"), (F.col("production_files") == 0, "no_production_file"), (F.col("production_files") > 3, "too_many_files"), (F.col("changed") > 150, "too_large")
    )
    return agg.select("*", reason.alias("reason_code"))


def entry_fingerprints(text: Column) -> list[Column]:
    """Digests of an entry: as it is, of its normalised tokens, of its raw tokens."""
    return [digest(text).alias("native_hash"), digest(F.array_join(tokens(collapse(text)), " ")).alias("normalized_hash"), digest(F.to_json(tokens(text))).alias("token_hash")]


def deduplicate(rows: DataFrame, key: list[str], order: list[str], alias: Column) -> DataFrame:
    """First row of each key by ``order``, with the sorted union of the group's aliases.

    Aliases and the first row are found by one aggregation, which combines on the map side.
    """
    rest = [c for c in rows.columns if c not in key]
    agg = rows.groupBy(*key).agg(
        F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_first"), F.array_sort(F.collect_set(alias)).alias("aliases"), F.count(F.lit(1)).alias("entries")
    )
    return agg.select(*key, *[F.col(f"_first.{c}").alias(c) for c in order if c not in key], *[F.col(f"_first.{c}").alias(c) for c in rest if c not in order], "aliases", "entries")


def attrition(rows: DataFrame, reason: str = "reason_code") -> DataFrame:
    """Rows by reason; null reasons are ``admitted``."""
    return rows.groupBy(F.coalesce(F.col(reason), F.lit("admitted")).alias("reason_code")).agg(F.count(F.lit(1)).alias("n"))


def package_probe(rows: DataFrame, package: str, advisory: str, limit: int | None = None) -> DataFrame:
    """Packages by distinct advisories, ranked by (-count, name); a limit is the report's length."""
    counts = rows.groupBy(F.col(package).alias("package")).agg(F.countDistinct(advisory).alias("advisories"))
    ranked = counts.select("*", F.row_number().over(Window.orderBy(F.desc("advisories"), "package")).alias("rank"))
    return ranked.where(F.col("rank") <= limit) if limit else ranked


def primary_row(rows: DataFrame, group: list[str], order: list[Column | str]) -> DataFrame:
    """The least row of each group by ``order``, found by aggregation."""
    rest = [c for c in rows.columns if c not in group]
    return rows.groupBy(*group).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*group, "_r.*")


def upsert(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows whose key isn't new, and the new rows; null keys match each other."""
    match = [stored[k].eqNullSafe(new[k]) for k in key]
    return stored.join(new, match, "left_anti").unionByName(new, allowMissingColumns=True)
