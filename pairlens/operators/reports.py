"""Report projections, tool adapters and review policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cwe
from .evaluation import share


def ranked_boundaries(states: DataFrame, unit: str = "unit") -> DataFrame:
    """States of a unit in report order: vulnerable, uncertain, patched; then score, support, boundary."""
    place = F.when(F.col("status") == "vulnerable", 0).when(F.col("status") == "uncertain", 1).otherwise(2)
    return states.select("*", F.row_number().over(Window.partitionBy(unit).orderBy(place, F.desc("score"), F.desc("support"), "boundary")).alias("place"))


def primary_observation(rows: DataFrame, group: list[str]) -> DataFrame:
    """Per group the observation with the least (rank, -similarity, granularity, region)."""
    rest = [c for c in rows.columns if c not in group]
    return rows.groupBy(*group).agg(F.min_by(F.struct(*rest), F.struct("rank", -F.col("similarity"), "granularity", "region")).alias("o")).select(*group, "o.*")


def reason_text(status: Column, reason: Column, route: Column) -> Column:
    """A sentence for a verdict."""
    return (
        F.when((status == "vulnerable") & (route == "hash"), "The function equals the version before the fix.")
        .when((status == "patched") & (route == "hash"), "The function equals the version after the fix.")
        .when(status == "vulnerable", "The function is closest to the version before the fix.")
        .when(status == "patched", "The function is closest to the version after the fix.")
        .when(reason == "CONTRADICTORY_EVIDENCE", "Both versions match alike.")
        .when(reason == "HASH_SIDE_AMBIGUOUS", "Both versions match once names are set aside.")
        .when(reason.isin("S_FAILED", "T_FAILED"), "The function is related, but too different to decide.")
        .otherwise("The evidence doesn't decide between the versions.")
    )


def distinct_advisories(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each advisory identity."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def final_metrics(rows: DataFrame) -> DataFrame:
    """Second opinions by attention tier: how many of each, and the share that stays flagged."""
    return rows.groupBy("priority").agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.col("opinion") == "flagged").alias("flagged"), F.count_if(F.col("opinion") == "dismissed").alias("dismissed"), share(F.count_if(F.col("opinion") == "flagged"), F.count(F.col("opinion"))).alias("flagged_share"))


def triage(priority: Column, opinion: Column) -> Column:
    """A review that a second opinion flags becomes automatic, one that it dismisses none."""
    return F.when((priority == "manual_review") & (opinion == "flagged"), "automatic_vulnerability").when((priority == "manual_review") & (opinion == "dismissed"), "none").otherwise(priority)


def review_contributors(states: DataFrame, unit: str = "unit") -> DataFrame:
    """Boundaries that force a review: the strong ones, or where there is none the unresolved ones."""
    agg = states.groupBy(unit).agg(F.collect_set(F.when(F.col("strong"), F.col("boundary"))).alias("s"), F.collect_set(F.when(F.col("unresolved"), F.col("boundary"))).alias("u"))
    return agg.select(unit, F.array_sort(F.when(F.size("s") > 0, F.col("s")).otherwise(F.col("u"))).alias("boundaries")).where(F.size("boundaries") > 0)


def named_anchor_priority(baseline: Column, named: Column, side: Column, threshold: float = 0.90) -> Column:
    """A review is kept only where a named anchor reaches the side threshold."""
    keep = F.coalesce(named & (side >= threshold), F.lit(False))
    return F.when((baseline == "manual_review") & ~keep, "informational_lineage").otherwise(baseline)


def relation(own: Column, other: Column, names_conflict: Column) -> Column:
    """How a unit's boundary relates to a confirmed one: by component, else by names."""
    return F.when(own.isNotNull() & (own == other), "connected_revision").when(F.coalesce(names_conflict, F.lit(False)), "identity_incompatible").otherwise("unknown")


def screen(*checks: tuple[Column, str]) -> Column:
    """All reasons that hold, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(r)) for c, r in checks]), lambda x: x.isNotNull())


def excluded_boundaries(boundaries: DataFrame, scanned: DataFrame) -> DataFrame:
    """Boundaries whose vulnerable hash wasn't scanned while the patched one was: columns plus ``excluded``."""
    seen = scanned.select("hash").distinct()
    v = boundaries.join(seen.withColumnRenamed("hash", "vulnerable_hash").withColumn("_v", F.lit(True)), "vulnerable_hash", "left")
    p = v.join(seen.withColumnRenamed("hash", "patched_hash").withColumn("_p", F.lit(True)), "patched_hash", "left")
    return p.select(*boundaries.columns, (F.col("_v").isNull() & F.col("_p").isNotNull()).alias("excluded"))


def target_match(path_equal: Column, known_sha: Column, sha: Column, known_name: Column, name: Column) -> Column:
    """Whether a unit is the target: the path, then its digest where known, else its name where known, else any."""
    return path_equal & F.when(known_sha.isNotNull(), known_sha == sha).when(known_name.isNotNull(), known_name == name).otherwise(F.lit(True))


def installed_package(path: Column) -> Column:
    """Package of a file below ``node_modules``: what follows the last one, with its scope; null elsewhere."""
    after = F.regexp_extract(path, r"^(?:.*/)?node_modules/((?:@[^/]+/)?[^/]+)/", 1)
    return F.nullif(after, F.lit(""))


#: One schema of findings for all tools.
FINDING = ["tool", "path", "start_line", "end_line", "rule_id", "message", "severity", "cwes"]
_SEMGREP = "results array<struct<path:string,check_id:string,start:struct<line:int>,end:struct<line:int>,extra:struct<message:string,severity:string,metadata:struct<cwe:array<string>>>>>"
_SARIF = "runs array<struct<results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,endLine:int>>>>>>>>"


def adapt(reports: DataFrame, tool: str, body: str = "body") -> DataFrame:
    """Findings of a tool's JSON reports in the common schema; null or broken reports give none."""
    codes = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), cwe), lambda x: x.isNotNull())
    if tool == "semgrep":
        r = reports.select(F.explode(F.from_json(body, _SEMGREP)["results"]).alias("r"))
        cols = [F.col("r.path"), F.col("r.start.line"), F.col("r.end.line"), F.col("r.check_id"), F.col("r.extra.message"), F.lower("r.extra.severity"), codes(F.col("r.extra.metadata.cwe"))]
    elif tool in ("codeql", "sarif"):
        r = reports.select(F.explode(F.flatten(F.transform(F.from_json(body, _SARIF)["runs"], lambda x: x["results"]))).alias("r")).select("r", F.get(F.col("r.locations"), F.lit(0))["physicalLocation"].alias("l"))
        cols = [F.col("l.artifactLocation.uri"), F.col("l.region.startLine"), F.coalesce("l.region.endLine", "l.region.startLine"), F.col("r.ruleId"), F.col("r.message.text"), F.col("r.level"), codes(F.array("r.ruleId"))]
    else:
        raise ValueError(f"no adapter for {tool}")
    return r.select(F.lit(tool).alias("tool"), *[c.alias(n) for c, n in zip(cols, FINDING[1:])])


def nested_ids(json_text: Column, name: str = "ghsa_id") -> Column:
    """All values of a key at any depth of a JSON text, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(json_text, F.lit(rf'"{name}"\s*:\s*"([^"]*)"'), F.lit(1))))


def seal(rows: Column) -> Column:
    """Digest of a value's JSON, to be kept beside it."""
    return F.sha2(F.to_json(rows), 256)
