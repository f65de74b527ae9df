"""Incremental scans: hash trees, change sets, reuse by content, dismissals, project context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKIPPED = r"(^|/)(\.git|node_modules|\.venv|__pycache__)(/|$)"


def file_hashes(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Path and content hash of files outside skipped folders."""
    return files.where(~F.col(path).rlike(SKIPPED)).select(F.col(path).alias("path"), F.sha2(F.col(content).cast("binary"), 256).alias("hash"))


def fold_level(nodes: DataFrame) -> DataFrame:
    """Hashes of the parents of ``path, kind, hash``: lines kind, name, hash, sorted and joined by line feeds."""
    parent = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    line = F.concat_ws("\x00", "kind", F.substring_index("path", "/", -1), "hash")
    return nodes.groupBy(parent.alias("path")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", F.substring_index("path", "/", -1).alias("name"), line.alias("line")))), lambda x: x["line"]), "\n"), 256).alias("hash"))


def merkle(files: DataFrame) -> DataFrame:
    """Hashes of all folders over ``path, hash``; the root has the empty path.

    One grouped fold per level, the deepest first: as many rounds as the tree is deep.
    """
    depth = F.size(F.split("path", "/"))
    nodes = files.select("path", F.lit("file").alias("kind"), "hash", depth.alias("depth"))
    deepest = nodes.agg(F.max("depth")).first()[0]
    spark, out, open_ = files.sparkSession, None, None
    if deepest is None:
        return spark.createDataFrame([("",)], "path string").select("path", F.sha2("path", 256).alias("hash"))
    for d in range(deepest, 0, -1):
        level = nodes.where(F.col("depth") == d).select("path", "kind", "hash")
        if open_ is not None:
            level = level.union(open_.select("path", F.lit("dir").alias("kind"), "hash"))
        open_ = fold_level(level)
        out = open_ if out is None else out.union(open_)
    return out


def changes(before: DataFrame, after: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """Added, changed and deleted keys."""
    a, b = before.select(key, F.col(value).alias("_b")), after.select(key, F.col(value).alias("_a"))
    state = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "deleted").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, key, "full_outer").select(key, state.alias("state")).where("state IS NOT NULL")


def reuse(functions: DataFrame, cached: DataFrame, key: str = "function_hash", fingerprint: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Functions with a cached result of the same content (under the same settings), and the work that is left."""
    if fingerprint is not None:
        cached = cached.where(F.col("fingerprint") == fingerprint)
    return functions.join(cached, key), functions.join(cached.select(key).distinct(), key, "left_anti")


def dismissal_status(dismissals: DataFrame, current: DataFrame) -> DataFrame:
    """Status of each dismissal against the current scan, by the first rule that holds.

    ``dismissals``: id, path, function_id, file_hash, function_hash, signature, dismissed_at.
    ``current``: path, function_id, file_hash, function_hash, signature (null: no finding), scanned.
    A file that has changed reopens its dismissals, whatever became of the function.
    """
    files = current.groupBy("path").agg(F.max("file_hash").alias("f_hash"), F.bool_or("scanned").alias("f_scanned"))
    found = current.select("path", "function_id", F.col("function_hash").alias("c_hash"), F.col("signature").alias("c_signature"))
    rows = dismissals.join(files, "path", "left").join(found, ["path", "function_id"], "left")
    status = (
        F.when(F.col("f_hash").isNull(), "file_missing")
        .when(F.col("f_hash") != F.col("file_hash"), "file_changed")
        .when(~F.coalesce("f_scanned", F.lit(False)), "scan_unavailable")
        .when(F.col("c_hash").isNull() | F.col("c_signature").isNull(), "no_longer_present")
        .when(F.col("c_hash") != F.col("function_hash"), "function_changed")
        .when(F.col("c_signature") != F.col("signature"), "finding_changed")
        .otherwise("dismissed")
    )
    return rows.select("id", "path", "function_id", status.alias("status"), "dismissed_at")


def latest_stale(statuses: DataFrame) -> DataFrame:
    """Per finding place, whether it is dismissed now, else why it was reopened last."""
    agg = statuses.groupBy("path", "function_id").agg(F.bool_or(F.col("status") == "dismissed").alias("dismissed"), F.max_by("status", F.struct("dismissed_at", "id")).alias("last"))
    return agg.select("path", "function_id", F.when(F.col("dismissed"), "dismissed").otherwise("reopened").alias("state"), F.when(~F.col("dismissed"), F.col("last")).alias("reason"))


def reconcile(findings: DataFrame, dismissals: DataFrame, files: DataFrame) -> DataFrame:
    """A saved report's findings with what became of their dismissals, without a new scan.

    ``findings``: path, function_id, function_hash, signature (recomputed in the project as it is; null where the
    finding is no longer active).  ``dismissals``: as for :func:`dismissal_status`.  ``files``: path, file_hash of
    the files as they are, scanned.  Findings that were never dismissed come with a null state.
    """
    here = files.select("path", "file_hash", "scanned").join(findings.select("path", "function_id", "function_hash", "signature"), "path", "left")
    marks = latest_stale(dismissal_status(dismissals, here))
    return findings.join(marks, ["path", "function_id"], "left").select(*findings.columns, "state", "reason")


def signature(*evidence: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*evidence)), 256)


def prefix_match(ids: DataFrame, prefix: str, column: str = "id") -> DataFrame:
    """The row of exactly this id, else the single row that begins with a prefix of eight characters or more."""
    exact = ids.where(F.col(column) == prefix)
    if exact.limit(1).count():
        return exact
    rows = ids.where(F.col(column).startswith(prefix)) if len(prefix) >= 8 else ids.where("false")
    return rows if rows.limit(2).count() == 1 else ids.where("false")


def owning_manifest(files: DataFrame, manifests: DataFrame, path: str = "path", folder: str = "folder") -> DataFrame:
    """Each file's nearest manifest: its folders are exploded and joined by equality, the longest stays."""
    parts = F.split(F.col(path), "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    rows = files.select(path, F.explode(ups).alias(folder)).join(manifests, folder)
    rest = [c for c in manifests.columns if c != folder]
    return rows.groupBy(path).agg(F.max_by(F.struct(folder, *rest), F.length(folder)).alias("m")).select(path, f"m.{folder}", *[F.col(f"m.{c}").alias(c) for c in rest])


def applicability(declared: Column, imported: Column, locked: Column, vendored: Column) -> Column:
    """Confirmed where vendored or declared and in use; declared alone, or not at all, stays unknown."""
    use = F.coalesce(imported, F.lit(False)) | F.coalesce(locked, F.lit(False))
    return F.when(F.coalesce(vendored, F.lit(False)) | (F.coalesce(declared, F.lit(False)) & use), "confirmed").otherwise("unknown")
