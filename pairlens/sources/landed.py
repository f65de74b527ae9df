"""Readers of landed files: advisories, source trees, artifacts, reports.

Network sources are landed as files first; the readers are lazy and prune columns and files.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SOURCE_FILE, repository
from ..operators.batches import flat_map
from ..operators.state import SKIPPED

REPORT_VERSION = "pairlens_scan_v1"
ADVISORY = (
    "ghsa_id string, cve_id string, summary string, description string, severity string, withdrawn_at string, references array<string>, cwes array<struct<cwe_id:string,name:string>>, "
    "vulnerabilities array<struct<package_ecosystem:string,package_name:string,vulnerable_version_range:string,first_patched_version:string>>"
)
OSV = "id string, aliases array<string>, affected array<struct<package:struct<name:string,ecosystem:string>,ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>,versions:array<string>>>"
COMMIT = "sha string, parent_shas array<string>, files array<struct<filename:string,status:string,additions:int,deletions:int,patch:string,previous_filename:string>>"

BLOB = "repo string, sha string, encoding string, content string"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines cut at line feeds alone: other line separators inside values are data."""
    return spark.read.schema(schema).option("lineSep", "\n").json(path)


def read_advisories(spark: SparkSession, path: str, ecosystem: str | None = None, affects: str | None = None, ghsa_id: str | None = None) -> DataFrame:
    """Advisories in force, one row per affected package."""
    rows = read_jsonl(spark, path, ADVISORY).where("withdrawn_at IS NULL")
    if ghsa_id:
        rows = rows.where(F.col("ghsa_id") == ghsa_id)
    rows = rows.select("*", F.explode("vulnerabilities").alias("v")).select("ghsa_id", "cve_id", "summary", "severity", "references", "cwes", F.col("v.package_name").alias("package"), F.col("v.package_ecosystem").alias("ecosystem"), F.col("v.vulnerable_version_range").alias("affected_range"), F.col("v.first_patched_version").alias("fixed_version"))
    if ecosystem:
        rows = rows.where(F.col("ecosystem") == ecosystem)
    return rows.where(F.col("package") == affects) if affects else rows


def read_osv(spark: SparkSession, path: str) -> DataFrame:
    """OSV entries by alias and package: first introduced and fixed events, and all versions."""
    rows = read_jsonl(spark, path, OSV).select("id", F.explode("aliases").alias("ghsa_alias"), "affected").select("id", "ghsa_alias", F.explode("affected").alias("a"))
    events = F.flatten(F.flatten(F.array(F.transform("a.ranges", lambda r: r["events"]))))
    first = lambda name: F.get(F.filter(F.transform(events, lambda e: e[name]), lambda x: x.isNotNull()), F.lit(0))
    return rows.select("id", "ghsa_alias", F.col("a.package.name").alias("package"), F.col("a.package.ecosystem").alias("ecosystem"), first("introduced").alias("introduced"), first("fixed").alias("fixed"), F.coalesce("a.versions", F.array().cast("array<string>")).alias("versions"))


def read_contents(spark: SparkSession, path: str, blobs: str | None = None) -> DataFrame:
    """Texts of files at a commit: ``repo, path, ref, content, problem``.

    A file that isn't there (404) has null content.  One without inline content (too large for it) takes the
    landed blob of its digest.  Everything else that is no base64 of UTF-8 has a problem in place of content.
    """
    rows = read_jsonl(spark, path, "repo string, path string, ref string, status int, encoding string, content string, sha string")
    big = read_jsonl(spark, blobs, BLOB) if blobs else spark.createDataFrame([], BLOB)
    big = big.groupBy("repo", "sha").agg(F.max(F.when(F.col("encoding") == "base64", F.col("content"))).alias("blob"))
    rows = rows.join(big, ["repo", "sha"], "left")
    inline = F.coalesce(F.col("encoding") == "base64", F.lit(False))
    body = F.when(inline, F.col("content")).when(F.col("encoding") == "none", F.col("blob"))
    data = F.try_to_binary(F.regexp_replace(body, r"\s", ""), F.lit("base64"))
    gone = F.coalesce(F.col("status") == 404, F.lit(False))
    text = F.when(~gone & F.is_valid_utf8(data.cast("string")), data.cast("string"))
    problem = (
        F.when(gone, None)
        .when(~inline & ~F.coalesce(F.col("encoding") == "none", F.lit(False)), "unexpected_encoding")
        .when(body.isNull(), "blob_missing")
        .when(text.isNull(), "not_utf8")
    )
    return rows.select("repo", "path", "ref", text.alias("content"), problem.alias("problem"))


def read_releases(spark: SparkSession, path: str) -> DataFrame:
    """Landed package metadata, one row per version: ``package, repo, version, tarball, git_head, missing``.

    A line is a response: package, status, body.  A package that isn't known (404) has one row with ``missing``.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select(F.try_parse_json("value").alias("r"))
    get = lambda c, at, kind="string": F.try_variant_get(c, at, kind)
    address = F.coalesce(get("r", "$.body.repository.url"), get("r", "$.body.repository"))
    rows = rows.select(get("r", "$.package").alias("package"), repository(address).alias("repo"), (F.coalesce(get("r", "$.status", "int"), F.lit(200)) == 404).alias("missing"), get("r", "$.body.versions", "map<string,variant>").alias("m"))
    rows = rows.where("package IS NOT NULL").select("package", "repo", "missing", F.explode_outer(F.when(~F.col("missing"), F.map_entries("m"))).alias("e"))
    return rows.select("package", "repo", F.col("e.key").alias("version"), get("e.value", "$.dist.tarball").alias("tarball"), get("e.value", "$.gitHead").alias("git_head"), "missing")


def read_dependents(spark: SparkSession, path: str) -> DataFrame:
    """Landed registry scores: ``package, dependents``; 0 where the count isn't given."""
    rows = spark.read.option("lineSep", "\n").text(path).select(F.try_parse_json("value").alias("r"))
    count = F.try_variant_get("r", "$.body.collected.npm.dependentsCount", "long")
    return rows.select(F.try_variant_get("r", "$.package", "string").alias("package"), F.coalesce(count, F.lit(0)).alias("dependents")).where("package IS NOT NULL")


def osv_query(commit: str | None = None, package: str | None = None, ecosystem: str | None = None, version: str | None = None) -> dict:
    """A query by commit, or by package, ecosystem and version; anything else is an error."""
    named = (package, ecosystem, version)
    if commit and not any(named):
        return {"commit": commit}
    if not commit and all(named):
        return {"package": {"name": package, "ecosystem": ecosystem}, "version": version}
    raise ValueError("ask by commit alone, or by package, ecosystem and version")


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    rows = read_jsonl(spark, path, COMMIT)
    return rows.select("sha", F.size("parent_shas").alias("parents"), F.explode("files").alias("f")).select("sha", "parents", F.col("f.filename").alias("path"), "f.status", (F.col("f.additions") + F.col("f.deletions")).alias("changed_lines"), "f.patch", "f.previous_filename")


def _inside(root: str) -> Column:
    return F.regexp_replace("path", "^.*?" + root.rstrip("/").replace("\\", "/").replace(".", r"\.") + "/", "")


def read_project(spark: SparkSession, path: str) -> DataFrame:
    """Manifests and lock files under a folder, installed packages' own ones included: ``path, content`` as text."""
    names = "{package.json,package-lock.json,yarn.lock,pnpm-lock.yaml}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(path)
    return files.select(_inside(path).alias("path"), F.col("content").cast("string").alias("content"))


def read_tree(spark: SparkSession, path: str, max_bytes: int = 1_000_000, limit: int | None = None, required: list[str] | None = None) -> DataFrame:
    """Source files under a folder: path inside it, content, size.

    Folders of dependencies and tools, other extensions and large files are left out, unless
    required.  ``limit`` keeps that many files by the digest of their path, required ones first;
    it is the caller's bound on a tree, not a guard against size.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select(_inside(path).alias("path"), F.col("length").alias("bytes"), "content")
    wanted = F.col("path").isin(required or [])
    rows = rows.where(wanted | (F.lower("path").rlike(SOURCE_FILE) & ~F.col("path").rlike(SKIPPED) & (F.col("bytes") <= max_bytes)))
    if limit is None:
        return rows
    return rows.orderBy(F.desc(wanted), F.sha2("path", 256)).limit(max(limit, len(required or [])))


def read_verified(spark: SparkSession, path: str, digests: DataFrame) -> DataFrame:
    """Artifacts whose content has its recorded digest: ``digests(name, sha256)``; others come with ``ok`` false and no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select(F.substring_index("path", "/", -1).alias("name"), "content", F.sha2("content", 256).alias("found"))
    rows = rows.join(digests, "name", "left").withColumn("ok", F.coalesce(F.col("found") == F.col("sha256"), F.lit(False)))
    return rows.select("name", "found", "ok", F.when(F.col("ok"), F.col("content")).alias("content"))


def extract_tars(artifacts: DataFrame, max_members: int = 50_000, max_bytes: int = 512 * 1024 * 1024) -> DataFrame:
    """Members of gzip tar files: plain files at relative paths inside.  An archive that breaks a rule gives one row with its problem."""

    def run(r: dict) -> list[dict]:
        import io
        import tarfile

        name, content, rows, total = r["name"], r["content"], [], 0
        try:
            if content is None:
                raise ValueError("no content")
            with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as tar:
                for n, m in enumerate(tar):
                    if n >= max_members:
                        raise ValueError("too many members")
                    if m.name.startswith("/") or ".." in m.name.split("/"):
                        raise ValueError("unsafe path")
                    if m.isdir():
                        continue
                    if not m.isfile():
                        raise ValueError("not a plain file")
                    total += m.size
                    if total > max_bytes:
                        raise ValueError("too large")
                    rows.append({"archive": name, "path": m.name, "content": tar.extractfile(m).read()})
        except (ValueError, OSError, EOFError, tarfile.TarError) as e:
            return [{"archive": name, "problem": str(e) or type(e).__name__}]
        return rows

    return flat_map(artifacts.select("name", "content"), run, "archive string, path string, content binary, problem string", rows=1)


def prune_artifact(files: DataFrame, archive: str = "archive") -> DataFrame:
    """Library sources of an artifact: no tests or docs, built folders only where there is no src or lib, no generated files."""
    text = F.col("content").cast("string")
    rows = files.where(F.lower("path").rlike(SOURCE_FILE) & ~F.lower("path").rlike(r"(^|/)(test|tests|docs?|examples?|benchmarks?)/|\.min\.|\.d\.ts$"))
    rows = rows.where(F.array_max(F.transform(F.split(text, "\n"), F.length)) <= 2000)
    sources = files.where(F.col("path").rlike("(^|/)(src|lib)/")).select(archive).distinct().withColumn("_src", F.lit(True))
    return rows.join(sources, archive, "left").where(~(F.col("path").rlike("(^|/)(dist|build|out)/") & F.col("_src").isNotNull())).drop("_src")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A scan report; one of another version is an error."""
    rows = spark.read.json(path, lineSep="\n")
    versions = [r[0] for r in rows.select("schema_version").distinct().limit(2).collect()] if "schema_version" in rows.columns else []
    if versions != [REPORT_VERSION]:
        raise ValueError(f"report version {versions}, not {REPORT_VERSION}")
    return rows


def with_retries(call: Callable, transient: tuple = (ConnectionError, TimeoutError), attempts: int = 5, longest: float = 30.0, sleep: Callable = time.sleep):
    """Call again after transient failures, waiting twice as long each time, up to ``longest`` seconds."""
    for n in range(attempts):
        try:
            return call()
        except transient:
            if n == attempts - 1:
                raise
            sleep(min(longest, 2.0**n))
