"""Command line: scan, report, dismiss, corpus."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import ScanConfig
from .operators.corpus import deduplicate, package_probe
from .operators.state import signature
from .plans.scan import scan, with_applicability
from .sources import reviews, sinks, store
from .sources.landed import REPORT_VERSION, read_jsonl, read_project, read_report, read_tree

ENTRY = "repo string, path string, function string, fix string, vulnerable string, patched string, advisory string, severity string, package string"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pairlens", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan", help="scan a source tree")
    s.add_argument("path")
    s.add_argument("--corpus", required=True)
    s.add_argument("--output", required=True)
    s.add_argument("--top-k", type=int, default=10)
    s.add_argument("--pairs", type=int, default=10)
    s.add_argument("--threshold", type=float, default=0.0)
    r = sub.add_parser("report", help="show a scan")
    r.add_argument("scan")
    r.add_argument("--format", choices=["text", "json", "sarif", "html"], default="text")
    r.add_argument("--include-informational", action="store_true")
    r.add_argument("--include-dismissed", action="store_true")
    r.add_argument("--output")
    d = sub.add_parser("dismiss", help="dismiss a finding, or take it back")
    d.add_argument("scan")
    d.add_argument("finding")
    d.add_argument("--reason", default="")
    d.add_argument("--undo", action="store_true")
    c = sub.add_parser("corpus", help="build, count or probe a corpus")
    c.add_argument("action", choices=["build", "stats", "probe"])
    c.add_argument("--corpus", required=True)
    c.add_argument("--entries")
    c.add_argument("--append", action="store_true")
    c.add_argument("--limit", type=int, default=20)
    return p


def finding_id():
    """A digest of what the decision rests on; other corpus rows don't change it."""
    return signature(*[F.col(c) for c in reviews.IDENTITY])


def with_dismissals(rows, scan_path: str):
    """Findings with ``dismissed`` and the reason, from the file of reviews beside the scan."""
    known = {r["id"]: r["reason"] for r in reviews.load(scan_path)}
    rows = rows.drop("dismissed", "reason")
    if not known:
        return rows.select("*", F.lit(False).alias("dismissed"), F.lit(None).cast("string").alias("reason"))
    reason = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[F.col("finding_id")]
    return rows.select("*", reason.isNotNull().alias("dismissed"), reason.alias("reason"))


def unite(rows):
    """Entries of the same change and package as one, the least advisory first, with all their advisories as aliases."""
    key = ["repo", "path", "function", "fix", "package"]
    each = rows.select(*[f.split()[0] for f in ENTRY.split(", ")], F.explode("aliases").alias("alias"))
    return deduplicate(each, key, ["advisory", "severity", "vulnerable", "patched"], F.col("alias")).drop("alias", "entries")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("pairlens").getOrCreate()
    if a.command == "scan":
        corpus = store.load(spark, a.corpus)
        if corpus is None:
            print("no corpus is published", file=sys.stderr)
            return 2
        config = ScanConfig(hits_per_region=a.top_k, pairs_per_unit=a.pairs, similarity=a.threshold)
        files = read_tree(spark, a.path)
        texts = files.select("path", F.col("content").cast("string").alias("content")).unionByName(read_project(spark, a.path))
        found = with_applicability(scan(files, corpus, config), corpus, texts)
        rows = found.select("*", finding_id().alias("finding_id"), F.lit(False).alias("dismissed"), F.lit(REPORT_VERSION).alias("schema_version"), F.lit(config.fingerprint()).alias("settings"))
        rows.write.mode("overwrite").json(a.output.rstrip("/") + ".new")
        store.replace(spark, a.output.rstrip("/") + ".new", a.output)
        return 0 if rows.isEmpty() else sinks.exit_code(with_dismissals(read_report(spark, a.output), a.output))
    if a.command == "report":
        rows = with_dismissals(read_report(spark, a.scan), a.scan)
        rows = rows if "severity" in rows.columns else rows.withColumn("severity", F.lit("unknown"))
        shown = rows if a.include_informational else rows.where(F.col("priority").isin(sinks.ACTIVE))
        shown = shown if a.include_dismissed else shown.where("NOT dismissed")
        items = [r.asDict(recursive=True) for r in sinks.ordered(shown).toLocalIterator()]
        text = {"text": sinks.compact, "sarif": sinks.sarif, "html": sinks.page, "json": lambda x: json.dumps(x, indent=1)}[a.format](items)
        sinks.write_text(a.output, text) if a.output else print(text)
        return sinks.exit_code(rows)
    if a.command == "dismiss":
        rows = read_report(spark, a.scan)
        found = rows.where(F.col("finding_id").startswith(a.finding)).dropDuplicates(["finding_id"]).limit(2).collect()
        if len(found) != 1 or (len(a.finding) < 8 and found[0]["finding_id"] != a.finding):
            print("no single finding has this id", file=sys.stderr)
            return 2
        try:
            reviews.change(a.scan, found[0].asDict(recursive=True), a.reason, a.undo)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 2
        return 0
    if a.action == "build":
        rows = read_jsonl(spark, a.entries, ENTRY)
        old = store.load(spark, a.corpus) if a.append else None
        rows = rows.withColumn("aliases", F.array("advisory"))
        rows = unite(old.unionByName(rows) if old is not None else rows)
        try:
            print(store.publish(rows, a.corpus))
        except ValueError as e:
            print(e, file=sys.stderr)
            return 2
        return 0
    corpus = store.load(spark, a.corpus)
    if corpus is None:
        return 2
    out = package_probe(corpus, "package", "advisory", max(1, a.limit)) if a.action == "probe" else corpus.groupBy("package").agg(F.count(F.lit(1)).alias("entries"))
    for r in out.orderBy(*out.columns[:1]).toLocalIterator():
        print(*r)
    return 0


if __name__ == "__main__":
    sys.exit(main())
