"""Queries of project evidence, second opinions, rates of a run, and the ablation over kinds of regions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import lineage as L
from ..operators import project as P
from ..operators import regions as R
from .evaluation import OUTCOME_SQL, outcomes
from .registry import Tables, query


@query("""
SELECT DISTINCT source AS unit, lang AS lineage, 'p' || CAST(n_chars % 9 AS VARCHAR) AS package, CASE WHEN doc_id % 3 = 0 THEN 'pypi' ELSE 'npm' END AS ecosystem, 'unknown' AS status
FROM documents WHERE n_chars % 9 > 0""")
def unknown_applicabilities(t: Tables):
    package = F.when(F.col("n_chars") % 9 > 0, F.concat(F.lit("p"), (F.col("n_chars") % 9).cast("string")))
    ecosystem = F.when(F.col("doc_id") % 3 == 0, "pypi").when(F.col("doc_id") % 3 == 1, "")
    return L.unknown_applicabilities(t.documents.select(F.col("source").alias("unit"), F.col("lang").alias("lineage"), package.alias("package"), ecosystem.alias("ecosystem")))


#: A project per source with a manifest per language; every other text imports its language's dependency.
PATH_SQL = "CASE WHEN doc_id % 5 = 0 THEN lang || '/node_modules/dep-' || lang || '/' WHEN doc_id % 7 = 0 THEN 'vendor/gone-' || lang || '/' ELSE lang || '/src/' END || CAST(doc_id AS VARCHAR) || '.js'"
PACKAGE_SQL = "CASE doc_id % 4 WHEN 0 THEN 'dep-' WHEN 1 THEN 'only-' WHEN 2 THEN 'pkg-' ELSE 'gone-' END || lang"


@query(f"""
WITH d AS (SELECT doc_id, source AS project, lang, {PATH_SQL} AS path, {PACKAGE_SQL} AS package FROM documents), u AS (SELECT source AS project, lang FROM documents WHERE n_chars % 2 = 0 AND doc_id % 3 > 0 GROUP BY ALL)
SELECT doc_id, project, path, package, CASE WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 4 = 0 THEN 'confirmed' ELSE 'conflicting' END WHEN doc_id % 4 = 2 AND doc_id % 7 > 0 THEN 'confirmed' WHEN doc_id % 7 = 0 AND doc_id % 4 = 3 THEN 'confirmed' WHEN doc_id % 4 = 0 AND u.lang IS NOT NULL THEN 'confirmed' ELSE 'unknown' END AS status,
  CASE WHEN doc_id % 5 = 0 OR (doc_id % 4 = 2 AND doc_id % 7 > 0) THEN 'package_ownership' WHEN doc_id % 7 = 0 AND doc_id % 4 = 3 THEN 'vendored_path' WHEN doc_id % 4 = 0 AND u.lang IS NOT NULL THEN 'resolved_dependency' WHEN doc_id % 4 < 2 THEN 'manifest_declaration' END AS kind
FROM d LEFT JOIN u USING (project, lang)""")
def project_evidence(t: Tables):
    d = t.documents.select("doc_id", F.col("source").alias("project"), "lang", F.expr(PATH_SQL.replace("VARCHAR", "STRING")).alias("path"), F.expr(PACKAGE_SQL).alias("package"), "n_chars")
    call = F.when((F.col("n_chars") % 2 == 0) & (F.col("doc_id") % 3 > 0), F.concat(F.lit("const a = require( 'dep-"), "lang", F.lit("/x'); import './b';"))).otherwise("import b from './b'")
    manifest = F.to_json(F.struct(F.concat(F.lit("pkg-"), "lang").alias("name"), F.map_from_arrays(F.array(F.concat(F.lit("dep-"), "lang"), F.concat(F.lit("only-"), "lang")), F.array(F.lit("^1"), F.lit("2"))).alias("dependencies")))
    files = d.select("project", "path", call.alias("content")).unionByName(d.select("project", "lang").distinct().select("project", F.concat("lang", F.lit("/package.json")).alias("path"), manifest.alias("content")))
    return P.assess(d.select("doc_id", "project", "path", "package"), files).select("doc_id", "project", "path", "package", "status", "kind")


@query(OUTCOME_SQL + """
, q AS (SELECT *, CASE WHEN n_chars % 4 = 0 THEN 'vulnerable' WHEN n_chars % 4 = 1 THEN 'patched' WHEN n_chars % 4 = 2 THEN 'abstained' END AS opinion FROM o JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id))
SELECT lang, count(opinion) AS opinions, count(*) FILTER (WHERE opinion IN ('vulnerable', 'patched')) AS decided, count(*) FILTER (WHERE opinion = 'abstained') AS abstained,
  round(count(*) FILTER (WHERE (opinion = 'vulnerable' AND expected = 'flagged') OR (opinion = 'patched' AND expected = 'cleared')) / nullif(count(*) FILTER (WHERE opinion IN ('vulnerable', 'patched')), 0), 6) AS accuracy,
  CASE WHEN count(opinion) > 0 THEN round(count(*) FILTER (WHERE expected = 'flagged' AND (outcome = 'true_positive' OR coalesce(opinion = 'vulnerable', FALSE))) / nullif(count(*) FILTER (WHERE expected = 'flagged'), 0), 6) END AS adjusted_recall
FROM q GROUP BY lang""")
def opinion_metrics(t: Tables):
    c = F.col("n_chars") % 4
    rows = outcomes(t).join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return E.opinion_metrics(rows.withColumn("opinion", F.when(c == 0, "vulnerable").when(c == 1, "patched").when(c == 2, "abstained")), ["lang"])


def _measure(name: str, of: str, flag: str) -> str:
    return f"SELECT '{name}' AS measure, count(*) FILTER (WHERE {of} AND {flag}) AS n, count(*) FILTER (WHERE {of}) AS cases FROM f"


RATES = [
    ("found", "TRUE", "found"), ("visible", "TRUE", "visible"), ("abstained", "TRUE", "abstained"),
    ("correct", "toxic = 1", "correct"), ("correct_decided", "toxic = 1 AND NOT abstained", "correct"), ("correct_of_all", "TRUE", "correct"),
    ("false_alarm", "toxic = 0", "alarm"), ("false_alarm_decided", "toxic = 0 AND NOT abstained", "alarm"), ("false_alarm_of_all", "TRUE", "alarm"),
    ("found_by_hash", "by_hash", "found"), ("found_otherwise", "NOT by_hash", "found"),
]


@query(f"""
WITH f AS (SELECT toxic, n_chars % 3 > 0 AS found, n_chars % 4 > 0 AS visible, doc_id % 6 = 0 AS abstained, doc_id % 5 = 0 AS by_hash, toxic = 1 AND n_chars % 7 > 2 AS correct, toxic = 0 AND n_chars % 11 = 0 AS alarm FROM documents JOIN labels USING (doc_id))
SELECT *, round(n / nullif(cases, 0), 6) AS rate FROM ({' UNION ALL '.join(_measure(*r) for r in RATES)})""")
def origin_rates(t: Tables):
    c, k, toxic = F.col("n_chars"), F.col("doc_id"), F.col("toxic") == 1
    rows = t.documents.join(t.labels, "doc_id").select(
        F.when(toxic, "flagged").otherwise("cleared").alias("expected"), (c % 3 > 0).alias("found"), (c % 4 > 0).alias("visible"), (k % 6 == 0).alias("abstained"), (k % 5 == 0).alias("by_hash"), (toxic & (c % 7 > 2)).alias("correct"), (~toxic & (c % 11 == 0)).alias("false_alarm")
    )
    return E.origin_rates(rows, ["visible"])


@query(r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS target, unnest(string_split(text, chr(10))) AS body FROM documents),
r AS (SELECT doc_id, target, unnest(CASE WHEN body LIKE '%.%' THEN ['changed', 'block', 'context'] ELSE ['changed'] END) AS granularity FROM l UNION ALL SELECT doc_id, 1000000000, 'function' FROM documents),
a AS (SELECT * FROM (VALUES ('all_types', ['changed', 'block', 'context', 'function'], 6), ('no_changed', ['block', 'context', 'function'], 6), ('no_block', ['changed', 'context', 'function'], 6), ('no_context', ['changed', 'block', 'function'], 6), ('no_function', ['changed', 'block', 'context'], 7), ('function_only', ['function'], 6)) v(arm, kinds, cap)),
n AS (SELECT *, row_number() OVER (PARTITION BY arm, doc_id ORDER BY target, granularity) AS n FROM r JOIN a ON list_contains(kinds, granularity)),
b AS (SELECT *, coalesce(max(n) OVER (PARTITION BY arm, doc_id ORDER BY target RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT arm, granularity, count(*) AS kept, count(DISTINCT doc_id) AS units FROM b WHERE before < cap - 1 AND n <= 6 GROUP BY ALL""")
def region_type_ablation(t: Tables):
    l = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "body"))
    kinds = F.when(F.contains("body", F.lit(".")), F.array(F.lit("changed"), F.lit("block"), F.lit("context"))).otherwise(F.array(F.lit("changed")))
    r = l.select("doc_id", (F.col("p") + 1).alias("target"), F.explode(kinds).alias("granularity")).unionByName(t.documents.select("doc_id", F.lit(1_000_000_000).alias("target"), F.lit("function").alias("granularity")))
    arms = [R.arm_regions(r, arm, "doc_id", "target", ["target", "granularity"], 6).select(F.lit(arm).alias("arm"), "doc_id", "granularity") for arm in R.ARMS]
    return reduce(lambda a, b: a.unionByName(b), arms).groupBy("arm", "granularity").agg(F.count(F.lit(1)).alias("kept"), F.countDistinct("doc_id").alias("units"))
