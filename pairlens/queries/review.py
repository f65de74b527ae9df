"""Queries of reports, policies and selection over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extraction as X
from ..operators import reports as P
from ..operators import selection as S
from ..operators import verdicts as V
from .detection import STATE_SQL, states
from .evaluation import outcomes
from .registry import Tables, query


@query("""
WITH c AS (SELECT doc_id, lang, CASE WHEN n_chars % 7 = 0 THEN 'manual_review' WHEN (toxic = 1) <> (n_chars % 5 = 0) THEN 'automatic_vulnerability' ELSE 'informational_lineage' END AS priority,
  CASE WHEN doc_id % 3 = 0 THEN 'flagged' WHEN doc_id % 3 = 1 THEN 'dismissed' END AS opinion FROM documents JOIN labels USING (doc_id))
SELECT CASE WHEN priority = 'manual_review' AND opinion = 'flagged' THEN 'automatic_vulnerability' WHEN priority = 'manual_review' AND opinion = 'dismissed' THEN 'none' ELSE priority END AS priority, count(*) AS n FROM c GROUP BY 1""")
def triage_projection(t: Tables):
    k = F.col("doc_id") % 3
    rows = outcomes(t).withColumn("opinion", F.when(k == 0, "flagged").when(k == 1, "dismissed"))
    return rows.groupBy(P.triage(F.col("priority"), F.col("opinion")).alias("priority")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH c AS (SELECT doc_id, CASE WHEN n_chars % 7 = 0 THEN 'manual_review' WHEN (toxic = 1) <> (n_chars % 5 = 0) THEN 'automatic_vulnerability' ELSE 'informational_lineage' END AS priority,
  CASE WHEN doc_id % 3 = 0 THEN 'flagged' WHEN doc_id % 3 = 1 THEN 'dismissed' END AS opinion FROM documents JOIN labels USING (doc_id))
SELECT priority, count(*) AS findings, count(*) FILTER (WHERE opinion = 'flagged') AS flagged, count(*) FILTER (WHERE opinion = 'dismissed') AS dismissed, round(count(*) FILTER (WHERE opinion = 'flagged') / nullif(count(opinion), 0), 6) AS flagged_share FROM c GROUP BY priority""")
def final_metrics(t: Tables):
    k = F.col("doc_id") % 3
    return P.final_metrics(outcomes(t).withColumn("opinion", F.when(k == 0, "flagged").when(k == 1, "dismissed")))


@query(f"""
WITH s AS (SELECT label AS unit, vec_id AS boundary, coalesce(abstention_reason = 'CONTRASTIVE_CONFLICT', FALSE) AS strong, coalesce(abstention_reason = 'E_NOT_RUN', FALSE) AS unresolved FROM ({STATE_SQL}) JOIN embeddings USING (vec_id)),
a AS (SELECT unit, list_sort(list(DISTINCT boundary) FILTER (WHERE strong)) AS s, list_sort(list(DISTINCT boundary) FILTER (WHERE unresolved)) AS u FROM s GROUP BY unit)
SELECT unit, array_to_string(CASE WHEN len(s) > 0 THEN s ELSE u END, ',') AS boundaries FROM a WHERE len(coalesce(s, u)) > 0""")
def review_contributors(t: Tables):
    r = F.col("abstention_reason")
    rows = states(t).select(F.col("label").alias("unit"), F.col("vec_id").alias("boundary"), F.coalesce(r == "CONTRASTIVE_CONFLICT", F.lit(False)).alias("strong"), F.coalesce(r == "E_NOT_RUN", F.lit(False)).alias("unresolved"))
    return P.review_contributors(rows).select("unit", F.array_join(F.transform("boundaries", lambda b: b.cast("string")), ",").alias("boundaries"))


@query("""
WITH r AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'manual_review' WHEN 'O' THEN 'automatic_vulnerability' ELSE 'none' END AS baseline, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 > 1 END AS named, CAST(o_orderkey % 11 AS DOUBLE) / 10 AS side FROM orders),
p AS (SELECT *, CASE WHEN baseline = 'manual_review' AND NOT coalesce(named AND side >= 0.9, FALSE) THEN 'informational_lineage' ELSE baseline END AS priority FROM r)
SELECT baseline, priority, count(*) AS n FROM p GROUP BY ALL""")
def experimental_priority(t: Tables):
    k = F.col("o_orderkey")
    base = F.when(F.col("o_orderstatus") == "F", "manual_review").when(F.col("o_orderstatus") == "O", "automatic_vulnerability").otherwise("none")
    rows = t.orders.select(base.alias("baseline"), F.when(k % 4 > 0, k % 4 > 1).alias("named"), (k % 11 / 10.0).alias("side"))
    return rows.groupBy("baseline", P.named_anchor_priority(F.col("baseline"), F.col("named"), F.col("side")).alias("priority")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH r AS (SELECT CASE WHEN event_id % 5 > 0 THEN event_id % 3 END AS own, event_id % 4 AS other, event_type = 'click' AS conflict, event_id % 7 = 0 AS by_hash, event_type IN ('view', 'click') AS protected, event_id % 2 = 0 AS alternative FROM events),
s AS (SELECT *, CASE WHEN own = other THEN 'connected_revision' WHEN conflict THEN 'identity_incompatible' ELSE 'unknown' END AS relation FROM r)
SELECT relation, CASE WHEN by_hash THEN 'automatic_vulnerability' WHEN protected THEN 'manual_review' WHEN alternative AND relation <> 'identity_incompatible' THEN 'manual_review' ELSE 'informational_lineage' END AS priority, count(*) AS n FROM s GROUP BY ALL""")
def revision_priority(t: Tables):
    k, e = F.col("event_id"), F.col("event_type")
    rows = t.events.select(
        P.relation(F.when(k % 5 > 0, k % 3), k % 4, e == "click").alias("relation"), F.lit("automatic_vulnerability").alias("baseline"), (k % 7 == 0).alias("by_hash"), F.lit("patched").alias("status"), e.isin("view", "click").alias("protected_conflict"), (k % 2 == 0).alias("relevant_alternative")
    )
    return rows.groupBy("relation", V.revision_priority(rows).alias("priority")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH d AS (SELECT doc_id, sha256(text) AS v, sha256(lower(text)) AS p FROM documents), s AS (SELECT DISTINCT sha256(lower(text)) AS h FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id, v NOT IN (SELECT h FROM s) AND p IN (SELECT h FROM s) AS excluded FROM d""")
def boundary_exclusion(t: Tables):
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("vulnerable_hash"), F.sha2(F.lower("text"), 256).alias("patched_hash"))
    return P.excluded_boundaries(d, d.where("doc_id % 2 = 0").select(F.col("patched_hash").alias("hash"))).select("doc_id", "excluded")


@query("""
SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'language' END, CASE WHEN text LIKE '%###%' THEN 'parse' END, CASE WHEN doc_id % 5 = 0 THEN 'identity' END], lambda x: x IS NOT NULL), ',') AS reasons FROM documents""")
def screen_reasons(t: Tables):
    r = P.screen((F.col("n_chars") < 200, "short"), (F.col("lang") != "en", "language"), (F.contains("text", F.lit("###")), "parse"), (F.col("doc_id") % 5 == 0, "identity"))
    return t.documents.select("doc_id", F.array_join(r, ",").alias("reasons"))


@query(r"""
WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'a/node_modules/@s/' || CAST(page_id % 7 AS VARCHAR) || '/lib/x.js' WHEN page_id % 3 = 1 THEN 'node_modules/q' || CAST(page_id % 5 AS VARCHAR) || '/node_modules/r/x.js' ELSE 'src/x.js' END AS path FROM pages)
SELECT nullif(regexp_extract(path, '^(?:.*/)?node_modules/((?:@[^/]+/)?[^/]+)/', 1), '') AS package, count(*) AS n FROM p GROUP BY 1""")
def installed_package(t: Tables):
    k = F.col("page_id")
    path = F.when(k % 3 == 0, F.concat(F.lit("a/node_modules/@s/"), (k % 7).cast("string"), F.lit("/lib/x.js"))).when(k % 3 == 1, F.concat(F.lit("node_modules/q"), (k % 5).cast("string"), F.lit("/node_modules/r/x.js"))).otherwise("src/x.js")
    return t.pages.groupBy(P.installed_package(path).alias("package")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH s AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS turn FROM documents)
SELECT doc_id, lang, source, CAST(turn AS INT) AS turn FROM s ORDER BY turn, lang, source, doc_id LIMIT 100""")
def pilot_sample(t: Tables):
    return S.pilot(t.documents.select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 100)


@query(r"""
WITH d AS (SELECT doc_id, lang, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h FROM documents), g AS (SELECT lang, h, min(doc_id) AS root FROM d GROUP BY ALL)
SELECT doc_id, root AS "group" FROM d JOIN g USING (lang, h)""")
def leakage_groups(t: Tables):
    token = F.sha2(F.concat_ws("|", "lang", F.trim(F.regexp_replace("text", r"\s+", " "))), 256)
    return S.leakage_groups(t.documents.select("doc_id", F.array(token, F.concat(F.lit("own-"), F.col("doc_id").cast("string"))).alias("tokens")), "doc_id")


LIMITS = [(s, e, m) for s in (0.6, 0.7, 0.8) for e in (0.85, 0.9) for m in (0.05, 0.1)]


@query(" UNION ALL ".join(
    f"SELECT CAST({s} AS DOUBLE) AS structure, CAST({e} AS DOUBLE) AS edit_side, CAST({m} AS DOUBLE) AS edit_margin, status, count(*) AS n FROM ({STATE_SQL.replace('>= 0.7', f'>= {s}').replace('>= 0.9', f'>= {e}').replace('< 0.9', f'< {e}').replace('>= 0.1', f'>= {m}').replace('<= -0.1', f'<= -{m}').replace('< 0.1', f'< {m}')}) GROUP BY status"
    for s, e, m in LIMITS
))
def decision_ablation(t: Tables):
    """Saved evidence classified again under each of the few settings."""
    out = None
    kept = states(t).drop("status", "abstention_reason", "edit_strategy", "contrast")
    for s, e, m in LIMITS:
        rows = V.classify(kept, V.Thresholds(structure=s, token=s, edit_side=e, edit_margin=m)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
        rows = rows.select(F.lit(s).alias("structure"), F.lit(e).alias("edit_side"), F.lit(m).alias("edit_margin"), "status", "n")
        out = rows if out is None else out.union(rows)
    return out


@query(r"""
WITH j AS (SELECT event_id, props FROM events) SELECT CAST(json_extract(props, '$.k') AS INT) AS k, count(*) AS n FROM j GROUP BY 1""")
def tool_adapter(t: Tables):
    """JSON reports projected by a stated schema."""
    return t.events.groupBy(F.from_json("props", "k int")["k"].alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query()
def commit_pairs(t: Tables):
    """Pairs taken from the sample fixes, as if each were a commit."""
    import difflib

    from ..functions.samples import PAIRS

    rows = [(name, f"src/{name}.js", v, p, "\n".join(list(difflib.unified_diff(v.split("\n"), p.split("\n"), lineterm=""))[2:])) for name, v, p in PAIRS]
    rows += [("none", "src/n.js", None, "function a() {}", ""), ("same", "src/s.js", "let a = 1;", "let a = 1;", ""), ("layout", "src/l.js", "let a = 1;", "let a  =  1;", ""), ("broken", "src/b.js", "let a = {", "let a;", "")]
    df = t.spark.createDataFrame(rows, "sha string, path string, before string, after string, patch string")
    return X.pairs_of_commits(df).select("sha", "path", "name", "changed_lines", "change_kind", "reason_code")


@query("""
WITH e AS (SELECT event_type AS arm, CASE WHEN event_id % 2 = 0 THEN 'flagged' ELSE 'cleared' END AS expected, CASE WHEN event_id % 7 = 0 THEN 'manual_review' WHEN event_id % 5 IN (0, 2) THEN 'automatic_vulnerability' ELSE 'none' END AS priority,
  CASE WHEN event_id % 3 > 0 THEN 1 + event_id % 9 END AS rank, user_id % 40 AS regions, value AS seconds FROM events),
o AS (SELECT *, CASE WHEN priority = 'automatic_vulnerability' THEN CASE WHEN expected = 'flagged' THEN 'tp' ELSE 'fp' END WHEN priority = 'manual_review' THEN 'a' ELSE CASE WHEN expected = 'flagged' THEN 'fn' ELSE 'tn' END END AS o FROM e)
SELECT arm, count(*) AS cases, round(count(*) FILTER (WHERE o = 'tp') / nullif(count(*) FILTER (WHERE o IN ('tp', 'fn')), 0), 6) AS recall, round(count(*) FILTER (WHERE o = 'tp') / nullif(count(*) FILTER (WHERE o IN ('tp', 'fp')), 0), 6) AS precision,
  round(count(*) FILTER (WHERE o = 'fp') / nullif(count(*) FILTER (WHERE o IN ('fp', 'tn')), 0), 6) AS false_positive_rate, round(count(*) FILTER (WHERE o = 'a') / count(*), 6) AS review_rate, round(count(*) FILTER (WHERE rank <= 5) / count(*), 6) AS recall_at_5,
  round(sum(coalesce(1.0 / rank, 0)) / count(*), 6) AS mrr, round(avg(regions), 6) AS mean_regions, round(sum(seconds), 4) AS seconds FROM o GROUP BY arm""")
def study_metrics(t: Tables):
    from ..operators.evaluation import study_metrics as metrics

    k = F.col("event_id")
    rows = t.events.select(
        F.col("event_type").alias("arm"), F.when(k % 2 == 0, "flagged").otherwise("cleared").alias("expected"), F.when(k % 7 == 0, "manual_review").when((k % 5).isin(0, 2), "automatic_vulnerability").otherwise("none").alias("priority"),
        F.when(k % 3 > 0, 1 + k % 9).alias("rank"), (F.col("user_id") % 40).alias("regions"), F.col("value").alias("seconds"),
    )
    return metrics(rows, ["arm"])


@query("""
WITH c AS (SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 2 = 0 THEN 'flagged' ELSE 'cleared' END AS expected, o_orderkey % 50 AS s, o_orderkey % 50 + 10 AS e, 'CWE-' || CAST(o_custkey % 3 AS VARCHAR) AS cwe FROM orders),
x AS (SELECT 't' || CAST(n_nationkey % 3 AS VARCHAR) AS tool, case_id, (case_id + n_nationkey) % 11 > 0 AS completed, (case_id + n_nationkey) % 4 > 0 AS extracted FROM c, nation WHERE n_nationkey < 3),
f AS (SELECT DISTINCT 't' || CAST(l_linenumber % 3 AS VARCHAR) AS tool, c.case_id FROM lineitem JOIN c ON l_orderkey = c.case_id WHERE l_suppkey % 60 <= c.e AND l_suppkey % 60 + 5 >= c.s AND 'CWE-' || CAST(l_partkey % 3 AS VARCHAR) = c.cwe),
r AS (SELECT x.*, c.expected, f.case_id IS NOT NULL AS flagged FROM x JOIN c USING (case_id) LEFT JOIN f ON f.tool = x.tool AND f.case_id = x.case_id)
SELECT tool, count(*) AS cases, count(*) FILTER (WHERE NOT completed) AS errors, round(count(*) FILTER (WHERE completed AND extracted) / nullif(count(*) FILTER (WHERE completed), 0), 6) AS coverage,
  round(count(*) FILTER (WHERE completed AND expected = 'flagged' AND flagged) / nullif(count(*) FILTER (WHERE completed AND expected = 'flagged'), 0), 6) AS recall,
  round(count(*) FILTER (WHERE completed AND expected <> 'flagged' AND flagged) / nullif(count(*) FILTER (WHERE completed AND expected <> 'flagged'), 0), 6) AS false_alarm_rate FROM r GROUP BY tool""")
def tool_scores(t: Tables):
    from ..operators.evaluation import tool_scores as scores

    k = F.col("o_orderkey")
    code = lambda c: F.concat(F.lit("CWE-"), (c % 3).cast("string"))
    cases = t.orders.select(k.alias("case_id"), F.when(k % 2 == 0, "flagged").otherwise("cleared").alias("expected"), F.lit("a.js").alias("path"), (k % 50).alias("start_line"), (k % 50 + 10).alias("end_line"), code(F.col("o_custkey")).alias("cwe"))
    runs = cases.select("case_id", F.explode(F.array(*[F.lit(n) for n in range(3)])).alias("n"))
    runs = runs.select(F.concat(F.lit("t"), (F.col("n") % 3).cast("string")).alias("tool"), "case_id", ((F.col("case_id") + F.col("n")) % 11 > 0).alias("completed"), ((F.col("case_id") + F.col("n")) % 4 > 0).alias("target_extracted"))
    found = t.lineitem.select(F.concat(F.lit("t"), (F.col("l_linenumber") % 3).cast("string")).alias("tool"), F.col("l_orderkey").alias("case_id"), F.lit("a.js").alias("path"), (F.col("l_suppkey") % 60).alias("start_line"), (F.col("l_suppkey") % 60 + 5).alias("end_line"), code(F.col("l_partkey")).alias("cwe"))
    return scores(cases, runs, found)


@query("""
WITH h AS (SELECT l_orderkey AS unit, l_linestatus = 'O' AS loose, l_quantity > 25 AS v FROM lineitem),
a AS (SELECT unit, bool_or(v) AS v, bool_or(NOT v) AS p, bool_or(NOT loose) AS ex, bool_or(v AND NOT loose) AS ev, bool_or(NOT v AND NOT loose) AS ep FROM h GROUP BY unit),
s AS (SELECT CASE WHEN v AND p THEN 'uncertain' WHEN v THEN 'vulnerable' ELSE 'patched' END AS before, CASE WHEN ex THEN CASE WHEN ev AND ep THEN 'uncertain' WHEN ev THEN 'vulnerable' ELSE 'patched' END ELSE CASE WHEN v AND p THEN 'uncertain' WHEN v THEN 'vulnerable' ELSE 'patched' END END AS after FROM a)
SELECT before || ' -> ' || after AS transition, count(*) AS n FROM s GROUP BY 1""")
def hash_replay(t: Tables):
    """Saved hits judged with and without the rule that exact hits go first."""
    from ..operators.evaluation import transitions
    from ..operators.matching import hash_verdicts

    v = (F.col("l_quantity") > 25).cast("int")
    hits = t.lineitem.select(F.col("l_orderkey").alias("unit"), F.lit("b").alias("boundary"), F.when(F.col("l_linestatus") == "O", "abstracted").otherwise("exact").alias("match"), v.alias("vulnerable"), (1 - v).alias("patched"), F.lit(1).alias("copies"))
    return transitions(hash_verdicts(hits.withColumn("match", F.lit("exact"))), hash_verdicts(hits), "unit", "status")
