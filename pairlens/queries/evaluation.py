"""Queries of evaluation and selection over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from .detection import HITS, labelled_hits
from .registry import Tables, query

OUTCOME_SQL = """
WITH c AS (SELECT doc_id, lang, source, CASE WHEN toxic = 1 THEN 'flagged' ELSE 'cleared' END AS expected,
  CASE WHEN n_chars % 7 = 0 THEN 'manual_review' WHEN (toxic = 1) <> (n_chars % 5 = 0) THEN 'automatic_vulnerability' ELSE 'informational_lineage' END AS priority FROM documents JOIN labels USING (doc_id)),
o AS (SELECT *, CASE WHEN priority = 'automatic_vulnerability' THEN CASE WHEN expected = 'flagged' THEN 'true_positive' ELSE 'false_positive' END
  WHEN priority = 'manual_review' THEN CASE WHEN expected = 'flagged' THEN 'abstained_positive' ELSE 'abstained_negative' END
  ELSE CASE WHEN expected = 'flagged' THEN 'false_negative' ELSE 'true_negative' END END AS outcome FROM c)
"""
METRICS = """count(*) AS cases, round(count(*) FILTER (WHERE outcome = 'true_positive') / nullif(count(*) FILTER (WHERE outcome IN ('true_positive', 'false_negative')), 0), 6) AS recall,
  round(count(*) FILTER (WHERE outcome = 'false_positive') / nullif(count(*) FILTER (WHERE outcome IN ('false_positive', 'true_negative')), 0), 6) AS false_positive_rate,
  round(count(*) FILTER (WHERE outcome = 'true_positive') / nullif(count(*) FILTER (WHERE outcome IN ('true_positive', 'false_positive')), 0), 6) AS precision,
  round(count(*) FILTER (WHERE outcome LIKE 'abstained%') / nullif(count(*), 0), 6) AS abstention_rate"""


def outcomes(t: Tables):
    d = t.documents.join(t.labels, "doc_id")
    expected = F.when(F.col("toxic") == 1, "flagged").otherwise("cleared")
    priority = F.when(F.col("n_chars") % 7 == 0, "manual_review").when((F.col("toxic") == 1) != (F.col("n_chars") % 5 == 0), "automatic_vulnerability").otherwise("informational_lineage")
    rows = d.select("doc_id", "lang", "source", expected.alias("expected"), priority.alias("priority"))
    return rows.withColumn("outcome", E.outcome(F.col("expected"), F.col("priority")))


@query(OUTCOME_SQL + "SELECT expected, outcome, count(*) AS n FROM o GROUP BY ALL")
def outcome_matrix(t: Tables):
    return outcomes(t).groupBy("expected", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query(OUTCOME_SQL + f"SELECT {METRICS} FROM o")
def verification_metrics(t: Tables):
    return E.verification_metrics(outcomes(t))


@query(OUTCOME_SQL + f"SELECT coalesce(lang, '(all)') AS stratum, {METRICS} FROM o GROUP BY ROLLUP (lang)")
def stratified_metrics(t: Tables):
    o = outcomes(t)
    by = E.verification_metrics(o, ["lang"]).withColumnRenamed("lang", "stratum")
    return by.unionByName(E.verification_metrics(o).withColumn("stratum", F.lit("(all)")))


RANKS = f"""
WITH h AS ({HITS}), r AS (SELECT query_id, min(rank) FILTER (WHERE label = ql) AS rank FROM h GROUP BY query_id),
c AS (SELECT query_id, query_id % 60 = 0 AS by_hash, CASE WHEN query_id % 60 = 0 THEN 1 ELSE rank END AS rank FROM r)
"""
RETRIEVAL = "count(*) AS cases, round(count(*) FILTER (WHERE rank <= 1) / count(*), 6) AS recall_at_1, round(count(*) FILTER (WHERE rank <= 5) / count(*), 6) AS recall_at_5, round(count(*) FILTER (WHERE rank <= 10) / count(*), 6) AS recall_at_10, round(sum(coalesce(1.0 / rank, 0)) / count(*), 6) AS mrr, count(*) FILTER (WHERE rank IS NULL) AS misses"


def ranks(t: Tables):
    r = labelled_hits(t).groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("ql"), F.col("rank"))).alias("rank"))
    by_hash = F.col("query_id") % 60 == 0
    return r.select("query_id", by_hash.alias("by_hash"), E.effective_rank(F.col("rank"), by_hash).alias("rank"))


@query(RANKS + f"SELECT 'all' AS scope, {RETRIEVAL} FROM c UNION ALL SELECT 'non_hash', {RETRIEVAL} FROM c WHERE NOT by_hash")
def retrieval_metrics(t: Tables):
    r = ranks(t)
    both = r.select("*", F.explode(F.when(F.col("by_hash"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("non_hash")))).alias("scope"))
    return E.retrieval_metrics(both, ["scope"])


@query(f"""
WITH h AS ({HITS}), f AS (SELECT query_id, bool_or(label = ql) AS shortlisted, bool_or(label = ql AND similarity >= 0.2) AS verified, bool_or(label = ql AND rank <= 5) AS retained, bool_or(label = ql AND rank <= 3) AS visible, bool_or(label = ql AND rank = 1) AS first FROM h GROUP BY query_id)
SELECT count(*) AS cases, count(*) FILTER (WHERE shortlisted) AS shortlisted, count(*) FILTER (WHERE shortlisted AND verified) AS verified, count(*) FILTER (WHERE shortlisted AND verified AND retained) AS retained,
  count(*) FILTER (WHERE shortlisted AND verified AND retained AND visible) AS visible, count(*) FILTER (WHERE shortlisted AND verified AND retained AND visible AND first) AS first FROM f""")
def origin_funnel(t: Tables):
    own = F.col("label") == F.col("ql")
    flags = labelled_hits(t).groupBy("query_id").agg(
        F.bool_or(own).alias("shortlisted"), F.bool_or(own & (F.col("similarity") >= 0.2)).alias("verified"), F.bool_or(own & (F.col("rank") <= 5)).alias("retained"), F.bool_or(own & (F.col("rank") <= 3)).alias("visible"), F.bool_or(own & (F.col("rank") == 1)).alias("first")
    )
    return E.funnel(flags, ["shortlisted", "verified", "retained", "visible", "first"])


@query(f"""
WITH h AS ({HITS}), g AS (SELECT unnest([1, 3, 5, 10]) AS k), u AS (SELECT unnest([0.0, 0.1, 0.2]) AS threshold)
SELECT CAST(k AS INT) AS k, CAST(threshold AS DOUBLE) AS threshold, count(*) AS hits, count(*) FILTER (WHERE label = ql) AS own, count(DISTINCT query_id) AS queries FROM h, g, u WHERE rank <= k AND similarity >= threshold GROUP BY ALL""")
def retrieval_ablation(t: Tables):
    """One search for the largest k; every setting filters its hits, which are expanded beside the few settings."""
    settings = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(u).alias("threshold")) for k in (1, 3, 5, 10) for u in (0.0, 0.1, 0.2)])
    rows = labelled_hits(t).select("*", F.inline(settings)).where("rank <= k AND similarity >= threshold")
    return rows.groupBy("k", "threshold").agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("label") == F.col("ql")).alias("own"), F.countDistinct("query_id").alias("queries"))


@query("""
WITH r AS (SELECT l_returnflag AS grp, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT grp, max(v) FILTER (WHERE i = CAST(ceil(n * 0.95) AS BIGINT)) AS p95_ceil, max(v) FILTER (WHERE i = least(n, CAST(floor(n * 0.95) AS BIGINT) + 1)) AS p95_floor FROM r GROUP BY grp""")
def p95_variants(t: Tables):
    rows = t.lineitem.select(F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").alias("v"))
    a = E.nearest_rank(rows, "v", ["grp"]).withColumnRenamed("quantile", "p95_ceil")
    return a.join(E.nearest_rank(rows, "v", ["grp"], variant="floor").withColumnRenamed("quantile", "p95_floor"), "grp")


@query("""
WITH p AS (SELECT p_partkey, p_size, round(p_retailprice, 2) AS price, p_partkey % 97 AS a, p_partkey % 89 AS b FROM part)
SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p x WHERE x.p_size >= p.p_size AND x.a >= p.a AND x.b >= p.b AND x.price <= p.price AND (x.p_size > p.p_size OR x.a > p.a OR x.b > p.b OR x.price < p.price))""")
def pareto_frontier(t: Tables):
    rows = t.part.select("p_partkey", "p_size", F.round("p_retailprice", 2).alias("price"), (F.col("p_partkey") % 97).alias("a"), (F.col("p_partkey") % 89).alias("b"))
    return E.pareto(rows, "p_partkey", ["p_size", "a", "b"], ["price"])


@query("""
WITH g AS (SELECT r_name AS experiment, CAST(r_regionkey AS DOUBLE) / 10 AS structure, CAST(n_nationkey % 5 AS DOUBLE) / 10 AS token FROM region JOIN nation ON r_regionkey = n_regionkey)
SELECT structure, token, CAST(0.9 AS DOUBLE) AS edit, min(experiment) AS experiment FROM g GROUP BY structure, token""")
def sweep_grid(t: Tables):
    grid = t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey"))
    settings = F.create_map(F.lit("structure"), F.col("r_regionkey") / 10.0, F.lit("token"), (F.col("n_nationkey") % 5) / 10.0)
    s = E.sweep({"structure": 0.7, "token": 0.7, "edit": 0.9}, grid.select(F.col("r_name").alias("experiment"), settings.alias("settings")))
    m = F.map_from_entries("settings")
    return s.select(F.element_at(m, "structure").alias("structure"), F.element_at(m, "token").alias("token"), F.element_at(m, "edit").alias("edit"), "experiment")


@query("""
WITH r AS (SELECT o_orderkey, o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS turn FROM orders),
c AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY turn, o_custkey, o_orderkey) AS c FROM r)
SELECT o_orderkey, o_custkey, o_orderpriority, CAST(turn AS INT) AS turn FROM c WHERE c <= 10""")
def round_robin_select(t: Tables):
    return E.round_robin(t.orders.select("o_orderkey", "o_custkey", "o_orderpriority"), "o_custkey", "o_orderkey", "o_orderpriority")


@query("""
WITH r AS (SELECT c_custkey, c_mktsegment, c_nationkey % 2 AS kind, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey % 2 ORDER BY c_custkey) AS turn FROM customer)
SELECT c_custkey, c_mktsegment, kind, CAST(turn AS INT) AS turn, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY turn, kind) AS INT) AS place FROM r""")
def stratified_interleave(t: Tables):
    from pyspark.sql import Window

    rows = t.customer.select("c_custkey", "c_mktsegment", (F.col("c_nationkey") % 2).alias("kind")).withColumn("_g", F.concat_ws("|", "c_mktsegment", "kind"))
    r = E.round_robin(rows, "_g", "c_custkey").drop("_g")
    return r.select("*", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("turn", "kind")).alias("place"))


@query("SELECT doc_id, 'vulnerable' AS kind, quality AS label FROM labels UNION ALL SELECT doc_id, 'fixed', toxic FROM labels")
def label_unpivot(t: Tables):
    return t.labels.select("doc_id", F.col("quality").alias("vulnerable"), F.col("toxic").alias("fixed")).unpivot("doc_id", ["vulnerable", "fixed"], "kind", "label")


@query("""
WITH r AS (SELECT doc_id, source, n_chars, doc_id % 97 = 0 AS required, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY (doc_id % 97 = 0) DESC, n_chars, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
SELECT doc_id, source, n_chars, CAST(before AS BIGINT) AS before FROM r WHERE before < 20000 OR required""")
def bounded_selection(t: Tables):
    rows = t.documents.select("doc_id", "source", "n_chars", (F.col("doc_id") % 97 == 0).alias("required"))
    return E.bounded_selection(rows, ["source"], ["n_chars", "doc_id"], "n_chars", 20000, F.col("required")).drop("required")


@query("""
WITH a AS (SELECT doc_id, lang, n_chars FROM documents JOIN labels USING (doc_id) WHERE toxic = 1), b AS (SELECT doc_id AS control_id, lang, n_chars AS m FROM documents JOIN labels USING (doc_id) WHERE toxic = 0),
d AS (SELECT doc_id, control_id, abs(n_chars - m) // 20 + 100 * abs(doc_id % 10 - control_id % 10) AS distance FROM a JOIN b USING (lang))
SELECT doc_id, control_id, distance FROM d QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, control_id) = 1""")
def nearest_control(t: Tables):
    d = t.documents.join(t.labels, "doc_id")
    d = d.select("doc_id", "lang", "n_chars", "toxic", (F.col("doc_id") % 10).alias("digit"))
    a, b = d.where("toxic = 1"), d.where("toxic = 0").withColumnRenamed("doc_id", "control_id")
    return E.nearest_control(a, b, "lang", "doc_id", "control_id", "n_chars", "digit", 20, 100)


@query("""
WITH b AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'manual_review' ELSE 'none' END AS p FROM labels), a AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'automatic_vulnerability' WHEN quality = 0 THEN 'manual_review' ELSE 'none' END AS p FROM labels)
SELECT b.p || ' -> ' || a.p AS transition, count(*) AS n FROM b JOIN a USING (doc_id) GROUP BY 1""")
def policy_transitions(t: Tables):
    b = t.labels.select("doc_id", F.when(F.col("toxic") == 1, "manual_review").otherwise("none").alias("p"))
    a = t.labels.select("doc_id", F.when((F.col("quality") == 1) & (F.col("toxic") == 1), "automatic_vulnerability").when(F.col("quality") == 0, "manual_review").otherwise("none").alias("p"))
    return E.transitions(b, a, "doc_id", "p")


PAIRS_SQL = """
WITH r AS (SELECT doc_id // 2 AS pair_id, CASE WHEN doc_id % 2 = 0 THEN 'flagged' ELSE 'cleared' END AS label, quality = 1 AS accepted, n_chars AS key FROM documents JOIN labels USING (doc_id)),
w AS (SELECT key, count(DISTINCT pair_id) AS owners FROM r GROUP BY key),
a AS (SELECT pair_id, count(*) FILTER (WHERE label = 'flagged') AS f, count(*) FILTER (WHERE label = 'cleared') AS c, bool_and(accepted) AS ok, max(owners) AS owners FROM r JOIN w USING (key) GROUP BY pair_id),
q AS (SELECT pair_id, CASE WHEN f = 0 OR c = 0 THEN 'incomplete_pair' WHEN NOT ok THEN 'not_accepted' WHEN owners > 1 THEN 'source_shared' ELSE 'admitted' END AS reason_code FROM a)
"""


def pairs(t: Tables):
    d = t.documents.join(t.labels, "doc_id")
    rows = d.select(F.floor(F.col("doc_id") / 2).alias("pair_id"), F.when(F.col("doc_id") % 2 == 0, "flagged").otherwise("cleared").alias("label"), (F.col("quality") == 1).alias("accepted"), F.col("n_chars").alias("key"))
    return E.complete_pairs(rows, "pair_id", "label", ("flagged", "cleared"), "accepted", "key")


@query(PAIRS_SQL + "SELECT pair_id, reason_code FROM q")
def pair_eligibility(t: Tables):
    return pairs(t)


@query(PAIRS_SQL + "SELECT reason_code, count(*) AS n FROM q GROUP BY 1")
def admission_quarantine(t: Tables):
    return pairs(t).groupBy("reason_code").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH r AS (SELECT event_id % 3 > 0 AS v, event_id % 4 > 0 AS p, event_id % 5 > 0 AS d, event_type = 'click' AS e FROM events)
SELECT CASE WHEN NOT (v AND p) THEN 'originals_failed' WHEN NOT d THEN 'not_distinguishing' WHEN e THEN 'behaviour_confirmed' ELSE 'behaviour_changed' END AS outcome, count(*) AS n FROM r GROUP BY 1""")
def three_way_outcome(t: Tables):
    k = F.col("event_id")
    return t.events.groupBy(E.three_way(k % 3 > 0, k % 4 > 0, k % 5 > 0, F.col("event_type") == "click").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
