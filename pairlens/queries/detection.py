"""Queries of retrieval, verification and verdicts over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import text as T
from ..operators import lineage as L
from ..operators import regions as R
from ..operators import retrieval as N
from ..operators import verdicts as V
from .corpus import NORM, labelled
from .registry import Tables, query

KNN_SQL = """
WITH q AS (SELECT vec_id AS query_id, embedding AS qv, label AS ql FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, ql, vec_id AS id, label, round(list_inner_product(CAST(qv AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 9) AS similarity FROM q, embeddings {where})
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS INT) AS rank FROM s WHERE query_id <> id QUALIFY rank <= 10
"""
HITS = KNN_SQL.format(where="")


def vectors(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def hits(t: Tables, k: int = 10, eligible=None):
    v = vectors(t)
    return N.top_k(v.where("id % 20 = 0"), v, k, exclude_self=True, eligible=eligible)


def labelled_hits(t: Tables, k: int = 10):
    v = vectors(t)
    return hits(t, k).join(v.select("id", "label"), "id").join(v.select(F.col("id").alias("query_id"), F.col("label").alias("ql")), "query_id")


def _six(name: str = "similarity"):
    return F.round(name, 6).alias(name)


@query(f"SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM ({HITS})")
def knn_topk(t: Tables):
    return hits(t).select("query_id", "id", _six(), "rank")


@query(f"SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM ({HITS}) WHERE ql = label")
def knn_postfilter(t: Tables):
    return labelled_hits(t).where("ql = label").select("query_id", "id", _six(), "rank")


@query(f"SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM ({KNN_SQL.format(where='WHERE label % 2 = 0')})")
def knn_prefilter(t: Tables):
    return hits(t, eligible=F.col("label") % 2 == 0).select("query_id", "id", _six(), "rank")


@query(f"""
WITH a AS (SELECT query_id, label AS pair_id, max(similarity) AS best, count(*) AS support, list(id ORDER BY similarity DESC, id)[1:5] AS top FROM ({HITS}) GROUP BY ALL)
SELECT query_id, pair_id, round(best, 6) AS best_similarity, support, array_to_string(top, ',') AS top_ids, CAST(row_number() OVER (PARTITION BY query_id ORDER BY best DESC, support DESC, pair_id) AS INT) AS pair_rank
FROM a QUALIFY pair_rank <= 5""")
def pair_aggregate_topb(t: Tables):
    g = N.group_by_pair(labelled_hits(t).withColumnRenamed("label", "pair_id"))
    return g.select("query_id", "pair_id", _six("best_similarity"), "support", F.array_join(F.transform("top_ids", lambda x: x.cast("string")), ",").alias("top_ids"), "pair_rank")


@query(f"""
WITH e AS (SELECT query_id, label AS lineage, round(0.60 * round(similarity, 6) + 0.25 * (id % 10 / 10.0) + 0.075, 6) AS s FROM ({HITS})),
a AS (SELECT query_id, lineage, count(*) AS observations, list_sort(list(s)) AS l FROM e GROUP BY ALL),
b AS (SELECT query_id, lineage, observations, l[len(l) // 2 + 1] AS score FROM a)
SELECT *, CASE WHEN score >= 0.82 THEN 'high' WHEN score >= 0.68 THEN 'medium' WHEN score >= 0.55 THEN 'low' ELSE 'none' END AS confidence FROM b""")
def lineage_score(t: Tables):
    rows = labelled_hits(t).select(F.col("query_id"), F.col("label").alias("lineage"), _six(), (F.col("id") % 10 / 10.0).alias("structure"))
    return L.lineage_scores(rows, unit="query_id")


WORDS_SQL = r"SELECT {key}, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{{L}}]+', ' ', 'g')), ' '), lambda x: x <> ''))) AS w FROM {table}"


@query(f"""
WITH b AS ({WORDS_SQL.format(key='item_id', table='benchmark')}), p AS (SELECT a.item_id AS left_id, b.item_id AS right_id, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS n, len(b.w) AS m FROM b a JOIN b ON a.item_id < b.item_id)
SELECT left_id, right_id, CAST(i AS BIGINT) AS common, round(i / (n + m - i), 6) AS jaccard FROM p WHERE i / (n + m - i) >= 0.05""")
def jaccard_pairs(t: Tables):
    """Pairs meet at their shared words, counted before any pair is scored."""
    w = t.benchmark.select("item_id", T.words(F.col("text")).alias("w")).select("item_id", F.size("w").alias("n"), F.explode("w").alias("word"))
    x, y = w.select(F.col("item_id").alias("left_id"), F.col("n").alias("a"), "word"), w.select(F.col("item_id").alias("right_id"), F.col("n").alias("b"), "word")
    p = x.join(y, "word").where("left_id < right_id").groupBy("left_id", "right_id", "a", "b").agg(F.count(F.lit(1)).alias("common"))
    j = F.col("common") / (F.col("a") + F.col("b") - F.col("common"))
    return p.where(j >= 0.05).select("left_id", "right_id", "common", F.round(j, 6).alias("jaccard"))


@query(f"""
WITH b AS ({WORDS_SQL.format(key='item_id', table='benchmark')}), s AS (SELECT item_id, len(w) AS n, unnest(w) AS word FROM b),
d AS (SELECT doc_id, unnest(w) AS word FROM ({WORDS_SQL.format(key='doc_id', table='documents')})),
c AS (SELECT item_id, doc_id, n, count(*) AS found FROM s JOIN d USING (word) GROUP BY ALL)
SELECT item_id, doc_id, round(found / n, 6) AS coverage FROM c QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY found DESC, doc_id) = 1""")
def signature_coverage(t: Tables):
    s = t.benchmark.select("item_id", T.words(F.col("text")).alias("w")).select("item_id", F.size("w").alias("n"), F.explode("w").alias("word"))
    d = t.documents.select("doc_id", F.explode(T.words(F.col("text"))).alias("word"))
    c = d.join(s, "word").groupBy("item_id", "doc_id", "n").agg(F.count(F.lit(1)).alias("found"))
    best = c.groupBy("item_id", "n").agg(F.max(F.struct("found", (-F.col("doc_id")).alias("d"))).alias("b"))
    return best.select("item_id", (-F.col("b.d")).alias("doc_id"), F.round(F.col("b.found") / F.col("n"), 6).alias("coverage"))


def window_hashes(words: str, n: int):
    """Hashes of all runs of ``n`` words of an array."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))


@query(f"""
WITH b AS (SELECT item_id, {NORM} AS q FROM benchmark), d AS (SELECT doc_id, {NORM} AS x FROM documents)
SELECT item_id, doc_id, length(q) AS chars FROM b JOIN d ON contains(x, q)""")
def benchmark_containment(t: Tables):
    """Documents meet items at up to eight of the item's inner words; the whole item is then looked for.

    Items without inner words (of two words or fewer) are looked for in every document.
    """
    words = F.split(T.collapse(F.col("text")), " ")
    items = t.benchmark.select("item_id", T.collapse(F.col("text")).alias("q"), words.alias("w"))
    # the first and last word of an item may be parts of longer ones, so the key is of the words between
    items = items.withColumn("n", F.greatest(F.lit(0), F.least(F.lit(8), F.size("w") - 2)))
    sizes = sorted([r["n"] for r in items.where("n > 0").select("n").distinct().collect()])
    texts = t.documents.select("doc_id", T.collapse(F.col("text")).alias("x"))
    found = texts.join(items.where("n = 0").select("item_id", "q"), F.contains("x", "q")).select("item_id", "doc_id", "q")
    if sizes:
        key = F.coalesce(*[F.when(F.col("n") == n, F.xxhash64(*[F.get("w", F.lit(1 + k)) for k in range(n)])) for n in sizes])
        keyed = items.where("n > 0").select("item_id", key.alias("h"))
        docs = t.documents.select("doc_id", F.explode(F.array(words)).alias("w"))
        # ids alone meet at the hashes; the few pairs get their texts afterwards
        met = docs.select("doc_id", F.explode(F.array_distinct(F.concat(*[window_hashes("w", n) for n in sizes]))).alias("h")).join(keyed, "h").select("item_id", "doc_id").distinct()
        found = found.union(met.join(texts, "doc_id").join(items.select("item_id", "q"), "item_id").where(F.contains("x", "q")).select("item_id", "doc_id", "q"))
    return found.select("item_id", "doc_id", F.length("q").cast("long").alias("chars")).distinct()


@query("""
WITH e AS (SELECT conv_id, turn, text FROM conversations)
SELECT conv_id, turn, min(turn) OVER w AS first, max(turn) OVER w AS last, count(*) OVER w AS n, CAST(sum(length(text)) OVER w AS BIGINT) AS total FROM e
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def line_context(t: Tables):
    return R.line_context(t.conversations, ["conv_id"], "turn", F.length("text"))


SPANS_SQL = "SELECT event_id AS span_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS start, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(value * 600) AS BIGINT) AS \"end\" FROM events WHERE event_type = '{kind}'"


def spans(t: Tables, kind: str):
    start = F.unix_timestamp("ts")
    return t.events.where(F.col("event_type") == kind).select(F.col("event_id").alias("span_id"), "user_id", start.alias("start"), (start + F.floor(F.col("value") * 600)).alias("end"))


@query(f"""
WITH s AS ({SPANS_SQL.format(kind='view')}), p AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS "at" FROM events WHERE event_type = 'click')
SELECT event_id, span_id, "end" - start AS seconds FROM p JOIN s ON p.user_id = s.user_id AND p."at" BETWEEN s.start AND s."end"
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY "end" - start, span_id) = 1""")
def innermost_enclosing(t: Tables):
    points = t.events.where("event_type = 'click'").select("event_id", "user_id", F.unix_timestamp("ts").alias("at"))
    inner = R.innermost(R.enclosing(points, spans(t, "view"), "user_id"), "event_id")
    return inner.select("event_id", "span_id", (F.col("end") - F.col("start")).alias("seconds"))


@query(f"""
WITH a AS ({SPANS_SQL.format(kind='view')}), b AS ({SPANS_SQL.format(kind='purchase')}),
o AS (SELECT a.span_id AS expected, b.span_id AS finding, least(a."end", b."end") - greatest(a.start, b.start) AS seconds FROM a JOIN b ON a.user_id = b.user_id AND a.start <= b."end" AND b.start <= a."end")
SELECT expected, count(*) AS findings, CAST(sum(seconds) AS BIGINT) AS seconds, min(finding) AS first_finding FROM o GROUP BY expected""")
def tool_overlap_score(t: Tables):
    a = spans(t, "view").select(F.col("span_id").alias("expected"), "user_id", F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = spans(t, "purchase").select(F.col("span_id").alias("finding"), "user_id", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    o = R.overlapping(a, b, "user_id")
    return o.groupBy("expected").agg(F.count(F.lit(1)).alias("findings"), F.sum(F.least("a_end", "b_end") - F.greatest("a_start", "b_start")).alias("seconds"), F.min("finding").alias("first_finding"))


@query(r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS body FROM documents),
f AS (SELECT doc_id, line, len(regexp_extract_all(body, '([A-Za-z_$][A-Za-z0-9_$]*|[0-9]+(?:[.][0-9]+)?|[^\sA-Za-z0-9_$])', 1)) AS n, regexp_matches(body, '[0-9]') AS literal FROM l)
SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE literal OR n >= 12) AS informative, CAST(sum(n) AS BIGINT) AS tokens FROM f GROUP BY doc_id""")
def informative_filter(t: Tables):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("body"))
    lines = lines.select("doc_id", F.explode(F.array(T.tokens(F.col("body")))).alias("tok"), F.col("body").rlike("[0-9]").cast("int").alias("names"))
    keep = R.informative(F.col("tok"), F.lit("context"), F.lit(0), F.col("names"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(keep).alias("informative"), F.sum(F.size("tok")).alias("tokens"))


@query(r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS target, unnest(string_split(text, chr(10))) AS body FROM documents),
r AS (SELECT doc_id, target, unnest(CASE WHEN body LIKE '%.%' THEN ['changed', 'block', 'context'] ELSE ['changed'] END) AS granularity FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY target, granularity) AS n FROM r),
b AS (SELECT *, coalesce(max(n) OVER (PARTITION BY doc_id ORDER BY target RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT doc_id, count(*) AS kept, CAST(max(target) AS INT) AS last_target FROM b WHERE before < 23 AND n <= 24 GROUP BY doc_id""")
def region_explode_cap(t: Tables):
    l = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "body"))
    kinds = F.when(F.contains("body", F.lit(".")), F.array(F.lit("changed"), F.lit("block"), F.lit("context"))).otherwise(F.array(F.lit("changed")))
    r = l.select("doc_id", (F.col("p") + 1).alias("target"), F.explode(kinds).alias("granularity"))
    return R.capped(r, "doc_id", "target", ["target", "granularity"], 24).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"), F.max("target").alias("last_target"))


#: Scores for the verdict rules, made from the key so that all branches occur.
SCORES = {
    "structure_v": "CAST(0.5 AS DOUBLE) + (vec_id % 11) / CAST(20.0 AS DOUBLE)", "token_v": "CAST(0.5 AS DOUBLE) + (vec_id % 13) / CAST(24.0 AS DOUBLE)", "structure_p": "CAST(0.5 AS DOUBLE) + (vec_id % 7) / CAST(12.0 AS DOUBLE)", "token_p": "CAST(0.5 AS DOUBLE) + (vec_id % 5) / CAST(8.0 AS DOUBLE)",
    "raw_v": "CASE WHEN vec_id % 17 = 0 THEN NULL ELSE CAST(0.6 AS DOUBLE) + (vec_id % 9) / CAST(20.0 AS DOUBLE) END", "raw_p": "CASE WHEN vec_id % 17 = 0 THEN NULL ELSE CAST(0.6 AS DOUBLE) + (vec_id % 8) / CAST(19.0 AS DOUBLE) END",
    "con_v": "CASE WHEN vec_id % 3 = 0 THEN CAST(0.7 AS DOUBLE) + (vec_id % 6) / CAST(17.0 AS DOUBLE) END", "con_p": "CASE WHEN vec_id % 3 = 0 THEN CAST(0.7 AS DOUBLE) + (vec_id % 4) / CAST(10.0 AS DOUBLE) END",
    "contrastive_used": "vec_id % 3 = 0", "identity_raw_v": "CASE WHEN vec_id % 4 > 0 THEN vec_id % 4 = 1 END", "identity_raw_p": "CASE WHEN vec_id % 5 > 0 THEN vec_id % 5 = 1 END",
    "identity_con_v": "vec_id % 2 = 0", "identity_con_p": "vec_id % 4 < 2", "context_v": "vec_id % 3 > 0", "context_p": "vec_id % 6 > 1", "name_conflict": "vec_id % 2 = 1", "observations": "vec_id % 19",
}
STATE_SQL = f"""
WITH a AS (SELECT vec_id, {', '.join(f'{v} AS {k}' for k, v in SCORES.items())} FROM embeddings),
b AS (SELECT *, structure_v >= 0.7 AND token_v >= 0.7 OR structure_p >= 0.7 AND token_p >= 0.7 AS corr, coalesce(raw_v - raw_p, 0) AS raw FROM a),
c AS (SELECT *, contrastive_used AND NOT coalesce(corr AND (raw_v >= 0.9 AND raw >= 0.1 OR raw_p >= 0.9 AND raw <= -0.1), FALSE) AS con, raw_v IS NOT NULL OR con_v IS NOT NULL AS ran FROM b),
d AS (SELECT *, coalesce(CASE WHEN con THEN con_v ELSE coalesce(raw_v, con_v) END, 0) AS v, coalesce(CASE WHEN con THEN con_p ELSE coalesce(raw_p, con_p) END, 0) AS p FROM c),
e AS (SELECT *, v - p AS contrast, corr AND v >= 0.9 AND v - p >= 0.1 AS sv0, corr AND p >= 0.9 AND v - p <= -0.1 AS sp0, least(structure_v, token_v) AS mv, least(structure_p, token_p) AS mp FROM d),
f AS (SELECT *, coalesce(con AND (sv0 AND NOT identity_con_v AND mp > mv OR sp0 AND NOT identity_con_p AND mv > mp), FALSE) AS generic FROM e),
g AS (SELECT *, sv0 AND NOT generic AS sv, sp0 AND NOT generic AS sp FROM f),
h AS (SELECT *, CASE WHEN sv THEN CASE WHEN con THEN identity_con_v ELSE coalesce(identity_raw_v, identity_con_v) END WHEN sp THEN CASE WHEN con THEN identity_con_p ELSE coalesce(identity_raw_p, identity_con_p) END END AS anchor FROM g),
i AS (SELECT *, coalesce((sv OR sp) AND NOT CASE WHEN sv THEN context_v ELSE context_p END AND name_conflict AND anchor IS NOT DISTINCT FROM FALSE, FALSE) AS rejected FROM h),
j AS (SELECT *, CASE WHEN observations = 0 OR rejected OR sv AND sp THEN 'uncertain' WHEN sp THEN 'patched' WHEN sv THEN 'vulnerable' ELSE 'uncertain' END AS status FROM i)
SELECT vec_id, status, CASE WHEN status = 'uncertain' THEN CASE WHEN observations = 0 THEN 'NO_EVIDENCE' WHEN rejected THEN 'IDENTITY_REJECTED' WHEN sv AND sp THEN 'CONTRADICTORY_EVIDENCE' WHEN generic THEN 'CONTRASTIVE_CONFLICT'
  WHEN NOT (structure_v >= 0.7 OR structure_p >= 0.7) THEN 'S_FAILED' WHEN NOT corr THEN 'T_FAILED' WHEN NOT ran THEN 'E_NOT_RUN' WHEN greatest(v, p) < 0.9 AND abs(contrast) < 0.1 THEN 'E_SIDE_AND_MARGIN_WEAK'
  WHEN greatest(v, p) < 0.9 THEN 'E_SIDE_WEAK' WHEN abs(contrast) < 0.1 THEN 'E_MARGIN_AMBIGUOUS' ELSE 'E_DIRECTION_UNRESOLVED' END END AS abstention_reason,
  CASE WHEN con THEN 'contrastive' WHEN ran THEN 'raw' ELSE 'not_run' END AS edit_strategy FROM j"""


def states(t: Tables):
    return V.classify(t.embeddings.select("vec_id", "label", *[F.expr(f"CAST({v} AS {'double' if k[:3] in ('str', 'tok', 'raw', 'con') and k not in ('contrastive_used', 'context_v', 'context_p') else 'int' if k == 'observations' else 'boolean'}) AS {k}") for k, v in SCORES.items()]))


@query(STATE_SQL)
def classify_boundary(t: Tables):
    return states(t).select("vec_id", "status", "abstention_reason", "edit_strategy")


@query(f"SELECT status, abstention_reason, count(*) AS n FROM ({STATE_SQL}) GROUP BY ALL")
def abstention_reason(t: Tables):
    return states(t).groupBy("status", "abstention_reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH s AS (SELECT label AS unit, status, abstention_reason = 'CONTRADICTORY_EVIDENCE' AS strong, coalesce(abstention_reason LIKE 'E_%', FALSE) AS credible, vec_id % 2 = 0 AS rejected FROM ({STATE_SQL}) JOIN embeddings USING (vec_id)),
a AS (SELECT unit, bool_or(status = 'vulnerable' AND NOT rejected) AS clean, bool_or(status = 'vulnerable') AS v, bool_or(status = 'patched') AS p, bool_or(status = 'uncertain' AND coalesce(strong, FALSE)) AS s, bool_or(status = 'uncertain' AND credible) AS c FROM s GROUP BY unit)
SELECT unit, CASE WHEN clean THEN 'automatic_vulnerability' WHEN v THEN 'manual_review' WHEN p AND NOT s THEN 'informational_lineage' WHEN s OR c THEN 'manual_review' ELSE 'none' END AS priority FROM a""")
def priority_rules(t: Tables):
    r = F.col("abstention_reason")
    rows = states(t).select(F.col("label").alias("unit"), "status", (r == "CONTRADICTORY_EVIDENCE").alias("strong"), F.coalesce(r.startswith("E_"), F.lit(False)).alias("credible"), (F.col("vec_id") % 2 == 0).alias("rejected"))
    return V.unit_priority(rows)


@query("""
WITH e AS (SELECT l_orderkey AS unit, l_linenumber AS region, round(l_discount - l_tax, 6) AS margin, l_quantity >= 10 AS passes FROM lineitem),
a AS (SELECT unit, count(DISTINCT CASE WHEN passes AND margin > 0 THEN region END) AS support, count(DISTINCT CASE WHEN passes AND margin < 0 THEN region END) AS against, count(*) AS n, max(margin) AS best_margin FROM e GROUP BY unit)
SELECT *, CASE WHEN support >= 2 AND support / n >= 0.6 AND against < support THEN 'flagged' WHEN support = 0 AND best_margin <= -0.1 THEN 'cleared' ELSE 'uncertain' END AS status FROM a""")
def support_verdict(t: Tables):
    rows = t.lineitem.select(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("region"), F.round(F.col("l_discount") - F.col("l_tax"), 6).alias("margin"), (F.col("l_quantity") >= 10).alias("passes"))
    return V.support_verdict(rows, ["unit"])


@query()
def evidence_dedup(t: Tables):
    rows = spans(t, "view").join(t.events.select(F.col("event_id").alias("span_id"), "value"), "span_id").withColumn("day", F.floor(F.col("start") / 86400))
    return V.disjoint_evidence(rows, ["user_id", "day"], order=[F.desc("value"), F.asc("span_id")]).select("span_id", "user_id", "day", "start", "end")


@query("""
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS u, source, lang, n_chars % 50 AS before, (n_chars + 7) % 50 AS after FROM documents),
e AS (SELECT u, source, lang, before AS t, 'before' AS side FROM d UNION ALL SELECT u, source, lang, after, 'after' FROM d),
s AS (SELECT source, lang, t FROM e GROUP BY ALL HAVING count(DISTINCT side) = 2 AND count(DISTINCT u) > 1)
SELECT DISTINCT e.u, 'text-' || sha256(e.source || chr(0) || e.lang || chr(0) || CAST(e.t AS VARCHAR)) AS v FROM e JOIN s USING (source, lang, t)""")
def revision_links(t: Tables):
    """Which documents hang on a text that one of them starts from and another ends at."""
    n = F.col("n_chars")
    d = t.documents.select(F.col("doc_id").cast("string").alias("boundary_id"), F.col("source").alias("lineage_id"), F.col("lang").alias("language"), (n % 50).cast("string").alias("vulnerable"), ((n + 7) % 50).cast("string").alias("patched"))
    return L.revision_links(d).select("u", "v")


@query(f"""
WITH d AS (SELECT doc_id, source, lang, sha256({NORM}) AS h FROM documents), k AS (SELECT lang, h, min(doc_id) AS root FROM d GROUP BY ALL)
SELECT doc_id AS node, root FROM d JOIN k USING (lang, h) WHERE (SELECT count(*) FROM d x WHERE x.lang = d.lang AND x.h = d.h) > 1""")
def revision_components(t: Tables):
    """Documents linked through shared normalised texts: each hangs on its text, stars are contracted."""
    from ..operators.graph import components

    d = t.documents.select("doc_id", "lang", T.digest(T.collapse(F.col("text"))).alias("h"))
    groups = d.groupBy("lang", "h").agg(F.min("doc_id").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return components(d.join(groups, ["lang", "h"]).select(F.col("doc_id").alias("u"), "v"))


@query()
def sequence_similarity(t: Tables):
    """Each benchmark item against the next, by tokens."""
    b = t.benchmark.select("item_id", T.tokens(F.col("text")).alias("a"))
    pairs = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b")), "item_id")
    return pairs.select("item_id", F.round(K.similarity_udf()("a", "b"), 6).alias("similarity"))


@query()
def fuzzy_substring(t: Tables):
    """Benchmark items against the documents that share one of their pieces, by words.

    An item is cut into disjoint pieces of four words (two halves, below eight words): a copy with
    fewer edits than pieces keeps one of them, wherever the edits are.
    """
    words = F.split(T.collapse(F.col("text")), " ")
    n, size = F.size("q"), F.least(F.lit(4), F.greatest(F.lit(1), F.floor(F.size("q") / 2).cast("int")))
    items = t.benchmark.select("item_id", words.alias("q")).where("q IS NOT NULL").withColumn("size", size)
    starts = F.transform(F.sequence(F.lit(1), F.floor(n / F.col("size")).cast("int")), lambda k: (k - 1) * F.col("size"))
    pieces = items.select("item_id", "q", "size", F.explode(starts).alias("at"))
    sizes = sorted([r["size"] for r in items.select("size").distinct().collect()])
    docs = t.documents.select("doc_id", F.explode(F.array(words)).alias("w"))
    if not sizes:
        sizes = [4]
    hashed = F.coalesce(*[F.when(F.col("size") == s, F.xxhash64(*[F.get("q", F.col("at") + k) for k in range(s)])) for s in sizes])
    keys = docs.select("doc_id", F.explode(F.array_distinct(F.concat(*[window_hashes("w", s) for s in sizes]))).alias("h"))
    met = keys.join(pieces.select("item_id", hashed.alias("h")), "h").select("item_id", "doc_id").distinct()
    found = met.join(items.select("item_id", "q"), "item_id").join(docs, "doc_id")
    return found.select("item_id", "doc_id", F.round(K.fuzzy_udf()("q", "w"), 6).alias("similarity"))


@query()
def diagnostic_diff(t: Tables):
    """Lines that differ between a labelled document and the next one of the same source."""
    from pyspark.sql import Window

    rows = labelled(t).select("doc_id", "source", T.lines_of(F.col("text")).alias("a"))
    rows = rows.withColumn("b", F.lead("a").over(Window.partitionBy("source").orderBy("doc_id"))).where("b IS NOT NULL")
    return rows.select("doc_id", F.inline(K.diff_udf()("a", "b"))).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars"))


def sample_files(t: Tables):
    from ..functions.samples import PAIRS
    from ..operators.units import scripts_of

    own = t.spark.createDataFrame([(f"{side}/{name}.js", text) for name, *pair in PAIRS for side, text in zip(("vulnerable", "patched"), pair)], "path string, content string")
    return scripts_of(t.pages).unionByName(own)


@query()
def region_scan(t: Tables):
    """The whole scan: pages' scripts and edited forms of the sample pairs against the sample pairs as the corpus."""
    from ..functions.samples import PAIRS
    from ..plans.scan import scan

    entries = [("own/samples", f"src/{name}.js", name, "fix", v, p, f"A-{i}", "high") for i, (name, v, p) in enumerate(PAIRS)]
    corpus = t.spark.createDataFrame(entries, "repo string, path string, function string, fix string, vulnerable string, patched string, advisory string, severity string")
    edited = sample_files(t).select(F.concat(F.lit("edited/"), "path").alias("path"), F.regexp_replace("content", r"return ", "log(1);\n  return ").alias("content"))
    return scan(sample_files(t).union(edited), corpus).drop("unit", "boundary", "function_hash")


@query()
def js_functions(t: Tables):
    """Functions of the pages' scripts and of the sample pairs."""
    from ..operators.units import extract_units

    return extract_units(sample_files(t)).drop("source")


@query()
def js_fingerprint(t: Tables):
    from ..operators.units import extract_units, with_fingerprints

    return with_fingerprints(extract_units(sample_files(t))).select("unit_id", "name", "native", "exact", "abstracted", "abstracted_length")


@query()
def js_regions(t: Tables):
    from ..operators.units import candidate_regions, extract_units

    r = candidate_regions(extract_units(sample_files(t)))
    return r.select("unit_id", "region_id", "granularity", "start_line", "end_line", F.size("tokens").alias("n_tokens"), F.array_join("calls", ",").alias("calls"))
