"""Queries of corpus building and hashing over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import versions as V
from ..operators import corpus as C
from ..operators import lineage as L
from ..operators import matching as M
from .registry import Tables, query

NORM = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
LOOSE = r"trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g'))"
SIDES = "CASE WHEN quality = 0 THEN 'vulnerable' ELSE 'patched' END"

SCAN_SQL = f"""
WITH d AS (SELECT doc_id, lang, text, {NORM} AS norm, {LOOSE} AS loose FROM documents),
f AS (
  SELECT doc_id, lang, 'native' AS kind, length(text) AS length, sha256(text) AS digest FROM d
  UNION ALL SELECT doc_id, lang, 'exact', length(norm), sha256(norm) FROM d WHERE length(loose) >= 50
  UNION ALL SELECT doc_id, lang, 'abstracted', length(loose), sha256(loose) FROM d WHERE length(loose) >= 50),
r AS (SELECT f.*, {SIDES} AS side FROM f JOIN labels USING (doc_id)),
x AS (SELECT kind, lang, length, digest, max((side = 'vulnerable')::INT) AS v, max((side = 'patched')::INT) AS p, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT t.doc_id, CASE WHEN t.kind = 'abstracted' THEN 0 ELSE 1 END AS ex, v, p, n FROM f t JOIN x USING (kind, lang, length, digest) WHERE t.doc_id NOT IN (SELECT doc_id FROM labels)),
a AS (SELECT doc_id, max(ex) AS ex, max(v * ex) AS ev, max(p * ex) AS ep, max(v * (1 - ex)) AS av, max(p * (1 - ex)) AS ap, sum(n) AS match_count FROM h GROUP BY doc_id),
b AS (SELECT doc_id, CASE WHEN ex = 1 THEN ev ELSE av END AS vulnerable_hit, CASE WHEN ex = 1 THEN ep ELSE ap END AS patched_hit, CAST(match_count AS BIGINT) AS match_count, CASE WHEN ex = 1 THEN 'exact' ELSE 'abstracted' END AS match_level FROM a),
s AS (SELECT *, CASE WHEN vulnerable_hit = 1 AND patched_hit = 1 THEN 'uncertain' WHEN vulnerable_hit = 1 THEN 'vulnerable' ELSE 'patched' END AS status,
  CASE WHEN vulnerable_hit = 1 AND patched_hit = 1 AND match_level = 'exact' THEN 'CONTRADICTORY_EVIDENCE' WHEN vulnerable_hit = 1 AND patched_hit = 1 THEN 'HASH_SIDE_AMBIGUOUS' END AS abstention_reason FROM b)
SELECT doc_id, vulnerable_hit, patched_hit, match_count, match_level, status, abstention_reason,
  CASE status WHEN 'vulnerable' THEN 'automatic_vulnerability' WHEN 'patched' THEN 'informational_lineage' ELSE 'manual_review' END AS priority
FROM s
"""


def labelled(t: Tables):
    return t.documents.join(t.labels, "doc_id")


def reference(t: Tables):
    side = F.when(F.col("quality") == 0, "vulnerable").otherwise("patched")
    return labelled(t).select(F.lit("all").alias("boundary"), side.alias("side"), F.col("lang").alias("language"), "text")


def targets(t: Tables):
    return t.documents.join(t.labels.select("doc_id"), "doc_id", "left_anti").select(F.col("doc_id").alias("unit"), F.col("lang").alias("language"), "text")


def scan(t: Tables):
    verdicts = M.hash_verdicts(M.lookup(targets(t), M.build_hash_index(reference(t))).where("same_language"))
    return verdicts.join(M.unit_priority(verdicts).drop("boundaries"), "unit").select(F.col("unit").alias("doc_id"), "vulnerable_hit", "patched_hit", "match_count", "match_level", "status", "abstention_reason", "priority")


@query(SCAN_SQL)
def hash_scan(t: Tables):
    return scan(t)


@query(f"""
WITH d AS (SELECT doc_id, lang, source AS text, {LOOSE.replace('text', 'source')} AS loose FROM documents UNION ALL SELECT -1 - doc_id, lang, text, {LOOSE} FROM documents),
k AS (SELECT doc_id, lang, length(loose) < 50 AS short, text, labels.doc_id IS NOT NULL AS known FROM d LEFT JOIN labels USING (doc_id)),
h AS (SELECT a.doc_id, a.lang, b.lang AS other FROM k a JOIN k b ON a.text = b.text WHERE NOT a.known AND b.known AND (a.short OR a.lang = b.lang))
SELECT doc_id, count(*) AS matches, count(*) FILTER (WHERE lang = other) AS same_language FROM h GROUP BY doc_id""")
def native_lookup(t: Tables):
    """Native hits of source names (short: found in every language) and of texts (in their own language) among labelled rows."""
    own = t.documents.select("doc_id", F.col("lang").alias("language"), F.col("source").alias("text")).union(t.documents.select(-1 - F.col("doc_id"), "lang", "text"))
    known = own.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    rest = own.join(t.labels.select("doc_id"), "doc_id", "left_anti").withColumnRenamed("doc_id", "unit")
    index = M.build_hash_index(known.select(F.lit("all").alias("boundary"), F.lit("vulnerable").alias("side"), "language", "text"))
    found = M.lookup(rest, index, kinds=("native",))
    return found.groupBy(F.col("unit").alias("doc_id")).agg(F.sum("copies").alias("matches"), F.sum(F.when(F.col("same_language"), F.col("copies")).otherwise(0)).alias("same_language"))


@query(f"""SELECT priority, count(*) AS units, CAST(sum(match_count) AS BIGINT) AS matches, count(*) FILTER (WHERE priority IN ('automatic_vulnerability', 'manual_review')) AS findings FROM ({SCAN_SQL}) GROUP BY priority""")
def audit_summary(t: Tables):
    active = F.col("priority").isin("automatic_vulnerability", "manual_review")
    return scan(t).groupBy("priority").agg(F.count(F.lit(1)).alias("units"), F.sum("match_count").alias("matches"), F.count_if(active).alias("findings"))


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_doc, count(DISTINCT lang) AS langs FROM documents GROUP BY 1 HAVING count(*) > 1")
def native_hash_dupes(t: Tables):
    rows = t.documents.groupBy(T.digest(F.col("text")).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"), F.countDistinct("lang").alias("langs"))
    return rows.where("n > 1")


@query(f"SELECT sha256({NORM}) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def normalized_hash_dupes(t: Tables):
    return t.documents.groupBy(T.digest(T.collapse(F.col("text"))).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query(f"""
WITH d AS (SELECT documents.*, {NORM} AS norm, {LOOSE} AS loose, labels.doc_id IS NOT NULL AS known FROM documents LEFT JOIN labels USING (doc_id)),
k AS (SELECT doc_id, length(norm) AS length, sha256(norm) AS digest, known FROM d WHERE length(loose) >= 50)
SELECT a.doc_id, a.length, count(*) AS matches FROM k a JOIN k b USING (length, digest) WHERE NOT a.known AND b.known GROUP BY ALL""")
def length_bucket_join(t: Tables):
    rows = M.fingerprint_rows(targets(t)).where("kind = 'exact'")
    index = M.build_hash_index(reference(t)).where("kind = 'exact'").groupBy("length", "digest").agg(F.sum("copies").alias("matches"))
    return rows.join(index, ["length", "digest"]).select(F.col("unit").alias("doc_id"), "length", "matches")


@query(f"""
WITH d AS (SELECT documents.*, {NORM} AS norm, {LOOSE} AS loose, labels.doc_id IS NOT NULL AS known FROM documents LEFT JOIN labels USING (doc_id)),
k AS (SELECT doc_id, lang, length(loose) AS length, sha256(loose) AS digest, known FROM d WHERE length(loose) >= 50)
SELECT a.doc_id, a.lang, count(*) AS matches, count(*) FILTER (WHERE a.lang = b.lang) AS same_language FROM k a JOIN k b USING (length, digest) WHERE NOT a.known AND b.known GROUP BY ALL""")
def language_scoped_hash(t: Tables):
    rows = M.fingerprint_rows(targets(t)).where("kind = 'abstracted'")
    index = M.build_hash_index(reference(t)).where("kind = 'abstracted'").groupBy("length", "digest", F.col("language").alias("other")).agg(F.sum("copies").alias("n"))
    found = rows.join(index, ["length", "digest"])
    same = F.sum(F.when(F.col("language") == F.col("other"), F.col("n")).otherwise(0))
    return found.groupBy(F.col("unit").alias("doc_id"), F.col("language").alias("lang")).agg(F.sum("n").alias("matches"), same.alias("same_language"))


@query(f"""
WITH d AS (SELECT doc_id, source, lang, sha256({NORM}) AS h FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, h ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY lang, h) AS entries FROM d)
SELECT doc_id, source, lang, entries FROM r WHERE rn = 1""")
def corpus_dedup_first(t: Tables):
    rows = t.documents.select("doc_id", "source", "lang", T.digest(T.collapse(F.col("text"))).alias("h"))
    return C.deduplicate(rows, ["lang", "h"], ["doc_id"], F.col("source")).select("doc_id", "source", "lang", "entries")


@query(f"""SELECT sha256({NORM}) AS digest, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1""")
def alias_union(t: Tables):
    rows = t.documents.select("doc_id", "source", T.digest(T.collapse(F.col("text"))).alias("digest"))
    return C.deduplicate(rows, ["digest"], ["doc_id"], F.col("source")).where("entries > 1").select("digest", F.array_join("aliases", ",").alias("sources"), F.col("doc_id").alias("first_doc"))


@query("""
SELECT doc_id, 'lineage-' || sha256(source || chr(0) || lang || chr(0) || '') AS lineage_id,
  'boundary-' || sha256('lineage-' || sha256(source || chr(0) || lang || chr(0) || '') || chr(0) || CAST(quality AS VARCHAR) || chr(0) || sha256(text) || chr(0) || sha256(lower(text))) AS boundary_id
FROM documents JOIN labels USING (doc_id)""")
def lineage_boundary_ids(t: Tables):
    rows = labelled(t).withColumn("lineage_id", L.lineage_id(F.col("source"), F.col("lang"), F.lit(None)))
    return rows.select("doc_id", "lineage_id", L.boundary_id(F.col("lineage_id"), F.col("quality"), F.col("text"), F.lower("text")).alias("boundary_id"))


@query("""
WITH c AS (SELECT source AS package, count(DISTINCT doc_id) AS advisories FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT package, advisories, CAST(row_number() OVER (ORDER BY advisories DESC, package) AS INT) AS rank FROM c""")
def package_probe(t: Tables):
    return C.package_probe(labelled(t), "source", "doc_id")


@query("""
SELECT CASE WHEN GROUPING(source) = 1 THEN '(all)' ELSE source END AS package, CASE WHEN GROUPING(lang) = 1 THEN '(all)' ELSE lang END AS language, count(*) AS entries, CAST(sum(n_chars) AS BIGINT) AS chars
FROM documents GROUP BY ROLLUP (source, lang)""")
def corpus_stats(t: Tables):
    r = t.documents.rollup("source", "lang").agg(F.count(F.lit(1)).alias("entries"), F.sum("n_chars").alias("chars"), F.grouping("source").alias("gs"), F.grouping("lang").alias("gl"))
    return r.select(F.when(F.col("gs") == 1, "(all)").otherwise(F.col("source")).alias("package"), F.when(F.col("gl") == 1, "(all)").otherwise(F.col("lang")).alias("language"), "entries", "chars")


@query(r"""
SELECT CASE WHEN length(trim(text)) = 0 THEN 'blank' WHEN n_chars < 100 THEN 'too_short' WHEN n_chars > 15000 THEN 'too_large' WHEN lang <> 'en' THEN 'language'
  WHEN regexp_matches(text, '[#$%&]{3}') THEN 'formatting_only' ELSE 'admitted' END AS reason_code, count(*) AS n FROM documents GROUP BY 1""")
def attrition_reasons(t: Tables):
    text = F.col("text")
    reason = C.first_reason(
        (F.length(F.trim(text)) == 0, "blank"), (F.col("n_chars") < 100, "too_short"), (F.col("n_chars") > 15000, "too_large"), (F.col("lang") != "en", "language"), (text.rlike("[#$%&]{3}"), "formatting_only")
    )
    return C.attrition(t.documents.select(reason.alias("reason_code")))


@query("""
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_extendedprice, l_linenumber) AS rn FROM lineitem) WHERE rn = 1""")
def primary_pair(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return C.primary_row(rows, ["l_orderkey"], ["l_quantity", "l_extendedprice", "l_linenumber"])


VERSION_SQL = "(p_size % 4)::VARCHAR || '.' || (p_partkey % 12)::VARCHAR || '.' || (p_partkey % 5)::VARCHAR || CASE WHEN p_partkey % 9 = 0 THEN '-rc.' || (p_partkey % 11)::VARCHAR ELSE '' END"
ORDER_SQL = "[p_size % 4, p_partkey % 12, p_partkey % 5, CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE 1 END, CASE WHEN p_partkey % 9 = 0 THEN p_partkey % 11 ELSE 0 END]"


def versions(t: Tables):
    v = F.expr("concat(p_size % 4, '.', p_partkey % 12, '.', p_partkey % 5, CASE WHEN p_partkey % 9 = 0 THEN concat('-rc.', p_partkey % 11) ELSE '' END)")
    return t.part.select("p_partkey", F.col("p_brand").alias("package"), v.alias("version"))


@query(f"""
WITH v AS (SELECT p_brand AS package, {VERSION_SQL} AS version, {ORDER_SQL} AS k FROM part)
SELECT package, '2.6.0' AS first_fixed, arg_max(version, k) AS last_affected FROM v WHERE k < [2, 6, 0, 1, 0] GROUP BY package""")
def last_affected_version(t: Tables):
    return C.release_boundary(versions(t).withColumn("first_fixed", F.lit("2.6.0")))


@query("""
WITH v AS (SELECT p_partkey, p_brand AS package, p_size % 4 AS a, p_partkey % 12 AS b, p_partkey % 5 AS c, p_partkey % 9 = 0 AS pre FROM part),
x AS (SELECT *, [a, b, c, CASE WHEN pre THEN 0 ELSE 1 END] AS k FROM v)
SELECT package, count(*) AS versions,
  count(*) FILTER (WHERE k >= [1, 2, 0, 1] AND a < 2) AS caret, count(*) FILTER (WHERE k >= [1, 2, 3, 1] AND [a, b] < [1, 3]) AS tilde,
  count(*) FILTER (WHERE k < [1, 4, 0, 1] OR k >= [3, 0, 0, 1]) AS either, count(*) FILTER (WHERE a = 2) AS prefix,
  count(*) FILTER (WHERE k >= [0, 5, 0, 1] AND k <= [1, 7, 0, 1]) AS hyphen,
  count(*) FILTER (WHERE k > [1, 2, 0, 1]) AS above, count(*) FILTER (WHERE k <= [1, 2, 0, 1]) AS upto, count(*) FILTER (WHERE k >= [0, 0, 0, 1] AND [a, b, c] < [0, 0, 1]) AS caret_zero,
  count(*) FILTER (WHERE k >= [1, 0, 0, 1] AND [a, b] < [1, 1]) AS tilde_one, count(*) FILTER (WHERE [a, b, c] = [1, 2, 3]) AS exact
FROM x GROUP BY package""")
def version_range_join(t: Tables):
    rows, v = versions(t), F.col("version")
    specs = {"caret": "^1.2.0", "tilde": "~1.2.3", "either": "&lt;1.4.0 || >=3.0.0", "prefix": "2.x", "hyphen": "0.5.0 - 1.7", "above": ">1.2", "upto": "<= 1.2", "caret_zero": "^0", "tilde_one": "~1", "exact": "=1.2.3"}
    return rows.groupBy("package").agg(F.count(F.lit(1)).alias("versions"), *[F.count_if(V.in_range(v, s)).alias(n) for n, s in specs.items()])


@query(r"""
WITH s AS (SELECT nullif(regexp_extract(regexp_replace(regexp_replace(lower(url), '^[a-z]+://(www\.)?', ''), '[?#].*$', ''), '^([^/]+/[^/]+)', 1), '') AS site FROM pages)
SELECT site, count(*) AS pages FROM s GROUP BY site""")
def repo_canonical(t: Tables):
    return t.pages.groupBy(T.site(F.col("url")).alias("site")).agg(F.count(F.lit(1)).alias("pages"))


@query(r"""
WITH p AS (SELECT replace(replace(url, '.html', '.ts'), 'blog.', 'test.') AS path FROM pages),
r AS (SELECT CASE WHEN NOT regexp_matches(lower(path), '\.(js|jsx|mjs|cjs|ts|tsx|mts|cts)$') THEN 'not_source' WHEN regexp_matches(lower(path), '\.d\.ts$') THEN 'declaration'
  WHEN regexp_matches(lower(path), '\.(min|bundle)\.') THEN 'generated' WHEN regexp_matches(lower(path), 'test|spec|example|fixture|vendor|node_modules|dist/') THEN 'not_production' ELSE 'admitted' END AS reason_code FROM p)
SELECT reason_code, count(*) AS n FROM r GROUP BY 1""")
def production_filter(t: Tables):
    path = F.replace(F.replace(F.col("url"), F.lit(".html"), F.lit(".ts")), F.lit("blog."), F.lit("test."))
    return C.attrition(t.pages.select(T.file_problem(path).alias("reason_code")))


@query(r"""
WITH k AS (SELECT doc_id, regexp_extract_all(text, '([A-Za-z_$][A-Za-z0-9_$]*|[0-9]+(?:[.][0-9]+)?|[^\sA-Za-z0-9_$])', 1) AS tokens FROM documents)
SELECT doc_id, len(tokens) AS n_tokens, sha256(array_to_string(tokens, ' ')) AS token_hash FROM k""")
def token_form(t: Tables):
    k = t.documents.select("doc_id", F.explode(F.array(T.tokens(F.col("text")))).alias("tokens"))
    return k.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), T.digest(F.array_join("tokens", " ")).alias("token_hash"))


@query(r"""
WITH k AS (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Za-z_$][A-Za-z0-9_$]*|[0-9]+(?:[.][0-9]+)?|[^\sA-Za-z0-9_$])', 1)) AS tok FROM documents)
SELECT doc_id, count(*) FILTER (WHERE regexp_matches(tok, '^[A-Za-z_$]') AND NOT kw) AS identifiers, count(*) FILTER (WHERE regexp_matches(tok, '^[0-9"''`]')) AS literals, count(*) FILTER (WHERE kw) AS keywords
FROM (SELECT *, tok IN ('if','else','for','while','do','switch','case','default','break','continue','return','function','class','const','let','var','new','try','catch','finally','throw','typeof','instanceof','in','of','await','async','yield','this','super','null','true','false','undefined','delete','void','import','export','extends') AS kw FROM k) GROUP BY doc_id""")
def role_tokens(t: Tables):
    r = t.documents.select("doc_id", F.explode(F.array(T.roles(T.tokens(F.col("text"))))).alias("roles")).where("size(roles) > 0")

    def count(test):
        return F.size(F.filter("roles", test)).cast("long")

    return r.select("doc_id", count(lambda x: x == "ID").alias("identifiers"), count(lambda x: x == "LIT").alias("literals"), count(lambda x: x.isin(T.KEYWORDS)).alias("keywords"))


@query("""
SELECT source AS repo, lang AS language, count(*) AS members, min(doc_id) AS representative, array_to_string(list_sort(list(DISTINCT CAST(quality AS VARCHAR) || CAST(toxic AS VARCHAR))), ',') AS aliases
FROM documents JOIN labels USING (doc_id) GROUP BY ALL""")
def cluster_entries(t: Tables):
    rows = labelled(t).withColumn("alias", F.concat("quality", "toxic")).withColumn("key", F.concat_ws("|", "source", "lang"))
    c = L.cluster(rows, "key", ["doc_id"], ["alias"])
    return c.select(F.substring_index("key", "|", 1).alias("repo"), F.substring_index("key", "|", -1).alias("language"), "members", F.col("representative.doc_id").alias("representative"), F.array_join("aliases.alias", ",").alias("aliases"))


@query("""
WITH old AS (SELECT source, lang, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL), new AS (SELECT source, lang, count(*) AS n FROM documents WHERE doc_id % 2 = 1 AND lang <> 'en' GROUP BY ALL)
SELECT * FROM new UNION ALL SELECT old.* FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.source = old.source AND new.lang = old.lang)""")
def store_upsert(t: Tables):
    part = lambda i: t.documents.where(F.col("doc_id") % 2 == i).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return C.upsert(part(0), part(1).where("lang <> 'en'"), ["source", "lang"])


@query("""
WITH r AS (SELECT o_custkey AS sha, 1 + o_custkey % 2 AS parents, o_orderkey % 7 > 0 AS prod, o_orderkey % 60 AS changed FROM orders),
a AS (SELECT sha, max(parents) AS parents, sum(prod::INT) AS files, sum(CASE WHEN prod THEN changed ELSE 0 END) AS changed FROM r GROUP BY sha)
SELECT CASE WHEN parents <> 1 THEN 'not_single_parent' WHEN files = 0 THEN 'no_production_file' WHEN files > 3 THEN 'too_many_files' WHEN changed > 150 THEN 'too_large' ELSE 'admitted' END AS reason_code, count(*) AS n FROM a GROUP BY 1""")
def diff_cleanliness(t: Tables):
    files = t.orders.select(
        F.col("o_custkey").alias("sha"), (1 + F.col("o_custkey") % 2).alias("parents"), F.when(F.col("o_orderkey") % 7 > 0, "src/a.js").otherwise("test/a.js").alias("path"), (F.col("o_orderkey") % 60).alias("changed_lines")
    )
    return C.attrition(C.diff_problem(files))
