"""Queries of incremental state, review and reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import state as S
from .registry import Tables, query

FILES_SQL = "SELECT source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.js' AS path, sha256(text) AS hash FROM documents"


def files(t: Tables):
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".js")))
    return S.file_hashes(t.documents.select(path.alias("path"), F.col("text").alias("content")))


@query(FILES_SQL)
def merkle_files(t: Tables):
    return files(t)


@query(f"""
WITH f AS ({FILES_SQL}), l2 AS (SELECT regexp_replace(path, '/[^/]*$', '') AS path, sha256(string_agg('file' || chr(0) || split_part(path, '/', 3) || chr(0) || hash, chr(10) ORDER BY split_part(path, '/', 3))) AS hash FROM f GROUP BY 1),
l1 AS (SELECT split_part(path, '/', 1) AS path, sha256(string_agg('dir' || chr(0) || split_part(path, '/', 2) || chr(0) || hash, chr(10) ORDER BY split_part(path, '/', 2))) AS hash FROM l2 GROUP BY 1),
l0 AS (SELECT '' AS path, sha256(string_agg('dir' || chr(0) || path || chr(0) || hash, chr(10) ORDER BY path)) AS hash FROM l1)
SELECT * FROM l2 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l0""")
def merkle_dirs(t: Tables):
    return S.merkle(files(t))


@query(f"""
WITH f AS ({FILES_SQL}), b AS (SELECT * FROM f WHERE hash < 'd'), a AS (SELECT path, CASE WHEN path LIKE '%7.js' THEN sha256(hash) ELSE hash END AS hash FROM f WHERE hash > '3')
SELECT path, CASE WHEN b.hash IS NULL THEN 'added' WHEN a.hash IS NULL THEN 'deleted' ELSE 'changed' END AS state FROM b FULL JOIN a USING (path) WHERE a.hash IS DISTINCT FROM b.hash""")
def changed_deleted(t: Tables):
    f = files(t)
    after = f.where("hash > '3'").select("path", F.when(F.col("path").endswith("7.js"), F.sha2("hash", 256)).otherwise(F.col("hash")).alias("hash"))
    return S.changes(f.where("hash < 'd'"), after)


@query("""
WITH f AS (SELECT doc_id, sha256(text) AS h FROM documents), c AS (SELECT h, min(doc_id) AS cached_from FROM f WHERE doc_id % 3 = 0 GROUP BY h)
SELECT doc_id, cached_from, cached_from IS NOT NULL AS reused FROM f LEFT JOIN c USING (h)""")
def cache_reuse(t: Tables):
    f = t.documents.select("doc_id", T.digest(F.col("text")).alias("function_hash"))
    cached = f.where("doc_id % 3 = 0").groupBy("function_hash").agg(F.min("doc_id").alias("cached_from"))
    done, work = S.reuse(f, cached)
    return done.select("doc_id", "cached_from", F.lit(True).alias("reused")).union(work.select("doc_id", F.lit(None).cast("long"), F.lit(False)))


@query("""
WITH d AS (SELECT doc_id AS id, source AS path, CAST(doc_id AS VARCHAR) AS function_id, 'f' || CAST(doc_id % 4 AS VARCHAR) AS file_hash, 'h' || CAST(doc_id % 5 AS VARCHAR) AS function_hash, 's' || CAST(quality AS VARCHAR) AS signature, doc_id * 10 AS dismissed_at FROM documents JOIN labels USING (doc_id)),
c AS (SELECT source AS path, CAST(doc_id AS VARCHAR) AS function_id, 'f1' AS file_hash, CASE WHEN doc_id % 7 > 0 THEN 'h' || CAST(doc_id % 5 + CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END AS VARCHAR) END AS function_hash, CASE WHEN doc_id % 4 > 0 THEN 's1' END AS signature, source <> 'src5' AS scanned FROM documents WHERE source <> 'src3' AND doc_id % 9 > 0),
f AS (SELECT path, max(file_hash) AS fh, bool_or(scanned) AS sc FROM c GROUP BY path)
SELECT d.id, d.path, d.function_id, CASE WHEN fh IS NULL THEN 'file_missing' WHEN fh <> d.file_hash THEN 'file_changed' WHEN NOT sc THEN 'scan_unavailable' WHEN c.function_hash IS NULL OR c.signature IS NULL THEN 'no_longer_present'
  WHEN c.function_hash <> d.function_hash THEN 'function_changed' WHEN c.signature <> d.signature THEN 'finding_changed' ELSE 'dismissed' END AS status, d.dismissed_at
FROM d LEFT JOIN f ON d.path = f.path LEFT JOIN c ON d.path = c.path AND d.function_id = c.function_id""")
def dismissal_status(t: Tables):
    k, s = F.col("doc_id"), lambda c: c.cast("string")
    d = t.documents.join(t.labels, "doc_id").select(
        k.alias("id"), F.col("source").alias("path"), s(k).alias("function_id"), F.concat(F.lit("f"), s(k % 4)).alias("file_hash"), F.concat(F.lit("h"), s(k % 5)).alias("function_hash"), F.concat(F.lit("s"), s(F.col("quality"))).alias("signature"), (k * 10).alias("dismissed_at")
    )
    c = t.documents.where("source <> 'src3' AND doc_id % 9 > 0").select(
        F.col("source").alias("path"), s(k).alias("function_id"), F.lit("f1").alias("file_hash"), F.when(k % 7 > 0, F.concat(F.lit("h"), s(k % 5 + F.when(k % 6 == 0, 1).otherwise(0)))).alias("function_hash"), F.when(k % 4 > 0, "s1").alias("signature"), (F.col("source") != "src5").alias("scanned")
    )
    return S.dismissal_status(d, c)


@query(r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(lower(url), '^[a-z]+://', ''), '[?#].*$', '') AS path, url FROM pages),
m AS (SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS folder, bool_or(page_id % 3 = 0) AS declared FROM p GROUP BY 1 UNION ALL SELECT split_part(path, '/', 1), FALSE FROM p GROUP BY 1)
SELECT path, arg_max(folder, length(folder)) AS folder, CASE WHEN arg_max(declared, length(folder)) AND bool_or(url LIKE '%page=%' OR url LIKE '%html%') THEN 'confirmed' ELSE 'unknown' END AS applicability
FROM p JOIN m ON starts_with(p.path, m.folder || '/') GROUP BY path""")
def applicability(t: Tables):
    path = F.regexp_replace(F.regexp_replace(F.lower("url"), "^[a-z]+://", ""), "[?#].*$", "")
    p = t.pages.select("page_id", path.alias("path"), "url")
    host, part = F.substring_index("path", "/", 1), F.substring_index("path", "/", 2)
    m = p.groupBy(part.alias("folder")).agg(F.bool_or(F.col("page_id") % 3 == 0).alias("declared")).union(p.select(host, F.lit(False)).distinct())
    use = p.groupBy("path").agg(F.bool_or(F.contains("url", F.lit("page=")) | F.contains("url", F.lit("html"))).alias("imported"))
    rows = S.owning_manifest(p.select("path").distinct(), m).join(use, "path")
    return rows.select("path", "folder", S.applicability(F.col("declared"), F.col("imported"), F.lit(False), F.lit(False)).alias("applicability"))


@query("""
WITH c AS (SELECT source, lang, min(doc_id) AS first_doc, count(*) AS n FROM documents WHERE doc_id % 4 > 0 GROUP BY ALL)
SELECT d.doc_id, coalesce(c.first_doc, -1) AS advisory, coalesce(c.n, 0) AS known, CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END AS priority_class,
  CAST(row_number() OVER (PARTITION BY d.source ORDER BY CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END, n_chars DESC, d.doc_id) AS INT) AS place
FROM documents d JOIN labels USING (doc_id) LEFT JOIN c ON d.source = c.source AND d.lang = c.lang""")
def enrich_left_join(t: Tables):
    from pyspark.sql import Window

    c = t.documents.where("doc_id % 4 > 0").groupBy("source", "lang").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n"))
    cls = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    rows = t.documents.drop("text").join(t.labels, "doc_id").join(c, ["source", "lang"], "left").withColumn("priority_class", cls)
    place = F.row_number().over(Window.partitionBy("source").orderBy("priority_class", F.desc("n_chars"), "doc_id"))
    return rows.select("doc_id", F.coalesce("first_doc", F.lit(-1)).alias("advisory"), F.coalesce("n", F.lit(0)).alias("known"), "priority_class", place.alias("place"))
