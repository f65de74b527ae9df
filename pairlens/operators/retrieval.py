"""Nearest vectors: exact top-K over blocks of queries, and what is made of the hits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import halving

#: Vectors of either side that one task compares at most, in expectation; of the corpus it holds a slice at a time.
BLOCK = 4096
SLICE = 512


def top_k(queries: DataFrame, corpus: DataFrame, k: int, vector: str = "vector", key: str = "id", threshold: float | None = None, exclude_self: bool = False, eligible: Column | None = None, block: int = BLOCK) -> DataFrame:
    """For each query its ``k`` most similar rows of the corpus: ``query_id, id, similarity, rank``.

    Both sides are dealt into blocks by a hash of their keys, and every block of queries meets every block of
    the corpus in a task of its own, which multiplies them and keeps the best ``k`` of each query; a window over
    those picks the last ones.  So neither side passes the driver, a task holds two blocks, and an exchange
    carries each query once per block of the corpus and each row of the corpus once per block of queries.
    Similarity is the inner product, rounded to nine places; ties go to the smaller id.  ``eligible`` is applied
    before the search (rows that fail take no place), ``threshold`` after it.  Null vectors are left out.
    """
    import numpy as np

    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(key).cast("long").alias(name), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")

    asked, pool = rows(queries, "query_id"), rows(corpus.where(eligible) if eligible is not None else corpus, "id")
    n, m = asked.count(), pool.count()
    # small searches are spread over the tasks there are
    tasks = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked_blocks, pool_blocks = max(1, -(-n // block)), max(1, -(-m // block), min(tasks, -(-m // SLICE)))
    left = asked.select("*", F.pmod(F.xxhash64("query_id"), F.lit(asked_blocks)).cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(pool_blocks - 1))).alias("b"))
    right = pool.select("*", F.explode(F.sequence(F.lit(0), F.lit(asked_blocks - 1))).alias("a"), F.pmod(F.xxhash64("id"), F.lit(pool_blocks)).cast("int").alias("b"))

    def best(wanted, given):
        import pyarrow as pa

        def matrix(table):
            return np.asarray(table["v"].combine_chunks().flatten(), dtype=np.float64).reshape(table.num_rows, -1)

        names = ["query_id", "id", "similarity"]
        if not wanted.num_rows or not given.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        ids, own, x, y = wanted["query_id"].to_numpy(), given["id"].to_numpy(), matrix(wanted), matrix(given)
        scores, found = np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), dtype=np.int64)
        for at in range(0, len(own), SLICE):
            some = own[at : at + SLICE]
            new = np.round(x @ y[at : at + SLICE].T, 9)
            if exclude_self:
                new[ids[:, None] == some[None, :]] = -np.inf
            scores, found = np.hstack([scores, new]), np.hstack([found, np.broadcast_to(some, new.shape)])
            order = np.lexsort((found, -scores), axis=1)[:, :k]
            scores, found = np.take_along_axis(scores, order, 1), np.take_along_axis(found, order, 1)
        keep = np.isfinite(scores).ravel()
        return pa.table([pa.array(np.repeat(ids, scores.shape[1])[keep]), pa.array(found.ravel()[keep]), pa.array(scores.ravel()[keep])], names=names)

    out = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(best, "query_id long, id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    ranked = out.select("*", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)
    return ranked.where(F.col("similarity") >= threshold) if threshold is not None else ranked


def group_by_pair(hits: DataFrame, query: str = "query_id", pair: str = "pair_id", best: int = 5, limit: int = 5) -> DataFrame:
    """Hits grouped by pair: best similarity, support, the ``best`` top ids; the first ``limit`` pairs by (-best, -support, pair)."""
    agg = hits.groupBy(query, pair).agg(
        F.max("similarity").alias("best_similarity"), F.count(F.lit(1)).alias("support"), F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "id"))), 1, best).alias("t")
    )
    w = Window.partitionBy(query).orderBy(F.desc("best_similarity"), F.desc("support"), pair)
    rows = agg.select(query, pair, "best_similarity", "support", F.col("t.id").alias("top_ids"), F.row_number().over(w).alias("pair_rank"))
    return rows.where(F.col("pair_rank") <= limit)


#: Encoders by id: functions of a text column.
ENCODERS = {
    "hashing-64": lambda text: hashing_vector(F.split(text, r"\s+"), 64),
    "hashing-256": lambda text: hashing_vector(F.split(text, r"\s+"), 256),
}


def encoder(model: str):
    if model not in ENCODERS:
        raise ValueError(f"no such encoder: {model}")
    return ENCODERS[model]


def batch_encoder(run, size: int = 64):
    """An encoder from a model's ``run(list of texts)``, which returns a list of vectors: Arrow batches, in slices that are halved where memory runs out."""

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in v] for v in halving(run, texts.fillna("").tolist(), size)], dtype=object)

    return lambda text: encode(text)


def hashing_vector(words: Column, size: int = 64) -> Column:
    """A stand-in encoder: signed feature hashing of words, L2-normalised."""
    slots = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(size)).cast("int").alias("i"), (F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) * 2 - 1).cast("double").alias("s")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(F.filter(slots, lambda x: x["i"] == i), F.lit(0.0), lambda a, x: a + x["s"]))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(raw, lambda x: F.when(norm > 0, x / norm).otherwise(0.0).cast("float"))
