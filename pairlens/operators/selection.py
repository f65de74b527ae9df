"""Choosing cases: without leakage between splits, diverse, and stratified."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components


def leakage_groups(cases: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """Cases that share any token (advisory, fix, source or syntax) directly or through others get one group.

    Each case hangs on its tokens' first case, so a token that a third of all cases has makes a star, no pairs.
    """
    rows = cases.select(F.col(key).alias("case"), F.explode(tokens).alias("token"))
    first = rows.groupBy("token").agg(F.min("case").alias("v"))
    found = components(rows.join(first, "token").select(F.col("case").alias("u"), "v"), "leakage")
    return cases.select(key).join(found.select(F.col("node").alias(key), "root"), key, "left").select(key, F.coalesce("root", key).alias("group"))


def split_groups(cases: DataFrame, groups: DataFrame, key: str, stratum: str, share: float = 0.3) -> DataFrame:
    """Whole groups to the tuning split, in order of their digest, until each stratum has its share.

    A group belongs to the stratum that most of its cases are in.
    """
    sized = cases.join(groups, key).groupBy("group", stratum).agg(F.count(F.lit(1)).alias("n"))
    home = sized.groupBy("group").agg(F.max_by(stratum, F.struct("n", stratum)).alias("home"), F.sum("n").alias("n"))
    order = Window.partitionBy("home").orderBy(F.sha2(F.col("group").cast("string"), 256), "group")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy("home"))
    return home.select("group", "home", "n", F.when(before + F.col("n") <= F.ceil(total * share), "tuning").otherwise("evaluation").alias("split"))


def pilot(rows: DataFrame, strata: list[str], order: str, limit: int) -> DataFrame:
    """One case of every stratum per turn, up to ``limit`` cases in all."""
    turned = rows.select("*", F.row_number().over(Window.partitionBy(*strata).orderBy(order)).alias("turn"))
    few = turned.where(F.col("turn") <= limit)
    return few.orderBy("turn", *strata, order).limit(limit)


def diverse(rows: list[dict], limit: int, package_cap: int = 3, advisory_cap: int = 1) -> list[dict]:
    """Greedy choice from a bounded list: languages in balance, caps per package and advisory, ties by digest."""
    import hashlib
    from collections import Counter

    left = sorted(rows, key=lambda r: hashlib.sha256(str(r["id"]).encode()).hexdigest())
    out: list[dict] = []
    counts = {k: Counter() for k in ("language", "package", "advisory")}
    while len(out) < limit:
        open_ = [r for r in left if counts["package"][r["package"]] < package_cap and counts["advisory"][r["advisory"]] < advisory_cap]
        if not open_:
            break
        r = min(open_, key=lambda r: counts["language"][r["language"]])
        left.remove(r)
        out.append(r)
        for k, c in counts.items():
            c[r[k]] += 1
    return out
