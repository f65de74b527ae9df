"""Evaluation: outcomes, metrics, ablations, and selection of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outcome(expected: Column, priority: Column) -> Column:
    """Six outcomes from the expected label (flagged or cleared) and what was done."""
    flagged = expected == "flagged"
    return (
        F.when(priority == "automatic_vulnerability", F.when(flagged, "true_positive").otherwise("false_positive"))
        .when(priority == "manual_review", F.when(flagged, "abstained_positive").otherwise("abstained_negative"))
        .otherwise(F.when(flagged, "false_negative").otherwise("true_negative"))
    )


def share(numerator: Column, denominator: Column) -> Column:
    """Null where the denominator is zero."""
    return F.round(F.try_divide(numerator.cast("double"), denominator.cast("double")), 6)


def verification_metrics(rows: DataFrame, group: list[str] | None = None, name: str = "outcome") -> DataFrame:
    """Recall and false-positive rate over decided cases; abstentions have a rate of their own; excluded rows don't count."""
    n = lambda v: F.count_if(F.col(name) == v)
    tp, fn, fp, tn, ap, an = (n(v) for v in ("true_positive", "false_negative", "false_positive", "true_negative", "abstained_positive", "abstained_negative"))
    return rows.where(~F.col(name).startswith("excluded")).groupBy(*(group or [])).agg(
        F.count(F.lit(1)).alias("cases"), share(tp, tp + fn).alias("recall"), share(fp, fp + tn).alias("false_positive_rate"), share(tp, tp + fp).alias("precision"), share(ap + an, F.count(F.lit(1))).alias("abstention_rate")
    )


def opinion_metrics(rows: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Second opinions (``opinion``: vulnerable, patched, abstained, manual_review or null): how many, how many
    decide, their accuracy against ``expected``, and the recall over flagged cases with what they add to ``outcome``.

    Excluded cases have no part in the recall, which is null where there is no opinion at all.
    """
    given, says = F.col("opinion").isNotNull(), F.coalesce(F.col("opinion") == "vulnerable", F.lit(False))
    decides = given & ~F.col("opinion").isin("abstained", "manual_review")
    flagged = F.col("expected") == "flagged"
    counted = flagged & ~F.col("outcome").startswith("excluded")
    agg = rows.groupBy(*(group or [])).agg(
        F.count_if(given).alias("opinions"), F.count_if(decides).alias("decided"), F.count_if(given & ~decides).alias("abstained"),
        share(F.count_if(decides & (says == flagged)), F.count_if(decides)).alias("accuracy"),
        share(F.count_if(counted & ((F.col("outcome") == "true_positive") | says)), F.count_if(counted)).alias("recall"),
    )
    return agg.withColumn("adjusted_recall", F.when(F.col("opinions") > 0, F.col("recall"))).drop("recall")


def origin_rates(rows: DataFrame, flags: list[str]) -> DataFrame:
    """Rates of a run, one row per measure: count, denominator, rate (null over no cases).

    ``rows``: expected, abstained, by_hash, found, correct, false_alarm, and further ``flags``.  Each is given over
    all labelled cases; ``correct`` and ``false_alarm`` also over their own label, with and without abstentions,
    and ``found`` for hash and other cases apart.
    """
    every, flagged, cleared = F.lit(True), F.col("expected") == "flagged", F.col("expected") == "cleared"
    measures = [(f, f, every) for f in ("found", *flags, "abstained")]
    for name, label in (("correct", flagged), ("false_alarm", cleared)):
        measures += [(name, name, label), (f"{name}_decided", name, label & ~F.col("abstained")), (f"{name}_of_all", name, every)]
    measures += [("found_by_hash", "found", F.col("by_hash")), ("found_otherwise", "found", ~F.col("by_hash"))]
    counts = rows.agg(*[F.struct(F.count_if(of & F.col(flag)).alias("n"), F.count_if(of).alias("cases")).alias(name) for name, flag, of in measures])
    lines = F.array(*[F.struct(F.lit(name).alias("measure"), F.col(name)["n"].alias("n"), F.col(name)["cases"].alias("cases")) for name, _, _ in measures])
    return counts.select(F.inline(lines)).select("*", share(F.col("n"), F.col("cases")).alias("rate"))


def effective_rank(rank: Column, hash_hit: Column) -> Column:
    """A hash hit is rank 1."""
    return F.when(hash_hit, 1).otherwise(rank)


def retrieval_metrics(rows: DataFrame, group: list[str] | None = None, rank: str = "rank", ks: tuple = (1, 5, 10)) -> DataFrame:
    """Recall at k and mean reciprocal rank; misses (null ranks) stay in the denominators."""
    n = F.count(F.lit(1))
    return rows.groupBy(*(group or [])).agg(
        n.alias("cases"), *[share(F.count_if(F.col(rank) <= k), n).alias(f"recall_at_{k}") for k in ks], share(F.sum(F.coalesce(1.0 / F.col(rank), F.lit(0.0))), n).alias("mrr"), F.count_if(F.col(rank).isNull()).alias("misses")
    )


def funnel(rows: DataFrame, stages: list[str], group: list[str] | None = None) -> DataFrame:
    """How many cases pass each flag and all before it."""
    passed, out = F.lit(True), []
    for s in stages:
        passed = passed & F.coalesce(F.col(s), F.lit(False))
        out.append(F.count_if(passed).alias(s))
    return rows.groupBy(*(group or [])).agg(F.count(F.lit(1)).alias("cases"), *out)


def nearest_rank(rows: DataFrame, value: str, group: list[str], p: float = 0.95, variant: str = "ceil") -> DataFrame:
    """The p-quantile by place: ``ceil(p n)`` or ``min(n, floor(p n) + 1)``, 1-based.

    Found from counts of distinct values, so no group is collected.
    """
    counts = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*group).orderBy(value)
    ranked = counts.select("*", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("c").over(Window.partitionBy(*group)).alias("n"))
    place = F.ceil(F.col("n") * p) if variant == "ceil" else F.least(F.col("n"), F.floor(F.col("n") * p) + 1)
    return ranked.where((F.col("upto") >= place) & (F.col("upto") - F.col("c") < place)).select(*group, F.col(value).alias("quantile"))


def pareto(rows: DataFrame, key: str, maximise: list[str], minimise: list[str]) -> DataFrame:
    """Rows that none other dominates: at least as good in all objectives and better in one.

    Each partition drops what its own rows dominate, in passes over Arrow batches, and partitions are
    merged eight by eight, so the last pass sees frontier rows only.  Equal rows stay side by side.
    """
    objectives = [*maximise, *minimise]

    def frontier(values):
        import numpy as np

        # a row that dominates another has a greater sum
        kept = np.zeros((0, values.shape[1]))
        chosen: list[int] = []
        for i in np.argsort(-values.sum(axis=1), kind="stable").tolist():
            v = values[i]
            if not ((kept >= v).all(axis=1) & (kept > v).any(axis=1)).any():
                kept = np.vstack([kept, v])
                chosen.append(i)
        return chosen

    def local(frames):
        import numpy as np
        import pandas as pd

        held = None
        for pdf in frames:
            held = pdf if held is None else pd.concat([held, pdf])
            values = np.hstack([held[maximise].to_numpy(dtype=float), -held[minimise].to_numpy(dtype=float)])
            held = held.iloc[frontier(values)]
        if held is not None:
            yield held

    few = rows.select(key, *objectives)
    parts = few.rdd.getNumPartitions()
    few = few.mapInPandas(local, few.schema)
    while parts > 1:
        parts = -(-parts // 8)
        few = few.coalesce(parts).mapInPandas(local, few.schema)
    return few


def sweep(baseline: dict[str, float], experiments: DataFrame) -> DataFrame:
    """Settings of all experiments, ``(experiment, settings map)`` laid over the baseline, each distinct one once."""
    base = F.create_map(*[F.lit(x) for kv in sorted(baseline.items()) for x in kv])
    merged = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key("settings", k)), "settings")
    rows = experiments.select("experiment", F.array_sort(F.map_entries(merged)).alias("settings"))
    return rows.groupBy(F.sha2(F.to_json("settings"), 256).alias("digest")).agg(F.min("experiment").alias("experiment"), F.first("settings").alias("settings"))


def round_robin(rows: DataFrame, group: str, order: str, cap: str | None = None, cap_limit: int = 10) -> DataFrame:
    """Turns: the first row of every group, then the second of every group, and so on; at most ``cap_limit`` rows per value of ``cap``."""
    turned = rows.select("*", F.row_number().over(Window.partitionBy(group).orderBy(order)).alias("turn"))
    if cap:
        turned = turned.select("*", F.row_number().over(Window.partitionBy(cap).orderBy("turn", group, order)).alias("_c")).where(F.col("_c") <= cap_limit).drop("_c")
    return turned


def bounded_selection(rows: DataFrame, group: list[str], order: list, weight: str, cap: int, required: Column | None = None) -> DataFrame:
    """Rows in order until the weights before them reach ``cap`` (the one that crosses it is kept), and all required ones."""
    first = [F.desc(required)] if required is not None else []
    before = F.coalesce(F.sum(weight).over(Window.partitionBy(*group).orderBy(*first, *order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = rows.select("*", before.alias("before"))
    keep = F.col("before") < cap
    return chosen.where(keep | required if required is not None else keep)


def nearest_control(cases: DataFrame, controls: DataFrame, group: str, key: str, control: str, value: str, kind: str, width: int, weight: int) -> DataFrame:
    """For each case the control of its group at the least distance, ties to the smaller key.

    The distance is the difference of ``value`` in whole ``width`` plus ``weight`` times that of ``kind``, of which a group
    has few; both are integers.  It is null where a value is, and such controls come last.

    No pairs are made: for each kind the nearest values on both sides of a case's value give the least distance, and the
    controls at that distance have one of ``2 * width`` values, which are looked up.  Windows run over distinct values.
    """
    known = controls.select(group, control, F.col(kind).cast("long").alias("_k"), F.col(value).cast("long").alias("_m"))
    asking = cases.select(key, group, F.col(value).cast("long").alias("_n"), F.col(kind).cast("long").alias("_d"))
    points = known.where("_m IS NOT NULL").groupBy(group, "_k", "_m").agg(F.min(control).alias(control))
    asked = asking.select(group, "_n", "_d").dropna().distinct()
    wanted = asked.select(group, "_n").distinct().join(points.select(group, "_k").distinct(), group)
    marks = wanted.select(group, "_k", F.col("_n").alias("_v"), F.lit(None).cast("long").alias("_m"), F.lit(True).alias("_asked"))
    marks = marks.union(points.select(group, "_k", "_m", "_m", F.lit(False))).groupBy(group, "_k", "_v").agg(F.max("_m").alias("_m"), F.max("_asked").alias("_asked"))
    rows = Window.partitionBy(group, "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sides = marks.withColumn("_below", F.max("_m").over(rows.orderBy("_v"))).withColumn("_above", F.min("_m").over(rows.orderBy(F.desc("_v")))).where("_asked")
    near = sides.select(group, "_k", F.col("_v").alias("_n"), F.expr(f"least(_v - _below, _above - _v) div {width}").alias("_q"))
    each = asked.join(near, [group, "_n"]).withColumn("_t", F.col("_q") + weight * F.abs(F.col("_d") - F.col("_k")))
    best = each.groupBy(group, "_n", "_d").agg(F.min("_t").alias("_t"), F.collect_list(F.struct("_t", "_k", "_q")).alias("_all"))
    best = best.select(group, "_n", "_d", "_t", F.inline(F.expr("transform(filter(_all, x -> x._t = _t), x -> struct(x._k AS _k, x._q AS _q))")))
    spots = F.expr(f"concat(sequence(_n + _q * {width}, _n + _q * {width} + {width - 1}), sequence(_n - _q * {width} - {width - 1}, _n - _q * {width}))")
    found = best.select(group, "_n", "_d", "_t", "_k", F.explode(spots).alias("_m")).join(points, [group, "_k", "_m"]).groupBy(group, "_n", "_d", "_t").agg(F.min(control).alias("_found"))
    least = known.groupBy(group).agg(F.min(control).alias("_least"))
    chosen = asking.join(least, group).join(found, [group, "_n", "_d"], "left").select(key, F.struct(F.col("_t").isNull(), "_t", F.coalesce("_found", "_least").alias("_c")).alias("_b"))
    return chosen.groupBy(key).agg(F.min("_b").alias("_b")).select(key, F.col("_b._c").alias(control), F.col("_b._t").alias("distance"))


def complete_pairs(rows: DataFrame, pair: str, label: str, labels: tuple[str, str], accepted: str, source: str) -> DataFrame:
    """Pairs with both labels, all accepted, and no source shared with another pair."""
    owners = rows.groupBy(source).agg(F.countDistinct(pair).alias("owners"))
    agg = rows.join(owners, source).groupBy(pair).agg(
        F.count_if(F.col(label) == labels[0]).alias("a"), F.count_if(F.col(label) == labels[1]).alias("b"), F.bool_and(accepted).alias("accepted"), F.max("owners").alias("owners")
    )
    reason = F.when((F.col("a") == 0) | (F.col("b") == 0), "incomplete_pair").when(~F.col("accepted"), "not_accepted").when(F.col("owners") > 1, "source_shared").otherwise("admitted")
    return agg.select(pair, reason.alias("reason_code"))


def transitions(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Histogram of ``before -> after``."""
    rows = before.select(key, F.col(value).alias("b")).join(after.select(key, F.col(value).alias("a")), key)
    return rows.groupBy(F.concat("b", F.lit(" -> "), "a").alias("transition")).agg(F.count(F.lit(1)).alias("n"))


def three_way(vulnerable_ran: Column, patched_ran: Column, originals_differ: Column, equals_side: Column) -> Column:
    """Outcome of running both originals and a candidate."""
    return F.when(~(vulnerable_ran & patched_ran), "originals_failed").when(~originals_differ, "not_distinguishing").when(equals_side, "behaviour_confirmed").otherwise("behaviour_changed")


def expected_rank(hits: DataFrame, expected: DataFrame, case: str = "case_id", identity: list[str] | None = None) -> DataFrame:
    """First rank at which a case's expected origin, or an alias of it, was found; null for misses."""
    identity = identity or ["origin"]
    found = hits.join(expected, [case, *identity], "left_semi").groupBy(case).agg(F.min("rank").alias("rank"))
    return expected.select(case).distinct().join(found, case, "left")


def tool_scores(cases: DataFrame, executions: DataFrame, findings: DataFrame) -> DataFrame:
    """Per tool: detections and false alarms of completed runs; failures and untouched targets apart.

    ``cases``: case_id, expected, path, start_line, end_line, cwe.  ``executions``: tool, case_id,
    completed, target_extracted.  ``findings``: tool, case_id, path, start_line, end_line, cwe.
    A finding counts where it overlaps the target's lines and names its weakness.
    """
    hit = findings.select("tool", "case_id", F.col("path").alias("p"), F.col("start_line").alias("a"), F.col("end_line").alias("b"), F.col("cwe").alias("c"))
    on = (F.col("p") == F.col("path")) & (F.col("a") <= F.col("end_line")) & (F.col("b") >= F.col("start_line")) & (F.col("c") == F.col("cwe"))
    flagged = hit.join(cases, "case_id").where(on).select("tool", "case_id").distinct().withColumn("flagged", F.lit(True))
    rows = executions.join(cases, "case_id").join(flagged, ["tool", "case_id"], "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))
    done, pos = F.col("completed"), F.col("expected") == "flagged"
    return rows.groupBy("tool").agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(~done).alias("errors"),
        share(F.count_if(done & F.col("target_extracted")), F.count_if(done)).alias("coverage"),
        share(F.count_if(done & pos & F.col("flagged")), F.count_if(done & pos)).alias("recall"),
        share(F.count_if(done & ~pos & F.col("flagged")), F.count_if(done & ~pos)).alias("false_alarm_rate"),
    )


def study_metrics(rows: DataFrame, group: list[str]) -> DataFrame:
    """One line per arm: decisions, reviews, ranks and costs of its cases (``expected, priority, rank, regions, seconds``)."""
    o = rows.withColumn("outcome", outcome(F.col("expected"), F.col("priority")))
    n = lambda v: F.count_if(F.col("outcome") == v)
    tp, fn, fp, tn = n("true_positive"), n("false_negative"), n("false_positive"), n("true_negative")
    all_ = F.count(F.lit(1))
    return o.groupBy(*group).agg(
        all_.alias("cases"), share(tp, tp + fn).alias("recall"), share(tp, tp + fp).alias("precision"), share(fp, fp + tn).alias("false_positive_rate"), share(n("abstained_positive") + n("abstained_negative"), all_).alias("review_rate"),
        share(F.count_if(F.col("rank") <= 5), all_).alias("recall_at_5"), share(F.sum(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), all_).alias("mrr"), F.round(F.avg("regions"), 6).alias("mean_regions"), F.round(F.sum("seconds"), 4).alias("seconds"),
    )
