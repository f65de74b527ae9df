"""Boundary verdicts from structural (S), token (T) and edit (E) scores, priorities and fallbacks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import DisjointSpans


@dataclass(frozen=True)
class Thresholds:
    structure: float = 0.70
    token: float = 0.70
    edit_side: float = 0.90
    edit_margin: float = 0.10
    signature: float = 0.65


#: Weight of a region's granularity.
WEIGHTS = {"changed": 4, "block": 3, "context": 2, "function": 1}


def best_rows(evidence: DataFrame, group: list[str]) -> DataFrame:
    """S and T of the best single row of each side: by the lesser of both, same granularity, coverage, similarity."""

    def best(side: str) -> Column:
        s, t = F.col(f"structure_{side}"), F.col(f"token_{side}")
        return F.max(F.struct(F.least(s, t).alias("m"), F.col("same_granularity").cast("int").alias("g"), F.col("coverage"), F.col("similarity"), s.alias("s"), t.alias("t"))).alias("b" + side)

    agg = evidence.groupBy(*group).agg(best("v"), best("p"), F.count(F.lit(1)).alias("observations"))
    return agg.select(*group, F.col("bv.s").alias("structure_v"), F.col("bv.t").alias("token_v"), F.col("bp.s").alias("structure_p"), F.col("bp.t").alias("token_p"), "observations")


def classify(rows: DataFrame, limits: Thresholds | None = None) -> DataFrame:
    """Adds ``status``, ``abstention_reason``, ``edit_strategy`` and ``contrast`` to one row per boundary.

    Columns read: observations; structure_v/p, token_v/p; raw_v/p and con_v/p (null: not
    measured); contrastive_used; identity_raw_v/p and identity_con_v/p (true, false or null);
    context_v/p (some block, context or function passes S and T on that side); name_conflict.
    """
    k = limits or Thresholds()
    no = F.lit(False)

    def sure(c: Column) -> Column:
        return F.coalesce(c, no)

    cv = sure((F.col("structure_v") >= k.structure) & (F.col("token_v") >= k.token))
    cp = sure((F.col("structure_p") >= k.structure) & (F.col("token_p") >= k.token))
    r = rows.withColumns({"_cv": cv, "_cp": cp, "_corr": cv | cp})
    both = F.col("raw_v").isNotNull() & F.col("raw_p").isNotNull()
    raw = F.when(both, F.col("raw_v") - F.col("raw_p")).otherwise(0.0)
    decisive = sure(F.col("_corr") & both & (((F.col("raw_v") >= k.edit_side) & (raw >= k.edit_margin)) | ((F.col("raw_p") >= k.edit_side) & (raw <= -k.edit_margin))))
    r = r.withColumn("_con", sure(F.col("contrastive_used")) & ~decisive).withColumn("_ran", F.col("raw_v").isNotNull() | F.col("raw_p").isNotNull() | F.col("con_v").isNotNull() | F.col("con_p").isNotNull())
    r = r.withColumns(
        {"_v": F.coalesce(F.when(F.col("_con"), F.col("con_v")).otherwise(F.coalesce("raw_v", "con_v")), F.lit(0.0)), "_p": F.coalesce(F.when(F.col("_con"), F.col("con_p")).otherwise(F.coalesce("raw_p", "con_p")), F.lit(0.0))}
    )
    r = r.withColumn("contrast", F.col("_v") - F.col("_p"))
    r = r.withColumns(
        {
            "_sv": F.col("_corr") & (F.col("_v") >= k.edit_side) & (F.col("contrast") >= k.edit_margin),
            "_sp": F.col("_corr") & (F.col("_p") >= k.edit_side) & (F.col("contrast") <= -k.edit_margin),
            "_mv": F.least("structure_v", "token_v"),
            "_mp": F.least("structure_p", "token_p"),
        }
    )
    generic = F.col("_con") & (
        (F.col("_sv") & F.col("identity_con_v").eqNullSafe(no) & (F.col("_mp") > F.col("_mv"))) | (F.col("_sp") & F.col("identity_con_p").eqNullSafe(no) & (F.col("_mv") > F.col("_mp")))
    )
    r = r.withColumn("_generic", sure(generic))
    r = r.withColumns({"_sv": F.col("_sv") & ~F.col("_generic"), "_sp": F.col("_sp") & ~F.col("_generic")})
    anchor_v = F.when(F.col("_con"), F.col("identity_con_v")).otherwise(F.coalesce("identity_raw_v", "identity_con_v"))
    anchor_p = F.when(F.col("_con"), F.col("identity_con_p")).otherwise(F.coalesce("identity_raw_p", "identity_con_p"))
    anchor = F.when(F.col("_sv"), anchor_v).when(F.col("_sp"), anchor_p)
    context = F.when(F.col("_sv"), F.col("context_v")).otherwise(F.col("context_p"))
    rejected = (F.col("_sv") | F.col("_sp")) & ~sure(context) & sure(F.col("name_conflict")) & anchor.eqNullSafe(no)
    r = r.withColumn("_rejected", sure(rejected))
    status = F.when(F.col("observations") == 0, "uncertain").when(F.col("_rejected") | (F.col("_sv") & F.col("_sp")), "uncertain").when(F.col("_sp"), "patched").when(F.col("_sv"), "vulnerable").otherwise("uncertain")
    side, margin = F.greatest("_v", "_p"), F.abs("contrast")
    reason = (
        F.when(F.col("observations") == 0, "NO_EVIDENCE")
        .when(F.col("_rejected"), "IDENTITY_REJECTED")
        .when(F.col("_sv") & F.col("_sp"), "CONTRADICTORY_EVIDENCE")
        .when(F.col("_generic"), "CONTRASTIVE_CONFLICT")
        .when(~sure((F.col("structure_v") >= k.structure) | (F.col("structure_p") >= k.structure)), "S_FAILED")
        .when(~F.col("_corr"), "T_FAILED")
        .when(~F.col("_ran"), "E_NOT_RUN")
        .when((side < k.edit_side) & (margin < k.edit_margin), "E_SIDE_AND_MARGIN_WEAK")
        .when(side < k.edit_side, "E_SIDE_WEAK")
        .when(margin < k.edit_margin, "E_MARGIN_AMBIGUOUS")
        .otherwise("E_DIRECTION_UNRESOLVED")
    )
    r = r.withColumn("status", status)
    r = r.withColumn("abstention_reason", F.when(F.col("status") == "uncertain", reason)).withColumn("edit_strategy", F.when(F.col("_con"), "contrastive").when(F.col("_ran"), "raw").otherwise("not_run"))
    return r.drop(*[c for c in r.columns if c.startswith("_")])


def support_verdict(evidence: DataFrame, group: list[str], consensus: float = 0.60, supporting: int = 2, cleared: float = -0.10) -> DataFrame:
    """The earlier rule: flagged on enough agreeing regions without an equal contradiction, cleared on none and a negative best margin.

    Reads ``region, margin, passes``.
    """
    agg = evidence.groupBy(*group).agg(
        F.countDistinct(F.when(F.col("passes") & (F.col("margin") > 0), F.col("region"))).alias("support"),
        F.countDistinct(F.when(F.col("passes") & (F.col("margin") < 0), F.col("region"))).alias("against"),
        F.count(F.lit(1)).alias("n"),
        F.max("margin").alias("best_margin"),
    )
    share = F.col("support") / F.col("n")
    flagged = (F.col("support") >= supporting) & (share >= consensus) & (F.col("against") < F.col("support"))
    status = F.when(flagged, "flagged").when((F.col("support") == 0) & (F.col("best_margin") <= cleared), "cleared").otherwise("uncertain")
    return agg.select(*group, "support", "against", "n", F.round("best_margin", 6).alias("best_margin"), status.alias("status"))


def disjoint_evidence(rows: DataFrame, group: list[str], start: str = "start", end: str = "end", order: list | None = None) -> DataFrame:
    """Greedy choice of rows whose spans don't overlap, in order of preference, per group.

    Rows are dealt by group and sorted by preference; one pass over the sorted batches decides
    each row with the spans that its group has taken so far, so no group is held in memory.
    """
    order = order or [F.desc("correspondence"), F.desc("same_granularity"), F.desc("weight"), F.desc("coverage"), F.desc("similarity"), F.asc("region")]
    at = [rows.columns.index(c) for c in group]
    a, b = rows.columns.index(start), rows.columns.index(end)

    def pick(batches):
        import pyarrow as pa

        key, taken = None, DisjointSpans()
        for batch in batches:
            keep = []
            for new, x, y in zip(zip(*(batch.column(i).to_pylist() for i in at)), batch.column(a).to_pylist(), batch.column(b).to_pylist()):
                if new != key:
                    key, taken = new, DisjointSpans()
                keep.append(taken.take(x, y))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(pick, rows.schema)


def unit_priority(states: DataFrame, unit: str = "unit") -> DataFrame:
    """Priority over boundary states ``status, strong, credible, rejected``.

    Any vulnerable state that wasn't rejected is automatic, any other vulnerable one is reviewed;
    patched without strong doubt informs; strong or credible doubt is reviewed.
    """
    true = F.lit(True)
    agg = states.groupBy(unit).agg(
        F.bool_or((F.col("status") == "vulnerable") & ~F.col("rejected").eqNullSafe(true)).alias("clean"),
        F.bool_or(F.col("status") == "vulnerable").alias("vulnerable"),
        F.bool_or(F.col("status") == "patched").alias("patched"),
        F.bool_or((F.col("status") == "uncertain") & F.col("strong").eqNullSafe(true)).alias("strong"),
        F.bool_or((F.col("status") == "uncertain") & F.col("credible").eqNullSafe(true)).alias("credible"),
    )
    priority = (
        F.when(F.col("clean"), "automatic_vulnerability")
        .when(F.col("vulnerable"), "manual_review")
        .when(F.col("patched") & ~F.col("strong"), "informational_lineage")
        .when(F.col("strong") | F.col("credible"), "manual_review")
        .otherwise("none")
    )
    return agg.select(unit, priority.alias("priority"))


def revision_priority(rows: DataFrame) -> Column:
    """Baseline priority adjusted by revisions: columns ``baseline, by_hash, status, protected_conflict, relevant_alternative, relation``."""
    return (
        F.when(F.col("by_hash") | (F.col("status") == "vulnerable"), F.col("baseline"))
        .when(F.col("protected_conflict"), "manual_review")
        .when(F.col("relevant_alternative") & (F.col("relation") != "identity_incompatible"), "manual_review")
        .otherwise("informational_lineage")
    )


def apply_fallback(states: DataFrame, decided: str = "fallback_status") -> DataFrame:
    """A decisive fallback replaces the status and clears the reason; the attempt and the earlier reason are kept."""
    hit = (F.col("status") == "uncertain") & F.col(decided).isin("vulnerable", "patched")
    return states.withColumns(
        {"prior_reason": F.col("abstention_reason"), "abstention_reason": F.when(~F.coalesce(hit, F.lit(False)), F.col("abstention_reason")), "status": F.when(hit, F.col(decided)).otherwise(F.col("status")), "fallback_tried": F.col(decided).isNotNull()}
    )
