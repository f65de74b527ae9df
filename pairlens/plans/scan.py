"""The whole scan as one plan: files to units to hash verdicts, retrieval for the rest, priorities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ScanConfig
from ..functions import kernels as K
from ..functions import text as T
from ..functions.text import language_of
from ..operators import lineage as L
from ..operators import retrieval as N
from ..operators import verdicts as V
from ..operators.matching import hash_verdicts
from ..operators.project import assess
from ..operators.units import candidate_regions, diagnostics, extract_units, fallback_udf, region_pairs, roles_udf, with_fingerprints
from .scratch import materialise


def _keys(rows: DataFrame) -> DataFrame:
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("digest")) for k in ("native", "exact", "abstracted")])
    return rows.select("*", F.inline(kinds)).where("digest IS NOT NULL")


def with_boundary(corpus: DataFrame) -> DataFrame:
    """Corpus entries with the ids of their lineage and boundary."""
    rows = corpus.withColumn("lineage", L.lineage_id(F.col("repo"), F.col("path"), F.col("function")))
    return rows.withColumn("boundary", L.boundary_id(F.col("lineage"), F.col("fix"), F.col("vulnerable"), F.col("patched")))


def reference_boundaries(corpus: DataFrame) -> DataFrame:
    """Corpus entries (repo, path, function, fix, vulnerable, patched, advisory, severity) as one row per boundary."""
    rows = with_boundary(corpus)
    # all that the id is made of is equal in a group
    same = [F.any_value(c).alias(c) for c in ("lineage", "function", "vulnerable", "patched")]
    return rows.groupBy("boundary").agg(*same, F.any_value(language_of(F.col("path"))).alias("language"), F.min("advisory").alias("advisory"), F.min("severity").alias("severity"), F.count(F.lit(1)).alias("entries"))


def hash_stage(units: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Verdicts of units, ``unit_id, language`` with fingerprints, that share a digest with some side of a boundary, in the same language."""
    sides = boundaries.select("boundary", "language", "entries", F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("source")) for s in ("vulnerable", "patched")])))
    index = _keys(with_fingerprints(sides)).groupBy("kind", "digest", "language", "boundary").agg(F.max((F.col("side") == "vulnerable").cast("int")).alias("vulnerable"), F.max((F.col("side") == "patched").cast("int")).alias("patched"), F.sum("entries").alias("copies"))
    found = _keys(units).join(index, ["kind", "digest", "language"])
    hits = found.select(F.col("unit_id").alias("unit"), "boundary", F.when(F.col("kind") == "abstracted", "abstracted").otherwise("exact").alias("match"), "vulnerable", "patched", "copies")
    return hash_verdicts(hits)


def matched_regions(own: DataFrame, theirs: DataFrame, config: ScanConfig) -> DataFrame:
    """The regions to compare, ``unit, pair_id, boundary, region_id, similarity``: of the best B pairs of a unit, the V best regions among the five best hits.

    ``own``: id, vector, unit, region_id, language.  ``theirs``: id, vector, pair_id, boundary, side, language.
    """
    hits = N.top_k(own, theirs, config.hits_per_region, threshold=config.similarity)
    hits = hits.join(own.select(F.col("id").alias("query_id"), "unit", "region_id", "language"), "query_id").join(theirs.select("id", "pair_id", "boundary", "side", F.col("language").alias("l")), "id").where("language = l")
    pairs = hits.groupBy("unit", "pair_id").agg(F.max("similarity").alias("best"), F.count(F.lit(1)).alias("support"))
    first = pairs.withColumn("n", F.row_number().over(Window.partitionBy("unit").orderBy(F.desc("best"), F.desc("support"), "pair_id"))).where(F.col("n") <= config.pairs_per_unit).select("unit", "pair_id")
    w = Window.partitionBy("unit", "pair_id")
    top = hits.join(first, ["unit", "pair_id"]).withColumn("n", F.row_number().over(w.orderBy(F.desc("similarity"), "region_id", "side"))).where("n <= 5")
    each = top.groupBy("unit", "pair_id", "boundary", "region_id").agg(F.max("similarity").alias("similarity"))
    return each.withColumn("n", F.row_number().over(w.orderBy(F.desc("similarity"), "region_id"))).where(F.col("n") <= config.regions_per_pair).drop("n")


def compare(rows: DataFrame) -> DataFrame:
    """Adds S and T of both sides, and what they give, to rows with a candidate's region columns and the structs ``v, p`` of a pair."""
    alike = K.similarity_udf()
    for side in "vp":
        rows = rows.withColumns({f"structure_{side}": 0.5 * alike("ast_shape", f"{side}.ast_shape") + 0.5 * alike("ast_path", f"{side}.ast_path"), f"token_{side}": alike("roles", f"{side}.roles"), f"api_{side}": api_score(side)})
    own, their = F.size("ast_shape"), F.size("v.ast_shape")
    score = {side: F.least(f"structure_{side}", f"token_{side}") for side in "vp"}
    return rows.withColumns(
        {
            "score_v": score["v"], "score_p": score["p"], "correspondence": F.greatest(score["v"], score["p"]), "margin": score["v"] - score["p"], "coverage": F.least(own, their) / F.greatest(own, their, F.lit(1)),
            "same_granularity": F.col("granularity") == F.col("pair_granularity"), "weight": F.coalesce(F.create_map(*[F.lit(x) for kv in V.WEIGHTS.items() for x in kv])[F.col("granularity")], F.lit(0)),
            "fix_coverage": T.coverage(F.col("fix_signature"), F.col("roles")), "vulnerable_coverage": T.coverage(F.col("vulnerable_signature"), F.col("roles")),
        }
    )


def api_score(side: str):
    """Mean of the Jaccard measures of calls and members that there are; null without any."""
    found = F.filter(F.array(*[T.jaccard(F.array_distinct(c), F.array_distinct(f"{side}.{c}")) for c in ("calls", "member_accesses")]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda a, x: a + x) / F.size(found))


def boundary_states(evidence: DataFrame, units: DataFrame, boundaries: DataFrame, config: ScanConfig) -> DataFrame:
    """One state per unit and boundary from compared regions: the best independent rows of each side, gates, edits where S and T hold, the verdict."""
    k, group = config.thresholds, ["unit", "boundary"]
    independent = V.disjoint_evidence(evidence, group)
    best = independent.groupBy(*group).agg(F.count(F.lit(1)).alias("observations"), F.max("fix_coverage").alias("fix_coverage"), F.max("vulnerable_coverage").alias("vulnerable_coverage"))
    for side in "vp":
        rows = V.disjoint_evidence(evidence.withColumn("correspondence", F.col(f"score_{side}")), group)
        best = best.join(V.best_rows(rows, group).select(*group, f"structure_{side}", f"token_{side}"), group)

    def broad(side: str):
        return F.bool_or(F.col("granularity").isin("block", "context", "function") & (F.col(f"structure_{side}") >= k.structure) & (F.col(f"token_{side}") >= k.token)).alias(f"context_{side}")

    best = best.join(evidence.groupBy(*group).agg(broad("v"), broad("p")), group)
    best = best.join(units.select(F.col("unit_id").alias("unit"), "name", "source"), "unit").join(boundaries.select("boundary", "lineage", "function", "vulnerable", "patched"), "boundary")
    best = best.withColumn("name_conflict", F.coalesce((F.col("name") != "") & (F.col("function") != "") & (F.col("name") != F.col("function")), F.lit(False)))
    best = best.withColumn("token_gate", ((F.col("structure_v") >= k.structure) & (F.col("token_v") >= k.token)) | ((F.col("structure_p") >= k.structure) & (F.col("token_p") >= k.token)))
    size = F.length("source") <= config.max_edit_chars if config.max_edit_chars is not None else F.lit(True)
    best = best.withColumn("edit_due", F.col("token_gate") & size)
    # texts of the units meet the fix's lines only where an edit score is due
    edited = best.where("edit_due").select(*group, "source").join(diagnostics(boundaries), "boundary")
    edited = edited.select(*group, roles_udf()("source").alias("given"), "removed", "added").select(*group, K.edit_udf()("removed", "added", "given").alias("e")).select(*group, "e.*")
    rows = best.join(edited, group, "left").withColumn("contrastive_used", F.coalesce("contrastive_used", F.lit(False)))
    return V.classify(rows, k)


def fallbacks(states: DataFrame, regions: DataFrame, pairs: DataFrame, config: ScanConfig) -> DataFrame:
    """Uncertain states that passed S and T, without a conflict, get a verdict from equal syntax forms.

    The whole functions must pass S and T too, and no local form may say otherwise.
    """
    k = config.thresholds
    open_ = (F.col("status") == "uncertain") & F.col("token_gate") & ~F.col("abstention_reason").isin("IDENTITY_REJECTED", "CONTRADICTORY_EVIDENCE", "CONTRASTIVE_CONFLICT")
    due = states.where(open_).select("unit", "boundary", "source", "vulnerable", "patched")
    whole = regions.where("granularity = 'function'").select("unit", "granularity", "ast_shape", "ast_path", "roles", "calls", "member_accesses")
    rows = due.join(whole, "unit").join(pairs.where("granularity = 'function'").withColumnRenamed("granularity", "pair_granularity"), "boundary")
    rows = compare(rows).where(f"(structure_v >= {k.structure} AND token_v >= {k.token}) OR (structure_p >= {k.structure} AND token_p >= {k.token})")
    rows = rows.select("unit", "boundary", fallback_udf()("source", "vulnerable", "patched").alias("f"))
    decided = rows.select("unit", "boundary", F.when(F.coalesce(F.col("f.local"), F.col("f.ast")) == F.col("f.ast"), F.col("f.ast")).alias("fallback_status")).distinct()
    return V.apply_fallback(states.join(decided, ["unit", "boundary"], "left"))


def priorities(states: DataFrame, components: DataFrame, by_hash: bool) -> DataFrame:
    """Priority per unit over ``unit, boundary, lineage, status, abstention_reason, token_gate, credible`` and the identity columns.

    Beside a patched boundary, an uncertain one is reviewed if it is a protected conflict, belongs to the same
    revisions, or passed S and T; unless nothing but its name speaks for it.
    """
    rejected = F.coalesce(F.col("abstention_reason") == "IDENTITY_REJECTED", F.lit(False))
    clash = F.coalesce(F.col("abstention_reason") == "CONTRADICTORY_EVIDENCE", F.lit(False))
    credible = F.col("credible") & ~rejected
    rows = states.withColumns({"strong": (credible & F.col("token_gate")) | clash if not by_hash else clash, "credible": credible, "rejected": F.lit(False)})
    base = V.unit_priority(rows).withColumnRenamed("priority", "baseline")
    if by_hash:
        return base.withColumnRenamed("baseline", "priority")
    rows = rows.join(components.select("boundary", "component"), "boundary", "left")
    patched = rows.where("status = 'patched'").select("unit", "lineage", "component").distinct()
    linked = patched.select("unit", "component").distinct().withColumn("connected", F.lit(True))
    kin = patched.select("unit", "lineage").distinct().withColumn("kin", F.lit(True))
    rows = rows.join(linked, ["unit", "component"], "left").join(kin, ["unit", "lineage"], "left")
    protected = F.coalesce(F.col("abstention_reason").isin("CONTRADICTORY_EVIDENCE", "CONTRASTIVE_CONFLICT", "HASH_SIDE_AMBIGUOUS"), F.lit(False))
    no = F.lit(False)
    nameless = F.col("kin").isNull() & F.col("name_conflict") & ~F.coalesce("context_v", no) & ~F.coalesce("context_p", no) & F.col("identity_con_v").eqNullSafe(no) & F.col("identity_con_p").eqNullSafe(no)
    open_ = (F.col("status") == "uncertain") & ~rejected
    relevant = open_ & F.col("credible") & (F.col("connected").isNotNull() | F.col("token_gate")) & (F.col("connected").isNotNull() | ~nameless)
    agg = rows.groupBy("unit").agg(
        F.bool_or(F.col("status") == "vulnerable").alias("v"), F.bool_or(F.col("status") == "patched").alias("p"), F.bool_or(open_ & protected).alias("protected_conflict"), F.bool_or(relevant).alias("relevant_alternative")
    )
    agg = agg.join(base, "unit").withColumns({"by_hash": F.col("v") | ~F.col("p"), "status": F.lit("patched"), "relation": F.lit("unknown")})
    return agg.select("unit", V.revision_priority(agg).alias("priority"))


def scan(files: DataFrame, corpus: DataFrame, config: ScanConfig | None = None) -> DataFrame:
    """Findings of ``files(path, content)`` against corpus entries: one row per unit and boundary.

    Hash hits are decided without retrieval; the rest is an anti-join away.  Units, boundaries, regions and
    evidence are written to the shared folder once, as several steps read them.  Files above the configured
    size are left to review by :func:`oversized`.
    """
    config = config or ScanConfig()
    units = with_fingerprints(extract_units(files.where(F.length("content") <= config.max_source_chars)))
    units = materialise(units.withColumn("language", language_of(F.col("path"))), "units")
    boundaries = materialise(reference_boundaries(corpus), "boundaries")
    by_hash = hash_stage(units, boundaries).select("unit", "boundary", "status", "abstention_reason")
    rest = units.join(by_hash.select(F.col("unit").alias("unit_id")).distinct(), "unit_id", "left_anti")

    encode = N.encoder(config.model)
    found = candidate_regions(rest, config.regions_per_unit).join(rest.select("unit_id", "language"), "unit_id").withColumnRenamed("unit_id", "unit")
    regions = materialise(found.select("*", F.xxhash64("unit", "region_id").alias("id"), encode(F.col("text")).alias("vector")), "regions")
    pairs = materialise(region_pairs(boundaries), "pairs")
    sides = pairs.join(boundaries.select("boundary", "language"), "boundary").select("boundary", "pair_id", "language", F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}.text").alias("text")) for s in "vp"])))
    theirs = materialise(sides.select("boundary", "pair_id", "language", "side", F.xxhash64("pair_id", "side").alias("id"), encode(F.col("text")).alias("vector")), "vectors")

    chosen = matched_regions(regions, theirs, config).join(regions.drop("id", "vector", "language", "text"), ["unit", "region_id"])
    evidence = compare(chosen.join(pairs.withColumnRenamed("granularity", "pair_granularity").drop("boundary"), "pair_id"))
    evidence = materialise(evidence.select(*"unit boundary pair_id granularity same_granularity weight coverage similarity correspondence margin score_v score_p structure_v token_v structure_p token_p api_v api_p fix_coverage vulnerable_coverage".split(), F.col("region_id").alias("region"), F.col("start_byte").alias("start"), F.col("end_byte").alias("end")), "evidence")
    states = boundary_states(evidence, rest, boundaries, config)
    if config.fallback:
        states = fallbacks(states, regions, pairs, config)
    else:
        states = states.withColumn("prior_reason", F.lit(None).cast("string"))
    scored = evidence.join(boundaries.select("boundary", "lineage"), "boundary").withColumn("structure", F.greatest("structure_v", "structure_p"))
    scores = L.lineage_scores(V.disjoint_evidence(scored, ["unit", "lineage"])).select("unit", "lineage", "confidence")
    states = materialise(states.join(scores, ["unit", "lineage"], "left").withColumn("credible", F.coalesce(F.col("confidence").isin("high", "medium"), F.lit(False))).drop("source", "vulnerable", "patched"), "states")

    components = L.revision_components(boundaries, within=["lineage", "language"], boundary="boundary")
    hashed = by_hash.join(boundaries.select("boundary", "lineage"), "boundary").withColumns({"credible": F.lit(True), "token_gate": F.lit(False)})
    priority = priorities(hashed, components, True).unionByName(priorities(states, components, False))
    none = F.lit(None).cast("string")
    by_hash = by_hash.withColumns({"route": F.lit("hash"), "edit_strategy": none, "prior_reason": none, "confidence": none})
    rows = by_hash.unionByName(states.select("unit", "boundary", "status", "abstention_reason", F.lit("retrieval").alias("route"), "edit_strategy", "prior_reason", "confidence"))
    place = units.select(F.col("unit_id").alias("unit"), "path", "name", "start_line", "end_line", "function_hash")
    out = rows.join(priority, "unit").join(boundaries.select("boundary", "advisory", "severity"), "boundary").join(place, "unit")
    return out.select("unit", "path", "name", "start_line", "end_line", "function_hash", "boundary", "advisory", "severity", "route", "status", "abstention_reason", "prior_reason", "edit_strategy", "confidence", "priority")


def with_applicability(findings: DataFrame, corpus: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with ``packages``: the packages of their boundary's advisories, each with its status in the project.

    ``files(path, content)`` are the sources, manifests and lock files of one project, as text.  The priority
    stays: which project a package applies to doesn't undo what the texts show.
    """
    named = with_boundary(corpus).where("package IS NOT NULL").select("boundary", "package").distinct()
    rows = findings.select("path", "boundary").distinct().join(named, "boundary").withColumn("project", F.lit(""))
    found = assess(rows, files.select(F.lit("").alias("project"), "path", "content"))
    listed = found.groupBy("path", "boundary").agg(F.array_sort(F.collect_set(F.concat_ws(":", "package", "status"))).alias("packages"))
    none = F.array().cast("array<string>")
    return findings.join(listed, ["path", "boundary"], "left").select(*findings.columns, F.coalesce("packages", none).alias("packages"))


def oversized(files: DataFrame, config: ScanConfig | None = None) -> DataFrame:
    """Files that are too large to scan: each goes to manual review."""
    config = config or ScanConfig()
    return files.where(F.length("content") > config.max_source_chars).select("path", F.lit("manual_review").alias("priority"), F.lit("SOURCE_TOO_LARGE").alias("abstention_reason"))
