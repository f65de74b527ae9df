import pytest
from pyspark.sql import functions as F

from pairlens.operators import corpus as C
from pairlens.operators import evaluation as E
from pairlens.operators import lineage as L
from pairlens.operators import matching as M
from pairlens.operators import regions as R
from pairlens.operators import retrieval as N
from pairlens.operators import state as S
from pairlens.operators import verdicts as V
from pairlens.operators.graph import components

LONG = "this is a text that has clearly more than fifty letters in all of it, number {}"


def verdicts(spark, reference, targets):
    r = spark.createDataFrame(reference, "boundary string, side string, language string, text string")
    t = spark.createDataFrame(targets, "unit string, language string, text string")
    return {(x["unit"], x["boundary"]): x for x in M.hash_verdicts(M.lookup(t, M.build_hash_index(r))).collect()}


def test_hash_conflicts(spark):
    ref = [("b1", "vulnerable", "en", LONG.format(1)), ("b1", "patched", "en", LONG.format(2)), ("b2", "vulnerable", "en", LONG.format(3)), ("b2", "patched", "en", LONG.format(3)), ("b3", "patched", "de", LONG.format(4))]
    v = verdicts(spark, ref, [("exact", "en", LONG.format(1)), ("loose", "en", LONG.format(9)), ("both", "en", LONG.format(3))])
    assert v["exact", "b1"]["status"] == "vulnerable" and v["exact", "b1"]["match_level"] == "exact"
    assert v["loose", "b1"]["abstention_reason"] == "HASH_SIDE_AMBIGUOUS"
    assert v["both", "b2"]["abstention_reason"] == "CONTRADICTORY_EVIDENCE"
    assert ("exact", "b3") not in v


def test_unmatched_and_empty(spark):
    t = spark.createDataFrame([("a", "en", "x"), ("b", "en", None)], "unit string, language string, text string")
    index = M.build_hash_index(spark.createDataFrame([], "boundary string, side string, language string, text string"))
    hits = M.lookup(t, index)
    assert hits.count() == 0 and M.unmatched(t, hits).count() == 2


def test_advisory_agreement(spark):
    adv = spark.createDataFrame(
        [("g1", "p", "npm", "<2.0.0", "2.0.0"), ("g2", "p", "npm", "<2.0.0", "2.0.0"), ("g3", "p", "npm", "<2.0.0", "2.0.0"), ("g4", "q", "npm", "<2.0.0", "2.0.0"), ("g1", "p", "npm", "", "2.0.0")],
        "ghsa_id string, package string, ecosystem string, affected_range string, fixed_version string",
    )
    osv = spark.createDataFrame(
        [("g1", "p", "npm", "1.0.0", "2.0.0", ["1.0.0", "1.5.0"]), ("g2", "p", "npm", "1.0.0", "3.0.0", []), ("g4", "p", "npm", None, "2.0.0", [])], "ghsa_alias string, package string, ecosystem string, introduced string, fixed string, versions array<string>"
    )
    rows = [(r["ghsa_id"], r["reason_code"], r["affected_versions"]) for r in C.advisory_agreement(adv, osv).collect()]
    assert sorted(rows, key=str) == sorted(
        [("g1", None, ["1.0.0", "1.5.0"]), ("g1", "range_missing", []), ("g2", "fix_disagrees", []), ("g3", "osv_alias_missing", []), ("g4", "osv_package_missing", [])], key=str
    )


def test_high_impact(spark):
    df = spark.createDataFrame([(100, 500, False, None, 10, 10, 0.1), (99, 500, False, False, 10, 10, 0.9), (200, 900, True, False, 1, 1, 1.0), (200, 900, False, False, 1000, 1000, 1.0)], "dependents int, stars int, archived boolean, disabled boolean, days_since_release int, days_since_commit int, answered_share double")
    assert [r[0] for r in df.select(C.high_impact(df)).collect()] == [True, False, False, False]


def test_dedup_unites_aliases(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("l", 3, "c")], "k string, n int, alias string")
    rows = {r["k"]: (r["n"], r["aliases"]) for r in C.deduplicate(df, ["k"], ["n"], F.col("alias")).collect()}
    assert rows == {"k": (1, ["a", "b"]), "l": (3, ["c"])}


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7)], "u long, v long")
    assert {(r["node"], r["root"]) for r in components(e).collect()} == {(5, 2), (4, 2), (3, 2), (2, 2), (9, 8), (8, 8)}
    assert components(e.where("false")).count() == 0


def test_revision_components(spark):
    b = spark.createDataFrame([("b3", "l", "js", "x", "y"), ("b1", "l", "js", "y", "z"), ("b2", "l", "js", "q", "r"), ("b4", "m", "js", "z", "w")], "boundary_id string, lineage_id string, language string, vulnerable string, patched string")
    assert {tuple(r) for r in L.revision_components(b).collect()} == {("b3", "b1"), ("b1", "b1"), ("b2", "b2"), ("b4", "b4")}


def test_upper_median_and_confidence(spark):
    v = lambda *x: spark.range(1).select(L.upper_median(F.array(*map(F.lit, x)))).first()[0]
    assert v(1.0, 2.0, 3.0, 4.0) == 3.0 and v(3.0, 1.0, 2.0) == 2.0
    got = [spark.range(1).select(L.confidence(F.lit(x))).first()[0] for x in (0.82, 0.68, 0.55, 0.5)]
    assert got == ["high", "medium", "low", "none"]


@pytest.mark.parametrize("parts", [1, 5])
def test_top_k_ties_and_filters(spark, parts):
    rows = [(i, [float(i % 3 == 0), 1.0], i % 2) for i in range(12)]
    v = spark.createDataFrame(rows, "id long, vector array<double>, label int").repartition(parts)
    got = [(r["id"], r["rank"]) for r in N.top_k(v.where("id = 0"), v, 4, exclude_self=True).orderBy("rank").collect()]
    assert got == [(3, 1), (6, 2), (9, 3), (1, 4)]
    assert [r["id"] for r in N.top_k(v.where("id = 0"), v, 2, exclude_self=True, eligible=F.col("label") == 1).orderBy("rank").collect()] == [3, 9]
    assert N.top_k(v.where("false"), v, 3).count() == 0


def state(**over):
    base = dict(observations=2, structure_v=0.9, token_v=0.9, structure_p=0.8, token_p=0.8, raw_v=1.0, raw_p=0.5, con_v=None, con_p=None, contrastive_used=False, identity_raw_v=True, identity_raw_p=None, identity_con_v=None, identity_con_p=None, context_v=True, context_p=True, name_conflict=False)
    return base | over


@pytest.mark.parametrize(
    "over, status, reason",
    [
        ({}, "vulnerable", None),
        ({"raw_v": 0.5, "raw_p": 1.0}, "patched", None),
        ({"observations": 0}, "uncertain", "NO_EVIDENCE"),
        ({"structure_v": 0.1, "structure_p": 0.1}, "uncertain", "S_FAILED"),
        ({"token_v": 0.1, "token_p": 0.1}, "uncertain", "T_FAILED"),
        ({"raw_v": None, "raw_p": None}, "uncertain", "E_NOT_RUN"),
        ({"raw_v": 0.8, "raw_p": 0.8}, "uncertain", "E_SIDE_AND_MARGIN_WEAK"),
        ({"raw_v": 0.85, "raw_p": 0.5}, "uncertain", "E_SIDE_WEAK"),
        ({"raw_v": 0.95, "raw_p": 0.92}, "uncertain", "E_MARGIN_AMBIGUOUS"),
        ({"context_v": False, "name_conflict": True, "identity_raw_v": False}, "uncertain", "IDENTITY_REJECTED"),
        ({"context_v": False, "name_conflict": True, "identity_raw_v": None}, "vulnerable", None),
        ({"raw_v": 0.95, "raw_p": 0.92, "contrastive_used": True, "con_v": 1.0, "con_p": 0.5, "identity_con_v": False, "structure_v": 0.75}, "uncertain", "CONTRASTIVE_CONFLICT"),
    ],
)
def test_classify(spark, over, status, reason):
    kinds = {"observations": "int", "contrastive_used": "boolean", "context_v": "boolean", "context_p": "boolean", "name_conflict": "boolean"} | {f"identity_{k}_{s}": "boolean" for k in ("raw", "con") for s in "vp"}
    s = state(**over)
    df = spark.createDataFrame([tuple(s.values())], ", ".join(f"{k} {kinds.get(k, 'double')}" for k in s))
    r = V.classify(df).first()
    assert (r["status"], r["abstention_reason"]) == (status, reason)


def test_best_rows_come_from_one_observation(spark):
    rows = [(1, 0.9, 0.2, 0.1, 0.1, True, 1.0, 0.5), (1, 0.6, 0.6, 0.3, 0.4, False, 0.5, 0.4)]
    df = spark.createDataFrame(rows, "b int, structure_v double, token_v double, structure_p double, token_p double, same_granularity boolean, coverage double, similarity double")
    r = V.best_rows(df, ["b"]).first()
    assert (r["structure_v"], r["token_v"], r["structure_p"], r["token_p"]) == (0.6, 0.6, 0.3, 0.4)


def test_fallback(spark):
    df = spark.createDataFrame([("uncertain", "E_SIDE_WEAK", "patched"), ("uncertain", "T_FAILED", None), ("vulnerable", None, "patched")], "status string, abstention_reason string, fallback_status string")
    assert [(r["status"], r["abstention_reason"], r["prior_reason"]) for r in V.apply_fallback(df).collect()] == [("patched", None, "E_SIDE_WEAK"), ("uncertain", "T_FAILED", "T_FAILED"), ("vulnerable", None, None)]


def test_metrics_denominators(spark):
    names = ["true_positive", "false_negative", "abstained_positive", "false_positive", "true_negative", "abstained_negative"]
    r = E.verification_metrics(spark.createDataFrame([(n,) for n in [*names, "excluded_case"]], "outcome string")).first()
    assert (r["recall"], r["false_positive_rate"], r["abstention_rate"], r["cases"]) == (0.5, 0.5, 0.333333, 6)
    ranks = spark.createDataFrame([(1,), (6,), (None,), (3,)], "rank int")
    m = E.retrieval_metrics(ranks).first()
    assert (m["recall_at_1"], m["recall_at_5"], m["mrr"], m["misses"]) == (0.25, 0.5, round((1 + 1 / 6 + 1 / 3) / 4, 6), 1)
    assert E.verification_metrics(spark.createDataFrame([("true_negative",)], "outcome string")).first()["recall"] is None


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 21)], "g string, v double")
    assert E.nearest_rank(df, "v", ["g"]).first()["quantile"] == 19.0 and E.nearest_rank(df, "v", ["g"], variant="floor").first()["quantile"] == 20.0


def test_pareto_against_all_pairs(spark):
    import random

    rng = random.Random(2)
    rows = [(i, float(rng.randrange(8)), float(rng.randrange(8)), float(rng.randrange(8))) for i in range(300)]
    want = {i for i, a, b, c in rows if not any(x >= a and y >= b and z <= c and (x, y, z) != (a, b, c) for _, x, y, z in rows)}
    df = spark.createDataFrame(rows, "i int, a double, b double, c double").repartition(20)
    assert {r["i"] for r in E.pareto(df, "i", ["a", "b"], ["c"]).collect()} == want


def test_encoders_by_id():
    with pytest.raises(ValueError):
        N.encoder("none")


@pytest.mark.parametrize("block", [7, 4096])
def test_top_k_against_all_products(spark, block):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 5)).round(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(3)
    got = {(r["query_id"], r["rank"]): r["id"] for r in N.top_k(df.where("id % 3 = 0"), df, 4, exclude_self=True, block=block).collect()}
    want = {}
    for q in range(0, 90, 3):
        order = sorted((i for i in range(90) if i != q), key=lambda i: (-round(float(x[q] @ x[i]), 9), i))
        want |= {(q, n): i for n, i in enumerate(order[:4], 1)}
    assert got == want


def test_sweep_and_round_robin(spark):
    base = {"a": 1.0, "b": 2.0}
    exp = spark.createDataFrame([("x", {"a": 1.0}), ("y", {"a": 3.0}), ("z", {"b": 2.0})], "experiment string, settings map<string,double>")
    assert {r["experiment"] for r in E.sweep(base, exp).collect()} == {"x", "y"}
    rows = spark.createDataFrame([(g, i, "c") for g in "ab" for i in range(3)], "g string, i int, c string")
    assert sorted((r["turn"], r["g"]) for r in E.round_robin(rows, "g", "i", "c", 3).collect()) == [(1, "a"), (1, "b"), (2, "a")]


def test_enclosing_and_overlap(spark):
    p = spark.createDataFrame([(1, "u", 50), (2, "u", 5000), (3, "v", 50)], "id long, g string, at long")
    s = spark.createDataFrame([(10, "u", 0, 6000), (11, "u", 40, 60), (12, "u", 40, 60)], "span_id long, g string, start long, end long")
    inner = R.innermost(R.enclosing(p, s, "g"), "id")
    assert {(r["id"], r["span_id"]) for r in inner.collect()} == {(1, 11), (2, 10)}
    a = s.select("g", F.col("span_id").alias("a"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = s.select("g", F.col("span_id").alias("b"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    assert R.overlapping(a, b, "g", 10).where("a < b").count() == 3


def test_merkle_and_changes(spark):
    f = spark.createDataFrame([("a/b.js", "1"), ("a/c/d.js", "2"), ("node_modules/x.js", "3")], "path string, content string")
    h = S.file_hashes(f)
    tree = {r["path"]: r["hash"] for r in S.merkle(h).collect()}
    assert set(tree) == {"", "a", "a/c"}
    moved = S.merkle(S.file_hashes(f.replace("2", "9", "content")).repartition(3))
    assert {r["path"]: r["hash"] for r in moved.collect()}[""] != tree[""]
    after = spark.createDataFrame([("a/b.js", "0"), ("n.js", "1")], "path string, hash string")
    assert {tuple(r) for r in S.changes(h, after).collect()} == {("a/b.js", "changed"), ("a/c/d.js", "deleted"), ("n.js", "added")}
    assert S.merkle(h.where("false")).first()["path"] == ""


def test_dismissals(spark):
    d = spark.createDataFrame(
        [(n, p, f, fh, uh, s, n) for n, (p, f, fh, uh, s) in enumerate([("gone", "f", "1", "1", "s"), ("a", "f", "1", "1", "s"), ("a", "g", "1", "0", "s"), ("a", "h", "1", "1", "t"), ("a", "x", "1", "1", "s"), ("a", "y", "0", "1", "s"), ("b", "f", "1", "1", "s"), ("a", "f", "0", "1", "s"), ("b", "f", "0", "1", "s"), ("a", "n", "1", "1", "s")])],
        "id int, path string, function_id string, file_hash string, function_hash string, signature string, dismissed_at int",
    )
    c = spark.createDataFrame([("a", "f", "1", "1", "s", True), ("a", "g", "1", "1", "s", True), ("a", "h", "1", "1", "s", True), ("b", "f", "1", "1", "s", False), ("a", "n", "1", "1", None, True)], "path string, function_id string, file_hash string, function_hash string, signature string, scanned boolean")
    got = [r["status"] for r in S.dismissal_status(d, c).orderBy("id").collect()]
    assert got == ["file_missing", "dismissed", "function_changed", "finding_changed", "no_longer_present", "file_changed", "scan_unavailable", "file_changed", "file_changed", "no_longer_present"]


def test_prefix_match(spark):
    ids = spark.createDataFrame([("aaaaaaaa1",), ("aaaaaaaa2",), ("bbbbbbbb1",)], "id string")
    assert S.prefix_match(ids, "aaaaaaaa").count() == 0 and S.prefix_match(ids, "bbbbbbbb").count() == 1 and S.prefix_match(ids, "bbb").count() == 0
    assert S.prefix_match(ids, "aaaaaaaa1").count() == 1


def test_manifest_owner(spark):
    f = spark.createDataFrame([("a/b/c.js",), ("x.js",)], "path string")
    m = spark.createDataFrame([("", "root"), ("a", "inner")], "folder string, name string")
    assert {(r["path"], r["name"]) for r in S.owning_manifest(f, m).collect()} == {("a/b/c.js", "inner"), ("x.js", "root")}


def test_scratch_tables_are_released(spark):
    import os

    from pairlens.plans import scratch

    kept, gone = scratch.materialise(spark.range(3), "kept"), scratch.materialise(spark.range(4), "gone")
    paths = scratch._CLAIMED[spark.sparkContext.applicationId][-2:]
    scratch.release(spark, paths[0])
    assert kept.count() == 3 and gone is not None
    assert [os.path.isdir(p.removeprefix("file://")) for p in paths] == [True, False]


def test_disjoint_evidence_against_slow_form(spark):
    import random

    rng = random.Random(6)
    rows = [(f"g{rng.randrange(9)}", i, (s := rng.randrange(200)), s + rng.randrange(1, 20), rng.random()) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, region int, start int, end int, score double").repartition(5)
    got = {r["region"] for r in V.disjoint_evidence(df, ["g"], order=[F.desc("score"), F.asc("region")]).collect()}
    want, taken = set(), {}
    for g, i, a, b, _ in sorted(rows, key=lambda r: (-r[4], r[1])):
        if all(b <= x or a >= y for x, y in taken.setdefault(g, [])):
            taken[g].append((a, b))
            want.add(i)
    assert got == want
    assert V.disjoint_evidence(df.where("false"), ["g"], order=[F.asc("region")]).count() == 0
