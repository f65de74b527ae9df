"""What the driver holds while near copies are linked."""

from itertools import combinations

import pytest

from pairlens.llm import language, simhash
from pairlens.operators import graph
from pairlens.plans import scratch


@pytest.mark.parametrize("bits", [1, 2])
def test_points_are_those_within_so_many_bits(spark, bits):
    fps = [0, -1, 1 << 62, -(1 << 63), 123456789]
    df = spark.createDataFrame([(x,) for x in fps], "fp long").select("fp", simhash._points(bits).alias("p"))
    masks = [sum(1 << b for b in c) for k in range(bits + 1) for c in combinations(range(64), k)]
    for fp, points in df.collect():
        assert sorted(points) == sorted(simhash._signed((fp & ((1 << 64) - 1)) ^ m) for m in masks)


def test_plan_of_links_stays_small(spark):
    df = simhash.links(spark.createDataFrame([(1,), (3,)], "fp long"))
    # twice 2081 numbers were in it
    assert len(df._jdf.queryExecution().logical().toString()) < 20_000 and {tuple(x) for x in df.collect()} == {(1, 3)}


def test_long_runs_have_the_driver_collect(spark, monkeypatch):
    scratch.tidy(spark)
    monkeypatch.setattr(scratch, "TIDY_S", 3600.0)
    assert not scratch.tidy(spark)
    monkeypatch.setattr(scratch, "TIDY_S", 0.0)
    assert scratch.tidy(spark)
    ran = []
    monkeypatch.setattr(scratch, "tidy", lambda s: ran.append(1))
    scratch.materialise(spark.range(3), "three")
    assert ran


def test_tidying_trims_memory_outside_the_heap(spark, monkeypatch):
    assert scratch.trim(spark)
    trimmed = []
    monkeypatch.setattr(scratch, "trim", trimmed.append)
    monkeypatch.setattr(scratch, "TIDY_S", 0.0)
    assert scratch.tidy(spark) and trimmed == [spark]


def test_links_are_read_from_written_tables(spark):
    df = simhash.links(spark.createDataFrame([(1,), (3,), (1 << 40,)], "fp long"))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_halves_of_a_round_have_plans_of_their_own(spark, monkeypatch):
    plans, write = [], scratch.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, name))
    edges = [(k, k + 1) for k in range(20)] + [(50, 60), (70, 60), (80, 80), (None, 5)]
    found = graph.components(spark.createDataFrame(edges, "u long, v long"))
    assert sorted(map(tuple, found.collect())) == [(k, 0) for k in range(21)] + [(50, 50), (60, 50), (70, 50)]
    assert max(p.count("Join") for p in plans) == 1


def test_dictionaries_take_no_job_for_each_partition(spark):
    rows = [(k % 2 and "aa" or "bb", " ".join(f"{'xy'[k % 2]}{chr(97 + (k * j) % 26)}" for j in range(200))) for k in range(300)]
    df = spark.createDataFrame(rows, "lang string, text string")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(kept, ("40", "false")):
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("dictionaries", "")
        assert set(language.learn_dictionaries(df)) == {"aa", "bb"}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("dictionaries"))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 20
