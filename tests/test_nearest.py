"""The nearest control against the query's own SQL: ties, null lengths and groups, far kinds."""

import random

import duckdb
import pytest

from pairlens.queries import ORACLES, QUERIES


@pytest.mark.parametrize("seed", range(3))
def test_nearest_control_follows_its_sql(spark, tmp_path, seed):
    r = random.Random(seed)
    con, n = duckdb.connect(), (400, 60, 150)[seed]
    length = lambda: None if r.random() < 0.1 else r.choice([r.randrange(60), r.randrange(3000), 500])
    docs = [(k - 5, r.choice(["a", "a", "b", "c", None]), length()) for k in range(n)]
    docs += [(n + 10, "only null controls", 40), (n + 11, "only null controls", None), (n + 12, "no controls", 7), *docs[:5]]
    labels = [(i, 0 if i == n + 11 else 1 if i > n else int(r.random() < 0.4)) for i in sorted({d[0] for d in docs})]
    con.execute("CREATE TABLE documents (doc_id BIGINT, lang VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs)
    con.execute("CREATE TABLE labels (doc_id BIGINT, toxic INTEGER)")
    con.executemany("INSERT INTO labels VALUES (?, ?)", labels)
    for t in ("documents", "labels"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    want = con.execute(ORACLES["nearest_control"]).fetchall()
    got = [tuple(x) for x in QUERIES["nearest_control"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=lambda x: x[0]) == sorted(want, key=lambda x: x[0]) and len(want) > 10


def test_nearest_control_of_a_large_group(spark, tmp_path):
    """20,000 cases and 60,000 controls of one group, 1,200 million pairs, against a few cases' own minima."""
    spark.range(80000).selectExpr("id AS doc_id", "'a' AS lang", "id * 7919 % 30011 AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(80000).selectExpr("id AS doc_id", "IF(id % 4 = 0, 1, 0) AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    got = {x.doc_id: (x.distance, x.control_id) for x in QUERIES["nearest_control"](spark, str(tmp_path)).collect()}
    assert len(got) == 20000
    for k in (0, 4, 40000, 79996):
        n = k * 7919 % 30011
        assert got[k] == min((abs(n - c * 7919 % 30011) // 20 + 100 * abs(k % 10 - c % 10), c) for c in range(80000) if c % 4)
