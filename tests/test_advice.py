"""Cases in which a query once did less than its whole job."""

from types import SimpleNamespace

import pytest

from pairlens.queries import detection


@pytest.fixture(scope="module")
def tables(spark):
    def make(items, docs):
        return SimpleNamespace(
            spark=spark, benchmark=spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), documents=spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
        )

    return make


def test_containment_of_short_items(tables):
    items = ["one", "one two", "one two three", "a b c d e f g h", "a b c d e f g h i", "a b c d e f g h i j", "zzz", "b c d", "", None]
    docs = ["someone two threefold", "xa b c d e f g h ix", "One  two", "a b c d e f g h i jk l", "", None]
    fold = lambda x: None if x is None else " ".join(x.split())
    want = {(i, d, len(fold(q))) for i, q in enumerate(items) for d, x in enumerate(docs) if q is not None and x is not None and fold(q) in fold(x)}
    t = tables(items, docs)
    got = [tuple(r) for r in detection.benchmark_containment(t).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_fuzzy_copies_with_edits_anywhere(tables):
    item = [f"w{k}" for k in range(50)]
    copies = []
    for at in range(0, 50, 7):
        copies.append([*item[:at], "other", *item[at + 1 :]])
    copies.append(["other" if k % 5 == 2 and k < 50 and k // 5 % 2 else w for k, w in enumerate(item)])
    short = ["p", "q", "r", "s", "t"]
    t = tables([" ".join(item), " ".join(short), "single"], [*["before " + " ".join(c) + " after" for c in copies], "x p other r s t y", "a single b", "none"])
    got = {(r["item_id"], r["doc_id"]): r["similarity"] for r in detection.fuzzy_substring(t).collect()}
    assert [got.get((0, d)) for d in range(8)] == [0.98] * 8
    assert got[0, 8] == 0.9 and got[1, 9] == 0.8 and got[2, 10] == 1.0 and len(got) == 11
