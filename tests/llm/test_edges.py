"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from pairlens.llm import chat, decontaminate, language, licenses, media, packing, secrets, simhash, token_files, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox jumps over the lazy dog again and again " * 20_000
ROWS = [
    (1, "hello world, this is a plain text of some words", "en", "a", 47),
    (1, "hello world, this is a plain text of some words", "en", "a", 47),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (None, "a text without any id", "en", "b", 21),
    (4, " \t\n ", "de", "", 4),
    (5, LONG, "en", "c", len(LONG)),
    (6, "1234567890 !!! \u0000 \U0001f600 中文", None, "c", 20),
    (-7, "Größe und Maß für die Straße", "de", None, 28),
]
EXTRA = "fp long, score double, words array<string>, media binary, ids binary, w string, h string, lang_pred string, secrets string, `odd name` string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def wide(spark, docs):
    """The same rows with more columns, under names that operators use themselves."""
    out = docs
    for f in EXTRA.split(", "):
        name, kind = f.rsplit(" ", 1)
        out = out.withColumn(name.strip("`"), F.lit(None).cast(kind))
    return out


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, "too short")], "item_id long, text string")


MODEL = toxicity.Model({"awful ": 4.0}, 1.0, 0.1, -3.0, 2.0)
DICTS = {"en": b"the quick brown fox and this is a plain text " * 50, "de": "der die das und für eine straße größe ist ".encode() * 50}
FOREST = "CASE WHEN f.digits > 0.3D AND f.named > 0.5D THEN 1.0D ELSE 0.0D END"


def operators(spark, benchmark):
    def files(d):
        path = f"{d.sparkSession.conf.get('spark.checkpoint.dir')}/t{abs(hash(id(d)))}{d.sparkSession.range(1).select(F.expr('uuid()')).first()[0]}"
        token_files.write_token_files(d, path)
        return token_files.read_token_files(spark, path)

    return {
        "packing": lambda d: packing.pack_documents(d),
        "licenses": lambda d: licenses.scan_licenses(d),
        "secrets": lambda d: secrets.secret_rows(secrets.find_secrets(d, FOREST, out="_secrets"), out="_secrets"),
        "token_files": files,
        "decontaminate": lambda d: decontaminate.find_leaks(d, benchmark),
        "simhash": lambda d: simhash.simhash_components(d),
        "media": lambda d: media.read_media(media.store_media(d)),
        "language": lambda d: language.identify(d, DICTS, prefix="found_"),
        "toxicity": lambda d: toxicity.score_toxicity(d, MODEL, prefix="tox_"),
    }


NAMES = ["packing", "licenses", "secrets", "token_files", "decontaminate", "simhash", "media", "language", "toxicity"]


@pytest.mark.parametrize("name", NAMES)
def test_edge_rows(spark, docs, wide, empty, benchmark, name):
    run = operators(spark, benchmark)[name]
    rows = run(docs).collect()
    narrow = [c for c in run(docs).columns]
    again = run(wide).select(*narrow).collect()
    drop = {"sequence_id"}
    key = lambda r: repr([(k, v) for k, v in r.asDict(recursive=True).items() if k not in drop])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert run(empty).count() == 0 and run(empty).columns == narrow
    if name in ("token_files", "simhash", "media", "language", "toxicity"):
        assert len(rows) == len(ROWS)
    if name == "packing":
        assert sum(r["start"] == 0 for r in rows) == len(ROWS)
        assert {r["length"] for r in rows if r["doc_id"] in (2, 3, 4)} == {1}
    if name == "simhash":
        assert {r["fingerprint"] for r in rows if r["doc_id"] in (2, 3, 4)} == {"0" * 16}
        assert {r["component_id"] for r in rows if r["doc_id"] in (2, 3, 4)} == {2}
    if name == "language":
        assert {r["found_pred"] for r in rows if r["doc_id"] in (2, 3, 4)} == {"und"}
        assert {r["doc_id"]: r["found_pred"] for r in rows}[-7] == "de"
    if name == "decontaminate":
        assert [(r["doc_id"], r["item_id"]) for r in rows] == [(5, 1)]


def test_clashing_output_columns_are_refused(docs):
    with pytest.raises(ValueError):
        language.identify(docs.withColumn("lang_pred", F.lit(1)), DICTS)
    with pytest.raises(ValueError):
        toxicity.score_toxicity(docs.withColumn("toxic_score", F.lit(1)), MODEL)
    with pytest.raises(ValueError):
        secrets.find_secrets(docs.withColumn("secrets", F.lit(1)), FOREST)
    with pytest.raises(ValueError):
        packing.pack_documents(docs, max_len=1000)


def test_chat_edges(spark):
    rows = [(1, 2, "assistant", "b"), (1, 0, "user", None), (1, 1, None, "x"), (1, 2, "assistant", "b"), (None, 0, "us\ner", "<|im_sep|>"), (2, None, "assistant", "<\\|x<|"), (2, 1, "assistant", "l" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("t", F.lit(1)).withColumn("runs", F.lit(2))
    got = {r["conv_id"]: r for r in chat.parse_chats(chat.format_chats(df)).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("user", ""), ("", "x"), ("assistant", "b"), ("assistant", "b")] and got[1]["loss_text"] == "bb"
    assert [tuple(t) for t in got[None]["turns"]] == [("us\ner", "<|im_sep|>")]
    assert [tuple(t) for t in got[2]["turns"]] == [("assistant", "<\\|x<|"), ("assistant", "l" * 100_000)]
    assert got[1]["formatted"].count("<|im_start|>") == 3
    assert chat.format_chats(df.where("false")).count() == 0


def test_chat_spans_hold_one_text_each(spark):
    rows = [(1, 0, "user", "hé"), (1, 1, "assistant", "aa"), (1, 2, "assistant", "b<|im_end|>ü"), (1, 3, "assistant", ""), (1, 4, "user", "😀"), (1, 5, "assistant", "zz")]
    (r,) = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    text = r["formatted"]
    assert [text[s["start"] : s["end"]] for s in r["loss_spans"]] == ["aa", "b<\\|im_end|>ü", "", "zz"]
    assert [text.encode()[s["start_byte"] : s["end_byte"]].decode() for s in r["loss_spans"]] == ["aa", "b<\\|im_end|>ü", "", "zz"]
    assert "<|im_sep|>" in text and all("<|im_sep|>" not in text[s["start"] : s["end"]] for s in r["loss_spans"])


@pytest.mark.parametrize("k", range(len(P.STAGES)))
def test_stages(spark, docs, wide, empty, benchmark, tmp_path, k):
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    name, stage = P.STAGES[k]
    kept = stage(spark, docs, str(tmp_path))
    rows = kept.collect()
    assert stage(spark, empty, str(tmp_path)).count() == 0
    if k < len(P.STAGES) - 1:
        assert kept.schema.simpleString() == docs.schema.simpleString()
        assert sorted(stage(spark, wide, str(tmp_path)).columns) == sorted(wide.columns)
    if k == 0:
        assert {r["doc_id"] for r in rows}.isdisjoint({2, 3, 4})
    if k == 1:
        assert sum(r["doc_id"] == 1 for r in rows) == 1 and sum(r["doc_id"] in (2, 3, 4) for r in rows) == 1
    if k == 2:
        assert {r["doc_id"] for r in rows} == {1, 2, 3, None, 4, 6, -7}
    if k == 3:
        assert len(rows) == len(ROWS)


def test_slices_cover_every_row_once(monkeypatch):
    import pyarrow as pa

    from pairlens.llm import common

    monkeypatch.setattr(common, "SLICE_BYTES", 10)
    texts = ["aaaa", None, "", "b" * 25, "cc", "dddddddddd", "e"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["i", "t"])
    for rows in (1, 2, 100):
        parts = list(common.slices([batch, batch.slice(0, 0)], rows, 1))
        assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts)))
        assert all(p.num_rows == 1 or (p.num_rows <= rows and sum(len(t or "") for t in p.column(1).to_pylist()) <= 10) for p in parts)
        assert sum(p.num_rows for p in common.slices([batch], rows)) == len(texts)
