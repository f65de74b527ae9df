import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from pairlens import cli
from pairlens.functions.samples import PAIRS
from pairlens.plans.scan import oversized, scan
from pairlens.sources import landed, sinks, store
from pairlens.streaming.scans import scan_stream

ENTRY = cli.ENTRY


def entries():
    return [("o/r", f"src/{n}.js", n, "f" * 40, v, p, f"A-{i}", "high", "pkg") for i, (n, v, p) in enumerate(PAIRS)]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(entries(), ENTRY)


def test_scan_tells_sides_apart(spark, corpus):
    near = PAIRS[0][1].replace("return target;", "log(1);\n  return target;")
    files = spark.createDataFrame([("a.js", PAIRS[0][1]), ("b.js", PAIRS[0][2]), ("c.js", PAIRS[0][1].replace("target", "into")), ("d.js", near), ("e.js", "function broken( {")], "path string, content string")
    rows = scan(files, corpus).where("advisory = 'A-0'").collect()
    got = {r["path"]: (r["route"], r["status"]) for r in rows}
    assert got["a.js"] == ("hash", "vulnerable") and got["b.js"] == ("hash", "patched") and got["c.js"] == ("hash", "vulnerable")
    assert got["d.js"][0] == "retrieval" and got["d.js"][1] in ("vulnerable", "uncertain")
    assert {r["path"]: r["priority"] for r in rows}["a.js"] == "automatic_vulnerability"
    assert "e.js" not in got


def test_scan_states_follow_regions(spark):
    """Verdicts, conflicts and rejections of the verification chain, end to end."""
    safe = "function send(url, body) {\n  const opts = { method: 'POST' };\n  prepare(opts, body);\n  opts.headers = base(opts);\n  return fetch(url, opts);\n}"
    fixed = safe.replace("opts.headers = base(opts);", "opts.headers = strict(opts, url.host, true);")
    swap = "function pick(list, at) {\n  const n = at;\n  return list[n] + at;\n}", "function pick(list, at) {\n  const n = at;\n  return list[!n] + at;\n}"
    long = "function mix(first, second, last) {\n  let total = 0;\n  total = first + second + third + fourth + fifth - last;\n  return total;\n}"
    rows = [("o/r", "src/send.js", "send", "f1", safe, fixed, "B-0", "high", "pkg"), ("o/r", "src/pick.js", "pick", "f2", *swap, "B-1", "low", "pkg"), ("o/r", "src/mix.js", "mix", "f3", long, long.replace("- last", "+ last"), "B-2", "low", "pkg")]
    corpus = spark.createDataFrame(rows, ENTRY)
    files = [
        ("v.js", safe.replace("prepare(opts, body);", "prepare(opts, body);\n  trace(body);")), ("p.js", fixed.replace("prepare(opts, body);", "prepare(opts, body);\n  trace(body);")),
        ("other.js", "function unrelated(rows, key) {\n  for (const row of rows) {\n    if (row.kind === 'total') continue;\n    emit(row.kind, key.size, 17);\n  }\n  const n = key;\n  return rows[n] + key;\n}"),
        ("mixed.js", "function mixed(first, second, last) {\n  let total = 0;\n  n = p + q - r;\n  total = first + second + third + fourth + fifth + last\n}"),
        ("far.js", "function far(x) {\n  while (x.next) { x = x.next; }\n  return x.value + 1;\n}"),
    ]
    found = {(r["path"], r["advisory"]): r for r in scan(spark.createDataFrame(files, "path string, content string"), corpus).collect()}
    v, p = found["v.js", "B-0"], found["p.js", "B-0"]
    assert (v["route"], v["status"], v["priority"]) == ("retrieval", "vulnerable", "automatic_vulnerability")
    assert (p["route"], p["status"]) == ("retrieval", "patched") and p["priority"] in ("informational_lineage", "manual_review")
    assert found["other.js", "B-1"]["abstention_reason"] == "IDENTITY_REJECTED" and found["mixed.js", "B-2"]["abstention_reason"] == "CONTRASTIVE_CONFLICT"
    assert found["far.js", "B-0"]["status"] == "uncertain" and found["far.js", "B-0"]["abstention_reason"] in ("S_FAILED", "T_FAILED")


def test_local_vote():
    from pairlens.functions import js

    name, v, p = PAIRS[1]
    assert js.local_vote(v.replace("value", "x"), v, p) == "vulnerable" and js.local_vote(p, v, p) == "patched" and js.local_vote("function f() {}", v, p) is None


def test_oversized(spark):
    files = spark.createDataFrame([("a.js", "x" * 300_000), ("b.js", "y")], "path string, content string")
    assert [r["path"] for r in oversized(files).collect()] == ["a.js"]


def test_stream_reuses_contents(spark, corpus, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text(json.dumps({"path": "a.js", "content": PAIRS[0][1]}) + "\n")
    stream = spark.readStream.schema("path string, content string").json(str(folder))
    counts = []
    for _ in range(2):
        scan_stream(stream, corpus, str(tmp_path / "out"), str(tmp_path / "cp"), after=lambda df, n: counts.append(df.count())).awaitTermination()
        (folder / "2.json").write_text(json.dumps({"path": "moved.js", "content": PAIRS[0][1]}) + "\n")
    assert counts[0] >= 1 and counts[1] == 0


def test_landed_sources(spark, tmp_path):
    (tmp_path / "adv.json").write_text(
        json.dumps({"ghsa_id": "g", "withdrawn_at": None, "vulnerabilities": [{"package_ecosystem": "npm", "package_name": "p", "vulnerable_version_range": "<2", "first_patched_version": "2.0.0"}]}) + "\n" + json.dumps({"ghsa_id": "w", "withdrawn_at": "2020", "vulnerabilities": []}) + "\n"
    )
    assert [r["package"] for r in landed.read_advisories(spark, str(tmp_path / "adv.json"), "npm").collect()] == ["p"]
    (tmp_path / "osv.json").write_text(json.dumps({"id": "o", "aliases": ["g"], "affected": [{"package": {"name": "p", "ecosystem": "npm"}, "ranges": [{"type": "SEMVER", "events": [{"introduced": "0"}, {"fixed": "2.0.0"}]}], "versions": ["1.0.0"]}]}) + "\n")
    r = landed.read_osv(spark, str(tmp_path / "osv.json")).first()
    assert (r["ghsa_alias"], r["introduced"], r["fixed"], r["versions"]) == ("g", "0", "2.0.0", ["1.0.0"])
    (tmp_path / "u.json").write_bytes('{"x": "a b\u0085c"}\n{"x": "d"}\n'.encode())
    assert landed.read_jsonl(spark, str(tmp_path / "u.json"), "x string").count() == 2
    with pytest.raises(ValueError):
        landed.osv_query(commit="a", package="b")
    assert landed.osv_query(commit="a") == {"commit": "a"}
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return "ok"

    assert landed.with_retries(flaky, sleep=lambda s: None) == "ok"


def test_tree_and_archives(spark, tmp_path):
    tree = tmp_path / "tree"
    (tree / "src").mkdir(parents=True)
    (tree / "node_modules").mkdir()
    (tree / "src" / "a.js").write_text("x")
    (tree / "src" / "a.txt").write_text("x")
    (tree / "node_modules" / "b.js").write_text("x")
    assert [r["path"] for r in landed.read_tree(spark, str(tree)).collect()] == ["src/a.js"]
    assert landed.read_tree(spark, str(tree), required=["node_modules/b.js"]).count() == 2

    def tar(members):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as t:
            for name, data in members:
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
        return out.getvalue()

    df = spark.createDataFrame([("ok", bytearray(tar([("src/a.js", b"1"), ("dist/a.js", b"2")]))), ("bad", bytearray(tar([("../a.js", b"1")]))), ("none", None)], "name string, content binary")
    rows = landed.extract_tars(df).collect()
    assert {(r["archive"], r["path"], r["problem"]) for r in rows} == {("ok", "src/a.js", None), ("ok", "dist/a.js", None), ("bad", None, "unsafe path"), ("none", None, "no content")}
    assert [r["path"] for r in landed.prune_artifact(landed.extract_tars(df).where("problem IS NULL")).collect()] == ["src/a.js"]


def test_snapshots(spark, tmp_path):
    df = spark.range(5)
    name = store.publish(df, str(tmp_path))
    assert store.publish(df.repartition(3), str(tmp_path)) == name and store.load(spark, str(tmp_path)).count() == 5
    other = store.publish(spark.range(6), str(tmp_path))
    assert other != name and store.current(spark, str(tmp_path)) == other
    with pytest.raises(ValueError):
        store.publish(spark.range(0), str(tmp_path))
    assert store.load(spark, str(tmp_path)).count() == 6


def test_sinks(spark):
    rows = [{"path": "a/b.js", "start_line": 2, "end_line": 4, "priority": "automatic_vulnerability", "severity": "high", "advisory": "A", "reason": "<r>"}, {"path": "c.js", "start_line": 0, "end_line": 0, "priority": "informational_lineage", "severity": None, "advisory": None, "reason": None}]
    s = json.loads(sinks.sarif(rows))
    assert s["version"] == "2.1.0" and [r["level"] for r in s["runs"][0]["results"]] == ["error", "note"] and s["runs"][0]["results"][0]["locations"][0]["physicalLocation"]["region"]["startLine"] == 3
    assert sinks.compact(rows).splitlines()[0] == "." and "&lt;r&gt;" in sinks.page(rows)
    df = spark.createDataFrame(rows, "path string, start_line int, end_line int, priority string, severity string, advisory string, reason string").withColumn("dismissed", F.lit(False))
    assert sinks.exit_code(df) == 1 and sinks.exit_code(df.where("path = 'c.js'")) == 0 and sinks.summary(df).count() == 2
    assert [r["path"] for r in sinks.ordered(df).collect()] == ["a/b.js", "c.js"]


def test_command_line(spark, tmp_path, capsys):
    lines = tmp_path / "entries.json"
    keys = [f.split()[0] for f in ENTRY.split(", ")]
    lines.write_text("".join(json.dumps(dict(zip(keys, e))) + "\n" for e in entries()))
    corpus, tree, out = str(tmp_path / "corpus"), tmp_path / "tree", str(tmp_path / "scan")
    tree.mkdir()
    (tree / "a.js").write_text(PAIRS[0][1])
    assert cli.main(["scan", str(tree), "--corpus", corpus, "--output", out], spark) == 2
    assert cli.main(["corpus", "build", "--corpus", corpus, "--entries", str(lines)], spark) == 0
    assert cli.main(["corpus", "probe", "--corpus", corpus], spark) == 0
    assert cli.main(["scan", str(tree), "--corpus", corpus, "--output", out], spark) == 1
    capsys.readouterr()
    assert cli.main(["report", out, "--format", "json"], spark) == 1
    found = json.loads(capsys.readouterr().out)
    assert found[0]["path"] == "a.js" and found[0]["status"] == "vulnerable"
    assert cli.main(["dismiss", out, found[0]["finding_id"], "--reason", "known"], spark) == 0
    assert cli.main(["report", out], spark) == 0
    from pairlens.sources import reviews, store

    (record,) = reviews.load(out)
    assert record["id"] == found[0]["finding_id"] and record["reason"] == "known"
    with reviews.locked(out):
        assert cli.main(["dismiss", out, found[0]["finding_id"], "--undo"], spark) == 2
    assert cli.main(["dismiss", out, found[0]["finding_id"], "--undo"], spark) == 0 and reviews.load(out) == []
    sinks.write_text(reviews.place(out), json.dumps({"schema": reviews.SCHEMA, "dismissals": [record | {"id": "0" * 64}]}))
    with pytest.raises(ValueError):
        reviews.load(out)
    # the same change again under another advisory: one entry with both
    again = dict(zip(keys, entries()[0])) | {"advisory": "A-00"}
    lines.write_text(json.dumps(again) + "\n")
    assert cli.main(["corpus", "build", "--corpus", corpus, "--entries", str(lines), "--append"], spark) == 0
    rows = store.load(spark, corpus)
    assert rows.count() == len(PAIRS) and rows.where("function = 'merge'").first()["aliases"] == ["A-0", "A-00"]
    built = []
    for _ in range(2):
        assert store.cached(lambda: built.append(1) or spark.range(3), str(tmp_path / "kept"), rows).count() == 3
    assert built == [1]
