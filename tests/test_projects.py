"""Project evidence, whole release boundaries, landed contents and metadata, reconciled reports, exports."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from pairlens.operators import corpus as C
from pairlens.operators import project as P
from pairlens.operators import regions as R
from pairlens.operators import state as S
from pairlens.operators.batches import halving
from pairlens.operators.retrieval import batch_encoder
from pairlens.plans.scan import with_applicability, with_boundary
from pairlens.sources import landed, sinks

FILES = "project string, path string, content string"


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_package_of(spark):
    names = ["lodash/fp", "@a/b/c", "@a", "./x", "/x", "node:fs", "#in", "", "fs", None]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(P.package_of(F.col("n")))
    assert [r[0] for r in df.collect()] == ["lodash", "@a/b", "@a", None, None, None, None, None, "fs", None]


def test_imports(spark):
    text = "import a from 'x/y'\nimport{b}from\"@s/t\"; require( 'z' ); import('w'); import './l'; // frommage 'no'\nimportant('q')"
    rows = P.imports(spark.createDataFrame([("p", "a.js", text), ("p", "b.js", None), ("p", "c.js", ""), ("p", "a.js", text)], FILES)).collect()
    assert sorted(r["package"] for r in rows) == ["@s/t", "w", "x", "z"]


@pytest.fixture(scope="module")
def project(spark):
    top = {"name": " top ", "version": 1, "dependencies": {"used": "^1", "both": "1", "quiet": "3"}, "devDependencies": {"both": "2", "odd": {"a": 1}}}
    rows = [
        ("p", "package.json", json.dumps(top)), ("p", "lib/package.json", json.dumps({"name": "inner", "dependencies": "none"})), ("p", "bad/package.json", "{"), ("p", "list/package.json", "[1]"), ("p", ".git/package.json", json.dumps(top)),
        ("p", "a.js", "require('used')"), ("p", "package-lock.json", json.dumps({"packages": {"": {}, "node_modules/used": {"version": "1.2.3"}, "node_modules/both": {"version": " "}, "node_modules/x": 1}})), ("p", "yarn.lock", "quiet@3:\n"), ("q", "yarn.lock", "used@1"),
    ]
    return spark.createDataFrame(rows, FILES)


def test_manifests(project):
    assert {(r["path"], r["folder"], r["name"], r["version"]) for r in P.manifests(project).collect()} == {("package.json", "", "top", "1"), ("lib/package.json", "lib", "inner", None)}
    found = P.declarations(project)
    assert {(r["package"], r["requirement"]) for r in found.collect()} == {("used", "^1"), ("both", "2"), ("quiet", "3"), ("odd", '{"a":1}')}
    assert {(r["project"], r["package"], r["version"]) for r in P.locked(project, found).collect()} == {("p", "used", "1.2.3"), ("p", "both", None), ("p", "quiet", None)}


def test_assess(spark, project):
    asked = [
        ("a.js", "used", "confirmed", "resolved_dependency", "1.2.3"), ("a.js", "both", "confirmed", "resolved_dependency", "2"), ("a.js", "odd", "unknown", "manifest_declaration", '{"a":1}'), ("a.js", "none", "unknown", None, None),
        ("a.js", "top", "confirmed", "package_ownership", "1"), ("lib/x/a.js", "top", "unknown", None, None), ("lib/x/a.js", "inner", "confirmed", "package_ownership", None),
        ("node_modules/y/node_modules/@s/t/a.js", "@s/t", "confirmed", "package_ownership", None), ("node_modules/y/a.js", "used", "conflicting", "package_ownership", None),
        ("vendor/@s-t/a.js", "@s/t", "confirmed", "vendored_path", None), ("vendor/z/a.js", "zz", "unknown", None, None),
    ]
    rows = spark.createDataFrame([("p", path, package) for path, package, *_ in asked], "project string, path string, package string")
    got = {(r["path"], r["package"], r["status"], r["kind"], r["evidence_version"]) for r in P.assess(rows, project).collect()}
    assert got == set(asked)
    assert [r["status"] for r in P.assess(rows.limit(1), project.where("false")).collect()] == ["unknown"]


def test_resolved_boundaries(spark):
    fix = lambda p, fixed="2.0.0", affected=("1.0.0", "1.9.0", "1.10.0", "2.1.0"), repo="o/r", sha="f": (p, repo, sha, fixed, list(affected))
    fixes = spark.createDataFrame(
        [fix("good"), fix("good", repo="o/other"), fix("good", affected=()), fix("good", affected=("2.0.0",)), fix("good", affected=("1.0.0",)), fix("bad"), fix("other"), fix("lost"), fix("good", sha="late"), fix("good", sha="far"), fix("good", sha="c1"), fix("none")],
        "package string, repo string, fix string, first_fixed string, affected_versions array<string>",
    )
    rel = lambda p, v, commit, name=None, tag=None, version=None: (p, "O/R", v, f"{p}-{v}.tgz", name or p, version or v, "h" + v, commit, tag)
    releases = spark.createDataFrame(
        [rel("good", "1.10.0", "c1", version="v1.10.0"), rel("good", "2.0.0", None, tag="c2"), rel("bad", "1.10.0", "c1", name="x"), rel("bad", "2.0.0", "c2"), rel("other", "1.10.0", "c1")[:4] + (None, None, None, None, None), rel("lost", "1.10.0", None)],
        "package string, repo string, version string, tarball string, artifact_name string, artifact_version string, artifact_sha256 string, git_head string, tag_commit string",
    )
    comparisons = spark.createDataFrame([("o/r", "c1", "f", "ahead"), ("o/r", "f", "c2", "ahead"), ("o/r", "c1", "late", "ahead"), ("o/r", "late", "c2", "diverged"), ("o/r", "c1", "c2", "ahead")], "repo string, older string, newer string, status string")
    got = sorted(((r["package"], r["fix"], r["repo"], len(r["affected_versions"])), r["reason_code"]) for r in C.resolved_boundaries(fixes, releases, comparisons).where("reason_code IS NOT NULL").collect())
    assert got == sorted([
        (("good", "f", "o/other", 4), "repository_mismatch"), (("good", "f", "o/r", 0), "affected_versions_missing"), (("good", "f", "o/r", 1), "last_affected_unresolved"), (("good", "f", "o/r", 1), "tarball_missing"),
        (("bad", "f", "o/r", 4), "tarball_identity_mismatch"), (("other", "f", "o/r", 4), "tarball_invalid"), (("lost", "f", "o/r", 4), "release_commit_unresolved"),
        (("good", "late", "o/r", 4), "fix_outside_release_boundary"), (("good", "far", "o/r", 4), "commit_ancestry_unresolved"), (("none", "f", "o/r", 4), "repository_mismatch"),
    ])
    rows = C.resolved_boundaries(fixes, releases, comparisons).where("reason_code IS NULL").collect()
    assert {(r["fix"], r["last_affected"], r["last_affected_commit"], r["first_fixed_commit"], r["fixed_artifact"]) for r in rows} == {("f", "1.10.0", "c1", "c2", "h2.0.0"), ("c1", "1.10.0", "c1", "c2", "h2.0.0")}


def test_contents(spark, tmp_path):
    code = lambda b: base64.encodebytes(b).decode()
    rows = [
        {"path": "a", "status": 200, "encoding": "base64", "content": code("é".encode() * 60)}, {"path": "b", "status": 404}, {"path": "c", "status": 200, "encoding": "none", "sha": "s"}, {"path": "d", "status": 200, "encoding": "none", "sha": "t"},
        {"path": "e", "status": 200, "encoding": "gzip", "content": ""}, {"path": "f", "status": 200, "encoding": "base64", "content": code(b"\xff\xfe")}, {"path": "g", "status": 200, "encoding": "base64", "content": ""},
    ]
    blobs = [{"repo": "r", "sha": "s", "encoding": "base64", "content": code(b"big")}]
    df = landed.read_contents(spark, lines(tmp_path / "c.jsonl", [{"repo": "r", "ref": "x", **r} for r in rows]), lines(tmp_path / "b.jsonl", blobs))
    assert {r["path"]: (r["content"], r["problem"]) for r in df.collect()} == {"a": ("é" * 60, None), "b": (None, None), "c": ("big", None), "d": (None, "blob_missing"), "e": (None, "unexpected_encoding"), "f": (None, "not_utf8"), "g": ("", None)}


def test_package_metadata(spark, tmp_path):
    versions = {"1.0.0": {"dist": {"tarball": "t"}, "gitHead": "g"}, "2.0.0": {}}
    rows = [{"package": "a", "status": 200, "body": {"repository": {"url": "git+https://github.com/O/R.git"}, "versions": versions}}, {"package": "b", "status": 404}, {"package": "c", "body": {"repository": "github:o/s", "versions": {}}}]
    df = landed.read_releases(spark, lines(tmp_path / "m.jsonl", rows))
    assert {tuple(r) for r in df.collect()} == {("a", "o/r", "1.0.0", "t", "g", False), ("a", "o/r", "2.0.0", None, None, False), ("b", None, None, None, None, True), ("c", "o/s", None, None, None, False)}
    scores = [{"package": "a", "body": {"collected": {"npm": {"dependentsCount": 7}}}}, {"package": "b", "body": {}}]
    assert {tuple(r) for r in landed.read_dependents(spark, lines(tmp_path / "d.jsonl", scores)).collect()} == {("a", 7), ("b", 0)}


def test_reconcile(spark):
    findings = spark.createDataFrame([("a", "f1", "h1", "s1"), ("a", "f2", "h2", None), ("b", "f3", "h3", "s3"), ("c", "f4", "h4", "s4")], "path string, function_id string, function_hash string, signature string")
    kept = [(1, "a", "f1", "A", "h1", "s1", 1), (2, "a", "f2", "A", "h2", "s2", 1), (3, "b", "f3", "old", "h3", "s3", 1)]
    dismissals = spark.createDataFrame(kept, "id int, path string, function_id string, file_hash string, function_hash string, signature string, dismissed_at int")
    files = spark.createDataFrame([("a", "A", True), ("b", "B", True), ("c", "C", True)], "path string, file_hash string, scanned boolean")
    got = {r["function_id"]: (r["state"], r["reason"]) for r in S.reconcile(findings, dismissals, files).collect()}
    assert got == {"f1": ("dismissed", None), "f2": ("reopened", "no_longer_present"), "f3": ("reopened", "file_changed"), "f4": (None, None)}
    gone = {r["function_id"]: r["reason"] for r in S.reconcile(findings, dismissals, files.where("path <> 'a'")).collect()}
    assert gone["f1"] == "file_missing"
    assert {r["state"] for r in S.reconcile(findings, dismissals.where("false"), files).collect()} == {None}


def test_sarif_shape():
    row = {"path": "a b/c.js", "start_line": 2, "end_line": 1, "name": "f", "priority": "manual_review", "advisory": "A", "aliases": ["B", "A"], "reason": "r", "function_hash": "h", "unit": "u"}
    run = json.loads(sinks.sarif([row], root="/p"))["runs"][0]
    found = run["results"][0]
    where = found["locations"][0]["physicalLocation"]
    assert where == {"artifactLocation": {"uri": "a%20b/c.js", "uriBaseId": "%SRCROOT%"}, "region": {"startLine": 3, "endLine": 3}}
    assert run["originalUriBaseIds"]["%SRCROOT%"]["uri"] == "file:///p/" and found["level"] == "note" and found["message"]["text"] == "f: r"
    assert [r["name"] for r in run["tool"]["driver"]["rules"]] == ["vulnerable-code", "manual-review"] and found["properties"]["pairlens"]["advisoryIds"] == ["A", "B"]
    same = json.loads(sinks.sarif([{**row, "start_line": 9, "end_line": 9}]))["runs"][0]["results"][0]
    assert same["partialFingerprints"] == found["partialFingerprints"]


def test_halving():
    seen = []

    def run(items):
        seen.append(len(items))
        if len(items) > 2:
            raise MemoryError
        return [x * 2 for x in items]

    assert halving(run, list(range(7)), 8) == [x * 2 for x in range(7)] and seen[0] == 7
    assert halving(run, [], 8) == []
    with pytest.raises(MemoryError):
        halving(lambda items: (_ for _ in ()).throw(MemoryError()), [1, 2], 2)
    with pytest.raises(ValueError):
        halving(lambda items: (_ for _ in ()).throw(ValueError()), [1, 2], 2)


def test_unknown_arm(spark):
    with pytest.raises(KeyError):
        R.eligible(spark.range(1).withColumn("granularity", F.lit("block")), "no_such")


def test_batch_encoder(spark):
    def run(texts):
        if len(texts) > 2:
            raise MemoryError
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([("a",), ("bcd",), (None,), ("",), ("ef",)], "t string").coalesce(1).select("t", batch_encoder(run)(F.col("t")).alias("v"))
    assert [r["v"] for r in df.collect()] == [[1.0, 1.0], [3.0, 1.0], [0.0, 1.0], [0.0, 1.0], [2.0, 1.0]]


def test_with_applicability(spark, tmp_path):
    corpus = spark.createDataFrame([("o/r", "x.js", "f", "c", "old", "new", "A", "used"), ("o/r", "x.js", "f", "c", "old", "new", "B", "gone"), ("o/s", "y.js", "g", "d", "old", "new", "C", None)], "repo string, path string, function string, fix string, vulnerable string, patched string, advisory string, package string")
    ids = {r["repo"]: r["boundary"] for r in with_boundary(corpus).collect()}
    findings = spark.createDataFrame([("a.js", ids["o/r"], 1), ("a.js", ids["o/r"], 2), ("a.js", ids["o/s"], 3)], "path string, boundary string, n int")
    (tmp_path / "a.js").write_text("require('used')")
    (tmp_path / "package.json").write_text(json.dumps({"dependencies": {"used": "1"}}))
    files = landed.read_tree(spark, str(tmp_path)).select("path", F.col("content").cast("string").alias("content")).unionByName(landed.read_project(spark, str(tmp_path)))
    got = {r["n"]: r["packages"] for r in with_applicability(findings, corpus, files).collect()}
    assert got == {1: ["gone:unknown", "used:confirmed"], 2: ["gone:unknown", "used:confirmed"], 3: []}
