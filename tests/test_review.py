import json
import random

from pyspark.sql import functions as F

from pairlens.functions.samples import PAIRS
from pairlens.operators import extraction as X
from pairlens.operators import reports as P
from pairlens.operators import selection as S

PATCH = "@@ -1,4 +1,5 @@\n a\n-b\n+c\n+\n+// note\n \n d\n\\ No newline at end of file"


def test_patch_lines():
    before, after, count = X.patch_lines(PATCH)
    assert before == {1} and after == {1, 2, 3} and count == 2
    assert X.patch_lines("@@ -1 +1,3 @@\n+/* x\n+ y\n+*/\n+z")[2] == 1
    assert X.patch_lines("") == (set(), set(), 0)


def test_units_of_lines_and_pairs():
    u = lambda n, a, b: {"name": n, "start_line": a, "end_line": b, "start_byte": a, "end_byte": b}
    units = [u("outer", 0, 20), u("inner", 5, 8)]
    assert [x["name"] for x in X.touched(units, {6, 7, 15})] == ["inner", "outer"]
    pairs = X.match_units([u("a", 0, 1), u(None, 100, 110)], [u(None, 130, 140), u("a", 90, 95)])
    assert [(x["name"], y["start_line"]) for x, y in pairs] == [("a", 90), (None, 130)]
    assert X.match_units([u(None, 0, 1)], [u(None, 60, 61)]) == [] and X.match_units([], []) == [] and X.match_units([u("a", 0, 1)], []) == []


def slow_match(before, after, nearest=50):
    left, pairs, rest = list(after), [], []
    for u in before:
        same = [v for v in left if u["name"] and v["name"] == u["name"]]
        if same:
            left.remove(same[0])
            pairs.append((u["id"], same[0]["id"]))
        else:
            rest.append(u)
    for u in rest:
        near = sorted(left, key=lambda v: abs(v["start_line"] - u["start_line"]))
        if near and abs(near[0]["start_line"] - u["start_line"]) <= nearest:
            left.remove(near[0])
            pairs.append((u["id"], near[0]["id"]))
    return pairs


def test_units_against_slow_forms():
    rng = random.Random(3)
    for _ in range(400):
        sides = []
        for side in "ba":
            units = []
            for k in range(rng.randrange(0, 7)):
                a = rng.randrange(120)
                units.append({"id": f"{side}{k}", "name": rng.choice([None, "f", "g", "h"]), "start_line": a, "end_line": a + rng.randrange(30), "start_byte": 10 * a + k, "end_byte": 10 * a + k + 5})
            sides.append(units)
        got = [(u["id"], v["id"]) for u, v in X.match_units(*sides)]
        assert got == slow_match(*sides)
        lines = {rng.randrange(150) for _ in range(rng.randrange(0, 9))}
        want = []
        for line in sorted(lines):
            around = [u for u in sides[0] if u["start_line"] <= line <= u["end_line"]]
            inner = min(around, key=lambda u: (u["end_line"] - u["start_line"], u["start_byte"]), default=None)
            if inner is not None and inner not in want:
                want.append(inner)
        assert X.touched(sides[0], lines) == want


def test_pairs_of_files():
    import difflib

    name, v, p = PAIRS[0]
    patch = "\n".join(list(difflib.unified_diff(v.split("\n"), p.split("\n"), lineterm=""))[2:])
    (pair,), reason = X.extract_pairs("a.js", v, p, patch)
    assert pair["name"] == "merge" and pair["change_kind"] == "insertion" and reason is None
    assert X.extract_pairs("a.js", None, p, "")[1] == "added_only" and X.extract_pairs("a.js", v, v, "")[1] == "identical"
    assert X.extract_pairs("a.js", v, v.replace("  ", "    "), "")[1] == "formatting_only" and X.extract_pairs("a.js", "(", p, "")[1] == "parser_invalid"


def test_gates_and_derived_texts():
    for name, text, _ in PAIRS:
        for family in ("rename", "reformat", "dead_branch", "split_return"):
            made = X.derive(text, family)
            if made and made != text:
                assert X.preservation_problem(text, made) in (None, "ungateable"), (name, family, made)
        if (made := X.derive(text, "rename")) and "`" not in text:
            assert X.same_but_for_names(text, made) or name in ("render", "parse", "read")
    assert X.preservation_problem(PAIRS[1][1], "function isHost(value) { return true; }") == "literal_dropped"
    assert X.preservation_problem("a", "a") == "identical"
    assert X.syntax_key("a = 1 // x") == X.syntax_key("a=1") and X.syntax_key("(") is None


def test_reports(spark):
    sarif = json.dumps({"runs": [{"results": [{"ruleId": "js/cwe-079-xss", "level": "error", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "a.js"}, "region": {"startLine": 3}}}]}]}]})
    semgrep = json.dumps({"results": [{"path": "b.js", "check_id": "r", "start": {"line": 1}, "end": {"line": 2}, "extra": {"message": "m", "severity": "WARNING", "metadata": {"cwe": ["CWE-0022: x", "other"]}}}]})
    df = spark.createDataFrame([(sarif,), (None,), ("{broken",)], "body string")
    assert [(r["path"], r["end_line"], r["cwes"]) for r in P.adapt(df, "sarif").collect()] == [("a.js", 3, ["CWE-79"])]
    assert [(r["path"], r["severity"], r["cwes"]) for r in P.adapt(spark.createDataFrame([(semgrep,)], "body string"), "semgrep").collect()] == [("b.js", "warning", ["CWE-22"])]
    text = json.dumps({"a": [{"ghsa_id": "G2"}, {"b": {"ghsa_id": "G1"}}], "ghsa_id": "G2"})
    assert spark.range(1).select(P.nested_ids(F.lit(text))).first()[0] == ["G1", "G2"]
    got = spark.range(1).select(P.target_match(F.lit(True), F.lit(None).cast("string"), F.lit("s"), F.lit("n"), F.lit("n"))).first()[0]
    assert got is True


def test_selection(spark):
    cases = spark.createDataFrame([(1, ["a", "b"], "x"), (2, ["b", "c"], "x"), (3, ["d"], "x"), (4, ["c"], "y"), (5, [], "y")], "id long, tokens array<string>, s string")
    groups = S.leakage_groups(cases, "id")
    assert {tuple(r) for r in groups.collect()} == {(1, 1), (2, 1), (4, 1), (3, 3), (5, 5)}
    split = {r["group"]: r["split"] for r in S.split_groups(cases, groups, "id", "s", 0.5).collect()}
    assert set(split) == {1, 3, 5} and "tuning" in split.values()
    rows = [{"id": i, "language": "js" if i % 3 else "ts", "package": f"p{i % 2}", "advisory": i} for i in range(12)]
    chosen = S.diverse(rows, 6)
    assert len(chosen) == 6 and {r["language"] for r in chosen} == {"js", "ts"} and max(sum(r["package"] == p for r in chosen) for p in ("p0", "p1")) == 3


def test_expanded_and_wrapped():
    from pairlens.functions import js

    assert js.expand("function f(a){for(let i=0;i<a;i++){g(i);}return a;}").count("\n") >= 4
    text, lines, size = js.wrapped("read(path) { return path; }")
    assert text.startswith("class") and lines == 1 and size == len("class W {\n") and js.wrapped("function f() {}")[1:] == (0, 0) and js.wrapped("{ (") is None


def test_expected_ranks(spark):
    from pairlens.operators.evaluation import expected_rank

    hits = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (2, "x", 1)], "case_id int, origin string, rank int")
    want = spark.createDataFrame([(1, "a"), (1, "alias"), (2, "y")], "case_id int, origin string")
    assert {tuple(r) for r in expected_rank(hits, want).collect()} == {(1, 3), (2, None)}
