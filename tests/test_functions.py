import difflib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from pairlens.functions import js
from pairlens.functions import kernels as K
from pairlens.functions import text as T
from pairlens.functions import versions as V
from pairlens.functions.samples import PAIRS


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()[0]


def test_fingerprint_cut_off_and_forms(spark):
    long = "Some  Words that\nare long enough to be told apart from others 12"
    f = one(spark, T.fingerprint(F.col("t")), t=long)
    g = one(spark, T.fingerprint(F.col("t")), t=long.replace("\n", "   ").replace("12", "99"))
    assert f["exact"] != g["exact"] and f["abstracted"] == g["abstracted"] and f["native"] != g["native"]
    assert one(spark, T.fingerprint(F.col("t")), t="short")["exact"] is None


@pytest.mark.parametrize(
    "url, repo",
    [("git+https://github.com/A/B.git", "a/b"), ("github:a/b", "a/b"), ("git@github.com:a/b.git", "a/b"), ("a/b", "a/b"), ("https://example.com/x", None), ("ssh://git@github.com/a/b", "a/b")],
)
def test_repository(spark, url, repo):
    assert one(spark, T.repository(F.col("u")), u=url) == repo


@pytest.mark.parametrize("path, problem", [("src/a.js", None), ("a.d.ts", "declaration"), ("a.min.js", "generated"), ("test/a.js", "not_production"), ("a.py", "not_source")])
def test_file_problem(spark, path, problem):
    assert one(spark, T.file_problem(F.col("p")), p=path) == problem


@pytest.mark.parametrize(
    "version, spec, inside",
    [
        ("1.1.9", "<1.2.0", True), ("1.2.0", "<1.2.0", False), ("1.9.0", "^1.2.0", True), ("2.0.0", "^1.2.0", False), ("0.2.5", "^0.2.3", True), ("0.3.0", "^0.2.3", False),
        ("1.2.9", "~1.2.3", True), ("1.3.0", "~1.2.3", False), ("2.7.1", "2.x", True), ("3.0.0", "2.x", False), ("1.5.0", "1.2.0 - 1.6", True), ("1.6.0", "1.2.0 - 1.6", True), ("1.6.9", "1.2.0 - 1.6", False), ("1.7.0", "1.2.0 - 1.6", False),
        ("1.0.0-rc.1", "<1.0.0", True), ("v1.0.0+build", "=1.0.0", True), ("4.0.0", "<2 || >=4", True), ("3.0.0", "<2 || >=4", False), ("1.0.0", "&gt;=1.0.0", True), ("x", "*", False),
        ("1.2.5", ">1.2", True), ("1.2.0", ">1.2", False), ("1.2.5", "<=1.2", False), ("0.5.0", "^0", False), ("0.0.0", "^0", True), ("1.2.5", "~1", False), ("1.0.5", "~1", True), ("1.2.3-rc.1", "=1.2.3", True), ("2.0.0-rc.1", "^1.2.0", False), ("2.0.0-rc.1", "2.x", True), ("1.0.0", "", False), ("1.0.0", "none || *", True), (">= 1.0.0 < 2", "*", False), ("1.5.0", ">= 1.0.0, < 2", True),
    ],
)
def test_ranges(spark, version, spec, inside):
    assert bool(one(spark, V.in_range(F.col("v"), spec), v=version)) is inside


def test_version_order(spark):
    order = ["1.0.0-1", "1.0.0-2", "1.0.0-10", "1.0.0-alpha", "1.0.0-alpha-2", "1.0.0-alpha.10", "1.0.0-beta", "1.0.0", "1.0.1", "1.10.0", "2"]
    rows = spark.createDataFrame([(v,) for v in order], "v string").orderBy(V.version_key(F.col("v"))).collect()
    assert [r[0] for r in rows] == order


def test_jaccard_and_coverage(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(spark, T.jaccard(a(), a())) is None
    assert one(spark, T.jaccard(a("x"), a())) == 0
    assert one(spark, T.coverage(a("x", "y"), a("y"))) == 0.5 and one(spark, T.coverage(a(), a("y"))) == 0


def test_identity_keeps_null_parts(spark):
    assert one(spark, T.identity("p", F.lit("a"), F.lit(None))) != one(spark, T.identity("p", F.lit("a")))


def test_excerpts_and_codes(spark):
    assert one(spark, T.cwe(F.col("c")), c="cwe-079") == "CWE-79" and one(spark, T.cwe(F.col("c")), c="none") is None
    assert one(spark, T.summary_excerpt(F.col("c")), c="# Summary\nshort text\n# More\nx") == "short text"
    assert one(spark, T.excerpt(F.col("c"), F.lit(30)), c="\n".join(map(str, range(200)))).startswith("5\n")
    refs = one(spark, T.commit_refs(F.col("c")), c="see https://github.com/a/b/commit/0123456789abcdef and https://github.com/a/b/commit/xyz")
    assert [(r["repo"], r["sha"]) for r in refs] == [("a/b", "0123456789abcdef")]


def slow_fuzzy(query, text):
    if not query or not text:
        return 0.0
    row = [0] * (len(text) + 1)
    for i, q in enumerate(query, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (q != x)))
        row = new
    return max(0.0, 1 - min(row) / len(query))


def test_fuzzy_equals_slow_form():
    short = [list(s) for n in range(5) for s in itertools.product("ab", repeat=n)]
    for a, b in itertools.product(short, short):
        assert K.fuzzy_substring(a, b) == slow_fuzzy(a, b), (a, b)
    rng = random.Random(4)
    for n in (29, 31, 32, 33, 63, 64, 65, 129, 257):
        a, b = [rng.randrange(4) for _ in range(n)], [rng.randrange(4) for _ in range(rng.randrange(1, 300))]
        assert K.fuzzy_substring(a, b) == slow_fuzzy(a, b)
    long = list(range(10_000))
    assert K.fuzzy_substring(long, [*long[:5000], -1, *long[5001:]]) == 1 - 1 / 10_000


def slow_matches(a, b):
    """Elements in matching blocks: the longest common run, the first in ``a`` and then in ``b``, and the same on both its sides."""
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, (n, -i, -j))
    n, i, j = best[0], -best[1], -best[2]
    return n + slow_matches(a[:i], b[:j]) + slow_matches(a[i + n :], b[j + n :]) if n else 0


def test_sequence_similarity():
    assert K.sequence_similarity([], []) == 1 and K.sequence_similarity([], [1]) == 0
    rng = random.Random(5)
    for _ in range(400):
        a, b = [rng.randrange(3) for _ in range(rng.randrange(9))], [rng.randrange(3) for _ in range(rng.randrange(9))]
        head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        x, y = a[head:], b[head:]
        tail = next((i for i, (p, q) in enumerate(zip(x[::-1], y[::-1])) if p != q), min(len(x), len(y)))
        shared = head + tail + slow_matches(x[: len(x) - tail], y[: len(y) - tail])
        assert K.sequence_similarity(a, b) == pytest.approx(2 * shared / (len(a) + len(b)) if a or b else 1)
    # 4,100 elements in both cores, 3,000 in the longer: popular elements are skipped by the sum
    a, b = ["x", *["p"] * 1100, "y"], ["z", *["q", "p"] * 1500, "w"]
    core = difflib.SequenceMatcher(None, a, b, autojunk=True).ratio()
    assert K.sequence_similarity(a, b) == pytest.approx(core) and core != difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_diff_contrast_and_disjoint():
    rows = K.diff_lines(["a", "// x", "b"], ["a", "c", "b"])
    assert [(r[0], r[3]) for r in rows] == [("added", "c")]
    assert K.change_kind({"added"}) == "insertion" and K.change_kind({"added", "removed"}) == "replacement" and K.change_kind(set()) == "unknown"
    assert K.contrastive([["ID", "=", "API:x"]], [["ID", "=", "API:x"]]) == [] and K.contrastive([list("abcd!efgh")], [list("abc")], 1) == [["d", "!", "e"]]
    assert K.contrastive([["ID", ";"]], []) == [] and K.contrastive([["if", "("], ["if", "("]], [["if"]], 0) == [["if"]]
    assert K.weighted_coverage([], ["a"]) is None and K.weighted_coverage([["a", "b", "c"], ["x"]], ["a", "b", "c"]) == 0.75
    s = K.edit_scores([["CALL:a", "b"]], [], ["x", "CALL:a", "b"])
    assert (s["raw_v"], s["raw_p"], s["con_v"], s["con_p"], s["contrastive_used"], s["identity_raw_v"], s["identity_con_p"]) == (1, None, 1, 0, True, True, None)
    s = K.edit_scores([["ID", ";"]], [["ID", ";", "ID"]], ["ID", ";", "ID"])
    assert (s["raw_v"], s["raw_p"], s["con_v"], s["con_p"], s["contrastive_used"], s["identity_raw_v"]) == (1, 1, 1, 1, False, False)
    # the removed side has nothing special: its raw score if that is more than the other's, else the complement
    s = K.edit_scores([["ID", "(", ")"]], [["ID", "(", "!", ")"]], ["ID", "(", ")"])
    assert s["contrastive_used"] and s["con_v"] == 1 and s["con_p"] == 0.75
    s = K.edit_scores([["ID", "(", ")"]], [["ID", "(", "!", ")"]], ["ID", "(", "!", ")", "(", ")"])
    assert s["con_p"] == 1 and s["con_v"] == 0
    assert K.pick_disjoint([(0, 5), (4, 6), (5, 8), (8, 9), (1, 2)]) == [0, 2, 3]


def test_functions_found():
    units = {(u["node_type"], u["name"]) for _, *pair in PAIRS for text in pair for u in js.unit_rows("a.js", text)}
    assert {("function_declaration", "merge"), ("arrow_function", "render"), ("method_definition", "read"), ("function_declaration", "next"), ("arrow_function", None)} <= units
    assert js.unit_rows("a.js", "function broken( {") == []
    multi = "const é = 'ü'; function f() { return 1; }"
    (u,) = js.unit_rows("a.js", multi)
    assert multi.encode()[u["start_byte"] : u["end_byte"]].decode() == u["source"] == "function f() { return 1; }"


def test_js_fingerprints():
    a = PAIRS[0][1]
    f = js.fingerprint(a)
    assert js.fingerprint(a.replace("  ", "\t ").replace("{\n", "{ // note\n", 1))["exact"] == f["exact"]
    renamed = js.fingerprint(a.replace("target", "into").replace("source", "from"))
    assert renamed["exact"] != f["exact"] and renamed["abstracted"] == f["abstracted"]
    swapped = js.fingerprint(a.replace("(target, source)", "(source, target)"))
    assert swapped["abstracted"] != f["abstracted"]
    assert js.fingerprint("x => x")["exact"] is None


def test_lexing_and_forms():
    kinds = [(t.kind, t.text) for t in js.lex("a = b / c; d = /x[/]y/g; `t${`n`}`; // e") if t.kind in ("regex", "template", "comment")]
    assert kinds == [("regex", "/x[/]y/g"), ("template", "`t${`n`}`"), ("comment", "// e")]
    assert js.normal_lines("a = 'x // y'; // gone\n\n  b  =  1") == ["a = 'x // y';", "b = 1"]
    assert js.role_tokens("a.b(c, 'x')") == ["ID", ".", "API:b", "(", "ID", ",", "'x'", ")"]
    assert js.has_identity(["ID", "API:x"]) and not js.has_identity(["ID", "=", "ID"])
    assert js.role_tokens("} else if (a.b(c) {") == ["}", "else", "if", "(", "ID", ".", "API:b", "(", "ID", ")", "{"] and js.role_tokens("'open") == ["'", "ID"]
    assert js.region_roles(["a", "=", "/x/g", ";", "return", "'s'"], ["'s'", "/x/g"]) == ["ID", "=", "LIT", ";", "return", "LIT", "REGEX:/x/g"]
    assert [js.api_anchor(x) for x in ("a . b?.c", "this.x", "f", "f().g")] == ["ID.b.c", "this.x", "f", "f().g"]
    assert js.regex_only_change(*PAIRS[1][1:]) and not js.regex_only_change(*PAIRS[0][1:])
    assert js.guard_form("function f(a) { return a ? 1 : 2; }") == js.guard_form("function g(b) { if (b) return 1; return 2; }").replace("function g", "function f")
    v, p = (js.ast_form(x) for x in PAIRS[4][1:])
    assert js.compare_forms(js.ast_form(PAIRS[4][1].replace("items", "rows")), v, p) == "vulnerable" and js.compare_forms(v, v, v) is None
    assert js.ast_form("function f() { return eval('1'); }") is None
    assert js.valid(js.strip_types("function f(a: string, b?: number): void { const x: Foo = y as Bar; return a ? b : c; }"))


def test_anchored_regions():
    name, v, p = PAIRS[0]
    r = js.anchored_regions(p, [2])
    assert r["changed"]["node_type"] == "if_statement" and r["changed"]["start_line"] == 2 and r["changed"]["ast_path"][0] == "function"
    assert r["block"]["start_line"] == 1 and r["block"]["node_type"] == "statement_block" and r["function"]["end_line"] == 6 and r["context"]["start_line"] == 0
    assert p.encode()[r["changed"]["start_byte"] : r["changed"]["end_byte"]].decode() == "if (key === '__proto__') continue;"
    assert r["changed"]["text"].startswith("node=if_statement path=function/")
    assert js.anchored_regions("x", [])["changed"]["tokens"] == ["x"] and js.anchored_regions(v, [99])["changed"]["tokens"] == js.anchored_regions(v, [])["function"]["tokens"]


def test_region_cap():
    body = "function f(a) {\n" + "".join(f"  use{i}(a.x{i}, 'v{i}');\n" for i in range(60)) + "}"
    assert len(js.regions(body, "u", 10)) == 10
    everything = js.regions(body, "u", 1000)
    assert everything[-1]["granularity"] == "function" and [r["region_id"] for r in everything][:2] == ["candidate:u:0000", "candidate:u:0001"]
