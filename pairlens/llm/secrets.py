"""Secret scans: candidate words, and a random forest that removes false positives.

A text is cut at white space.  A word is looked at if it is long and has a digit, or if it
stands after a secret's name and a sign of assignment.  Every run between the quotes, brackets and
signs of such a word is a candidate by the same rule, with the run before it as its neighbour, so that
minified JSON, markup, URLs and calls give all their values.  Each candidate gets features: length,
kinds of characters and the transitions between them, how much of it common words cover, shape,
the neighbouring words and the path (the document's source).  A random forest, trained by Spark's
own library on labelled findings, is turned into one SQL expression, the share of its trees'
votes.  So extraction, features and forest are column expressions over an array inside the row:
scanning is narrow, and Python code never sees a row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.5
TREES, DEPTH, SEED = 25, 6, 11
TRAINING_ROWS = 12_000
MASK = "[SECRET]"

#: Words that name secrets, words that name other digests, and common words of identifiers.
SECRET_NAMES = "api[_-]?key|apikey|access[_-]?key|secret|token|passw(or)?d|passwd|pwd|auth|bearer|credential|private[_-]?key|client[_-]?id"
OTHER_NAMES = "commit|sha1|sha256|sha|md5|checksum|digest|hash|etag|uuid|guid|revision|rev|version|build|example|sample|placeholder|dummy|isbn|phone|tel|date|order|invoice|issue|id"
COMMON = "test example sample dummy change your placeholder user name file path data value index page image report final draft copy list item table node class object string number total count level group order server client local host config default version release update manager service handler controller january february march april june july august september october november december http https www com org net html json xml png jpg pdf".split()
PATHS = "test|example|sample|fixture|mock|doc|readme|tutorial"

FEATURES = [
    "length", "digits", "uppers", "lowers", "others", "transitions", "distinct", "covered", "is_hex", "is_uuid", "only_digits", "repeats",
    "prefix", "dots", "dashes", "at_or_url", "assigned", "named", "other_named", "quoted", "path",
]


def _candidate(word: str, before: str, before2: str) -> str:
    """Condition on a word and the two before it."""
    digits = f"(length({word}) >= 12 AND {word} RLIKE '[0-9]')"
    sign = f"({before} RLIKE '[:=]$' AND lower(concat({before2}, {before})) RLIKE '{SECRET_NAMES}')"
    own = f"(lower({word}) RLIKE '({SECRET_NAMES})[^a-z0-9]*[:=>]')"
    return f"(length({word}) >= 8 AND ({digits} OR {own} OR {sign}))"


def _features(value: str, word: str, before: str, path: str) -> dict[str, str]:
    n = f"greatest(length({value}), 1)"
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    kinds = f"translate({value}, '{lower}{upper}{digit}', '{'a' * 26}{'A' * 26}{'0' * 10}')"

    def share(pattern: str) -> str:
        return f"double(length(regexp_replace({value}, '[^{pattern}]', ''))) / {n}"

    near = f"lower(concat({before}, ' ', {word}))"
    return {
        "length": f"double({n})",
        "digits": share("0-9"),
        "uppers": share("A-Z"),
        "lowers": share("a-z"),
        "others": f"double(length(regexp_replace({value}, '[A-Za-z0-9]', ''))) / {n}",
        "transitions": f"double(length(regexp_replace({kinds}, '(.)\\\\1+', '$1')) - 1) / {n}",
        "distinct": f"double(size(array_distinct(split({value}, '')))) / {n}",
        "covered": f"double(length({value}) - length(regexp_replace(lower({value}), '{'|'.join(COMMON)}', ''))) / {n}",
        "is_hex": f"double({value} RLIKE '^([0-9a-f]+|[0-9A-F]+)$' AND {value} RLIKE '[0-9]' AND {value} RLIKE '[A-Fa-f]')",
        "is_uuid": f"double({value} RLIKE '^[0-9a-fA-F]{{8}}-([0-9a-fA-F]{{4}}-){{3}}[0-9a-fA-F]{{12}}$')",
        "only_digits": f"double({value} RLIKE '^[0-9+.,:/_-]+$')",
        "repeats": f"double({value} RLIKE '(.)\\\\1{{3,}}|0123|1234|abcd|ABCD')",
        "prefix": f"double({value} RLIKE '^(AKIA|ASIA|ghp_|gho_|github_pat_|xox[abprs]-|sk_live_|sk-|AIza|eyJ|glpat-)')",
        "dots": f"double(length(regexp_replace({value}, '[^.]', ''))) / {n}",
        "dashes": f"double(length(regexp_replace({value}, '[^_-]', ''))) / {n}",
        "at_or_url": f"double({word} RLIKE '@|://|^www[.]|[.](com|org|net|html)' OR {value} RLIKE '^/|/[a-z]+/')",
        "assigned": f"double({near} RLIKE '[:=]|<[a-z0-9_.-]+>')",
        "named": f"double({near} RLIKE '(^|[^a-z])({SECRET_NAMES})[^a-z]')",
        "other_named": f"double({near} RLIKE '(^|[^a-z])({OTHER_NAMES})[^a-z]')",
        "quoted": f"double({word} RLIKE '[\\'\"`]')",
        "path": f"double(lower(coalesce({path}, '')) RLIKE '{PATHS}')",
    }


def _value(word: str) -> str:
    """The last long run of a word: what stands after names, signs and quotes."""
    return f"regexp_extract({word}, '([A-Za-z0-9+/_~.@!$%^&*#-]*[A-Za-z0-9+/_~!$%^&*#-]={{0,2}})[^A-Za-z0-9+/_~=-]*$', 1)"


#: A run and the signs before it; base64's padding belongs to it.
_RUN = "([^A-Za-z0-9+/_~.@!$%^&*#-]*)([A-Za-z0-9+/_~.@!$%^&*#-]+(?:==?(?![A-Za-z0-9+/_~.@!$%^&*#=-]))?)"


def _runs(c: str) -> str:
    """An array of the runs of a word ``c`` (at, word, before, before2) that are candidates: at, word, before, value.

    ``word`` is the run with the run before it and the signs around both, which is the whole word if it has two runs at most;
    ``before`` is what stands before that.
    """
    # a sign between the parameters of a URL, or of an entity, ends a run; another & is part of it
    marked = f"regexp_replace({c}.word, '&(?=[A-Za-z0-9_.%-]{{1,64}}=[^=]|#?[A-Za-z0-9]{{1,8}};)', '\u0001')"
    cut = f"named_struct('w', {marked})"
    cut = f"transform(array({cut}), m -> named_struct('signs', regexp_extract_all(m.w, '{_RUN}', 1), 'runs', regexp_extract_all(m.w, '{_RUN}', 2), 'end', regexp_extract(m.w, '[^A-Za-z0-9+/_~.@!$%^&*#=-]*$', 0)))[0]"
    lead = "CASE WHEN i = 0 THEN r.signs[0] ELSE concat(r.signs[i - 1], r.runs[i - 1], r.signs[i]) END"
    before = f"CASE WHEN i < 2 THEN concat({c}.before2, ' ', {c}.before) ELSE r.runs[i - 2] END"
    parts = f"named_struct('at', {c}.at, 'lead', {lead}, 'run', r.runs[i], 'word', concat({lead}, r.runs[i], coalesce(get(r.signs, i + 1), r.end)), 'before', {before}, 'value', rtrim('.@', r.runs[i]), 'first', i = 0, 'last', i = size(r.runs) - 1)"
    long = "filter(sequence(0, size(r.runs) - 1), i -> length(r.runs[i]) >= 8)"
    sign = f"(x.first AND {c}.before RLIKE '[:=]$' AND lower(concat({c}.before2, {c}.before)) RLIKE '{SECRET_NAMES}')"
    named = f"lower(x.lead) RLIKE '({SECRET_NAMES})[^a-z0-9]*[:=>]'"
    keep = f"length(x.value) >= 8 AND (x.last OR (length(x.word) >= 12 AND x.value RLIKE '[0-9]') OR {named} OR {sign})"
    found = f"filter(transform({long}, i -> {parts}), x -> {keep})"
    return f"flatten(transform(array({cut}), r -> CASE WHEN size(r.runs) > 0 THEN {found} ELSE filter(transform(array(0), i -> {parts}), x -> false) END))"


def example_findings(spark: SparkSession, rows: int = TRAINING_ROWS, salt: str = "") -> DataFrame:
    """Labelled findings built by rule: ``word, before, path, label``; the same rows each time for a ``salt``.

    Positives are random strings in the forms that secrets take, mostly beside their names;
    negatives are digests, identifiers, numbers, addresses and placeholders beside others.
    Another ``salt`` draws other strings, for tests.
    """
    def drawn(key: str) -> str:
        return f"sha2(concat('{key}{salt}', id), 256)"

    hexes = f"substr(concat({drawn('h')}, {drawn('i')}), 1, {{}})"
    base = f"regexp_replace(base64(unhex({drawn('b')})), '[+/=]', substr('xK4', 1 + id % 3, 1))"
    base2 = f"regexp_replace(base64(unhex({drawn('c')})), '=', '')"

    def pick(items: str, key: str) -> str:
        names = items.split()
        return f"element_at(array({', '.join(repr(x) for x in names)}), int(pmod(xxhash64(id, '{key}{salt}'), {len(names)})) + 1)"

    own, other = pick("token secret password api_key apikey access_key auth_token client_secret pwd credential", "a"), pick("commit sha256 md5 checksum digest uuid revision etag build hash", "b")
    word, word2 = pick(" ".join(COMMON), "c"), pick(" ".join(COMMON), "d")
    hex_len = "element_at(array(16, 18, 20, 24, 32, 40, 48, 64), int(pmod(xxhash64(id, 'l'), 8)) + 1)"
    prose = pick("the of and which with from that der die und les des que los", "p")
    quoted, plain = "concat('\"', {}, '\"')", "concat({}, '.')"
    mixed = f"concat(substr({base}, 1, 6), '#', substr({base2}, 3, 6))"
    digits = f"substr(regexp_replace({drawn('n')}, '[a-f]', ''), 1, {{}})"
    positives = [
        (quoted.format(hexes.format(hex_len)), f"concat({own}, ' =')"),
        (f"concat({own}, '=', {hexes.format(hex_len)})", prose),
        (f"concat({own}, ':\"', substr({base}, 1, 40), '\"')", prose),
        (quoted.format(f"substr({base2}, 1, 36)"), f"concat({own}, ':')"),
        (f"concat('AKIA', upper(substr({base}, 1, 16)))", prose),
        (f"concat('ghp_', substr(concat({base}, {base}), 1, 36))", prose),
        (f"concat('sk_live_', substr({base}, 1, 24))", prose),
        (f"concat('eyJ', {base2}, '.eyJ', {base}, '.', {base2})", f"concat({prose}, ' Bearer')"),
        (quoted.format(mixed), f"concat({own}, ' =')"),
        (f"substr({base2}, 1, 40)", f"concat({own}, ' is')"),
    ]
    negatives = [
        (hexes.format(hex_len), f"concat({prose}, ' ', {other})"),
        (quoted.format(hexes.format(hex_len)), f"concat({other}, ' =')"),
        (f"concat({other}, '=', {hexes.format(hex_len)})", prose),
        (f"regexp_replace(substr({drawn('u')}, 1, 32), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '$1-$2-$3-$4-$5')", f"concat({prose}, ' ', {other})"),
        (plain.format(f"concat({word}, '_', {word2}, '_', {digits.format(4)})"), prose),
        (f"concat({word}, initcap({word2}), 'Service', {digits.format(2)})", prose),
        (f"concat({prose}, '.', {digits.format(2)}, '@mail.', {word}, '.com')", prose),
        (f"concat('https://www.', {word}, '.com/', {word2}, '/', {digits.format(6)})", prose),
        (f"concat('+', {digits.format(2)}, '-', {digits.format(3)}, '-', {digits.format(7)})", prose),
        ("concat(2000 + id % 30, '-0', 1 + id % 9, '-1', id % 9, 'T10:', 10 + id % 49, ':00')", prose),
        (digits.format(16), prose),
        (quoted.format(f"concat('your_', {own}, '_here', '123')"), f"concat({own}, ' =')"),
        (quoted.format("repeat(substr('xX0*', 1 + id % 4, 1), 20 + id % 20)"), f"concat({own}, ' =')"),
        (quoted.format("substr('0123456789abcdef0123456789abcdef0123456789', 1, 24 + id % 17)"), f"concat({own}, ' =')"),
        (f"concat({prose}, {prose}, {prose}, {word}, '###', {digits.format(1)})", prose),
        (f"concat('AKIA', 'EXAMPLE', upper({word}), 'EXAMPLE')", prose),
    ]
    ids = spark.range(0, rows, 1, 1)
    half = rows // 2

    def case(column: int) -> str:
        yes = " ".join(f"WHEN {i} THEN {p[column]}" for i, p in enumerate(positives))
        no = " ".join(f"WHEN {i} THEN {p[column]}" for i, p in enumerate(negatives))
        return f"CASE WHEN id < {half} THEN CASE id % {len(positives)} {yes} END ELSE CASE id % {len(negatives)} {no} END END"

    paths = "CASE WHEN id % 7 = 0 AND id >= {0} THEN 'docs/example' WHEN id % 11 = 0 THEN 'src/main' ELSE 'src' END".format(half)
    return ids.select(F.expr(case(0)).alias("word"), F.expr(case(1)).alias("before"), F.expr(paths).alias("path"), F.expr(f"double(id < {half})").alias("label"))


def train_forest(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> str:
    """A forest trained on ``word, before, path, label``, as SQL over the features: the share of votes for a secret.

    Rows without a label are left out, null words, neighbours and paths read as empty, repeated rows count each.
    Without any labelled row nothing is a secret.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = findings.where("label IS NOT NULL").select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("word", "before", "path")], "label")
    if rows.isEmpty():
        return "0.0D"
    rows = rows.withColumn("value", F.expr(_value("word")))
    features = _features("value", "word", "before", "path")
    rows = rows.select("label", *[F.expr(features[name]).alias(name) for name in FEATURES])
    data = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rows).select("label", "x")
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(data)
    return "(" + " + ".join(_tree_sql(t.toDebugString) for t in model.trees) + f") / {len(model.trees)}"


def _tree_sql(text: str) -> str:
    """A tree as nested CASE expressions over ``f.<feature>``."""
    lines = [x.strip() for x in text.splitlines()[1:] if x.strip()]

    def node(at: int) -> tuple[str, int]:
        if m := re.match(r"Predict: ([\d.]+)", lines[at]):
            return m[1] + "D", at + 1
        m = re.match(r"If \(feature (\d+) <= ([-\d.Ee]+)\)", lines[at])
        yes, at = node(at + 1)
        no, at = node(at + 1)  # past the Else line
        return (yes if yes == no else f"CASE WHEN f.{FEATURES[int(m[1])]} <= {float(m[2])!r}D THEN {yes} ELSE {no} END"), at

    return node(0)[0]


def find_secrets(df: DataFrame, forest: str, text_col: str = "text", path_col: str | None = "source", out: str = "secrets", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``df`` and an array ``out`` of the secrets: word number, value, score.

    A word may hold several.  Null and empty texts have an empty array.  Each place counts, repeated values too; ties in
    the forest's vote at ``threshold`` are secrets.  Whole texts are scanned.  Repeated rows give
    the same; an empty table gives none.  A clash of ``out`` with an input column is an error.
    """
    if out in df.columns:
        raise ValueError(f"column {out} is taken")
    words = "_words"
    while words in df.columns:
        words = "_" + words
    text = F.col(f"`{text_col}`")
    # every way to be a candidate needs a digit or a sign of assignment somewhere
    cut = _once(df, words, F.when(text.rlike("[0-9:=>]"), F.split(text, r"\s+")).otherwise(F.array().cast("array<string>")))
    w = f"`{words}`"
    indices = f"filter(sequence(0, greatest(size({w}) - 1, 0)), i -> length(get({w}, i)) >= 8)"
    near = f"transform({indices}, i -> named_struct('at', i, 'word', {w}[i], 'before', coalesce(get({w}, i - 1), ''), 'before2', coalesce(get({w}, i - 2), '')))"
    path = f"`{path_col}`" if path_col and path_col in df.columns else "''"
    features = _features("c.value", "c.word", "c.before", path)
    struct = ", ".join(f"'{n}', {features[n]}" for n in FEATURES)
    candidates = f"filter({near}, c -> {_candidate('c.word', 'c.before', 'c.before2')})"
    valued = f"flatten(transform({candidates}, c -> {_runs('c')}))"
    featured = f"transform({valued}, c -> named_struct('at', c.at, 'value', c.value, {struct}))"
    scored = f"transform({featured}, f -> named_struct('at', f.at, 'value', f.value, 'score', {forest}))"
    return _once(cut, out, F.expr(f"filter({scored}, s -> s.score >= {threshold}D)")).drop(words)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once: the optimiser moves nothing through a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def secret_rows(found: DataFrame, id_col: str = "doc_id", out: str = "secrets") -> DataFrame:
    """One row per secret: id, word number, length, sha256 of the value (never the value itself) and score."""
    rows = found.select(F.col(id_col).alias("doc_id"), F.inline(out))
    return rows.select("doc_id", F.col("at").alias("word_index"), F.length("value").alias("secret_chars"), F.sha2("value", 256).alias("secret_sha256"), F.round("score", 4).alias("score"))


def redact(found: DataFrame, text_col: str = "text", out: str = "secrets", mask: str = MASK) -> DataFrame:
    """Texts with each secret's value replaced by ``mask``; ``out`` is dropped."""
    values = f"array_sort(array_distinct(transform(`{out}`, s -> s.value)), (a, b) -> length(b) - length(a))"
    clean = F.expr(f"CASE WHEN size(`{out}`) = 0 THEN `{text_col}` ELSE aggregate({values}, `{text_col}`, (t, v) -> replace(t, v, '{mask}')) END")
    return found.withColumn(text_col, clean).drop(out)
