"""Cases in which an operator once did less than its whole job."""

import hashlib

from pairlens.llm import decontaminate, language, secrets, toxicity


def leaks(item, *docs):
    import pyarrow as pa

    return decontaminate.Index([(1, item)]).scan(pa.array(list(docs)))


TOM = "Tom has 3 apples. Ann gives him 5 more. Tom eats 2. How many apples does Tom have now?"


def test_names_that_begin_sentences():
    renamed = TOM.replace("Tom", "Sue").replace("Ann", "Max")
    exact, other, mixed = leaks(TOM, TOM, f"Next. {renamed} Done.", renamed.replace("Sue eats 2. How many apples does Sue", "Joe eats 2. How many apples does Kim"))
    assert exact[0][2:4] == (15, 19) and exact[0][4] == 0
    assert other and other[0][2] == 15 and other[0][4] == 2
    assert not mixed or mixed[0][2] < 15


def test_short_and_numeric_items():
    for item in ("What is 2+2?", "Compute 12 + 34 * 56 - 78 / 9", "What is the capital of France?", "Why?"):
        copy, after_line, none = leaks(item, f"Before that. {item} After.", f"Question 12\n{item}\nAnswer", "The capital is 12 of 34.")
        assert copy and after_line and not none and copy[0][4] == after_line[0][4] == 0, item
    other, same = leaks("Compute 12 + 34 * 12 - 78 / 9", "So: compute 13 + 35 * 14 - 7 / 2", "So: compute 13 + 35 * 13 - 7 / 2")
    assert not other and same[0][4] == 4


def test_slots_agree_within_an_occurrence():
    item = "On Monday Alice has 12 apples and then gives 5 kg of them to Bob who sells 30 for 7 dollars."

    def variant(a, b, *numbers):
        out = item.replace("Alice", a).replace("Bob", b)
        for old, new in zip(("12", "5 ", "30", "7 "), numbers):
            out = out.replace(old, new)
        return out

    one, two = variant("Carol", "Dave", "40", "9 ", "11", "3 "), variant("Zoe", "Adam", "21", "8 ", "77", "4 ")
    # a piece of the item as it is, far from the variant; two variants that mix in both orders
    stray = "People say that Alice has 12 apples and then gives 5 kg of them to others. "
    filler = " Something else stands here for a while." * 30 + " "
    for text in (one, stray + filler + one, one + filler + stray, one + " " + two, two + filler + one):
        found = leaks(item, text)[0]
        assert found and found[0][2] == found[0][1] and found[0][4] >= 6, text


def test_every_run_of_a_word_is_scanned(spark, forest):
    a, b = hashlib.sha256(b"a").hexdigest()[:32], hashlib.sha256(b"b").hexdigest()[:32]
    rows = [
        (1, f'{{"api_key":"{a}","user":"bob"}}', {a}), (2, "<password>k3J9xQ2mLp0Z</password>", {"k3J9xQ2mLp0Z"}), (3, f"see https://x.org/p?api_key={a}&lang=en there", {a}), (4, f'token="{a}";secret="{b}"', {a, b}),
        (5, '[{"name":"some","page":12},' * 3000 + f'{{"token":"{a}","n":1}}' + ',{"name":"some","page":12}' * 3000, {a}), (6, f'client.login(token="{a}",true)', {a}), (7, f'{{"commit":"{a}","n":1}}', set()),
    ]
    df = spark.createDataFrame([(d, t, "src") for d, t, _ in rows], "doc_id long, text string, source string")
    found = secrets.find_secrets(df, forest)
    got = {r["doc_id"]: {x["value"] for x in r["secrets"]} for r in found.collect()}
    assert got == {d: v for d, _, v in rows}
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(found).collect()}
    assert clean[1] == '{"api_key":"[SECRET]","user":"bob"}' and clean[2] == "<password>[SECRET]</password>" and a not in clean[5]


def test_copies_do_not_crowd_out_a_language(spark):
    few = [("en", f"word{chr(97 + k % 26)}{chr(97 + k // 26)} of the text") for k in range(300)]
    assert language.learn_dictionaries(spark.createDataFrame(few, "lang string, text string").where("false")) == {}
    for hot in ("the same text again", "another hot one"):
        df = spark.createDataFrame([*few, *[("en", hot)] * 30_000, *[("de", t) for _, t in few]], "lang string, text string").repartition(4)
        found = language.learn_dictionaries(df)
        assert all(f"word{chr(97 + k % 26)}{chr(97 + k // 26)} ".encode() in found["en"] for k in range(300)) and found["en"].count(hot.encode()) == 1


def test_texts_under_one_header_all_teach(spark):
    header = "This page is from the archive of a board, with a fixed opening that is long enough. "
    words = [f"{a}{b}" for a in ("ba", "do", "ke", "li", "mu", "ra") for b in ("n", "so", "ti", "ve", "rum")]
    rows = []
    for d in range(800):
        text = " ".join(words[(d * 7 + k * k) % 30] for k in range(60)) + f" {words[d % 30]}{d}"
        rows.append((header + text + " grimol", 1) if d % 4 == 0 else (text, 0))
    model = toxicity.learn(spark.createDataFrame([*rows, *rows], "text string, toxic int").repartition(3))
    again = toxicity.learn(spark.createDataFrame(rows[::-1], "text string, toxic int").repartition(5))
    assert model.weights.get("grimol ", 0) > 0 and model == again
