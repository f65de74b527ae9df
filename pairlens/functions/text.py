"""Text forms as column expressions: white space, tokens, fingerprints, addresses.

All run inside the JVM.  White space is ``[ \\t\\n\\x0B\\f\\r]``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fingerprints of shorter abstracted texts are null: too little to tell anything.
MIN_FINGERPRINT_CHARS = 50
#: Words that keep their own role.
KEYWORDS = "if else for while do switch case default break continue return function class const let var new try catch finally throw typeof instanceof in of await async yield this super null true false undefined delete void import export extends".split()
SOURCE_FILE = r"(?i)\.(js|jsx|mjs|cjs|ts|tsx|mts|cts)$"
TOKEN = r"[A-Za-z_$][A-Za-z0-9_$]*|[0-9]+(?:[.][0-9]+)?|[^\sA-Za-z0-9_$]"


def collapse(text: Column) -> Column:
    """White space runs to one space, ends trimmed; blank lines vanish with them."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def lines_of(text: Column) -> Column:
    """Lines with white space collapsed, blank ones dropped."""
    return F.filter(F.transform(F.split(text, "\n"), collapse), lambda x: x != "")


def abstracted(text: Column) -> Column:
    """Letters alone, lower-cased: a form in which numbers and signs don't matter."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def fingerprint(text: Column, minimum: int = MIN_FINGERPRINT_CHARS) -> Column:
    """Struct of digests and lengths by kind; exact and abstracted are null where the abstracted form is short."""
    exact, loose = collapse(text), abstracted(text)
    enough = F.length(loose) >= minimum
    return F.struct(
        digest(text).alias("native"),
        F.length(text).cast("long").alias("native_length"),
        F.when(enough, digest(exact)).alias("exact"),
        F.when(enough, F.length(exact).cast("long")).alias("exact_length"),
        F.when(enough, digest(loose)).alias("abstracted"),
        F.when(enough, F.length(loose).cast("long")).alias("abstracted_length"),
    )


def identity(prefix: str, *parts: Column) -> Column:
    """``prefix-`` and the digest of the parts joined by NUL; null parts are empty, not left out."""
    joined = F.concat_ws("\x00", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "-"), digest(joined))


def tokens(text: Column) -> Column:
    """Words, numbers, single signs."""
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


def roles(token_array: Column) -> Column:
    """Numbers and quoted texts to LIT, names to ID; keywords and signs keep themselves."""
    return F.transform(
        token_array,
        lambda t: F.when(t.isin(KEYWORDS), t).when(t.rlike(r"^[0-9\"'`]"), F.lit("LIT")).when(t.rlike(r"^[A-Za-z_$]"), F.lit("ID")).otherwise(t),
    )


def words(text: Column) -> Column:
    """Distinct lower-cased words of letters, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(abstracted(text), " "), lambda w: w != "")))


def repository(url: Column) -> Column:
    """``owner/name`` of a repository address in its usual spellings, else null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"^git\+", ""), r"(\.git)?/?([?#].*)?$", "")
    path = F.regexp_extract(bare, r"^(?:github:|git@github\.com:|(?:https?|git|ssh)://(?:[^/@]+@)?github\.com[/:])([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)", 1)
    short = F.regexp_extract(bare, r"^([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)$", 1)
    return F.nullif(F.when(path != "", F.lower(path)).otherwise(F.lower(short)), F.lit(""))


def site(url: Column) -> Column:
    """Host and first path part of any address, without scheme, ``www.``, query and fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(url), r"^[a-z]+://(www\.)?", ""), r"[?#].*$", "")
    return F.nullif(F.regexp_extract(bare, r"^([^/]+/[^/]+)", 1), F.lit(""))


def file_problem(path: Column) -> Column:
    """Why a path is no production source file, or null."""
    p = F.lower(path)
    return (
        F.when(~p.rlike(SOURCE_FILE), "not_source")
        .when(p.rlike(r"\.d\.ts$"), "declaration")
        .when(p.rlike(r"\.(min|bundle)\."), "generated")
        .when(p.rlike(r"test|spec|example|fixture|vendor|node_modules|dist/"), "not_production")
    )


def language_of(path: Column, stated: Column | None = None) -> Column:
    """Stated language, else by the path before ``::``."""
    p = F.lower(F.substring_index(path, "::", 1))
    found = F.when(p.rlike(r"\.tsx$"), "tsx").when(p.rlike(r"\.(ts|mts|cts)$"), "typescript").otherwise("javascript")
    return F.coalesce(stated, found) if stated is not None else found


def commit_refs(text: Column) -> Column:
    """(owner/name, sha) of commit addresses in a text."""
    pattern = r"https?://github\.com/([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)/(?:commit|pull/[0-9]+/commits)/([0-9a-f]{7,40})"
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("repo"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("sha"))


def cwe(text: Column) -> Column:
    """``CWE-<number>`` without leading zeros, or null."""
    n = F.regexp_extract(F.upper(text), r"CWE[-_ ]?0*([0-9]+)", 1)
    return F.when(n != "", F.concat(F.lit("CWE-"), n))


def jaccard(a: Column, b: Column) -> Column:
    """Null if both are empty, 0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def coverage(signature: Column, found: Column) -> Column:
    """Share of distinct signature entries that are found; 0 for an empty signature."""
    n = F.size(F.array_distinct(signature))
    return F.when(n > 0, F.size(F.array_intersect(signature, found)) / n).otherwise(F.lit(0.0))


def excerpt(text: Column, focus: Column, lines: int = 120, before: int = 24) -> Column:
    """At most ``lines`` lines, from ``before`` lines above the 1-based ``focus``."""
    return F.array_join(F.slice(F.split(text, "\n"), F.greatest(focus.cast("int") - before, F.lit(1)), F.lit(lines)), "\n")


def summary_excerpt(text: Column) -> Column:
    """The section headed Summary, else the first block (with the next one if it is a heading)."""
    section = F.regexp_extract(text, r"(?is)^\s*#+\s*summary\s*\n+(.*?)(?:\n\s*#|\z)", 1)
    blocks = F.filter(F.split(F.trim(text), r"\n\s*\n"), lambda b: F.trim(b) != "")
    first = F.get(blocks, F.lit(0))
    return F.trim(F.when(section != "", section).when(first.rlike(r"^\s*#"), F.concat_ws("\n\n", first, F.get(blocks, F.lit(1)))).otherwise(first))
