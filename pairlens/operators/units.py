"""Function units from source files: Arrow-batched tables around the front end."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import js
from ..functions.kernels import diff_lines
from ..functions.text import TOKEN
from .batches import flat_map

UNITS = "path string, unit_id string, name string, node_type string, start_line int, end_line int, start_byte int, end_byte int, source string, function_hash string"
STRINGS = T.ArrayType(T.StringType())
REGION = [T.StructField(n, T.StringType()) for n in ("granularity", "node_type", "text")] + [T.StructField(n, T.IntegerType()) for n in ("start_line", "end_line", "start_byte", "end_byte")] + [T.StructField(n, STRINGS) for n in ("ast_path", "ast_shape", "tokens", "roles", "calls", "member_accesses", "identifiers", "literals")]


def extract_units(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row per function of ``files(path, content)``; invalid and null contents give none."""

    def run(r: dict) -> list[dict]:
        return [{"path": r["path"], **u} for u in js.unit_rows(r["path"], r["content"])] if r["content"] else []

    return flat_map(files.select(F.col(path).alias("path"), F.col(content).cast("string").alias("content")), run, UNITS)


def with_fingerprints(units: DataFrame, source: str = "source") -> DataFrame:
    """Adds ``native, exact, abstracted, abstracted_length``; distinct texts are worked on once per batch."""

    @F.pandas_udf("native string, exact string, abstracted string, abstracted_length long")
    def finger(texts: pd.Series) -> pd.DataFrame:
        known = {t: js.fingerprint(t) for t in texts.dropna().unique()}
        none = {"native": None, "exact": None, "abstracted": None, "abstracted_length": None}
        return pd.DataFrame([known.get(t, none) for t in texts], columns=list(none))

    return units.select("*", finger(source).alias("_f")).select(*units.columns, "_f.*")


def candidate_regions(units: DataFrame, cap: int = 96) -> DataFrame:
    """Regions of each unit, in the order and with the cap of the front end."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("unit_id", "region_id")] + REGION)

    def run(r: dict) -> list[dict]:
        source = r["source"]
        return [{"unit_id": r["unit_id"], **x} for x in js.regions(source, r["unit_id"], cap)] if source and js.valid(source) else []

    return flat_map(units.select("unit_id", "source"), run, schema)


def region_pairs(boundaries: DataFrame) -> DataFrame:
    """Four paired regions of each ``(boundary, vulnerable, patched)``, and what the fix adds and removes, as signatures.

    ``v`` and ``p`` are the regions of the two sides around their first changed lines.  A blank or invalid side gives none.
    """
    side = T.StructType(REGION)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("boundary", "pair_id", "granularity")] + [T.StructField("v", side), T.StructField("p", side)] + [T.StructField(n, STRINGS) for n in ("fix_signature", "vulnerable_signature")])

    def run(r: dict) -> list[dict]:
        v, p = r["vulnerable"] or "", r["patched"] or ""
        if not v.strip() or not p.strip() or not js.valid(v) or not js.valid(p):
            return []
        diff = diff_lines(v.splitlines(), p.splitlines())
        before, after = js.anchored_regions(v, [d[1] for d in diff if d[1] is not None]), js.anchored_regions(p, [d[2] for d in diff if d[2] is not None])

        def entries(kind: str) -> list[str]:
            return sorted({x for d in diff if d[0] == kind for x in js.region_roles(re.findall(TOKEN, d[3]), [])})

        more = {"fix_signature": entries("added"), "vulnerable_signature": entries("removed")}
        return [{"boundary": r["boundary"], "pair_id": f"{r['boundary']}:{g}", "granularity": g, "v": before[g], "p": after[g], **more} for g in before if g in after]

    return flat_map(boundaries.select("boundary", "vulnerable", "patched"), run, schema)


def diagnostics(boundaries: DataFrame) -> DataFrame:
    """Role tokens of the lines that each ``(boundary, vulnerable, patched)`` removes and adds."""

    def run(r: dict) -> list[dict]:
        diff = diff_lines((r["vulnerable"] or "").splitlines(), (r["patched"] or "").splitlines())
        lines = {kind: [roles for d in diff if d[0] == kind and (roles := js.role_tokens(d[3]))] for kind in ("removed", "added")}
        return [{"boundary": r["boundary"], **lines}]

    return flat_map(boundaries.select("boundary", "vulnerable", "patched"), run, "boundary string, removed array<array<string>>, added array<array<string>>")


def roles_udf():
    """Role tokens of a source text."""
    return F.pandas_udf(lambda texts: pd.Series([None if t is None else js.role_tokens(t) for t in texts], dtype=object), STRINGS)


def fallback_udf():
    """(candidate, vulnerable, patched) to the side by local forms, ``conflict`` if they disagree, and the side by syntax form."""

    def f(candidate: pd.Series, vulnerable: pd.Series, patched: pd.Series) -> pd.DataFrame:
        rows = [(js.local_vote(c, v, p), js.compare_forms(*(js.ast_form(x) for x in (c, v, p)))) for c, v, p in zip(candidate, vulnerable, patched)]
        return pd.DataFrame(rows, columns=["local", "ast"]).astype(object)

    return F.pandas_udf(f, "local string, ast string")


def scripts_of(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Inline scripts of pages as files ``(path, content)``."""
    bodies = F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1))).alias("n", "content")
    return pages.select(key, bodies).select(F.concat_ws("", F.lit("page-"), F.col(key).cast("string"), F.lit("-"), F.col("n").cast("string"), F.lit(".js")).alias("path"), "content")
