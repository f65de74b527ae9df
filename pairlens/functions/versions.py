"""Semantic versions as ordered structs, and ranges as column predicates.

A range is a list of alternatives, each a list of terms (operator, version) that must all hold.  Operands of
``< <= > >= ^ ~`` are filled up with zeros; a bare or ``=`` version holds for all versions that begin with the
parts it gives, whatever their pre-release.
"""

from __future__ import annotations

import html
import operator
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_ORDER = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
#: The words of the range grammar.
_WORD = re.compile(r"(?P<operator>[<>]=?|[=^~])|(?P<version>v?\d+(?:\.\d+){0,2}(?:-[\w.-]+)?)|(?P<any>[xX*])")


def version_key(version: Column) -> Column:
    """(major, minor, patch, release, pre) that sorts as versions do; null where not a version.

    ``v`` and build data go; missing parts are 0; a pre-release sorts below its release.  Dots and dashes part
    its identifiers, numeric ones sort below the others and by value.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(version), "^[vV=]+", ""), r"\+.*$", "")
    core = F.regexp_extract(bare, r"^(\d+(?:\.\d+){0,2})(?:-[0-9A-Za-z.-]+)?$", 1)
    parts = F.split(core, r"\.")
    pre = F.regexp_extract(bare, r"^[0-9.]+-(.*)$", 1)

    def number(i: int) -> Column:
        return F.coalesce(F.try_to_number(F.get(parts, F.lit(i)), F.lit("9" * 18)).cast("long"), F.lit(0).cast("long"))

    identifiers = F.transform(
        F.filter(F.split(pre, r"[.-]"), lambda x: x != ""),
        lambda x: F.struct((~x.rlike(r"^\d+$")).cast("int").alias("alpha"), F.when(x.rlike(r"^\d+$"), F.lpad(x, 18, "0")).otherwise(x).alias("id")),
    )
    return F.when(core != "", F.struct(number(0).alias("major"), number(1).alias("minor"), number(2).alias("patch"), (pre == "").cast("int").alias("release"), identifiers.alias("pre")))


def terms(alternative: str) -> list[tuple[str, str | None]]:
    """Terms of one alternative; ``None`` stands for any version.  Words that are no part of the grammar are passed over."""
    if m := re.fullmatch(r"\s*(\S+)\s+-\s+(\S+)\s*", alternative):
        return [(">=", m[1]), ("<=", m[2])]
    out, pending, end = [], "", 0
    for m in _WORD.finditer(alternative):
        if alternative[end : m.start()].strip():
            pending = ""
        if m["operator"]:
            pending = m["operator"]
        else:
            out.append((pending, m["version"]))
            pending = ""
        end = m.end()
    return out


def _begins(key: Column, numbers: list[int]) -> Column:
    """The first parts of a key as a struct that compares with one of ``numbers``."""
    return F.struct(*[key[name] for name in ("major", "minor", "patch")[: len(numbers)]])


def _literal(numbers: list[int]) -> Column:
    return F.struct(*[F.lit(n).cast("long").alias(name) for n, name in zip(numbers, ("major", "minor", "patch"))])


def _holds(key: Column, sign: str, version: str | None) -> Column:
    if version is None:
        return F.lit(True)
    given = [int(x) for x in version.lstrip("v").split("-")[0].split("+")[0].split(".")]
    full = (given + [0, 0])[:3]
    if sign in _ORDER:
        return _ORDER[sign](key, version_key(F.lit(version)))
    if sign in ("", "="):
        return _begins(key, given) == _literal(given)
    # the last part that may not change: of ~ the second, of ^ the first that isn't zero
    fixed = 1 if sign == "~" else next((i for i, n in enumerate(full) if n), 2)
    ceiling = full[:fixed] + [full[fixed] + 1]
    return (key >= version_key(F.lit(version))) & (_begins(key, ceiling) < _literal(ceiling))


def in_range(version: Column, spec: str) -> Column:
    """Whether a version is in an npm-style range: ``||`` alternatives, hyphens, ``^ ~ < <= > >= =``, ``x``, partial versions.

    Null and unparseable versions are in none; an alternative without terms holds for none.
    """
    key = version_key(version)
    choices = [reduce(operator.and_, [_holds(key, *t) for t in found]) for part in html.unescape(spec).split("||") if (found := terms(part))]
    return key.isNotNull() & F.coalesce(reduce(operator.or_, choices, F.lit(False)), F.lit(False))
