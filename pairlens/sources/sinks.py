"""Report sinks: SARIF, compact text, a single HTML page.  Findings of one scan are a report's worth of rows."""

from __future__ import annotations

import hashlib
import html
import json
import os
import pathlib
import tempfile
from collections.abc import Iterable
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Order of priorities and severities in reports.
PRIORITIES = ["automatic_vulnerability", "manual_review", "informational_lineage", "none"]
SEVERITIES = ["critical", "high", "moderate", "medium", "low", "unknown"]
ACTIVE = PRIORITIES[:2]
REPORT_TOOL_VERSION = "1"


def ordered(findings: DataFrame) -> DataFrame:
    """By priority, severity, path and line."""
    place = lambda c, names: F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.lower(c)), F.lit(0))
    return findings.orderBy(place(F.col("priority"), PRIORITIES), place(F.coalesce("severity", F.lit("unknown")), SEVERITIES), "path", "start_line")


def summary(findings: DataFrame) -> DataFrame:
    """Counts by priority and severity, with distinct advisories; dismissed findings are left out."""
    return findings.where("NOT coalesce(dismissed, false)").groupBy("priority", F.coalesce("severity", F.lit("unknown")).alias("severity")).agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("advisory").alias("advisories"))


def exit_code(findings: DataFrame) -> int:
    return int(not findings.where(F.col("priority").isin(ACTIVE) & ~F.coalesce("dismissed", F.lit(False))).isEmpty())


#: Rule, level and description of each priority in exports.
RULES = {
    "automatic_vulnerability": ("vulnerable-code", "error", "Vulnerable code clone"),
    "manual_review": ("manual-review", "note", "Review possible vulnerable code clone"),
}
OTHER_RULE = ("related-code", "note", "Related code")


def fingerprint(r: dict) -> str:
    """What a finding keeps between runs: digest of priority, path, unit (else name and lines) and function hash."""
    unit = r.get("unit") or f"{r.get('name') or '<anonymous>'}:{r['start_line'] + 1}:{r['end_line'] + 1}"
    return hashlib.sha256("|".join([r["priority"], r["path"], str(unit), r.get("function_hash") or ""]).encode()).hexdigest()


def sarif(rows: Iterable[dict], tool: str = "pairlens", root: str | None = None, version: str = REPORT_TOOL_VERSION) -> str:
    """SARIF 2.1.0, a rule for each priority; automatic findings are errors, the others notes; lines are 1-based.

    Paths are relative to ``%SRCROOT%``, which ``root`` sets.
    """
    rules = {tool + "/" + name: (level, text) for name, level, text in (*RULES.values(), OTHER_RULE)}
    results = []
    for r in sorted(rows, key=lambda r: (r["path"], r["start_line"], r["end_line"], r["priority"], r.get("name") or "")):
        rule, level, _ = RULES.get(r["priority"], OTHER_RULE)
        shown = {k: r.get(c) for k, c in (("confidence", "confidence"), ("reason", "reason"), ("opinion", "opinion"), ("findingId", "finding_id"))}
        ids = sorted({x for x in [r.get("advisory"), *(r.get("aliases") or [])] if x})
        region = {"startLine": max(1, r["start_line"] + 1), "endLine": max(1, r["start_line"] + 1, r["end_line"] + 1)}
        results.append(
            {
                "ruleId": f"{tool}/{rule}",
                "level": level,
                "message": {"text": f"{r.get('name') or '<anonymous>'}: {r.get('reason') or r['priority']}"},
                "locations": [{"physicalLocation": {"artifactLocation": {"uri": quote(r["path"], safe="/"), "uriBaseId": "%SRCROOT%"}, "region": region}}],
                "partialFingerprints": {"primaryLocationLineHash": fingerprint(r)},
                "properties": {tool: {"priority": r["priority"], "advisoryIds": ids, "packages": sorted(r.get("packages") or []), **shown}},
            }
        )
    used = {x["ruleId"] for x in results}
    named = [{"id": i, "name": i.rsplit("/", 1)[-1], "shortDescription": {"text": text}, "defaultConfiguration": {"level": level}} for i, (level, text) in rules.items() if i in used or not i.endswith(OTHER_RULE[0])]
    run = {"tool": {"driver": {"name": tool, "version": version, "rules": named}}, "results": results}
    if root is not None:
        run["originalUriBaseIds"] = {"%SRCROOT%": {"uri": pathlib.Path(root).resolve().as_uri().rstrip("/") + "/"}}
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [run]}, indent=1)


def compact(rows: Iterable[dict]) -> str:
    """Findings grouped by folder, one line each."""
    folders: dict[str, list[str]] = {}
    for r in rows:
        folder, _, name = r["path"].rpartition("/")
        folders.setdefault(folder or ".", []).append(f"  {name}:{r['start_line'] + 1}  {r['priority']}  {r.get('advisory') or ''}".rstrip())
    return "\n".join(line for f in sorted(folders) for line in [f, *sorted(folders[f])]) + "\n"


def page(rows: Iterable[dict], title: str = "Scan report") -> str:
    """A page without outside parts."""
    head = ["priority", "severity", "path", "start_line", "advisory", "reason"]
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(r.get(h) if r.get(h) is not None else ''))}</td>" for h in head) + "</tr>" for r in rows)
    columns = "".join(f"<th>{h}</th>" for h in head)
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><style>td,th{{padding:.2em .6em;text-align:left}}</style><h1>{html.escape(title)}</h1><table><tr>{columns}</tr>{body}</table>"


def write_text(path: str, text: str) -> None:
    """Replace a local file in one step."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, new = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(new, path)
