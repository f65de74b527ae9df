"""Dismissals of findings: a small local file beside a scan, checked when read and changed under a lock."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from .sinks import write_text

SCHEMA = "pairlens-dismissals-1"
#: What an id is made of, in this order.
IDENTITY = ("path", "function_hash", "boundary", "status", "abstention_reason", "priority")


def place(scan: str) -> str:
    return scan.rstrip("/") + ".dismissals.json"


def finding_id(finding: dict) -> str:
    """The digest that reports carry: of the fields that aren't null, as compact JSON."""
    return hashlib.sha256(json.dumps({k: finding[k] for k in IDENTITY if finding.get(k) is not None}, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def _problem(record: object, seen: set[str]) -> str | None:
    if not isinstance(record, dict) or not isinstance(record.get("finding"), dict):
        return "a record without its finding"
    finding = record["finding"]
    if not isinstance(finding.get("path"), str) or not re.fullmatch(r"[0-9a-f]{64}", str(finding.get("function_hash"))):
        return "a finding without path and function hash"
    if record.get("id") != finding_id(finding):
        return "an id that isn't its finding's"
    if record["id"] in seen:
        return "a finding dismissed twice"
    try:
        datetime.fromisoformat(record["dismissed_at"])
    except (KeyError, TypeError, ValueError):
        return "a record without a time"
    return None if isinstance(record.get("reason"), str) else "a record without a reason"


def load(scan: str) -> list[dict]:
    """All records; none without a file.  A file with any fault is an error, not read in part."""
    if not os.path.exists(place(scan)):
        return []
    with open(place(scan), encoding="utf-8") as f:
        body = json.load(f)
    if not isinstance(body, dict) or body.get("schema") != SCHEMA or not isinstance(body.get("dismissals"), list):
        raise ValueError(f"{place(scan)}: not a list of dismissals")
    seen: set[str] = set()
    for record in body["dismissals"]:
        if problem := _problem(record, seen):
            raise ValueError(f"{place(scan)}: {problem}")
        seen.add(record["id"])
    return body["dismissals"]


@contextmanager
def locked(scan: str) -> Iterator[None]:
    """One writer at a time; another one is refused at once."""
    lock = place(scan) + ".lock"
    try:
        os.close(os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
    except FileExistsError as e:
        raise ValueError(f"{lock}: another review is being written") from e
    try:
        yield
    finally:
        os.unlink(lock)


def change(scan: str, finding: dict, reason: str, undo: bool = False) -> None:
    """Dismiss a finding, or take it back; the file is replaced in one step."""
    with locked(scan):
        key = finding_id(finding)
        records = [r for r in load(scan) if r["id"] != key]
        if not undo:
            kept = {k: finding.get(k) for k in (*IDENTITY, "name", "start_line", "end_line", "advisory")}
            records.append({"id": key, "reason": reason.strip(), "dismissed_at": datetime.now(timezone.utc).isoformat(timespec="seconds"), "finding": kept})
        write_text(place(scan), json.dumps({"schema": SCHEMA, "dismissals": records}, indent=1) + "\n")
