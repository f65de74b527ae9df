"""Registered queries of the library and their SQL, gathered from the modules beside this one."""

from __future__ import annotations

from . import corpus, detection, evaluation, projects, review, state
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "corpus", "detection", "evaluation", "projects", "review", "state"]
