"""Settings of a scan, and the fingerprint that results are kept under."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from .operators.verdicts import Thresholds


@dataclass(frozen=True)
class ScanConfig:
    """K hits per region, B pairs per function, R regions per function, V verified regions per pair."""

    hits_per_region: int = 10
    pairs_per_unit: int = 5
    regions_per_unit: int = 96
    regions_per_pair: int = 3
    similarity: float = 0.0
    max_source_chars: int = 200_000
    max_edit_chars: int | None = None
    model: str = "hashing-64"
    fallback: bool = True
    thresholds: Thresholds = field(default_factory=Thresholds)

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()
