"""Parameters of a scan, with the usual defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    interval: float = 3.0
    min_duration: float = 10.0
    min_segment: float = 9.0
    distance: int = 20
    token_limit: int = 512
    min_shared: int = 2
    max_frequency: int = 200
    per_item: int = 50
    min_coverage: float = 95.0
    top_offsets: int = 20


#: Documents: one sentence a second, segments of three sentences.
DOCUMENTS = Params(interval=1.0, min_segment=3.0, min_duration=3.0)
TOLERANCE = 1e-9
