"""Settings of a run, with their limits (all have working defaults)."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class PipelineConfig:
    """Settings; out-of-range values are brought to their nearest limit by :meth:`checked`."""

    time_threshold: float = 1.0
    keep_ratio: float = 0.2
    keep_min: int = 2
    min_area: float = 1000.0
    bird_confidence: float = 0.3
    eye_tolerance: float = 0.06
    eyes_per_bird: int = 2
    geo_mode: str = "china"
    candidate_threshold: float | None = None
    accept_floor: float | None = 0.5
    province: str | None = None
    city: str | None = None
    daily_limit: int = 2_000_000
    switch_ratio: float = 0.75
    longest_name: int = 8
    caption_default: str = ""

    def checked(self) -> PipelineConfig:
        if self.geo_mode not in ("china", "province", "auto", "none"):
            raise ValueError(f"unknown geo_mode {self.geo_mode!r}")
        clamp = lambda v, lo, hi: min(hi, max(lo, v))
        return replace(self, time_threshold=max(0.0, self.time_threshold), keep_ratio=clamp(self.keep_ratio, 0.01, 1.0), keep_min=max(1, self.keep_min), switch_ratio=clamp(self.switch_ratio, 0.1, 0.99), daily_limit=max(1, self.daily_limit), longest_name=max(2, self.longest_name))

    @classmethod
    def from_json(cls, text: str, **flags) -> PipelineConfig:
        """Settings of a JSON text; explicit flags win, unknown keys are passed over."""
        names = {f.name for f in fields(cls)}
        given = {k: v for k, v in json.loads(text or "{}").items() if k in names} | {k: v for k, v in flags.items() if v is not None}
        return cls(**given).checked()

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, indent=2)
