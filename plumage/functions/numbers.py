"""Number and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp without zone, read as UTC (DT2)."""
    return F.unix_micros(ts.cast("timestamp"))


def keep_quota(n: Column, ratio: float, least: int) -> Column:
    """Frames to keep of a burst of ``n`` (AGG3): half-even share, at least ``least``, at most ``n``."""
    share = F.bround(n * F.lit(min(1.0, max(0.01, ratio)))).cast("long")
    return F.when(n <= 0, F.lit(0).cast("long")).otherwise(F.least(n, F.greatest(F.lit(max(1, least)).cast("long"), share)))


def frame_score(focus: Column, area: Column, has_eye: Column, w_focus: float = 1.0, w_area: float = 0.45, eye_bonus: float = 0.8) -> Column:
    """Composite score of a frame (MTH4)."""
    return w_focus * focus + w_area * (area / 10000.0) + F.when(has_eye, eye_bonus).otherwise(0.0)


def sharpness_blend(lap_var: Column, tenengrad: Column, centre: Column, penalty: Column) -> Column:
    """Blend of raw sharpness terms (MTH5)."""
    positive = lambda c: F.log1p(F.greatest(F.lit(0.0), c))
    return positive(lap_var) + 0.55 * positive(tenengrad) + 0.35 * positive(centre) - penalty


def duration_text(seconds: Column) -> Column:
    """Seconds as hours, minutes and seconds in Chinese (STR17); negative: 0."""
    s = F.greatest(F.lit(0), F.bround(seconds).cast("long"))
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    text = lambda c, unit: F.concat(c.cast("string"), F.lit(unit))
    part = lambda c, unit: F.when(c > 0, text(c, unit)).otherwise("")
    return (
        F.when(s < 60, text(s, "秒"))
        .when(s < 3600, F.when(r > 0, F.concat(text(m, "分"), text(r, "秒"))).otherwise(text(m, "分钟")))
        .otherwise(F.concat(text(h, "小时"), part(m, "分"), part(r, "秒")))
    )


def clamped_line(n: Column, slope: float, base: float = 0.0, low: float = 0.0, high: float | None = None) -> Column:
    """``base + slope * n`` held between bounds (MTH6)."""
    value = F.greatest(F.lit(float(low)), F.lit(float(base)) + n * F.lit(float(slope)))
    return value if high is None else F.least(F.lit(float(high)), value)


#: Seconds a stage is expected to take for n images: (slope, base, low, high).
STAGE_ESTIMATES = {"burst": (2.8, 0.0, 18.0, None), "burst_report": (0.12, 15.0, 10.0, 120.0), "gps": (0.08, 6.0, 4.0, 120.0), "species_local": (5.0, 0.0, 25.0, None), "species_remote": (14.0, 0.0, 25.0, None), "watermark": (0.8, 0.0, 12.0, None)}


def backoff_seconds(attempt: int, retry_after: float | None, base: float = 2.0, most: float = 120.0, draw: float = 0.0) -> float:
    """Wait before a retry (MTH8); ``draw`` in [0, 1) scales the jitter."""
    if retry_after and retry_after > 0:
        return min(retry_after, most)
    wait = base**attempt
    return min(wait + draw * min(2.0, 0.15 * wait), most)


def fitted_size(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """Size with the longer side at ``most`` (MTH11); smaller images stay."""
    side = F.greatest(width, height)
    scaled = lambda c: F.when(side > most, F.floor(c * (F.lit(float(most)) / side)).cast("int")).otherwise(c)
    return scaled(width), scaled(height)
