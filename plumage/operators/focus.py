"""Sharpness of decoded images: numpy kernels in Arrow batches.

One pass over an image gives all raw terms; blends are expressions. Borders are
mirrored without repeating the edge pixel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERMS_SCHEMA = "path string, width int, height int, lap_var double, tenengrad double, centre double, penalty double"


def gray_of(data: bytes, height: int, width: int, channels: int):
    """Luma of a BGR (or gray) image as float64."""
    import numpy as np

    x = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels).astype(np.float64)
    return x[:, :, 0] if channels < 3 else np.rint(0.114 * x[:, :, 0] + 0.587 * x[:, :, 1] + 0.299 * x[:, :, 2])


def _filtered(gray, kernel):
    import numpy as np

    p = np.pad(gray, 1, mode="reflect") if min(gray.shape) > 1 else np.pad(gray, 1, mode="edge")
    h, w = gray.shape
    out = np.zeros((h, w))
    for i in range(3):
        for j in range(3):
            if kernel[i][j]:
                out += kernel[i][j] * p[i : i + h, j : j + w]
    return out


def laplacian(gray):
    return _filtered(gray, ((0, 1, 0), (1, -4, 1), (0, 1, 0)))


def gradient(gray):
    """Magnitude of the 3 x 3 Sobel gradient (IMG1)."""
    import numpy as np

    return np.hypot(_filtered(gray, ((-1, 0, 1), (-2, 0, 2), (-1, 0, 1))), _filtered(gray, ((-1, -2, -1), (0, 0, 0), (1, 2, 1))))


def centre_energy(gray, lap) -> float:
    """Laplacian energy under a Gaussian weight around the middle (IMG2)."""
    import numpy as np

    h, w = gray.shape
    sigma = 0.28 * min(h, w) + 1e-3
    y, x = np.ogrid[:h, :w]
    weight = np.exp(-((x - (w - 1) / 2) ** 2 + (y - (h - 1) / 2) ** 2) / (2 * sigma**2))
    return float((weight * lap**2).sum() / (weight.sum() + 1e-8))


def ring_penalty(magnitude, ring: int = 10, weight: float = 1.15, free: float = 1.35) -> float:
    """How much sharper the frame's border is than its middle (IMG3)."""
    import numpy as np

    h, w = magnitude.shape
    r = max(1, min(ring, min(h, w) // 5))
    ch, cw = max(2, int(h * 0.34)), max(2, int(w * 0.34))
    y, x = (h - ch) // 2, (w - cw) // 2
    middle = np.zeros((h, w), bool)
    middle[max(y, 0) : y + ch, max(x, 0) : x + cw] = True
    border = np.ones((h, w), bool)
    border[r : h - r, r : w - r] = False
    border &= ~middle
    if not border.any() or not middle.any():
        return 0.0
    return max(0.0, float(magnitude[border].mean()) / (float(magnitude[middle].mean()) + 1e-6) - free) * weight


def focus_terms(gray) -> tuple[float, float, float, float]:
    """Raw terms of the hybrid score (IMG4): variance, gradient, centre, penalty."""
    lap, magnitude = laplacian(gray), gradient(gray)
    return float(lap.var()), float(magnitude.mean()), centre_energy(gray, lap), ring_penalty(magnitude)


def polygon_mask(points, width: int, height: int):
    """Pixels of a polygon (IMG5), even-odd; None below 50 pixels or 3 points."""
    import numpy as np

    points = np.rint(np.asarray(points, dtype=np.float64)) if points is not None and len(points) >= 3 else None
    if points is None:
        return None
    y, x = np.mgrid[:height, :width]
    inside = np.zeros((height, width), bool)
    for (x1, y1), (x2, y2) in zip(points, np.roll(points, 1, axis=0), strict=True):
        if y1 != y2:
            inside ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    for (x1, y1), (x2, y2) in zip(points, np.roll(points, 1, axis=0), strict=True):  # the outline belongs to it
        steps = int(max(abs(x2 - x1), abs(y2 - y1))) + 1
        px, py = np.rint(np.linspace(x1, x2, steps)).astype(int), np.rint(np.linspace(y1, y2, steps)).astype(int)
        ok = (px >= 0) & (px < width) & (py >= 0) & (py < height)
        inside[py[ok], px[ok]] = True
    return inside if inside.sum() >= 50 else None


#: Fixed value: the 5 x 5 ellipse that masks are eroded and widened by.
ELLIPSE = ((0, 0, 1, 0, 0), (1, 1, 1, 1, 1), (1, 1, 1, 1, 1), (1, 1, 1, 1, 1), (0, 0, 1, 0, 0))


def _morph(mask, grow: bool):
    import numpy as np

    h, w = mask.shape
    p = np.pad(mask, 2, constant_values=not grow)
    shifts = [p[i : i + h, j : j + w] for i in range(5) for j in range(5) if ELLIPSE[i][j]]
    return np.logical_or.reduce(shifts) if grow else np.logical_and.reduce(shifts)


def mask_terms(gray, mask) -> tuple[float, float, float, float] | None:
    """Raw terms inside a mask (IMG5); None for masks that are too small."""
    if mask is None or mask.shape != gray.shape or mask.sum() < 80:
        return None
    core, ring = _morph(mask, False), _morph(_morph(mask, True), True) & ~mask
    if not core.any():
        return None
    lap, magnitude = laplacian(gray), gradient(gray)
    inner = lap[core]
    mean = float(magnitude[core].mean())
    outer = float(magnitude[ring].mean()) if ring.any() else 0.0
    return float(inner.var()) if inner.size > 1 else float((inner**2).mean()), mean, float((inner**2).mean()), max(0.0, outer / (mean + 1e-6) - 1.25) * 1.15


#: Fixed value: the share that a subject's box is widened by before its sharpness is measured.
ROI_MARGIN = 0.04


def subject_terms(pixels, box: tuple | None = None, outline=None, mode: str = "mask_hybrid") -> tuple[float, float, float, float] | None:
    """IMG6: raw terms of a whole image, of a subject's box or of what its outline holds.

    ``mode`` as in the settings: ``mask_hybrid`` uses the outline where its mask is large
    enough and the box elsewhere, ``hybrid`` the box; of ``laplacian`` only the variance
    counts. None for an empty box.
    """
    import numpy as np

    from .detection import grown_box

    h, w = pixels.shape[:2]
    x1, y1, x2, y2 = grown_box(box, w, h, ROI_MARGIN) if box else (0, 0, w, h)
    crop = pixels[y1:y2, x1:x2]
    if crop.size == 0:
        return None
    gray = gray_of(crop.tobytes(), *crop.shape)
    if mode == "laplacian":
        return float(laplacian(gray).var()), 0.0, 0.0, 0.0
    if mode == "mask_hybrid" and box and outline:
        points = np.array([(p["x"] - x1, p["y"] - y1) for p in outline])
        terms = mask_terms(gray, polygon_mask(points, x2 - x1, y2 - y1))
        if terms is not None:
            return terms
    return focus_terms(gray)


def image_terms(images: DataFrame) -> DataFrame:
    """Raw terms of every row of Spark's ``image`` source; undecodable ones have nulls.

    The pixels stay in the task that read them.
    """

    def batches(source):
        import pandas as pd

        for pdf in source:
            out = []
            for path, h, w, c, data in pdf.itertuples(index=False):
                ok = h and h > 1 and w > 1 and data is not None and len(data) == h * w * c
                out.append((path, w, h, *(focus_terms(gray_of(bytes(data), h, w, c)) if ok else (None,) * 4)))
            yield pd.DataFrame(out, columns=["path", "width", "height", "lap_var", "tenengrad", "centre", "penalty"])

    i = F.col("image")
    return images.select(*[i[c].alias(c) for c in ("origin", "height", "width", "nChannels", "data")]).mapInPandas(batches, TERMS_SCHEMA)


def scored(images: DataFrame) -> DataFrame:
    """IMG4, IMG6: the hybrid score of every image; 0 where it can't be decoded."""
    from ..functions.numbers import sharpness_blend

    score = sharpness_blend(F.col("lap_var"), F.col("tenengrad"), F.col("centre"), F.col("penalty"))
    return image_terms(images).withColumn("focus", F.coalesce(score, F.lit(0.0)))
