"""Development of pictures: local contrast by tile histograms, tone, and a wildlife look.

Kernels take and give arrays of bytes; :func:`developed_files` runs one over decoded
files in tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

#: Tiles on each side, and the lightness of development's steps.
TILES = 8
DARK_MEAN, LIGHT_MEAN, DARK_GAMMA, LIGHT_GAMMA = 0.38, 0.62, 0.88, 1.10
BLUR_SIGMA = 1.05


def tile_tables(plane, clip: float, tiles: int = TILES):
    """Look-up tables of each tile: its equalised histogram with counts above a limit spread out.

    ``clip`` is the limit in units of an even histogram. What is cut off goes evenly to
    all values, and the rest of that to values a fixed step apart. The plane's sides
    must be multiples of ``tiles``.
    """
    import numpy as np

    h, w = plane.shape[0] // tiles, plane.shape[1] // tiles
    area = h * w
    cells = plane.reshape(tiles, h, tiles, w).transpose(0, 2, 1, 3).reshape(tiles * tiles, area).astype(np.int64)
    counts = np.zeros((tiles * tiles, 256), dtype=np.int64)
    np.add.at(counts, (np.repeat(np.arange(tiles * tiles), area), cells.ravel()), 1)
    if clip > 0:
        limit = max(1, int(clip * area / 256))
        over = np.maximum(counts - limit, 0).sum(axis=1)
        counts = np.minimum(counts, limit) + (over // 256)[:, None]
        for i, rest in enumerate(over % 256):
            if rest:
                counts[i, : max(256 // rest, 1) * rest : max(256 // rest, 1)] += 1
    table = np.rint(np.cumsum(counts, axis=1) * (255.0 / area))
    return np.clip(table, 0, 255).reshape(tiles, tiles, 256)


def equalised(plane, clip: float, tiles: int = TILES):
    """Contrast-limited adaptive equalisation: each pixel by the tables of the four nearest tiles, blended.

    Planes whose sides aren't multiples of ``tiles`` are continued by mirroring for the
    tables only.
    """
    import numpy as np

    height, width = plane.shape
    more = (-height % tiles, -width % tiles)
    if any(more):
        mode = "reflect" if min(height, width) > max(more) else "edge"
        wide = np.pad(plane, ((0, more[0]), (0, more[1])), mode=mode)
    else:
        wide = plane
    tables = tile_tables(wide, clip, tiles)

    def around(n: int, size: int):
        at = np.arange(n) / size - 0.5
        low = np.floor(at).astype(int)
        return np.clip(low, 0, tiles - 1), np.clip(low + 1, 0, tiles - 1), at - low

    top, bottom, fy = around(height, wide.shape[0] // tiles)
    left, right, fx = around(width, wide.shape[1] // tiles)
    value = lambda y, x: tables[y[:, None], x[None, :], plane]
    fx, fy = fx[None, :], fy[:, None]
    blend = (value(top, left) * (1 - fx) + value(top, right) * fx) * (1 - fy) + (value(bottom, left) * (1 - fx) + value(bottom, right) * fx) * fy
    return np.clip(np.rint(blend), 0, 255).astype(np.uint8)


#: Linear sRGB to XYZ (rows), divided by the white of daylight.
_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
_WHITE = (0.950456, 1.0, 1.088754)


def to_lab(rgb):
    """Lightness (0 to 255) and the two colour planes (around 128) of an RGB image, as bytes."""
    import numpy as np

    x = rgb.astype(np.float64) / 255
    x = np.where(x > 0.04045, ((x + 0.055) / 1.055) ** 2.4, x / 12.92)
    xyz = x @ (np.array(_XYZ) / np.array(_WHITE)[:, None]).T
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    lab = np.stack([np.where(xyz[..., 1] > 0.008856, 116 * f[..., 1] - 16, 903.3 * xyz[..., 1]) * 2.55, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], axis=-1)
    return np.clip(np.rint(lab), 0, 255).astype(np.uint8)


def from_lab(lab):
    """The RGB image of :func:`to_lab`'s planes."""
    import numpy as np

    light, a, b = lab[..., 0] / 2.55, lab[..., 1] - 128.0, lab[..., 2] - 128.0
    fy = (light + 16) / 116
    f = np.stack([fy + a / 500, fy, fy - b / 200], axis=-1)
    xyz = np.where(f > 6 / 29, f**3, (f - 16 / 116) / 7.787)
    xyz[..., 1] = np.where(light > 903.3 * 0.008856, fy**3, light / 903.3)
    x = (xyz * np.array(_WHITE)) @ np.linalg.inv(np.array(_XYZ)).T
    x = np.where(x > 0.0031308, 1.055 * np.maximum(x, 0) ** (1 / 2.4) - 0.055, 12.92 * x)
    return np.clip(np.rint(x * 255), 0, 255).astype(np.uint8)


def toned(rgb, shadow: float = 0.0, exposure: float = 0.0, contrast: float = 0.0):
    """IMG17: shadows (0 to 100), then brightness and contrast (-100 to 100) of an RGB image; 0 leaves it."""
    import numpy as np

    shadow, exposure, contrast = max(0, min(100, int(shadow))), max(-100, min(100, int(exposure))), max(-100, min(100, int(contrast)))
    out = rgb
    if shadow:
        lab = to_lab(out)
        lab[..., 0] = equalised(lab[..., 0], 1.0 + shadow / 100.0 * 8.0)
        out = from_lab(lab)
    if exposure:
        out = np.clip(out * min(2.2, max(0.35, 1 + exposure / 200)), 0, 255).astype(np.uint8)
    if contrast:
        luma = np.floor(out.astype(np.float64) @ np.array((299.0, 587.0, 114.0)) / 1000)
        mean = int(luma.mean() + 0.5)
        out = np.clip(mean + (out.astype(np.float64) - mean) * min(2.2, max(0.35, 1 + contrast / 200)), 0, 255).astype(np.uint8)
    return out


def _blurred(image, sigma: float):
    import numpy as np

    reach = int(round(sigma * 6 + 1)) // 2
    weights = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    weights /= weights.sum()
    out = image.astype(np.float64)
    for axis in (0, 1):
        n = out.shape[axis]
        pad = [(reach, reach) if k == axis else (0, 0) for k in range(out.ndim)]
        wide = np.pad(out, pad, mode="reflect" if n > reach else "edge")
        out = sum(w * np.take(wide, np.arange(i, i + n), axis=axis) for i, w in enumerate(weights))
    return out


def wildlife(rgb, denoise: Callable | None = None):
    """IMG16: a rendered raw picture made ready to look at: mid tones, local contrast, shadows, sharpness.

    ``denoise(rgb, strength)`` is the caller's (2.5 to 8, by the variance of the
    Laplacian); without it noise stays. An empty image comes back as it is.
    """
    import numpy as np

    from .focus import gray_of, laplacian

    if rgb.size == 0:
        return rgb
    lab = to_lab(rgb)
    light = lab[..., 0] / 255.0
    mean, spread = float(light.mean()), float(light.std())
    gamma = DARK_GAMMA if mean < DARK_MEAN else LIGHT_GAMMA if mean > LIGHT_MEAN else 1.0
    plane = np.clip(light**gamma * 255.0 + 1e-9, 0, 255).astype(np.uint8)
    light = equalised(plane, float(np.clip(2.2 + (0.18 - spread) * 14.0, 1.6, 6.5))) / 255.0
    lift = 0.11 * np.clip(1.0 - light, 0, 1) ** 1.75 * np.clip(0.48 - light, 0, None)
    lab[..., 0] = (np.clip(light + lift, 0, 1) * 255.0 + 1e-9).astype(np.uint8)
    out = from_lab(lab)
    if denoise is not None:
        noise = float(laplacian(gray_of(out[:, :, ::-1].tobytes(), *out.shape)).std())
        out = denoise(out, float(np.clip(2.5 + noise * 0.35, 2.5, 8.0)))
    amount = float(np.clip(0.28 + 0.32 * (1.0 - min(spread * 5.5, 1.0)), 0.12, 0.62))
    soft = np.rint(_blurred(out, BLUR_SIGMA))
    return np.clip(np.rint(out * (1.0 + amount) - soft * amount), 0, 255).astype(np.uint8)


def developed_files(files: DataFrame, decoder: Callable[[], Callable], encoder: Callable[[], Callable], develop: Callable = wildlife) -> DataFrame:
    """SNK2, IMG16: ``files(dest, content)`` decoded (BGR), developed and encoded: ``(dest, content, error)``.

    Feed it with the previews of raw files and hand its rows to ``files.write_files``.
    Faults cost their file only; it keeps its content, so that a copy is still written.
    """

    def batches(source):
        import pandas as pd

        decode, encode = decoder(), encoder()
        for pdf in source:
            out = []
            for dest, content in zip(pdf["dest"], pdf["content"], strict=True):
                try:
                    pixels = decode(bytes(content))
                    if pixels is None:
                        raise ValueError("not decoded")
                    out.append((dest, encode(develop(pixels[:, :, 2::-1])[:, :, ::-1]), None))
                except Exception as e:  # noqa: BLE001  told with the file
                    out.append((dest, content, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["dest", "content", "error"])

    return files.select("dest", "content").mapInPandas(batches, "dest string, content binary, error string")
