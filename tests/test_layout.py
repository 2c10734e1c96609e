"""Wrapping, captions and labels against plain versions."""

import random

from pyspark.sql import functions as F

from plumage.functions import layout as L

WIDTHS = {"i": 0.2, "W": 0.9, " ": 0.25, "国": 1.1}


def width(c):
    return WIDTHS.get(c, 1.0 if ord(c) >= 0x2E80 else 0.5)


def plain_wrap(text, most, size):
    lines, cur, wide = [], "", 0.0
    if most <= 0:
        return []
    for c in (text or "").strip():
        w = width(c) * size
        if wide + w <= most:
            cur, wide = cur + c, wide + w
        else:
            lines += [cur] if cur else []
            cur, wide = c, w
    return lines + ([cur] if cur else [])


def test_wrapping(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("iWab 国鸟é🐦") for _ in range(rng.randint(0, 40))), rng.randint(-2, 120), rng.choice([10, 16])) for _ in range(400)] + [(None, 50, 10), ("  ab ", 5, 10), ("国", 3, 10)]
    df = spark.createDataFrame(rows, "t string, most int, size int").select("*", L.wrapped(F.col("t"), F.col("most"), F.col("size"), WIDTHS).alias("lines"), L.text_width(F.col("t"), F.col("size"), WIDTHS).alias("w"))
    for r in df.collect():
        assert r.lines == plain_wrap(r.t, r.most, r["size"]), r
        assert abs(r.w - sum(width(c) for c in r.t or "") * r["size"]) < 1e-9


def test_caption_geometry(spark):
    rng = random.Random(5)
    rows = [(rng.randint(1, 9000), rng.randint(1, 9000), rng.randint(0, 4), rng.randint(0, 4), rng.randint(0, 900), rng.randint(0, 900)) for _ in range(300)]
    df = spark.createDataFrame(rows, "w int, h int, nl int, nr int, lw int, lh int")
    lines = lambda c: F.array_repeat(F.lit("x"), F.col(c))
    df = df.withColumn("f", L.caption_frame(F.col("w"), F.col("h"))).withColumns({"b": L.caption_bar(F.col("f"), lines("nl"), lines("nr")), "logo": L.logo_place(F.col("f"), F.col("w"), F.col("h"), F.col("lw"), F.col("lh"))})
    for r in df.collect():
        side = max(2, int(0.01 * (r.w + r.h)))
        canvas = r.w + 2 + 2 * side
        font = max(18, int(min(r.w, r.h) * 0.019))
        pad, gap = max(15, int(canvas * 0.018)), max(16, int(canvas * 0.028))
        assert tuple(r.f) == (side, canvas, side + r.h + 2, font, pad, max(12, int(font * 0.65)), gap, max(40, (canvas - 2 * pad - gap) // 2))
        line, n = font + 2, max(r.nl, r.nr, 1)
        lead = max(2, int(line * 0.12))
        bar = max(44, 2 * r.f.pad_y + n * line + (n - 1) * lead)
        assert tuple(r.b) == (line, lead, bar, r.f.bar_top + bar, r.f.bar_top + r.f.pad_y)
        room = max(40, int(r.w * 0.3)), max(28, int(r.h * 0.16))
        size = (r.lw, r.lh)
        if r.lw > 0 and r.lh > 0:
            scale = min(room[0] / r.lw, room[1] / r.lh)
            size = max(1, int(r.lw * scale)), max(1, int(r.lh * scale))
        assert (r.logo.width, r.logo.height) == size
        assert (r.logo.x, r.logo.y) == (side + 1 + max(0, (r.w - size[0]) // 2), side + 1 + r.h - size[1] - max(8, int(r.h * 0.02)))
    dark = spark.createDataFrame([(199.9,), (200.0,), (None,)], "l double").select(L.logo_is_dark(F.col("l"))).collect()
    assert [r[0] for r in dark] == [False, True, False]


def spot(x1, y1, y2, tw, lh, w, h, pad, gap):
    above, below = y1 - lh - gap, y2 + gap
    y = above if above >= 0 else below if below + lh <= h else max(0, above)
    over = x1 + tw + pad - w
    return (max(0, x1 - over) if over > 0 else x1), y


def test_labels(spark):
    rng = random.Random(6)
    rows = []
    for i in range(150):
        labels = [(x, y, y + rng.randint(1, 60), rng.randint(10, 80), rng.randint(8, 30)) for x, y in ((rng.randint(0, 190), rng.randint(0, 90)) for _ in range(rng.randint(0, 6)))]
        rows.append((i, 200, 120, labels))
    df = spark.createDataFrame(rows, "i int, w int, h int, labels array<struct<x1:int,y1:int,y2:int,text_w:int,label_h:int>>")
    got = df.select("*", L.labels_apart(F.col("labels"), F.col("w"), F.col("h"), F.lit(6), F.lit(4)).alias("placed")).collect()
    for r in got:
        done = []
        for x1, y1, y2, tw, lh in r.labels:
            x, y = spot(x1, y1, y2, tw, lh, r.w, r.h, 6, 4)
            tries = [y, y1 - lh - 4, y2 + 4, y1 - 2 * lh - 4, y2 + 4 + lh, y1 - 3 * lh - 4, y2 + 4 + 2 * lh]
            hit = lambda t: any(x < a + c and a < x + tw + 6 and t < b + d and b < t + lh for a, b, c, d in done)  # noqa: E731, B023
            done.append((x, next((t for t in tries if t >= 0 and t + lh <= r.h and not hit(t)), y), tw + 6, lh))
        assert [tuple(p) for p in r.placed] == done
    sizes = spark.createDataFrame([(1500, 1000), (6000, 4000), (100, 90)], "w int, h int").select(L.label_sizes(F.col("w"), F.col("h")).alias("s")).collect()
    assert [tuple(r.s) for r in sizes] == [(4, 3, 36, 26, 8, 6), (16, 12, 144, 104, 32, 24), (3, 3, 28, 20, 6, 4)]
