"""Where captions, logos and labels go: geometry of pictures as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From this code point on characters are one em wide, before it half of one.
WIDE_FROM = 0x2E80
#: Luma from which a logo is dark, ink of dark and light logos, gap lines and captions.
NEAR_WHITE = 200.0
DARK, LIGHT, GRAY, TEXT = (22, 22, 22), (255, 255, 255), (148, 148, 148), (28, 28, 28)


def _whole(value: Column) -> Column:
    """A positive double cut to an int."""
    return F.floor(value).cast("int")


def char_width(char: Column, size: Column, widths: dict[str, float] | None = None) -> Column:
    """Width of a character at a font size: by the table of ems, else one em or half of one."""
    plain = F.when(F.ascii(char) >= WIDE_FROM, 1.0).otherwise(0.5)
    if not widths:
        return plain * size
    table = F.create_map(*[F.lit(x) for pair in widths.items() for x in (pair[0], float(pair[1]))])
    return F.coalesce(F.try_element_at(table, char), plain) * size


def text_width(text: Column, size: Column, widths: dict[str, float] | None = None) -> Column:
    """Sum of its characters' widths; null: 0."""
    return F.aggregate(_characters(F.coalesce(text, F.lit(""))), F.lit(0.0), lambda w, c: w + char_width(c, size, widths))


def _characters(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def wrapped(text: Column, most: Column, size: Column, widths: dict[str, float] | None = None) -> Column:
    """STR16: lines of a text, as many characters on each as fit into ``most``; a fold in the row.

    A character wider than that has a line of its own. Null and blank texts, and no
    room at all, give no lines.
    """
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")

    def step(acc: Column, char: Column) -> Column:
        wide = char_width(char, size, widths)
        fits = acc["width"] + wide <= most
        closed = F.when(fits | (acc["line"] == ""), acc["lines"]).otherwise(F.array_append(acc["lines"], acc["line"]))
        return F.struct(closed.alias("lines"), F.when(fits, F.concat(acc["line"], char)).otherwise(char).alias("line"), F.when(fits, acc["width"] + wide).otherwise(wide).alias("width"))

    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"), F.lit(0.0).alias("width"))
    folded = F.aggregate(_characters(plain), start, step, lambda acc: F.when(acc["line"] == "", acc["lines"]).otherwise(F.array_append(acc["lines"], acc["line"])))
    return F.when(most > 0, folded).otherwise(F.array().cast("array<string>"))


def fitted(width: Column, height: Column, room_w: Column, room_h: Column) -> Column:
    """MTH10: ``(width, height)`` of the largest picture of the same shape in a room, 1 at least; sizes of 0 stay."""
    scale = F.least(room_w / width, room_h / height)
    fit = F.struct(F.greatest(F.lit(1), _whole(width * scale)).alias("width"), F.greatest(F.lit(1), _whole(height * scale)).alias("height"))
    return F.when((width <= 0) | (height <= 0), F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"))).otherwise(fit)


def caption_frame(width: Column, height: Column) -> Column:
    """IMG18: margins and type sizes of a framed picture, before its texts are known."""
    side = F.greatest(F.lit(2), _whole(F.lit(0.01) * (width + height)))
    canvas = width + 2 * side + 2
    font = F.greatest(F.lit(18), _whole(F.least(width, height) * F.lit(0.019)))
    pad, gap = F.greatest(F.lit(15), _whole(canvas * F.lit(0.018))), F.greatest(F.lit(16), _whole(canvas * F.lit(0.028)))
    half = F.greatest(F.lit(40), F.floor((canvas - 2 * pad - gap) / 2).cast("int"))
    fields = {"side": side, "canvas_width": canvas, "bar_top": side + height + 2, "font_size": font, "pad_x": pad, "pad_y": F.greatest(F.lit(12), _whole(font * F.lit(0.65))), "gap": gap, "half_width": half}
    return F.struct(*[v.cast("int").alias(k) for k, v in fields.items()])


def caption_bar(frame: Column, left_lines: Column, right_lines: Column, line_height: Column | None = None) -> Column:
    """IMG18: heights of the bar below a picture and of the whole, for its lines of text.

    ``line_height`` is what the font measures; without it the font's size and two.
    """
    line = F.greatest(frame["font_size"] + 2, F.lit(0) if line_height is None else line_height)
    lead = F.greatest(F.lit(2), _whole(line * F.lit(0.12)))
    n = F.greatest(F.size(left_lines), F.size(right_lines), F.lit(1))
    bar = F.greatest(F.lit(44), frame["pad_y"] * 2 + n * line + (n - 1) * lead)
    fields = {"line_height": line, "line_gap": lead, "bar_height": bar, "canvas_height": frame["bar_top"] + bar, "text_top": frame["bar_top"] + frame["pad_y"]}
    return F.struct(*[v.cast("int").alias(k) for k, v in fields.items()])


def logo_place(frame: Column, width: Column, height: Column, logo_w: Column, logo_h: Column, share: float = 0.30) -> Column:
    """IMG18: size and corner of the logo above the bar: in the middle of the picture's lower edge."""
    room_w = F.greatest(F.lit(40), _whole(width * F.lit(min(0.8, max(0.05, share)))))
    size = fitted(logo_w, logo_h, room_w, F.greatest(F.lit(28), _whole(height * F.lit(0.16))))
    corner = frame["side"] + 1
    x = corner + F.greatest(F.lit(0), F.floor((width - size["width"]) / 2).cast("int"))
    y = corner + height - size["height"] - F.greatest(F.lit(8), _whole(height * F.lit(0.02)))
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), size["width"].alias("width"), size["height"].alias("height"))


def logo_is_dark(luma: Column) -> Column:
    """MTH10: whether the ground is so light that the logo has to be dark."""
    return F.coalesce(luma, F.lit(0.0)) >= NEAR_WHITE


def label_sizes(width: Column, height: Column) -> Column:
    """IMG13: widths of lines, type sizes, padding and gap of labels on a picture."""
    scale = F.greatest(width, height) / F.lit(1500.0)
    at_least = {"bird_line": (3, 4), "eye_line": (3, 3), "main_size": (28, 36), "small_size": (20, 26), "pad": (6, 8), "gap": (4, 6)}
    return F.struct(*[F.greatest(F.lit(low), _whole(scale * F.lit(float(slope)))).alias(k) for k, (low, slope) in at_least.items()])


def label_spot(x1: Column, y1: Column, y2: Column, text_w: Column, label_h: Column, width: Column, height: Column, pad: Column, gap: Column) -> Column:
    """IMG13: corner of a label: above its box, else below it, else as far up as it goes; not beyond the right edge."""
    above, below = y1 - label_h - gap, y2 + gap
    y = F.when(above >= 0, above).when(below + label_h <= height, below).otherwise(F.greatest(F.lit(0), above))
    over = x1 + text_w + pad - width
    return F.struct(F.when(over > 0, F.greatest(F.lit(0), x1 - over)).otherwise(x1).cast("int").alias("x"), y.cast("int").alias("y"))


def labels_apart(labels: Column, width: Column, height: Column, pad: Column, gap: Column) -> Column:
    """IMG13: rectangles ``(x, y, w, h)`` of ``labels(x1, y1, y2, text_w, label_h)``, in their order, that don't cover each other.

    An ordered fold in the row: each label takes the first free spot of its own spot,
    above or below its box, and those one and two label heights further out; where all
    are taken or outside the picture, its own.
    """

    def place(done: Column, label: Column) -> Column:
        own = label_spot(label["x1"], label["y1"], label["y2"], label["text_w"], label["label_h"], width, height, pad, gap)
        rect = lambda y: F.struct(own["x"].alias("x"), y.cast("int").alias("y"), (label["text_w"] + pad).cast("int").alias("w"), label["label_h"].cast("int").alias("h"))
        above, below = label["y1"] - label["label_h"] - gap, label["y2"] + gap
        tries = F.array(rect(own["y"]), rect(above), rect(below), *[rect(y) for k in (1, 2) for y in (above - k * label["label_h"], below + k * label["label_h"])])
        covers = lambda a, b: (a["x"] < b["x"] + b["w"]) & (b["x"] < a["x"] + a["w"]) & (a["y"] < b["y"] + b["h"]) & (b["y"] < a["y"] + a["h"])
        free = F.filter(tries, lambda t: (t["y"] >= 0) & (t["y"] + t["h"] <= height) & ~F.exists(done, lambda d: covers(t, d)))
        return F.array_append(done, F.coalesce(F.get(free, F.lit(0)), rect(own["y"])))

    return F.aggregate(labels, F.array().cast("array<struct<x:int,y:int,w:int,h:int>>"), place)
