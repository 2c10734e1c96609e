"""Report rows, totals, and HTML pages of bounded size."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one HTML page shows; the others are on the pages that follow.
PAGE_ROWS = 500


def image_rows(frames: DataFrame) -> DataFrame:
    """PRJ1: what a report says about each frame (times as text, scores to two digits)."""
    return frames.select(
        "camera", "burst_id", "path", F.regexp_extract("path", r"([^/\\]*)$", 1).alias("name"), F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss").alias("time"),
        "time_diff", F.bround("focus", 2).alias("focus"), F.bround("area", 2).alias("area"), F.coalesce("has_eye", F.lit(False)).alias("has_eye"), F.coalesce("keep", F.lit(False)).alias("kept"),
    )


def nested_report(frames: DataFrame) -> DataFrame:
    """SNK1: one row a burst with its frames, for a JSON sink; a burst's frames are one session."""
    rows = image_rows(frames).filter("burst_id is not null")
    one = F.struct("time", "path", "name", "time_diff", "focus", "area", "has_eye", "kept")
    return rows.groupBy("camera", "burst_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("kept").alias("kept"), F.array_sort(F.collect_list(one)).alias("images"))


def run_totals(results: DataFrame) -> DataFrame:
    """AGG10-12, SNK15: one row of counts for ``results(birds, eyes, crops, ok)``."""
    return results.agg(F.count(F.lit(1)).alias("images"), F.sum("birds").alias("birds"), F.sum("eyes").alias("eyes"), F.sum("crops").alias("crops"), F.count_if("ok").alias("ok"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("failed"))


def _cell(tag: str, value: object, extra: str = "") -> str:
    return f"<{tag}{extra}>{html.escape('' if value is None else str(value))}</{tag}>"


def _document(title: str, body: str) -> str:
    return f"<!DOCTYPE html><meta charset=utf-8><title>{html.escape(title)}</title>{_cell('h1', title)}{body}"


def _page(title: str, cards: list[tuple[str, object]], head: list[str], rows) -> str:
    kpis = "".join(f"<div class=card>{_cell('b', v)} {html.escape(k)}</div>" for k, v in cards)
    body = "".join("<tr>" + "".join(_cell("td", v) for v in r) + "</tr>" for r in rows)
    return _document(title, f"{kpis}<table><tr>{''.join(_cell('th', h) for h in head)}</tr>{body}</table>")


def html_pages(rows: DataFrame, order: list[str], title: str, cards: list[tuple[str, object]]) -> DataFrame:
    """SNK9, SNK10: ``(page, html)``: a table in pages of PAGE_ROWS, values escaped.

    Pages are made where their rows are, so nothing passes through the driver. Rows
    are numbered in ``order``, a total one, unless they have a ``page`` already.
    """
    from .archive import numbered

    if "page" not in rows.columns:
        rows = numbered(rows, order).withColumn("page", F.floor((F.col("seq") - 1) / PAGE_ROWS).cast("long")).drop("seq")
    columns = [c for c in rows.columns if c != "page"]

    def render(pdf):
        import pandas as pd

        pdf = pdf.sort_values(order)
        return pd.DataFrame({"page": [pdf["page"].iloc[0]], "html": [_page(title, cards, columns, pdf[columns].itertuples(index=False))]})

    return rows.groupBy("page").applyInPandas(render, "page long, html string")


def thumbnail(pixels, most: int = 400):
    """IMG15: a picture no wider than ``most``; narrower ones as they are."""
    from .recognition import resized

    h, w = pixels.shape[:2]
    return pixels if w <= most else resized(pixels, max(1, int(h * (most / w))), most)


def thumbnails(files: DataFrame, decoder, encoder, most: int = 400) -> DataFrame:
    """IMG15, STR19: ``(path, thumb)`` of ``files(path, content)``, as JPEG in base64; null where it can't be made."""

    def batches(source):
        import base64

        import pandas as pd

        decode, encode = decoder(), encoder()

        def one(content):
            try:
                return base64.b64encode(encode(thumbnail(decode(bytes(content)), most))).decode()
            except Exception:  # noqa: BLE001  a picture that fails has no thumbnail
                return None

        for pdf in source:
            yield pd.DataFrame({"path": pdf["path"], "thumb": [one(c) for c in pdf["content"]]})

    return files.select("path", "content").mapInPandas(batches, "path string, thumb string")


CARD_FIELDS = ["time", "time_diff", "focus", "area", "has_eye"]


def _card(row) -> str:
    picture = f'<img loading=lazy src="data:image/jpeg;base64,{row.thumb}">' if row.thumb else "<div class=none></div>"
    facts = "".join(f"<li>{html.escape(f)}: {html.escape(str(getattr(row, f)))}</li>" for f in CARD_FIELDS)
    state = "kept" if row.kept else "dropped"
    return f"<div class='image {state}'>{picture}{_cell('b', row.name)}<ul>{facts}</ul><span>{state}</span></div>"


def burst_report(frames: DataFrame, title: str, thumbs: DataFrame | None = None) -> DataFrame:
    """SNK8: ``(dest, content)`` of the HTML report of evaluated frames, to be written by ``files.write_files``.

    ``frames`` are rows of :func:`burst.best_frames`. One section a burst, then single
    frames; a card for each image, with its thumbnail from ``thumbs(path, thumb)`` where
    there is one. Pages hold PAGE_ROWS images, so a burst of any length is cut and says
    so; they are rendered in tasks. ``index.html`` has the totals as cards and leads to
    all pages, through pages of links where there are more than PAGE_ROWS.
    """
    from . import burst
    from .archive import numbered

    rows = image_rows(frames.withColumn("path", F.col("path").cast("string")).withColumn("keep", F.coalesce("keep", F.lit(False))))
    rows = rows.withColumns({"part": F.when(F.col("burst_id").isNull(), 1).otherwise(0), "camera": F.col("camera").cast("string"), "burst_id": F.coalesce("burst_id", F.lit(-1))})
    sizes = rows.filter("part = 0").groupBy("camera", "burst_id").agg(F.count(F.lit(1)).alias("of"), F.count_if("kept").alias("of_kept"))
    placed = numbered(rows, ["part", "camera", "burst_id", "time", "path"]).withColumn("page", F.floor((F.col("seq") - 1) / PAGE_ROWS).cast("long"))
    placed = placed.join(sizes, ["camera", "burst_id"], "left")
    placed = placed.join(thumbs.select(F.col("path").cast("string"), "thumb").dropDuplicates(["path"]), "path", "left") if thumbs is not None else placed.withColumn("thumb", F.lit(None).cast("string"))

    def render(pdf):
        import pandas as pd

        pdf = pdf.sort_values("seq").astype({"of": "Int64", "of_kept": "Int64"})
        out, last = [], None
        for row in pdf.itertuples(index=False):
            group = (row.part, row.camera if row.part == 0 else None, row.burst_id)
            if group != last:
                name = f"{row.camera} / {row.burst_id}: {row.of} images, {row.of_kept} kept" if row.part == 0 else "Single images"
                more = " (continued)" if last is None and row.page > 0 else ""
                out.append(("</section>" if last else "") + "<section>" + _cell("h2", name + more))
                last = group
            out.append(_card(row))
        page, ends = int(pdf["page"].iloc[0]), [f"{r.camera} / {r.burst_id}" if r.part == 0 else "single images" for r in (pdf.iloc[0], pdf.iloc[-1])]
        body = _document(f"{title}, page {page + 1}", "".join(out) + "</section>")
        return pd.DataFrame({"dest": [f"pages/{page:08d}.html"], "content": [body.encode()], "place": [page], "label": [f"{page + 1}: {ends[0]} to {ends[1]}"]})

    from ..sources.tables import materialised

    pages = materialised(placed.groupBy("page").applyInPandas(render, "dest string, content binary, place long, label string"))
    cards = burst.totals(frames.withColumns({"keep": F.coalesce("keep", F.lit(False)), "first_of_session": F.col("n") > 1})).first()
    bursts = sizes.count()
    kpis = [("images", cards.total), ("kept", cards.kept), ("dropped", cards.discarded), ("bursts", bursts)]
    levels, links, level = [pages.select("dest", "content")], pages.select("dest", "place", "label"), 0
    n = links.count()
    while n > PAGE_ROWS:
        level += 1
        links = materialised(_link_pages(links, title, level))
        levels.append(links.select("dest", "content"))
        links, n = links.select("dest", "place", "label"), -(-n // PAGE_ROWS)
    top = sorted(links.collect(), key=lambda r: r.place)  # PAGE_ROWS links at most
    head = "".join(f"<div class=card>{_cell('b', v)} {html.escape(k)}</div>" for k, v in kpis)
    body = _document(title, head + "<ol>" + "".join(f"<li><a href='{html.escape(r.dest)}'>{html.escape(r.label)}</a></li>" for r in top) + "</ol>")
    index = frames.sparkSession.createDataFrame([("index.html", bytearray(body.encode()))], "dest string, content binary")
    out = index
    for part in levels:
        out = out.unionByName(part)
    return out


def _link_pages(links: DataFrame, title: str, level: int) -> DataFrame:
    """Pages of PAGE_ROWS links to the pages of the level below."""

    def render(pdf):
        import pandas as pd

        pdf = pdf.sort_values("place")
        page = int(pdf["place"].iloc[0]) // PAGE_ROWS
        body = _document(title, "<ol>" + "".join(f"<li><a href='../{html.escape(d)}'>{html.escape(t)}</a></li>" for d, t in zip(pdf["dest"], pdf["label"], strict=True)) + "</ol>")
        label = f"{pdf['label'].iloc[0].split(':')[0]} to {pdf['label'].iloc[-1].split(':')[0]}"
        return pd.DataFrame({"dest": [f"links{level}/{page:08d}.html"], "content": [body.encode()], "place": [page], "label": [f"{label}"]})

    return links.withColumn("_g", F.floor(F.col("place") / PAGE_ROWS)).groupBy("_g").applyInPandas(render, "dest string, content binary, place long, label string")


def read_report(spark, path: str) -> DataFrame:
    """SRC32: a nested report again, a row a burst with its images."""
    one = "struct<time:string,path:string,name:string,time_diff:double,focus:double,area:double,has_eye:boolean,kept:boolean>"
    return spark.read.schema(f"camera string, burst_id long, total long, kept long, images array<{one}>").json(path)


def phase_ranges(phases: DataFrame, order: str, within: str | None = None, weight: str = "weight") -> DataFrame:
    """WIN11: adds ``lo`` and ``hi``, each phase's part of a hundred in its order, by weight."""
    whole = Window.partitionBy(within) if within else Window.partitionBy(F.lit(0))
    upto = F.sum(weight).over(whole.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(weight).over(whole)
    return phases.withColumns({"lo": F.lit(100.0) * (upto - F.col(weight)) / total, "hi": F.lit(100.0) * upto / total})


def stamped_name(stem: str, suffix: str = ".html"):
    """DT5: a file name with the time of now, as a column."""
    return F.concat(F.lit(f"{stem}_"), F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss"), F.lit(suffix))


def species_rows(candidates: DataFrame, images: DataFrame) -> DataFrame:
    """SNK9, SNK10: a line for each candidate, and for images without one; one pass over both."""
    known = candidates.filter("chinese_name is not null and chinese_name not in ('', '未知')")
    return images.select("image").join(known, "image", "left").select("image", "det", "rank", F.coalesce("chinese_name", F.lit("未知种类")).alias("chinese_name"), "confidence")
