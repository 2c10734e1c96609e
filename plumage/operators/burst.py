"""Bursts: gap sessions of frames, quotas, and the best frames of each.

Every function takes frames with columns ``camera`` (folder or device), ``us``
(capture time in microseconds) and ``path``, whose order (us, path) is total.
All windows partition by camera, so a chain of them needs one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import frame_score, keep_quota


def _order():
    return Window.partitionBy("camera").orderBy("us", "path")


def _session():
    return Window.partitionBy("camera", "sid")


def gaps(frames: DataFrame) -> DataFrame:
    """WIN1: ``time_diff`` to the frame before, in seconds; the first has 0."""
    return frames.withColumn("time_diff", F.coalesce((F.col("us") - F.lag("us").over(_order())) / 1e6, F.lit(0.0)))


def sessions(frames: DataFrame, threshold: float) -> DataFrame:
    """WIN2-4: ``sid``, its size ``n``, and ``burst_id`` (dense from 0, null for single frames).

    A gap of exactly the threshold joins.
    """
    new = F.when(F.col("time_diff") > threshold, 1).otherwise(0)
    df = gaps(frames).withColumn("sid", F.sum(new).over(_order().rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("n", F.count(F.lit(1)).over(_session()))
    first_of_burst = F.when((F.col("n") > 1) & (F.row_number().over(_session().orderBy("us", "path")) == 1), 1).otherwise(0)
    df = df.withColumn("_first", first_of_burst)
    upto = F.sum("_first").over(_order().rowsBetween(Window.unboundedPreceding, 0)) - 1
    return df.withColumn("burst_id", F.when(F.col("n") > 1, upto)).drop("_first")


def best_frames(bursts: DataFrame, ratio: float = 0.2, least: int = 2, min_area: float | None = None, score: Column | None = None) -> DataFrame:
    """AGG3, WIN5, FLT4: ``quota``, ``score``, ``rk`` and ``keep`` for session rows.

    Single frames are kept. With ``min_area``, frames of smaller subjects are not
    eligible: they are never kept, and only eligible frames are ranked. The quota is
    that of the whole burst.
    """
    if score is None:
        score = frame_score(F.col("focus"), F.col("area"), F.col("has_eye"))
    eligible = F.lit(True) if min_area is None else F.coalesce(F.col("area") >= min_area, F.lit(False))
    df = bursts.withColumns({"score": score, "eligible": eligible, "quota": keep_quota(F.col("n"), ratio, least)})
    rank = F.row_number().over(_session().orderBy(F.desc("eligible"), F.desc("score"), "us", "path")).cast("long")
    df = df.withColumn("rk", rank)
    return df.withColumn("keep", F.col("eligible") & ((F.col("n") == 1) | (F.col("rk") <= F.col("quota"))))


def sampled(bursts: DataFrame) -> DataFrame:
    """WIN13: ``at``, a frame's place in its session, and whether it is one of those to measure.

    In sessions of more than three frames, those at ``round(i * n / count)`` are, for a
    third of the frames (three at least); smaller ones are measured whole. The only
    ``i`` that can lead to a place are those beside its share of the count.
    """
    df = bursts.withColumn("at", (F.row_number().over(_session().orderBy("us", "path")) - 1).cast("long"))
    count = F.greatest(F.lit(3), F.floor(F.col("n") / 3)).cast("long")
    near = F.floor(F.col("at") * count / F.col("n")).cast("long")
    leads = lambda i: i.between(0, count - 1) & (F.bround(i * (F.col("n") / count)).cast("long") == F.col("at"))
    return df.withColumn("sampled", (F.col("n") <= 3) | leads(near - 1) | leads(near) | leads(near + 1))


def estimated(measured: DataFrame) -> DataFrame:
    """JN11: ``est_focus``; frames that weren't measured take 0.95 of the score of the nearest that was.

    Of two equally near ones the earlier counts. Rows come from :func:`sampled`, with ``focus``.
    """
    inside = _session().orderBy("us", "path")
    back, ahead = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(0, Window.unboundedFollowing)
    known = lambda c: F.when(F.col("sampled"), F.col(c))
    df = measured.withColumns({"_pa": F.last(known("at"), True).over(back), "_pf": F.last(known("focus"), True).over(back), "_na": F.first(known("at"), True).over(ahead), "_nf": F.first(known("focus"), True).over(ahead)})
    earlier = F.col("_na").isNull() | ((F.col("at") - F.col("_pa")) <= (F.col("_na") - F.col("at")))
    near = F.when(F.col("_pa").isNotNull() & earlier, F.col("_pf")).otherwise(F.col("_nf"))
    return df.withColumn("est_focus", F.when(F.col("sampled"), F.col("focus")).otherwise(near * 0.95)).drop("_pa", "_pf", "_na", "_nf")


def sampled_scores(bursts: DataFrame) -> DataFrame:
    """WIN13, JN11: ``at``, ``sampled`` and ``est_focus`` where every frame has a ``focus``."""
    return estimated(sampled(bursts))


def burst_summary(frames: DataFrame) -> DataFrame:
    """AGG1: one row a burst."""
    return frames.filter("burst_id is not null").groupBy("camera", "burst_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("keep").alias("kept"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.max("focus").alias("best_focus"))


def totals(frames: DataFrame) -> DataFrame:
    """AGG2: one row for the run."""
    return frames.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("discarded"),
        F.count_if((F.col("n") > 1) & (F.col("first_of_session"))).alias("bursts"), F.count_if(F.col("n") == 1).alias("singles"),
    )


def kept_frames(frames: DataFrame) -> DataFrame:
    """FLT14, SET2: kept frames of bursts, then kept single frames; ``part`` orders both."""
    kept = frames.filter("keep")
    return kept.filter("n > 1").withColumn("part", F.lit(0)).unionByName(kept.filter("n = 1").withColumn("part", F.lit(1)))


def giant_folder_sessions(frames: DataFrame, threshold: float, slices: int = 64) -> DataFrame:
    """Session starts of one camera with very many frames, without a global sort in one task.

    Frames are range-partitioned by time and written cut; sessions are found inside
    each slice, and slices are stitched through their first and last times, of which
    there are ``slices`` rows. ``sid`` counts sessions from 0 over the whole camera.
    """
    from ..sources.tables import materialised

    cut = materialised(frames.repartitionByRange(slices, "us", "path").withColumn("slice", F.spark_partition_id()))
    inside = Window.partitionBy("slice").orderBy("us", "path")
    df = cut.withColumn("_new", F.when((F.col("us") - F.lag("us").over(inside)) / 1e6 > threshold, 1).otherwise(0))
    ends = df.groupBy("slice").agg(F.min("us").alias("lo"), F.max("us").alias("hi"), F.sum("_new").alias("new"))
    chain = Window.orderBy("slice")
    ends = ends.withColumn("_gap", F.when((F.col("lo") - F.lag("hi").over(chain)) / 1e6 > threshold, 1).otherwise(0))
    ends = ends.withColumn("base", F.sum("_gap").over(chain.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("new").over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_local", local).join(F.broadcast(ends.select("slice", "base")), "slice").withColumn("sid", F.col("base") + F.col("_local")).drop("_new", "_local", "base", "slice")  # a row a slice


#: Sessions whose running counts one task adds up.
BLOCK = 65_536


def sliced_sessions(frames: DataFrame, threshold: float, slices: int = 64) -> DataFrame:
    """WIN2-4 as :func:`sessions`, where a camera may hold any part of all frames.

    Frames are range-partitioned by camera and time and written cut, so a camera with
    very many is spread over slices; sessions are found inside each and stitched
    through the ends of the slices. Numbers of sessions and bursts come from the table
    of sessions, whose numbers without gaps cut it into equal blocks. ``slices`` rows,
    and one row a block, are all that a single task sees. ``time_diff`` is left out.
    """
    from ..sources.tables import materialised

    late = lambda a, b: (a - b) / 1e6 > threshold
    cut = materialised(frames.repartitionByRange(slices, "camera", "us", "path").withColumn("_slice", F.spark_partition_id()))
    inside = Window.partitionBy("_slice").orderBy("camera", "us", "path")
    before = F.lag(F.struct("camera", "us")).over(inside)
    new = before.isNotNull() & (~before["camera"].eqNullSafe(F.col("camera")) | late(F.col("us"), before["us"]))
    df = cut.withColumn("_new", F.when(new, 1).otherwise(0))
    place = F.struct("camera", "us")
    ends = df.groupBy("_slice").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.sum("_new").alias("new"))
    chain = Window.orderBy("_slice")
    last = F.lag("hi").over(chain)
    apart = last.isNotNull() & (~last["camera"].eqNullSafe(F.col("lo.camera")) | late(F.col("lo.us"), last["us"]))
    ends = ends.withColumn("_apart", F.when(apart, 1).otherwise(0))
    base = F.sum("_apart").over(chain.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("new").over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("_local", local).join(F.broadcast(ends.select("_slice", base.alias("_base"))), "_slice")  # a row a slice
    rows = materialised(rows.withColumn("_s", (F.col("_base") + F.col("_local")).cast("long")).drop("_new", "_local", "_base", "_slice"))

    found = materialised(rows.groupBy("_s").agg(F.first("camera").alias("camera"), F.count(F.lit(1)).alias("n")))
    blocked = found.withColumns({"_b": F.call_function("div", F.col("_s"), F.lit(BLOCK)), "_many": F.when(F.col("n") > 1, 1).otherwise(0)})
    starts = blocked.groupBy("_b").agg(F.sum("_many").alias("_m")).select("_b", F.coalesce(F.sum("_m").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    so_far = F.coalesce(F.sum("_many").over(Window.partitionBy("_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = blocked.withColumn("_earlier", so_far).join(starts, "_b").withColumn("_earlier", F.col("_earlier") + F.col("_start"))
    first = counted.groupBy("camera").agg(F.min("_s").alias("_s0"), F.min("_earlier").alias("_e0"))
    numbered = counted.join(first, counted["camera"].eqNullSafe(first["camera"])).select("_s", "n", (F.col("_s") - F.col("_s0")).alias("sid"), F.when(F.col("n") > 1, F.col("_earlier") - F.col("_e0")).alias("burst_id"))
    return rows.join(numbered, "_s").drop("_s")
