"""Bursts, budgets and rates of photos that arrive continuously."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def streaming_bursts(frames: DataFrame, threshold: str = "1 second", late: str = "10 minutes") -> DataFrame:
    """STM1: a burst is a session window with an inclusive gap: ``camera, started, ended, n``.

    ``frames(camera, ts)``. State is one open session a camera; it closes when the
    watermark passes its end. Frames later than that are dropped, a batch behind.
    """
    timed = frames.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    sessions = timed.groupBy("camera", F.session_window("ts", threshold).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("ended"))
    return sessions.select("camera", F.col("w.start").alias("started"), "ended", "n")


def batch_sessions(frames: DataFrame, threshold: str) -> DataFrame:
    """The same over a finished table: the streaming and the batch plan share their rule."""
    return frames.groupBy("camera", F.session_window(F.col("ts").cast("timestamp"), threshold).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("camera", F.unix_micros("w.start").alias("started_us"), "n")


def daily_budget(usage: DataFrame, late: str = "1 hour") -> DataFrame:
    """STM5: tokens by calendar day and model, over a daily tumbling window."""
    timed = usage.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.filter("total_tokens > 0").groupBy(F.window("ts", "1 day").alias("w"), "model").agg(F.sum("total_tokens").alias("tokens")).select(F.to_date("w.start").alias("day"), "model", "tokens")


def moving_rate(ticks: DataFrame, alpha: float = 0.35) -> DataFrame:
    """STM4, WIN12: the moving average of seconds an item, by job, as ticks arrive.

    ``ticks(job, done, seconds)``: items done and seconds passed since the job began.
    State is one number a job; a batch's ticks are taken in the order of ``done``.
    """

    def update(key: tuple, parts: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        rate = state.get[0] if state.exists else None
        done = 0
        for pdf in parts:
            pdf = pdf[pdf["done"] > 0].sort_values("done")
            for d, s in zip(pdf["done"], pdf["seconds"], strict=True):
                rate = s / d if rate is None else (1 - alpha) * rate + alpha * (s / d)
                done = max(done, int(d))
        if rate is not None:
            state.update((rate,))
            yield pd.DataFrame({"job": [key[0]], "done": [done], "rate": [rate]})

    return ticks.groupBy("job").applyInPandasWithState(update, "job string, done long, rate double", "rate double", "update", GroupStateTimeout.NoTimeout)


def ema(ticks: DataFrame, alpha: float = 0.35) -> DataFrame:
    """WIN12 over a finished table ``(job, ord, value)``: the last average of each job.

    The average is a sum with weights that fall by the distance from the end, so it
    needs ranks and one aggregate, not an ordered fold.
    """
    from pyspark.sql import Window

    back = F.row_number().over(Window.partitionBy("job").orderBy(F.desc("ord"))) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy("job"))
    df = ticks.withColumns({"_back": back, "_n": n})
    weight = F.when(F.col("_back") == F.col("_n") - 1, F.lit(1.0)).otherwise(F.lit(alpha)) * F.pow(F.lit(1 - alpha), F.col("_back"))
    return df.groupBy("job").agg(F.sum(F.col("value") * weight).alias("ema"), F.count(F.lit(1)).alias("n"))
