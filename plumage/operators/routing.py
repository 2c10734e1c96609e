"""Budgets of remote models, model choice, and routing between two classifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import distinct_names

DAILY_LIMIT = 2_000_000
SWITCH_RATIO = 0.75


def daily_usage(events: DataFrame) -> DataFrame:
    """AGG8: tokens by day and model; the total, else prompt and completion; positive ones only."""
    tokens = F.coalesce("total_tokens", F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0)))
    return events.withColumn("_t", tokens).filter("_t > 0").groupBy(F.to_date("ts").alias("day"), "model").agg(F.sum("_t").alias("tokens"))


def candidate_models(text: Column) -> Column:
    """AGG15: distinct model names of a list in text form."""
    return distinct_names(text)


def picked_models(usage: DataFrame, models: list[str], limit: int = DAILY_LIMIT, ratio: float = SWITCH_RATIO, default: str = "") -> DataFrame:
    """AGG9: for each day, the first model below the threshold, else the least used.

    Models without usage count as 0. Without models, the default. The list is an
    array literal, so days need no join with it.
    """
    names = list(dict.fromkeys(m.strip() for m in models if m.strip()))
    days = usage.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("model", "tokens"))).alias("used"))  # as many entries as models
    if not names:
        return days.select("day", F.lit(default).alias("model"))
    threshold = int(limit * min(0.99, max(0.1, ratio)))
    rows = F.array(*[F.struct(F.coalesce(F.try_element_at("used", F.lit(m)), F.lit(0)).alias("u"), F.lit(i).alias("ord"), F.lit(m).alias("model")) for i, m in enumerate(names)])
    df = days.withColumn("_m", rows)
    below = F.get(F.filter("_m", lambda m: m["u"] < threshold), F.lit(0))
    return df.select("day", F.coalesce(below["model"], F.array_min("_m")["model"]).alias("model"))


def unblocked(models: Column, blocked: Column) -> Column:
    """SET4: models less the blocked ones; all of them if none is left."""
    left = F.array_except(models, blocked)
    return F.when(F.size(left) == 0, F.array_distinct(models)).otherwise(left)


def routed(items: DataFrame, key: str, primary: Callable[[DataFrame], DataFrame], secondary: Callable[[DataFrame], DataFrame] | None, names: tuple[str, str]) -> DataFrame:
    """Two-pass routing: items without rows from the first classifier go to the second.

    Both take items and return candidate rows with ``key``. The second sees only the
    items that the first left, by an anti-join; ``method`` says who answered.
    """
    first = primary(items).withColumn("method", F.lit(names[0]))
    if secondary is None:
        return first
    rest = items.join(first.select(key).distinct(), key, "left_anti")
    return first.unionByName(secondary(rest).withColumn("method", F.lit(names[1])), allowMissingColumns=True)


#: How an answer's way is told: the remote service, the local model, and what went before.
REMOTE, LOCAL = "豆包", "本地模型"
ATTEMPT = "status string, model string, candidates array<struct<rank:int,name:string,confidence:double>>"

Attempt = Callable[[DataFrame], DataFrame]


def hybrid(items: DataFrame, key: str, local: Attempt | None, remote: Attempt | None, use_local: bool | Column = True, fallback: bool = True, remote_name: str = REMOTE, local_name: str = LOCAL) -> DataFrame:
    """2.13: each item's candidates, the way that gave them, and what every way tried came to.

    ``local`` and ``remote`` take items and return ``key`` and the columns of ``ATTEMPT``,
    one row an item: ``status`` is ``ok``, ``empty`` or ``raised``, and an item without a row
    counts as ``raised``. ``use_local`` may be a condition on the items (UDF4). Adds
    ``candidates`` (an empty array if there are none), ``method``, ``remote_status`` and
    ``local_status`` (null where not asked).

    Preferred local: its answer stands even if it is empty; where it raises or there is
    none, the remote is asked if ``fallback``. Preferred remote: an answer that isn't
    empty stands; else the local model answers, unless the remote raised and
    ``fallback`` is off. Keys are unique. Each way is asked once and its answers are
    written, so that no request is paid for twice.
    """
    from ..sources.tables import materialised

    asked = lambda way, rows, prefix: materialised(rows.select(key).join(_one_each(way(rows), key), key, "left").select(key, F.coalesce("status", F.lit("raised")).alias(f"{prefix}_status"), F.col("model").alias(f"{prefix}_model"), F.col("candidates").alias(f"{prefix}_candidates")))
    absent = lambda rows, prefix: rows.select(key, F.lit(None).cast("string").alias(f"{prefix}_status"), F.lit(None).cast("string").alias(f"{prefix}_model"), F.lit(None).cast("array<struct<rank:int,name:string,confidence:double>>").alias(f"{prefix}_candidates")).limit(0)

    prefer_local = use_local if isinstance(use_local, Column) else F.lit(use_local)
    df = items.withColumn("_local_first", F.coalesce(prefer_local, F.lit(False)))
    here, there = df.filter("_local_first"), df.filter("not _local_first")

    first_remote = asked(remote, there, "remote") if remote else absent(there, "remote")
    unanswered = F.col("remote_status").isNull() | (F.col("remote_status") == "empty") | ((F.col("remote_status") == "raised") & F.lit(fallback))
    to_local = here.unionByName(there.join(first_remote.select(key, "remote_status"), key, "left").filter(unanswered).drop("remote_status"))
    by_local = asked(local, to_local, "local") if local else absent(df, "local")
    failed_here = here.join(by_local.select(key, "local_status"), key, "left").filter(F.col("local_status").isNull() | (F.col("local_status") == "raised")).drop("local_status")
    second_remote = asked(remote, failed_here, "remote") if remote and fallback else absent(here, "remote")

    out = df.join(first_remote.unionByName(second_remote), key, "left").join(by_local, key, "left")
    served = F.concat(F.lit(f"{remote_name}API"), F.when(F.coalesce("remote_model", F.lit("")) != "", F.concat(F.lit("("), "remote_model", F.lit(")"))).otherwise(""))
    gave = lambda c: F.coalesce(F.col(c).isin("ok", "empty"), F.lit(False))
    remote_first = (
        F.when(F.col("remote_status") == "ok", served)
        .when((F.col("remote_status") == "raised") & F.lit(not fallback), F.lit(f"{remote_name}API(失败)"))
        .when(gave("local_status"), F.lit(f"{local_name}({remote_name}无可用结果，已回退)"))
        .when(F.col("remote_status") == "empty", served)
        .otherwise("unknown")
    )
    local_first = F.when(gave("local_status"), F.lit(local_name)).when(gave("remote_status"), F.concat(served, F.lit("(回退)"))).otherwise("unknown")
    none = F.array().cast("array<struct<rank:int,name:string,confidence:double>>")
    by_preference = F.when(gave("local_status"), F.col("local_candidates")).when(gave("remote_status"), F.col("remote_candidates"))
    chosen = F.when(F.col("_local_first"), by_preference).when(F.col("remote_status") == "ok", F.col("remote_candidates")).when(gave("local_status"), F.col("local_candidates"))
    method = F.when(F.col("_local_first"), local_first).otherwise(remote_first)
    return out.withColumns({"candidates": F.coalesce(chosen, none), "method": method}).drop("_local_first", "remote_model", "local_model", "remote_candidates", "local_candidates")


def _one_each(rows: DataFrame, key: str) -> DataFrame:
    """One attempt an item: answers before empty ones before faults."""
    order = F.struct(F.when(F.col("status") == "ok", 0).when(F.col("status") == "empty", 1).otherwise(2).alias("o"), F.coalesce("model", F.lit("")).alias("m"))
    return rows.groupBy(key).agg(F.min_by(F.struct("status", "model", "candidates"), order).alias("_a")).select(key, "_a.*")


def answered(answers: DataFrame, parsed: DataFrame, key: str = "image") -> DataFrame:
    """Rows of ``sources.remote.ask_models`` as attempts: no answer is ``empty``, like one without candidates.

    The request loop doesn't raise: what is left after its tries is an answer of nothing.
    ``parsed(key, candidates)`` are the candidates read from the answers.
    """
    df = answers.select(F.col("image").alias(key), "model").join(parsed.select(key, "candidates"), key, "left")
    return df.select(key, F.when(F.size("candidates") > 0, "ok").otherwise("empty").alias("status"), "model", "candidates")
