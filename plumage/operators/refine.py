"""Species candidates refined by region.

Candidates have columns ``image``, ``det`` (detection), ``rank`` (1 is the best, in
model order), ``idx`` (species, null if unknown) and ``confidence``, and the region
of their image in ``province`` (null if unknown). Whitelists are tables of distinct
``(region, idx)`` and of ``idx``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEAD = 10
OUTSIDE_CONFIDENCE = 0.75
BONUS = 0.005


def _det():
    return Window.partitionBy("image", "det")


def whitelist_flags(candidates: DataFrame, regional: DataFrame, national: DataFrame) -> DataFrame:
    """JN3: ``listed``, whether the effective list has the candidate, and ``in_national``.

    The list is the region's, or the national one where the region has none. Lists
    are joined by equality, so they can grow beyond what a broadcast takes.
    """
    regions = regional.select(F.col("region").alias("_known")).distinct()
    hits = regional.select(F.col("region").alias("_r"), F.col("idx").alias("_ri")).distinct()
    df = candidates.join(regions, F.col("province") == F.col("_known"), "left")
    df = df.join(hits, (F.col("province") == F.col("_r")) & (F.col("idx") == F.col("_ri")), "left")
    df = df.join(national.select(F.col("idx").alias("_ni")).distinct(), F.col("idx") == F.col("_ni"), "left")
    listed = F.when(F.col("_known").isNotNull(), F.col("_r").isNotNull()).otherwise(F.col("_ni").isNotNull())
    return df.withColumns({"listed": listed, "in_national": F.col("_ni").isNotNull(), "has_region": F.col("_known").isNotNull()}).drop("_known", "_r", "_ri", "_ni")


def admitted(flagged: DataFrame, outside: float = OUTSIDE_CONFIDENCE) -> DataFrame:
    """FLT8, FLT9: listed candidates, or very sure ones where no candidate is listed."""
    passed = flagged.filter(F.col("listed") | (F.col("confidence") > outside))
    return passed.withColumn("_any", F.max("listed").over(_det())).filter(F.col("listed") | ~F.col("_any")).drop("_any")


def reranked(passed: DataFrame, bonus: float = BONUS) -> DataFrame:
    """WIN10: ``new_rank`` by confidence, with a small bonus for nationally listed species."""
    value = F.col("confidence") + F.when(F.col("in_national"), bonus).otherwise(0.0)
    return passed.withColumn("new_rank", F.row_number().over(_det().orderBy(F.desc(value), "rank")).cast("long"))


def refined(candidates: DataFrame, regional: DataFrame, national: DataFrame, mode: str = "china", threshold: float | None = None) -> DataFrame:
    """The whole refinement: head, threshold, region rules, ranking. Adds ``new_rank``.

    ``mode``: ``none`` applies no region rule, ``china`` and ``province`` the national
    list where a region has none, ``auto`` is ``province`` where the region is known
    and ``china`` elsewhere. The regional list applies in any mode but ``none``.
    """
    if mode not in ("china", "province", "auto", "none"):
        raise ValueError(f"unknown mode {mode!r}")
    head = candidates.filter(F.col("rank") <= HEAD)
    if threshold is not None:
        head = head.filter(F.coalesce("confidence", F.lit(0.0)) >= threshold)
    if mode == "none":
        return head.withColumn("new_rank", F.row_number().over(_det().orderBy("rank")).cast("long"))
    return reranked(admitted(whitelist_flags(head, regional, national)))


def promoted(candidates: DataFrame, regional: DataFrame, max_rank: int = 5, gap: float = 0.35) -> DataFrame:
    """WIN9: the best regional candidate first, if the first isn't regional and the gap is small."""
    hits = regional.select(F.col("region").alias("_r"), F.col("idx").alias("_i")).distinct()
    df = candidates.join(hits, (F.col("province") == F.col("_r")) & (F.col("idx") == F.col("_i")), "left").withColumn("_in", F.col("_r").isNotNull())
    by_rank = _det().orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumns({"_top": F.first("confidence").over(by_rank), "_top_in": F.first("_in").over(by_rank)})
    fits = F.col("_in") & ~F.col("_top_in") & (F.col("rank") <= max_rank) & (F.col("confidence") + gap >= F.col("_top"))
    df = df.withColumn("_best", F.min(F.when(fits, F.struct(-F.col("confidence"), F.col("rank")))).over(_det())["rank"])
    return df.withColumn("new_rank", F.row_number().over(_det().orderBy(F.when(F.col("rank") == F.col("_best"), 0).otherwise(1), "rank")).cast("long")).drop("_r", "_i", "_in", "_top", "_top_in", "_best")


def accepted(counts: DataFrame, floor: float | None) -> DataFrame:
    """FLT10: per detection, the first candidate or the reason why there is none.

    ``counts`` has a row a detection: ``raw_count``, ``post_count``, ``top_confidence``
    (after refinement) and ``is_bird`` (false for other subjects of a remote answer,
    which the floor spares). Where it also has ``kept_count``, detections that a later
    step left without candidates have a reason of their own.
    """
    low = F.lit(False) if floor is None else F.coalesce(F.col("top_confidence") < floor, F.lit(False)) & F.col("is_bird")
    none_left = "all_candidates_removed_by_geo_rules" if floor is None else "all_candidates_filtered_below_unknown_kind_threshold"
    reason = F.when(F.col("raw_count") == 0, "no_model_candidates").when(F.col("post_count") == 0, none_left).when(low, "top1_conf_below_min_accept")
    if "kept_count" in counts.columns:
        reason = reason.when(F.col("kept_count") == 0, "all_candidates_filtered_after_geo_refine")
    return counts.withColumn("unknown_reason", reason).withColumn("accepted", reason.isNull())


def softmax_top(vectors: DataFrame, k: int, column: str = "logits") -> DataFrame:
    """SRT3: the ``k`` likeliest classes of each vector: ``rank``, ``idx``, ``p`` (all native)."""
    x = F.col(column)
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v.cast("double") - top.cast("double")))
    total = F.aggregate("_e", F.lit(0.0), lambda a, b: a + b)
    pairs = F.transform("_e", lambda v, i: F.struct((-v).alias("m"), i.alias("idx")))
    df = vectors.withColumn("_e", e).withColumn("_total", total).withColumn("_top", F.slice(F.array_sort(pairs), 1, k))
    return df.select("*", F.posexplode("_top").alias("_pos", "_x")).withColumns({"rank": (F.col("_pos") + 1).cast("long"), "idx": F.col("_x.idx"), "p": -F.col("_x.m") / F.col("_total")}).drop("_e", "_total", "_top", "_pos", "_x")
