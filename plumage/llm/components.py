"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unwritten, written


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges(a, b)``; label: the smallest reachable node.

    Each round gives every node the smallest label among its own, its neighbours'
    and, for the roots, those that reach their members (so that whole trees move
    at once), then follows each label one step. The number of rounds grows with the
    logarithm of a component's diameter. Only minima are gathered by node, and
    those are combined before the shuffle: a node with very many edges is no hot
    key, and on the join side AQE can split it. Self-loops give a component of one.
    No edges give no rows.
    """
    edges = edges.select("a", "b")
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a is not null and b is not null").distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    before = _signature(labels)
    while before[0]:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("low"))
        heard = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "low").alias("low"))
        offers = heard.select("node", "low").unionByName(heard.filter("low < label").select(F.col("label").alias("node"), "low"))
        hooked = written(offers.groupBy("node").agg(F.min("low").alias("label")), "hooked")
        up = hooked.select(F.col("node").alias("_n"), F.col("label").alias("_up"))
        jumped = written(hooked.join(up, F.col("label") == F.col("_n"), "left").select("node", F.least("label", F.coalesce("_up", "label")).alias("label")), "labels")
        unwritten(hooked)
        unwritten(labels)
        labels, after = jumped, _signature(jumped)
        if after == before:
            break
        before = after
    unwritten(both)
    return labels


def _signature(labels: DataFrame) -> tuple:
    """Labels only fall, so an unchanged exact sum means that none has changed."""
    return tuple(labels.agg(F.count(F.lit(1)), F.sum(F.col("label").cast("decimal(20,0)"))).first())
