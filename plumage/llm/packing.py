"""Packing into length buckets whose boundaries minimise padding.

A dynamic program over the histogram of all lengths chooses the boundaries; every
document of a bucket is padded to the bucket's boundary. Batches of one token
budget form inside each bucket: ``budget // boundary`` documents each, and one
where a document alone exceeds the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, words_of
from .sharding import numbered

BUCKETS = 16
BUDGET = 65_536
#: Lengths up to this are told apart; longer ones are rounded up to 7 leading bits.
EXACT = 4_096
LEAD_BITS = 7


def edge(length: Column) -> Column:
    """Upper end of a length's histogram bin: itself up to EXACT, else less than 1/64 above."""
    low = F.length(F.bin(length)) - LEAD_BITS
    step = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(low, F.lit(0)))
    return F.when(length <= EXACT, length).otherwise(F.ceil(length / step).cast("long") * step)


def optimal_boundaries(edges: list[int], counts: list[int], buckets: int) -> tuple[list[int], int]:
    """At most ``buckets`` boundaries out of ``edges`` with the least padded total.

    ``best[j]`` is the least total of padded tokens for the bins before ``j``; each
    layer allows one more bucket. Returns the boundaries and the padded total.
    """
    import numpy as np

    n = len(edges)
    if n == 0:
        return [], 0
    upto = np.concatenate([[0], np.cumsum(np.asarray(counts, dtype=np.float64))])
    top = np.asarray(edges, dtype=np.float64)
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    cuts = []
    for _ in range(min(buckets, n)):
        layer, cut = best.copy(), np.full(n + 1, -1)
        for j in range(1, n + 1):
            offers = best[:j] + top[j - 1] * (upto[j] - upto[:j])
            i = int(offers.argmin())
            if offers[i] < layer[j]:
                layer[j], cut[j] = offers[i], i
        cuts.append(cut)
        best = layer
    chosen, j = [], n
    for cut in reversed(cuts):
        if cut[j] >= 0:
            chosen.append(int(edges[j - 1]))
            j = int(cut[j])
        if j == 0:
            break
    return sorted(chosen), int(best[n])


def boundaries(rows: DataFrame, length: str, buckets: int = BUCKETS) -> list[int]:
    """Boundaries for all rows; the histogram has below 8,000 bins, whatever the lengths."""
    bins = rows.groupBy(edge(F.col(length)).alias("edge")).agg(F.count(F.lit(1)).alias("n")).orderBy("edge").collect()
    return optimal_boundaries([r.edge for r in bins], [r.n for r in bins], buckets)[0]


def packed(rows: DataFrame, keys: list[str], length: str, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Adds ``bucket``, ``boundary``, ``batch``, ``slot`` and ``padding`` to rows of ``keys``.

    ``keys`` are the columns to keep, ``length`` (a non-null long) among them; keys
    named like the added columns are replaced by those.
    Inside a bucket the order is a hash of the keys, so batches are a reproducible
    shuffle; every batch but a bucket's last is full. A length of 0 has boundary 0
    or the first one. Repeated rows each get a place. An empty table gives no rows.
    """
    keys = [c for c in keys if c not in ("bucket", "boundary", "batch", "slot", "padding")]
    rows = rows.select(*[F.col(f"`{c}`") for c in keys])
    ends = boundaries(rows, length, buckets)
    bucket = F.lit(0)
    for i, e in reversed(list(enumerate(ends[:-1]))):
        bucket = F.when(F.col(length) <= e, F.lit(i)).otherwise(bucket if i < len(ends) - 2 else F.lit(len(ends) - 1))
    placed = numbered(rows.withColumn("bucket", bucket), [*keys, "bucket"], within=["bucket"])
    boundary = F.element_at(F.array(*[F.lit(e).cast("long") for e in ends or [0]]), F.col("bucket") + 1)
    placed = placed.withColumn("boundary", boundary).withColumn("_per", F.greatest(F.lit(1).cast("long"), F.call_function("div", F.lit(budget).cast("long"), F.greatest("boundary", F.lit(1)))))
    return placed.select(*keys, "bucket", "boundary", F.call_function("div", F.col("row_number"), F.col("_per")).alias("batch"), F.pmod("row_number", "_per").alias("slot"), (F.col("boundary") - F.col(length)).alias("padding"))


def word_lengths(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens)``: a token is a white-space word here; null texts have none."""
    return docs.select("doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_tokens"))


def op3_length_buckets(spark, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every document, by its number of words."""
    return packed(word_lengths(documents(spark, sf_dir, "doc_id", "text")), ["doc_id", "n_tokens"], "n_tokens")
