"""Embedding near-duplicates through an inverted multi-index.

Vectors are cut in halves and each half has its own k-means codebook; the product
of both is a grid of cells. A vector visits cells in rising order of the sum of its
two distances (the multi-sequence order) until the sum exceeds that of its nearest
cell by a margin, and is compared with all members of the cells visited. The margin
is fitted: for sampled vectors, a neighbour at exactly the wanted cosine lies in a
visited cell with the target recall; closer neighbours are found more often.

Only the codebooks and the margin come from a sample. Every vector is indexed and
is a query. Cells and their visitors are cut into blocks that one task compares as
a matrix product, so a cell with very many vectors is spread over tasks, and only
counts and one edge a vector leave a block, never its pairs.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unwritten, written
from .components import connected_components

COSINE = 0.95
TARGET_RECALL = 0.995
#: Classes that codebooks and margin are fitted on: so many on average, by a hash of their ids.
SAMPLE = 8_192
#: Vectors a cell should have; the codebooks grow with the root of the table.
CELL = 1_024
MAX_CODES = 512
BLOCK = 1_024
QUERY_BLOCK = 4_096
SEED = 7


def unit_vectors(vectors: DataFrame, dims: int, column: str = "embedding") -> DataFrame:
    """``(vec_id, unit)``: vectors of length 1 as little-endian doubles, padded with zeros.

    ``unit`` is null for vectors that are null, zero or hold null or non-finite
    components; those link with nothing.
    """

    def batches(source):
        import numpy as np
        import pyarrow as pa

        for batch in source:
            out = []
            for v in batch.column(1).to_pylist():
                unit = None
                if v is not None and None not in v:
                    x = np.zeros(dims)
                    x[: len(v)] = v
                    top = np.abs(x).max(initial=0.0)
                    if np.isfinite(top) and top > 0:
                        x /= top  # very large and very small components keep a finite norm
                        unit = (x / np.linalg.norm(x)).astype("<f8").tobytes()
                out.append(unit)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "unit"])

    return vectors.select(F.col("vec_id").cast("long"), F.col(column).cast("array<double>")).mapInArrow(batches, "vec_id long, unit binary")


def kmeans(x, k: int, rounds: int = 12):
    """Codebook of at most ``k`` centroids (Lloyd), from a bounded sample."""
    import numpy as np

    rng = np.random.default_rng(SEED)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = distances(x, centres).argmin(axis=1)
        for c in range(len(centres)):
            members = x[near == c]
            if len(members):
                centres[c] = members.mean(axis=0)
    return centres


def distances(x, centres):
    """Squared distances of rows to centroids."""
    return (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)[None, :]


def multi_sequence(d1, d2, margin: float) -> list[int]:
    """Cells ``i * len(d2) + j`` in rising order of ``d1[i] + d2[j]``, up to the margin."""
    import numpy as np

    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    limit = d1[o1[0]] + d2[o2[0]] + margin
    heap, seen, out = [(d1[o1[0]] + d2[o2[0]], 0, 0)], {(0, 0)}, []
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > limit:
            break
        out.append(int(o1[i]) * len(d2) + int(o2[j]))
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(o1) and b < len(o2) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (d1[o1[a]] + d2[o2[b]], a, b))
    return out


def fit_index(sample, n: int, cosine: float = COSINE, recall: float = TARGET_RECALL):
    """Codebooks of both halves and the margin, from rows of unit vectors."""
    import numpy as np

    half = max(1, sample.shape[1] // 2)
    k = int(min(MAX_CODES, max(2, round((n / CELL) ** 0.5)), max(1, len(sample) // 4)))
    one, two = kmeans(sample[:, :half], k), kmeans(sample[:, half:], k)
    rng = np.random.default_rng(SEED + 1)
    noise = rng.standard_normal(sample.shape)
    noise -= (noise * sample).sum(axis=1)[:, None] * sample
    norm = np.linalg.norm(noise, axis=1)[:, None]
    other = cosine * sample + (1 - cosine**2) ** 0.5 * noise / np.where(norm > 0, norm, 1)
    d1, d2 = distances(sample[:, :half], one), distances(sample[:, half:], two)
    e1, e2 = distances(other[:, :half], one), distances(other[:, half:], two)
    rows = np.arange(len(sample))
    beyond = d1[rows, e1.argmin(axis=1)] + d2[rows, e2.argmin(axis=1)] - d1.min(axis=1) - d2.min(axis=1)
    back = e1[rows, d1.argmin(axis=1)] + e2[rows, d2.argmin(axis=1)] - e1.min(axis=1) - e2.min(axis=1)
    margin = float(np.quantile(np.minimum(beyond, back), recall))  # a pair is found from either side
    return one, two, margin


def visits(classes: DataFrame, one, two, margin: float) -> DataFrame:
    """``(rep, weight, unit, cell, visited)`` of every class."""
    half = one.shape[1]

    def batches(source):
        import numpy as np
        import pyarrow as pa

        for batch in source:
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype="<f8").reshape(batch.num_rows, -1)
            d1, d2 = distances(x[:, :half], one), distances(x[:, half:], two)
            found = [multi_sequence(a, b, margin) for a, b in zip(d1, d2, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["rep", "weight", "unit", "cell", "visited"])

    return classes.select("rep", "weight", "unit").mapInArrow(batches, "rep long, weight long, unit binary, cell long, visited array<long>")


def compare(queries, members, cosine: float):
    """Links between a block of queries and one of members: ``(rep, links, low)`` rows.

    A pair that both sides see is counted where the query has the smaller id.
    ``low`` is the smallest vector that the block connects the vector with.
    """
    import numpy as np
    import pandas as pd

    none = pd.DataFrame({"rep": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "low": np.zeros(0, np.int64)})
    if not len(queries) or not len(members):
        return none
    q = np.frombuffer(b"".join(queries["unit"]), dtype="<f8").reshape(len(queries), -1)
    m = np.frombuffer(b"".join(members["unit"]), dtype="<f8").reshape(len(members), -1)
    link = q @ m.T >= cosine
    qid, mid = queries["rep"].to_numpy(), members["rep"].to_numpy()
    link &= qid[:, None] != mid[None, :]
    keep_q, keep_m = link.any(axis=1), link.any(axis=0)
    if not keep_q.any():
        return none
    link, qid, mid = link[np.ix_(keep_q, keep_m)], qid[keep_q], mid[keep_m]
    cells, at = np.unique(queries["cell"].to_numpy()[keep_q], return_inverse=True)
    seen = np.array([np.isin(cells, v) for v in members["visited"].to_numpy()[keep_m]])
    link &= ~seen[:, at].T | (qid[:, None] < mid[None, :])
    counts = [link @ members["weight"].to_numpy()[keep_m], queries["weight"].to_numpy()[keep_q] @ link]
    low_q, low_m, far = qid.copy(), mid.copy(), np.iinfo(np.int64).max
    while True:
        new_m = np.minimum(low_m, np.where(link, low_q[:, None], far).min(axis=0))
        new_q = np.minimum(low_q, np.where(link, new_m[None, :], far).min(axis=1))
        if (new_m == low_m).all() and (new_q == low_q).all():
            break
        low_q, low_m = new_q, new_m
    out = pd.DataFrame({"rep": np.concatenate([qid, mid]), "links": np.concatenate(counts).astype(np.int64), "low": np.concatenate([low_q, low_m])})
    return out[out["links"] > 0]


def near_vectors(vectors: DataFrame, cosine: float = COSINE, column: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors``.

    Equal unit vectors are one class and link with each other. Vectors of different
    lengths compare as if the shorter had zeros at its end. Repeated rows are copies.
    A null vec_id takes part, but is no component's id unless alone. An empty table
    gives no rows.
    """
    import numpy as np

    dims = vectors.agg(F.max(F.size(column))).first()[0] or 1
    units = unit_vectors(vectors, max(dims, 2), column).withColumn("key", F.unhex(F.sha2("unit", 256)))
    units = written(units, "unit-vectors")
    classes = written(units.filter("unit is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("unit").alias("unit")).filter("rep is not null"), "vector-classes")
    n = classes.count()
    if n == 0:
        linked = classes.select("key", "rep", F.lit(0).cast("long").alias("links"), F.col("rep").alias("label"), "weight")
    else:
        # of n classes some SAMPLE, chosen by a hash where they are, so no task hands on more than its share
        sample = sorted(classes.filter(F.pmod(F.xxhash64("rep"), F.lit(n)) < SAMPLE).select("rep", "unit").collect())
        one, two, margin = fit_index(np.array([np.frombuffer(r.unit, dtype="<f8") for r in sample]), n, cosine)
        indexed = written(visits(classes, one, two, margin), "multi-index")
        sizes = indexed.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")).select("cell", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks"))
        asked = indexed.select("rep", "weight", "unit", "cell", F.explode("visited").alias("at"))
        visitors = asked.groupBy("at").agg(F.count(F.lit(1)).alias("_n")).select("at", F.ceil(F.col("_n") / QUERY_BLOCK).cast("int").alias("_qblocks"))
        grid = written(sizes.join(visitors, F.col("cell") == F.col("at")).select("at", "_blocks", "_qblocks"), "cell-blocks")
        spread = lambda salt, n: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")
        left = asked.join(grid, "at").select("rep", "weight", "unit", "cell", "at", spread(1, "_qblocks").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("mb"))
        right = indexed.withColumnRenamed("cell", "at").join(grid, "at").select("rep", "weight", "unit", "visited", "at", F.explode(F.sequence(F.lit(0), F.col("_qblocks") - 1)).alias("qb"), spread(2, "_blocks").alias("mb"))
        left, right = left.select([F.col(c).alias(c) for c in left.columns]), right.select([F.col(c).alias(c) for c in right.columns])  # both come from one table

        def block(queries, members):
            return compare(queries, members, cosine)

        found = left.groupBy("at", "qb", "mb").cogroup(right.groupBy("at", "qb", "mb")).applyInPandas(block, "rep long, links long, low long")
        found = written(found, "vector-links")
        counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
        labels = connected_components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")))
        linked = classes.select("key", "rep", "weight").join(counts, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        linked = linked.select("key", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "rep").alias("label"), "weight")
        unwritten(indexed)
    linked = written(linked.select("key", (F.col("links") + F.col("weight") - 1).alias("n_links"), F.col("label").alias("component_id")), "vector-classes-linked")
    out = units.select("vec_id", "key").join(linked, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_multi_index(spark, sf_dir: str) -> DataFrame:
    """Links and component of every embedding."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
