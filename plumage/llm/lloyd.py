"""Clustering of integer vectors by Lloyd's rounds that touch only what has changed.

Vectors and their assignments are one written table, and the componentwise sums of
each cluster are kept from round to round. A round compares a vector with the
centroids that changed since; only a vector whose owner moved is compared with all.
(Its owner was the nearest of all centroids, so where the owner stands still, the
unchanged others are still no nearer.) The sums then take over signed transfers: a
vector that went from one cluster to another is subtracted there and added here.
Everything is integer arithmetic, so no order of additions can change a result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unwritten, written

DIMS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
#: Components lie within +-LIMIT, so that a squared distance of 64 of them fits a long.
LIMIT = 1 << 27

Centroids = list[tuple[int, ...]]


def whole_vectors(vectors: DataFrame, column: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``(vec_id, v)``: ``floor(scale * x)`` of the rows with ``dims`` finite components.

    Components beyond ``LIMIT`` count as ``LIMIT``.
    """
    x = F.col(column).cast("array<double>")
    finite = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = vectors.filter((F.size(column) == dims) & finite)
    held = lambda c: F.least(F.greatest(F.floor(c * scale), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int")
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, held).alias("v"))


def start_order(vec_id: Column) -> Column:
    """Starting centroids are the vectors that come first in this order."""
    return F.sha2(F.concat(F.lit("1:"), vec_id.cast("string")), 256)


def starts(vectors: DataFrame, clusters: int = CLUSTERS) -> Centroids:
    """The first ``clusters`` vectors by :func:`start_order`; null vec_ids are none."""
    first = vectors.filter("vec_id is not null").select(start_order(F.col("vec_id")).alias("h"), "v").orderBy("h", "v").limit(clusters)
    return [tuple(r.v) for r in first.collect()]


def assigned(rows: DataFrame, centroids: Centroids, changed: set[int]) -> DataFrame:
    """``(vec_id, v, was, cluster, distance)`` from rows with ``cluster`` and ``distance``.

    ``was`` is the former cluster, -1 before the first round. Vectors whose cluster
    is in ``changed`` (or -1) meet all centroids, others the changed ones.
    """
    import numpy as np

    centres = np.array(centroids, dtype=np.int64)
    moved = np.zeros(len(centroids) + 1, dtype=bool)
    moved[[*changed, -1]] = True  # cluster -1 finds the last place
    some = np.array(sorted(changed), dtype=np.int64)

    def squared(v, c):
        out = np.empty((len(v), len(c)), dtype=np.int64)
        for i, centre in enumerate(c):
            d = v - centre
            out[:, i] = np.einsum("ij,ij->i", d, d)
        return out

    def batches(source):
        import pyarrow as pa

        for batch in source:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
            was, far = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().copy()
            own, whole = was.copy(), moved[was]
            if whole.any():
                d = squared(v[whole], centres)
                own[whole] = d.argmin(axis=1)  # the first, so the smaller number, of equal ones
                far[whole] = d.min(axis=1)
            if len(some) and not whole.all():
                rest = ~whole
                d = squared(v[rest], centres[some])
                near, least = some[d.argmin(axis=1)], d.min(axis=1)
                nearer = (least < far[rest]) | ((least == far[rest]) & (near < own[rest]))
                own[rest], far[rest] = np.where(nearer, near, own[rest]), np.where(nearer, least, far[rest])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(own.astype(np.int32)), pa.array(far)], ["vec_id", "v", "was", "cluster", "distance"])

    return rows.select("vec_id", "v", "cluster", "distance").mapInArrow(batches, "vec_id long, v array<int>, was int, cluster int, distance long")


def transfers(rows: DataFrame, dims: int) -> dict[int, tuple[int, list[int]]]:
    """Signed count and componentwise sums that each cluster gains, from vectors that moved.

    One row a cluster is combined in every task and comes to the driver, however many move.
    """
    gone = F.struct(F.col("was").alias("cluster"), F.lit(-1).cast("long").alias("sign"))
    come = F.struct("cluster", F.lit(1).cast("long").alias("sign"))
    signed = rows.filter("cluster != was").select("v", F.explode(F.array(gone, come)).alias("_t")).filter("_t.cluster >= 0").select("_t.cluster", "_t.sign", "v")
    sums = [F.sum(F.col("sign") * F.col("v")[i]).alias(f"s{i}") for i in range(dims)]
    return {r[0]: (r[1], list(r[2:])) for r in signed.groupBy("cluster").agg(F.sum("sign"), *sums).collect()}


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, column: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every kept vector.

    Rows whose vector is null, has another length or a component that is null or not
    finite are left out. Repeated rows are vectors of their own; a null vec_id takes
    part but starts no cluster. Fewer vectors than ``clusters`` make fewer centroids;
    empty clusters keep theirs. Other columns are not read. No vectors (or none with a
    vec_id) give no rows. Distances and inertia are exact integers.
    """
    spark = vectors.sparkSession
    rows = written(whole_vectors(vectors, column, dims, scale), "lloyd-vectors")
    centroids = starts(rows, clusters)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    source, sums, changed = rows, {k: (0, [0] * dims) for k in range(len(centroids))}, set(range(len(centroids)))
    rows = rows.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    for turn in range(rounds + 1):
        rows = written(assigned(rows, centroids, changed), "lloyd-assigned")
        unwritten(source)
        source = rows
        if turn == rounds:
            break
        for k, (n, gain) in transfers(rows, dims).items():
            sums[k] = (sums[k][0] + n, [a + b for a, b in zip(sums[k][1], gain, strict=True)])
        moved = [tuple(s // n for s in total) if n else centroids[k] for k, (n, total) in sums.items()]
        changed = {k for k, c in enumerate(moved) if c != centroids[k]}
        centroids = moved
        if not changed:
            break
    digests = spark.createDataFrame([(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    spread = {r[0]: r[1] for r in rows.groupBy("cluster").agg(F.sum("distance")).collect()}
    inertia = spark.createDataFrame([(k, n, sum(spread.values())) for k, n in spread.items()], "cluster int, cluster_inertia long, inertia long")
    facts = F.broadcast(digests.join(inertia, "cluster"))  # one row a cluster
    return rows.join(facts, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_delta_lloyd(spark, sf_dir: str) -> DataFrame:
    """Cluster and squared distance of every embedding after three rounds from 16 starts."""
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _op13_sql() -> str:
    """Each round is two tables: the vectors' clusters, and the centroids that follow."""
    parts = [
        "kept AS (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings"
        " WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64)",
        "c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS INTEGER) AS c, v AS m FROM kept WHERE vec_id IS NOT NULL"
        " QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), v) <= 16)",
    ]
    for i in range(ROUNDS + 1):
        parts.append(
            f"a{i} AS (SELECT r, vec_id, v, c, d FROM (SELECT r, vec_id, v, c, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v, m)]) AS d FROM kept, c{i})"
            " QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"
        )
        if i < ROUNDS:
            parts.append(
                f"s{i} AS (SELECT c, k, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS k FROM a{i}) GROUP BY c, k),"
                f" f{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS m FROM s{i} GROUP BY c),"
                f" c{i + 1} AS (SELECT c{i}.c, coalesce(f{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN f{i} ON c{i}.c = f{i}.c)"
            )
    last = f"a{ROUNDS}"
    return (
        "WITH " + ", ".join(parts) + f" SELECT vec_id, {last}.c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY {last}.c) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM {last} JOIN c{ROUNDS} ON {last}.c = c{ROUNDS}.c"
    )


OP13_SQL = _op13_sql()
