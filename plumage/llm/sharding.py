"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get a global number from a fixed total order (a 64-bit hash of the row's
key, then the key itself). A keyed bijection of ``[0, n)`` moves number ``r`` to
``p``; the shard is ``p mod shards`` and the slot ``p div shards``, so shard sizes
differ by one row at most, slots have no gaps, and anybody who knows ``n`` and the
seed can compute the place of row ``r`` without looking at the data.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, utf8_bytes

ROUNDS = 6
SEED = 20_240_501
#: The hash's leading 12 bits cut the order into blocks that are numbered apart.
BLOCK_BITS = 12
#: A row that repeats more often than this is unrolled by several tasks.
UNROLL = 100_000
#: Steps of cycle walking that are unrolled; see :func:`feistel_column`.
WALK = 64


def domain(n: int) -> tuple[int, int]:
    """Sides ``a, b`` of the smallest near-square grid of at least ``n`` cells."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def feistel_index(r: int, n: int, seed: int = SEED, rounds: int = ROUNDS) -> int:
    """Place of row ``r`` among ``n``; the same values as :func:`feistel_column`."""
    import xxhash

    a, b = domain(n)

    def mixed(value: int, i: int) -> int:
        h = xxhash.xxh64_intdigest(struct.pack("<q", value), seed=42)
        h = xxhash.xxh64_intdigest(struct.pack("<q", seed + i), seed=h)
        return h - (1 << 64) if h >= 1 << 63 else h

    while True:
        left, right = divmod(r, b)
        for i in range(rounds):
            if i % 2 == 0:
                left = (left + mixed(right, i) % a) % a
            else:
                right = (right + mixed(left, i) % b) % b
        r = left * b + right
        if r < n:
            return r


def feistel_column(r: Column, n: int, seed: int = SEED, rounds: int = ROUNDS) -> Column:
    """``r`` (long, in ``[0, n)``) moved by the permutation.

    The grid of ``a * b`` cells has fewer than ``a`` cells beyond ``n`` (about one
    in ``sqrt(n)``), so a second pass is rare and a cycle outside ``[0, n)`` has
    fewer than ``a`` steps. ``WALK`` passes therefore always suffice up to
    ``a = 64``; beyond, a row would need all of them with a chance below
    ``64 ** -64``, and would raise an error rather than get a wrong place.
    """
    a, b = domain(n)

    def once(x: Column) -> Column:
        right = F.pmod(x, F.lit(b))
        left = F.call_function("div", x - right, F.lit(b))
        for i in range(rounds):
            if i % 2 == 0:
                left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(seed + i).cast("long")), F.lit(a)), F.lit(a))
            else:
                right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(seed + i).cast("long")), F.lit(b)), F.lit(b))
        return left * F.lit(b) + right

    first = once(r)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(first < n, first).otherwise(F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walking did not end"))))


def numbered(rows: DataFrame, keys: list[str], within: list[str] | None = None) -> DataFrame:
    """Add ``row_number`` (long, gapless from 0) in a total order of the rows.

    ``within`` names some of the keys: each of their values is numbered by itself.
    They may have a few dozen values at most, as the table of block starts, which
    is broadcast, has up to 4,096 rows for each.

    The order is by a hash of all ``keys``, then by the keys; it depends on the
    rows alone, not on partitions or cluster size. Nothing is sorted as a whole:
    the hash's leading bits make 4,096 blocks, each numbered by itself and moved
    by the count of the blocks before it. Equal rows are counted before the
    shuffle and unrolled afterwards, so rows that repeat cannot fill one task.
    The keys must be all columns of ``rows``.
    """
    own = {c: f"_k{i}" for i, c in enumerate(keys)}  # inner names can't clash with those of the rows
    names, within = list(own.values()), [own[c] for c in within or []]
    hashed = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()]).withColumn("_h", F.xxhash64(*names)).withColumn("_block", F.shiftrightunsigned("_h", 64 - BLOCK_BITS))
    distinct = hashed.groupBy("_block", "_h", *names).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*within).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = distinct.groupBy(*within, "_block").agg(F.sum("_n").alias("_rows")).select(*within, "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    in_block = Window.partitionBy(*within, "_block").orderBy("_h", *names).rowsBetween(Window.unboundedPreceding, -1)
    placed = distinct.withColumn("_at", F.coalesce(F.sum("_n").over(in_block), F.lit(0))).join(F.broadcast(starts), [*within, "_block"])  # 2 ** BLOCK_BITS rows at most, for each value of within
    placed = placed.withColumn("_at", F.col("_at") + F.col("_start"))
    unrolled = placed.select(*names, "_at", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("_n"), F.lit(UNROLL)) - 1)).alias("_i"))
    pieces = placed.filter(F.col("_n") > UNROLL).select(*names, "_at", "_n", F.explode(F.sequence(F.lit(1).cast("long"), F.floor((F.col("_n") - 1) / UNROLL))).alias("_piece")).repartition("_piece", "_at")
    rest = pieces.select(*names, "_at", F.explode(F.sequence(F.col("_piece") * UNROLL, F.least(F.col("_n"), (F.col("_piece") + 1) * UNROLL) - 1)).alias("_i"))
    return unrolled.unionByName(rest).select(*[F.col(n).alias(c) for c, n in own.items()], (F.col("_at") + F.col("_i")).alias("row_number"))


def shard(rows: DataFrame, keys: list[str], shards: int = 8, seed: int = SEED, total: int | None = None) -> DataFrame:
    """Put rows into ``shards`` shards: adds ``row_number``, ``shard`` and ``slot``.

    ``keys`` are the columns that make the order; other columns are left out, and
    keys named like the added columns are replaced by those. Null keys are ordinary values. Equal rows
    are interchangeable and get the places of their numbers. An empty table gives
    no rows. Shards differ by one row at most.
    """
    n = rows.count() if total is None else total
    added = ("row_number", "shard", "slot")
    moved = numbered(rows.withColumnsRenamed({c: f"{c} (given)" for c in keys if c in added}), [f"{c} (given)" if c in added else c for c in keys])
    moved = moved.withColumn("_p", feistel_column(F.col("row_number"), n, seed))
    return moved.select(*[F.col(f"`{c}`") for c in keys if c not in added], "row_number", F.pmod("_p", F.lit(shards)).cast("int").alias("shard"), F.expr(f"_p div {shards}").alias("slot"))


def op9_feistel_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 8 shards whose row counts differ by one at most (law ``rows``).

    Null texts have size 1 and the CRC of no bytes.
    """
    keyed = documents(spark, sf_dir, "doc_id", "text").select("doc_id", (utf8_bytes(F.col("text")) + 1).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    total = documents(spark, sf_dir).count()
    out = shard(keyed, ["doc_id", "size", "text_crc32"], 8, total=total)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
