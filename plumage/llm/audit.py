"""Audit of how filters interact: what each removes in every order of application.

A document's failures are one bit mask, so a table of any size becomes counts by
``(part, mask, good, toxic)`` before anything is enumerated: at most 128 cells a
part. What a mask meets in each order doesn't depend on the data. It is a table of
its own: masks unpivoted against the steps of each order, with a running bit-or
over the steps before for the filters that the mask failed earlier. Cells joined
to it by their mask give every metric as a conditional sum, and a window over all
rows of one filter adds up its removals in all orders.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound, documents, unwritten, words_of, written

#: The filters, by letter; the n-th has bit ``2 ** n``.
FILTERS = "ABCDE"
MIN_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 2
SYMBOLS = r"[#$%&*|]"


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails; null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    counts = bound(words_of(text), lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct")))
    capitals = F.octet_length(F.regexp_replace(whole, "[^A-Z]+", ""))

    def mask(c: Column) -> Column:
        failed = [c["words"] < MIN_WORDS, 100 * c["distinct"] < DISTINCT_PERCENT * c["words"], 100 * capitals.cast("long") > CAPITAL_PERCENT * F.length(whole), whole.rlike(SYMBOLS)]
        return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))

    return bound(counts, mask)


def failures(docs: DataFrame) -> DataFrame:
    """``(doc_id, part, mask)`` of every row of ``docs``, all five filters in the mask.

    Filter E compares digests of whole texts: the smallest doc_id of each text
    passes, rows that share it included, and all others fail. A null doc_id is
    neither smaller nor larger than another, so it passes and makes none fail.
    Firsts are minima, combined before the shuffle, and rows find theirs by text and
    doc_id together, so neither a text nor a source that most rows have is a hot key.
    """
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), text_mask(F.col("text")).alias("mask"))
    rows = written(rows, "audit-rows")
    firsts = rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    later = F.col("doc_id").isNotNull() & F.col("_first").isNull()
    found = rows.join(firsts, ["doc_id", "digest"], "left").select("doc_id", "part", (F.col("mask") + F.when(later, 16).otherwise(0)).alias("mask"))
    found.written_path = rows.written_path
    return found


def cells(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts ``n`` by ``(part, mask, good, toxic)``.

    A document is good (toxic) if a row of ``labels`` with its doc_id has quality
    (toxic) 1; documents without labels and null doc_ids are neither.
    """
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return failed.join(known, "doc_id", "left").select("part", "mask", flag("good"), flag("toxic")).groupBy("part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))


def steps(spark, filters: str = FILTERS) -> DataFrame:
    """``(mask, filter_order, step, filter, fails, before)`` of every mask, order and step.

    ``before`` holds the bits that the mask fails at earlier steps: a running bit-or.
    With five filters these are 32 * 120 * 5 rows, whatever the data.
    """
    orders = spark.createDataFrame([("".join(o),) for o in itertools.permutations(filters)], "filter_order string")
    unpivoted = orders.select(F.explode(F.sequence(F.lit(0), F.lit(2 ** len(filters) - 1))).alias("mask"), "filter_order", F.posexplode(F.split("filter_order", "")).alias("at", "filter")).filter("filter != ''")
    bit = F.call_function("shiftleft", F.lit(1), F.instr(F.lit(filters), F.col("filter")) - 1)
    failing = unpivoted.select("mask", "filter_order", (F.col("at") + 1).cast("int").alias("step"), "filter", bit.alias("bit"), F.col("mask").bitwiseAND(bit).alias("fails"))
    earlier = Window.partitionBy("mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    return failing.withColumn("before", F.coalesce(F.bit_or("fails").over(earlier), F.lit(0)))


def interactions(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Metrics of every part, order and step, zeros included, from :func:`cells`.

    Each cell meets the steps of its mask by an equality join; the steps are
    broadcast, their number being fixed by the number of filters (19,200 rows of five).
    """
    n, here = F.col("n"), (F.col("fails") != 0) & (F.col("before") == 0)
    total = lambda condition: F.sum(F.when(condition, n).otherwise(0)).cast("long")
    long_form = counted.join(F.broadcast(steps(counted.sparkSession, filters)), "mask")
    metrics = long_form.groupBy("part", "filter_order", "step", "filter").agg(
        total(F.col("fails").bitwiseOR(F.col("before")) == 0).alias("kept"),
        total(here).alias("removed"),
        total((F.col("fails") != 0) & (F.col("before") != 0)).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(here & F.col("good")).alias("good_lost"),
        total(here & F.col("toxic")).alias("toxic_lost"),
    )
    return metrics.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")).cast("long"))


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Metrics of the filters A to E on ``docs`` (doc_id, text, source), by part, order and step.

    A part is a source; null sources are the part ``''``, as are empty ones. A null
    text counts as empty. Repeated rows count each. Other columns of both tables are
    not read, so none can clash. Texts are read once, whole, in the row; they don't
    move. Without labels nothing good or toxic is lost; an empty table gives no rows.
    """
    failed = failures(docs)
    counted = written(cells(failed, labels), "audit-cells")
    unwritten(failed)
    return interactions(counted).select("part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op11_filter_interactions(spark, sf_dir: str) -> DataFrame:
    """What five filters remove from the documents of each source, in all 120 orders."""
    return audited(documents(spark, sf_dir, "doc_id", "text", "source"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
firsts AS (SELECT t, min(doc_id) AS first_id FROM docs GROUP BY t),
known AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(words.t, '[^A-Z]', '', 'g')) > 2 * length(words.t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(words.t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN words.doc_id > first_id THEN 16 ELSE 0 END) AS mask
  FROM words JOIN firsts ON words.t = firsts.t LEFT JOIN known ON words.doc_id = known.doc_id),
cells AS (SELECT part, mask, good, toxic, count(*) AS n FROM masks GROUP BY ALL),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (
  SELECT filter_order, s.step, letter, bit FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s
  JOIN f ON letter = substr(filter_order, s.step, 1)),
long_form AS (
  SELECT cells.*, filter_order, step, letter, bit, mask & bit AS fails,
    coalesce(bit_or(mask & bit) OVER (PARTITION BY part, mask, good, toxic, filter_order ORDER BY step
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM cells, steps),
metrics AS (
  SELECT part, filter_order, step, letter AS filter,
    sum(CASE WHEN fails | before = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails != 0 AND before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails != 0 AND before != 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails != 0 AND before = 0 AND good THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails != 0 AND before = 0 AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM long_form GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM metrics
"""
