"""Quality rules whose cut-offs come from mergeable quantile sketches.

Every metric of a document is an integer. Its sketch is a table of counts over
buckets that keep the seven leading bits of the value, so a quantile read from it
is at most 1/64 too low. Sketches merge by adding counts: partial aggregates of
one group (a source that holds most rows is summed in every task before the
shuffle), and the groups of a language into one sketch of that language.

A group's cut-off is a fence outside its quartiles: ``q75 + 3 * spread`` above or
``q25 - 3 * spread`` below, where ``spread`` is the distance of the quartiles, or
the metric's least spread if that is larger. A group of (language, source) with
fewer than ``MIN_GROUP`` documents uses its language's sketch, or the one of all
documents if that is small as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound, documents, words_of, written

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW_WORDS = 8
MIN_GROUP = 200
FENCE = 3
LEAD_BITS = 7

#: Metric: (+1 for a fence above, -1 for one below; least spread). All are per thousand.
RULES = {
    "symbols_per_word": (1, 33),
    "dup_lines": (1, 150),
    "repeat_words": (1, 100),
    "capitals": (1, 60),
    "distinct_words": (-1, 110),
}

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(words: Column, window: int) -> Column:
    """Words that lie in a window found twice or more in the text, first included.

    Window hashes are compared, and only where two are equal are they sorted with
    their places. Each window of a repeated kind adds the words that the repeated
    window before it didn't hold.
    """
    count = F.size(words) - window + 1
    hashes = F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.slice(words, i, window)))

    def places(ordered: Column) -> Column:
        def same(at: Column, other: Column) -> Column:
            return F.coalesce(F.get(ordered, other)["g"] == at["g"], F.lit(False))

        return F.array_sort(F.transform(F.filter(ordered, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    def counted(grams: Column) -> Column:
        ordered = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return F.aggregate(
            bound(ordered, places),
            F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")),
            lambda acc, i: F.struct((acc["n"] + F.least(i - acc["last"], F.lit(window))).alias("n"), i.alias("last")),
            lambda acc: acc["n"],
        )

    found = F.when(F.size(F.array_distinct(F.col("_grams"))) == F.size("_grams"), 0).otherwise(counted(F.col("_grams")))
    return F.when(count > 0, hashes).otherwise(F.array().cast("array<bigint>")), found


def with_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts and the metrics of :data:`RULES` to each row.

    A null, empty or blank text has no words, no lines and zero everywhere except
    ``distinct_words``, which is 1000 for it. Everything is computed in the row: no
    shuffle, and no Python.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_words", words_of(F.col(text)))
    grams, found = _repeat_words(F.col("_words"), WINDOW_WORDS)
    df = df.withColumn("_grams", grams)
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_lines", lines)
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": found.cast("long"),
        "_capitals": (F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"),
        "_distinct": F.size(F.array_distinct("_words")).cast("long"),
    })

    def per(part: str, whole: str, none: int = 0) -> Column:
        return F.when(F.col(whole) == 0, F.lit(none).cast("long")).otherwise(F.call_function("div", F.col(part) * 1000, F.col(whole)))

    df = df.withColumns({
        "symbols_per_word": per("n_symbols", "n_words"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "repeat_words": per("n_repeat_words", "n_words"),
        "capitals": per("_capitals", "word_chars"),
        "distinct_words": per("_distinct", "n_words", 1000),
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")),
    })
    return df.drop("_words", "_grams", "_lines", "_capitals", "_distinct", "n_lines")


def bucket(value: Column, bits: int = LEAD_BITS) -> Column:
    """The lower end of a value's bucket: its leading bits, the rest zero."""
    low = F.greatest(F.length(F.bin(value)) - bits, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def sketches(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by keys, metric and bucket: one mergeable sketch a group and metric."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("bucket")) for m in RULES]))
    return metrics.select(*keys, pairs.alias("_p")).groupBy(*keys, F.col("_p.metric").alias("metric"), F.col("_p.bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of finer groups added up to those of ``keys``."""
    return sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Size of each group and metric, and its 25 and 75 % quantiles."""
    whole = Window.partitionBy(*keys, "metric")
    upto = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    at = sketch.withColumn("_upto", F.sum("n").over(upto)).withColumn("size", F.sum("n").over(whole))
    quantile = lambda percent: F.min(F.when(100 * F.col("_upto") >= percent * F.col("size"), F.col("bucket")))
    return at.groupBy(*keys, "metric").agg(F.max("size").alias("size"), quantile(25).alias("q25"), quantile(75).alias("q75"))


def cutoffs(sketch: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """One row for each (lang, source): its cut-off for every metric.

    ``sketch`` has counts by ``lang``, ``source``, metric and bucket; null is a
    language or source like any other.
    """
    own = quartiles(sketch, ["lang", "source"])
    by_lang = quartiles(merged(sketch, ["lang"]), ["lang"]).select(F.col("lang").alias("_l"), F.col("metric").alias("_m"), F.struct("size", "q25", "q75").alias("_by_lang"))
    by_all = quartiles(merged(sketch, []), []).select(F.col("metric").alias("_a"), F.struct("size", "q25", "q75").alias("_by_all"))
    df = own.withColumn("_own", F.struct("size", "q25", "q75"))
    df = df.join(by_lang, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("metric") == F.col("_m"))).join(F.broadcast(by_all), F.col("metric") == F.col("_a"))  # one row a metric
    df = df.withColumn("_q", F.when(F.col("size") >= min_group, F.col("_own")).when(F.col("_by_lang.size") >= min_group, F.col("_by_lang")).otherwise(F.col("_by_all")))
    q25, q75 = F.col("_q.q25"), F.col("_q.q75")
    cut = None
    for metric, (side, least) in RULES.items():
        spread = FENCE * F.greatest(q75 - q25, F.lit(least))
        value = q75 + spread if side > 0 else q25 - spread
        cut = F.when(F.col("metric") == metric, value) if cut is None else cut.when(F.col("metric") == metric, value)
    return df.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == m, cut)).alias(f"cut_{m}") for m in RULES])


def judged(metrics: DataFrame, cuts: DataFrame) -> DataFrame:
    """Join cut-offs to documents and add ``kept``.

    The cut-offs are a written table, so the planner knows their size: it
    broadcasts them below its threshold, and beyond it uses a shuffled join whose
    hot sources AQE splits.
    """
    cuts = cuts.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[f"cut_{m}" for m in RULES])
    df = metrics.join(cuts, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    bad = F.col("base_failed")
    for metric, (side, _) in RULES.items():
        bad = bad | (F.col(metric) > F.col(f"cut_{metric}") if side > 0 else F.col(metric) < F.col(f"cut_{metric}"))
    return df.withColumn("kept", ~F.coalesce(bad, F.lit(False))).drop("_lang", "_source", *[f"cut_{m}" for m in RULES])


def quality_filter(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (columns ``text``, ``lang``, ``source``, any others) that pass.

    The rows are written once with their metrics, so each text is measured once, and
    texts are never shuffled. Null, empty and blank texts fail the base rules; a very
    long text is measured whole; rows that repeat get the same verdict; null is a
    language or source like any other; other columns go along, whatever their names.
    An empty table stays empty.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text", "lang", "source")
    metrics = written(with_metrics(packed).drop("text"), "quality-metrics")
    cuts = written(cutoffs(sketches(metrics, ["lang", "source"])), "quality-cutoffs")
    return judged(metrics, cuts).filter("kept").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def op5_adaptive_quality(spark, sf_dir: str) -> DataFrame:
    """Base counts of every document and the verdict of its group's cut-offs.

    The metrics are written once (some bytes a document), so the texts are read once.
    """
    docs = documents(spark, sf_dir, "doc_id", "text", "lang", "source")
    metrics = written(with_metrics(docs).drop("text"), "quality-metrics")
    cuts = written(cutoffs(sketches(metrics, ["lang", "source"])), "quality-cutoffs")
    return judged(metrics, cuts).select("doc_id", *BASE, "base_failed", "kept", *RULES)


_LEAST = ", ".join(f"('{m}', {side}, {least})" for m, (side, least) in RULES.items())
_BAD = " OR ".join(f"coalesce(m.{m} {'>' if side > 0 else '<'} c.cut_{m}, false)" for m, (side, _) in RULES.items())
_QUANTILES = "max(size) AS size, min(CASE WHEN 100 * upto >= 25 * size THEN bucket END) AS q25, min(CASE WHEN 100 * upto >= 75 * size THEN bucket END) AS q75"


def _quartiles_sql(keys: str) -> str:
    by = f"{keys}, metric" if keys else "metric"
    return f"""(SELECT {by}, {_QUANTILES} FROM (
        SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}) AS size
        FROM (SELECT {by}, bucket, count(*) AS n FROM sketch GROUP BY {by}, bucket)) GROUP BY {by})"""


#: DuckDB SQL for the rows of :func:`op5_adaptive_quality`; windows of words are compared as texts.
OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, array_to_string(words[i : i + {WINDOW_WORDS - 1}], ' ') AS g FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW_WORDS - 2})) AS i FROM w)),
again AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
found AS (SELECT rid, sum(least(i - coalesce(before, -{WINDOW_WORDS}), {WINDOW_WORDS})) AS n FROM (SELECT *, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM again) GROUP BY rid),
b AS (SELECT w.rid, doc_id, lang, source, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(found.n, 0) AS n_repeat_words, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals, len(list_distinct(words)) AS n_distinct FROM w LEFT JOIN found USING (rid)),
m AS (SELECT *, CASE WHEN n_words = 0 THEN 0 ELSE 1000 * n_symbols // n_words END AS symbols_per_word, CASE WHEN n_lines = 0 THEN 0 ELSE 1000 * n_dup_lines // n_lines END AS dup_lines,
  CASE WHEN n_words = 0 THEN 0 ELSE 1000 * n_repeat_words // n_words END AS repeat_words, CASE WHEN word_chars = 0 THEN 0 ELSE 1000 * n_capitals // word_chars END AS capitals,
  CASE WHEN n_words = 0 THEN 1000 ELSE 1000 * n_distinct // n_words END AS distinct_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM b),
long AS ({" UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, CAST({m} AS BIGINT) AS v FROM m" for m in RULES)}),
sketch AS (SELECT lang, source, metric, (v >> greatest(length(bin(v)) - {LEAD_BITS}, 0)) << greatest(length(bin(v)) - {LEAD_BITS}, 0) AS bucket FROM long),
own AS {_quartiles_sql("lang, source")}, by_lang AS {_quartiles_sql("lang")}, by_all AS {_quartiles_sql("")},
chosen AS (SELECT o.lang, o.source, o.metric, CASE WHEN o.size >= {MIN_GROUP} THEN o.q25 WHEN l.size >= {MIN_GROUP} THEN l.q25 ELSE a.q25 END AS q25,
  CASE WHEN o.size >= {MIN_GROUP} THEN o.q75 WHEN l.size >= {MIN_GROUP} THEN l.q75 ELSE a.q75 END AS q75
  FROM own o JOIN by_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.metric = l.metric JOIN by_all a ON o.metric = a.metric),
cut AS (SELECT lang, source, metric, CASE WHEN side > 0 THEN q75 + {FENCE} * greatest(q75 - q25, least_spread) ELSE q25 - {FENCE} * greatest(q75 - q25, least_spread) END AS v
  FROM chosen JOIN (VALUES {_LEAST}) r(name, side, least_spread) ON metric = name),
c AS (SELECT lang, source, {", ".join(f"max(CASE WHEN metric = '{m}' THEN v END) AS cut_{m}" for m in RULES)} FROM cut GROUP BY lang, source)
SELECT m.doc_id, {", ".join(f"CAST({x} AS BIGINT) AS {x}" for x in [*BASE, *RULES])}, base_failed, NOT (base_failed OR {_BAD}) AS kept
FROM m JOIN c ON m.lang IS NOT DISTINCT FROM c.lang AND m.source IS NOT DISTINCT FROM c.source
"""
