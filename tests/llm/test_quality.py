import collections
import random
import re

from pyspark.sql import functions as F

from plumage.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    at = collections.defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark, make, odd):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) + "\n" * rng.randint(0, 3) for _ in range(60)]
    texts += ["x " * 40, "a\nb\na\n \na\n", "# $ | <é>   z", "\x0b\x0c a\tb\r\nc"]
    docs = make(odd + [(100 + i, t) for i, t in enumerate(texts)])
    for r in Q.with_metrics(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text), r.text
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)


def test_buckets_keep_leading_bits(spark):
    for r in spark.range(5000).select("id", Q.bucket(F.col("id")).alias("b")).collect():
        assert r.b <= r.id and (r.id - r.b) * 64 <= r.id and (r.id >= 128 or r.b == r.id)


def test_merged_sketches_are_the_whole_ones(spark, make, prose):
    docs = Q.with_metrics(make([(i, prose(i, 30 + i)) for i in range(60)]))
    fine = Q.sketches(docs, ["lang", "source"])
    whole = Q.sketches(docs.withColumns({"lang": F.lit("x")}), ["lang"]).drop("lang")
    assert sorted(Q.merged(fine, []).collect()) == sorted(whole.select("metric", "bucket", "n").collect())
    quart = {r.metric: r for r in Q.quartiles(whole.withColumn("g", F.lit(1)), ["g"]).collect()}
    values = sorted(r.distinct_words for r in docs.collect())
    got = quart["distinct_words"]
    exact = values[-(-len(values) // 4) - 1], values[-(-3 * len(values) // 4) - 1]
    assert got.size == 60 and all(0 <= e - q <= e / 64 for e, q in zip(exact, (got.q25, got.q75), strict=True))


def test_small_groups_use_larger_sketches_and_junk_goes(spark, prose):
    rows = [(i, prose(i, 80), "en", "big", 1) for i in range(250)] + [(1000 + i, prose(500 + i, 80), "en", "small", 1) for i in range(3)] + [(2000, prose(9, 80), None, None, 1)]
    junk = [(3000, prose(1, 80).replace(" ", " | "), "en", "small", 1), (3001, prose(2, 80).upper() + " A" * 3, "en", "big", 1), (3002, "ten words " * 10, "en", "big", 1), (3003, None, "en", "big", 1)]
    docs = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string, n_chars long")
    kept = Q.quality_filter(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in rows)


def test_thresholds_adapt(spark, prose):
    """A source full of tables keeps them; the same text is an outlier elsewhere."""
    table = lambda i: prose(i, 60).replace(" ", " | ")
    rows = [(i, table(i), "en", "tables", 1) for i in range(220)] + [(1000 + i, prose(i, 60), "en", "prose", 1) for i in range(220)] + [(5000, table(999), "en", "prose", 1)]
    kept = {r.doc_id for r in Q.quality_filter(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert len(kept) == 440 and 5000 not in kept


def test_empty_and_clashing_names(spark, make, prose):
    assert Q.quality_filter(make([])).count() == 0
    docs = make([(1, prose(1, 50)), (1, prose(1, 50))]).withColumns({"n_words": F.lit("mine"), "_words": F.lit(1), "kept": F.lit(2), "cut_capitals": F.lit(3), "a.b": F.lit(4)})
    assert [tuple(r)[5:] for r in Q.quality_filter(docs).collect()] == [("mine", 1, 2, 3, 4)] * 2


def test_no_python_in_the_plan(spark, make):
    plan = Q.quality_filter(make([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sql_gives_the_same_rows(spark, make, odd, prose, tmp_path):
    import duckdb

    rows = odd + [(100 + i, prose(i, 30 + i) + " #" * (i % 9) + "\n" + prose(i, 9) * (i % 5)) for i in range(300)]
    make(rows).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    relation = con.sql(Q.OP5_SQL)
    df = Q.op5_adaptive_quality(spark, str(tmp_path))
    assert sorted(df.columns) == sorted(relation.columns)
    order = sorted(df.columns)
    ours = sorted(str([r[c] for c in order]) for r in df.collect())
    assert ours == sorted(str([r[relation.columns.index(c)] for c in order]) for r in relation.fetchall()) and len(ours) == len(rows)
