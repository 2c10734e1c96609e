import zlib
from collections import Counter

from pyspark.sql import functions as F

from plumage.llm import sharding as S


def test_permutation_equals_python(spark):
    for n in (1, 2, 3, 7, 64, 65, 1000):
        got = [r[0] for r in spark.range(n).select(S.feistel_column(F.col("id"), n, 99)).collect()]
        assert sorted(got) == list(range(n)) and got == [S.feistel_index(i, n, 99) for i in range(n)]


def test_shuffle_is_thorough():
    n = 5000
    moved = [S.feistel_index(i, n) for i in range(n)]
    assert sum(abs(a - b) == 1 for a, b in zip(moved, moved[1:], strict=False)) < 20 and moved != [S.feistel_index(i, n, 1) for i in range(n)]


def test_shards_are_even_gapless_and_reproducible(spark, make, odd):
    docs = make(odd + [(100 + i, f"t{i}") for i in range(331)]).select("doc_id", "text")
    a = S.shard(docs, ["doc_id", "text"], 8).collect()
    b = S.shard(docs.repartition(5), ["doc_id", "text"], 8).collect()
    key = lambda r: (r.row_number, r.shard, r.slot)
    assert sorted(map(key, a)) == sorted(map(key, b)) and Counter((r.doc_id, r.text) for r in a) == Counter((r.doc_id, r.text) for r in docs.collect())
    sizes = Counter(r.shard for r in a)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in a if r.shard == s) == list(range(sizes[s]))
    n = len(a)
    assert sorted(r.row_number for r in a) == list(range(n)) and all(divmod(S.feistel_index(r.row_number, n), 8) == (r.slot, r.shard) for r in a)


def test_very_many_equal_rows_are_unrolled(spark, monkeypatch):
    monkeypatch.setattr(S, "UNROLL", 50)
    rows = spark.range(1000).select(F.when(F.col("id") < 777, 1).otherwise(F.col("id")).alias("k"))
    out = S.numbered(rows, ["k"]).collect()
    assert sorted(r.row_number for r in out) == list(range(1000)) and Counter(r.k for r in out)[1] == 777


def test_numbers_within_groups(spark):
    rows = spark.range(300).select("id", (F.col("id") % 3).alias("g"))
    out = S.numbered(rows, ["id", "g"], ["g"]).collect()
    assert all(sorted(r.row_number for r in out if r.g == g) == list(range(100)) for g in range(3))


def test_empty_null_and_clashing_names(spark, make):
    assert S.shard(make([]).select("doc_id"), ["doc_id"]).count() == 0
    rows = make([(None, None), (1, "x")]).select("doc_id", F.lit(5).alias("_h"), F.lit(6).alias("shard"), F.lit(7).alias("row_number"))
    out = S.shard(rows, rows.columns, 2).collect()
    assert sorted(r.row_number for r in out) == [0, 1] and {r._h for r in out} == {5} and sorted(r.shard for r in out) == [0, 1]


def test_query_columns(spark):
    rows = S.op9_feistel_shards(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
