import itertools
import random

from pyspark.sql import functions as F

from plumage.llm import packing as P


def padded_total(lengths, ends):
    return sum(min(e for e in ends if e >= n) for n in lengths)


def test_boundaries_are_optimal():
    rng = random.Random(3)
    for _ in range(40):
        lengths = [rng.randint(0, 30) for _ in range(rng.randint(1, 40))]
        edges = sorted(set(lengths))
        k = rng.randint(1, 5)
        ends, total = P.optimal_boundaries(edges, [lengths.count(e) for e in edges], k)
        best = min(padded_total(lengths, [*c, edges[-1]]) for m in range(min(k, len(edges))) for c in itertools.combinations(edges[:-1], m))
        assert total == best == padded_total(lengths, ends) and len(ends) <= k


def test_every_row_gets_a_place_within_budget(spark, make, odd):
    rows = P.word_lengths(make(odd + [(100 + i, "w " * (i % 37)) for i in range(400)]))
    out = P.packed(rows, ["doc_id", "n_tokens"], "n_tokens", buckets=4, budget=300).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in out) == sorted((r.doc_id or -1, r.n_tokens) for r in rows.collect())
    batches = {}
    for r in out:
        assert 0 <= r.padding == r.boundary - r.n_tokens
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, batch), members in batches.items():
        per = max(1, 300 // max(1, members[0].boundary))
        assert sorted(m.slot for m in members) == list(range(len(members)))
        assert len(members) == per or (bucket, batch + 1) not in batches


def test_same_places_whatever_the_partitions(spark, make):
    rows = P.word_lengths(make([(i, "w " * (i % 11)) for i in range(200)]))
    a = P.packed(rows.repartition(7), ["doc_id", "n_tokens"], "n_tokens", 3, 100).collect()
    b = P.packed(rows.coalesce(1), ["doc_id", "n_tokens"], "n_tokens", 3, 100).collect()
    assert sorted(a) == sorted(b)


def test_empty_one_length_and_clashing_names(spark, make):
    assert P.packed(P.word_lengths(make([])), ["doc_id", "n_tokens"], "n_tokens").count() == 0
    rows = P.word_lengths(make([(1, "a"), (2, "b")])).withColumns({"bucket": F.lit(9), "_n": F.lit(1), "_block": F.lit(2)})
    out = P.packed(rows, rows.columns, "n_tokens").collect()
    assert {(r.bucket, r.boundary, r._n, r._block) for r in out} == {(0, 1, 1, 2)}


def test_long_lengths_share_bins(spark):
    rows = spark.createDataFrame([(n,) for n in (4096, 4097, 4160, 10**6, 10**6 + 1)], "n long").select("n", P.edge(F.col("n")).alias("e"))
    assert all(r.n <= r.e < r.n * (1 + 1 / 60) for r in rows.collect()) and rows.filter("n = 4096").first().e == 4096
