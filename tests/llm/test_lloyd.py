import hashlib
import math
import random

import duckdb
import pytest

from plumage.llm import lloyd as L


def brute(rows, dims, clusters=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:clusters]
    cents = [v for _, v in starts]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((far(v, c), k) for k, c in enumerate(cents)) for _, v in kept]
    for _ in range(rounds):
        own = assign()
        for k in range(len(cents)):
            mine = [v for (_, v), (_, c) in zip(kept, own, strict=True) if c == k]
            if mine:
                cents[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    own = assign()
    inertia = [sum(d for d, c in own if c == k) for k in range(len(cents))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    out = [(i, k, d, inertia[k], sum(inertia), digest[k]) for (i, _), (d, k) in zip(kept, own, strict=True)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1, 0, 1]) + rng.gauss(0, 0.4) for _ in range(64)]) for i in range(400)]
    rows += [(1000 + i, list(rows[i % 7][1])) for i in range(60)]  # copies
    rows += [(5, rows[9][1]), (None, rows[3][1]), (None, rows[200][1])]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 63 + [None]), (2004, [1.0] * 63 + [math.nan]), (2005, [math.inf] * 64), (2006, [0.0] * 64), (2007, [1.0] * 65)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, v int")


def test_against_brute_force_and_sql(spark, vectors):
    df = frame(spark, vectors).repartition(5)
    got = sorted((tuple(r) for r in L.clustered(df).collect()), key=repr)
    assert got == brute(vectors, 64)
    con = duckdb.connect()
    arrow = df.select("vec_id", "embedding").toArrow()
    con.register("embeddings", arrow)
    assert sorted(con.sql(L.OP13_SQL).fetchall(), key=repr) == got


@pytest.mark.parametrize("rounds", [1, 2, 8, 40])
def test_any_number_of_rounds(spark, rounds):
    rng = random.Random(rounds)
    rows = [(i, [rng.randint(-3, 3) / 64 for _ in range(2)]) for i in range(300)]  # many ties
    got = sorted((tuple(r) for r in L.clustered(frame(spark, rows), 6, rounds, dims=2).collect()), key=repr)
    assert got == brute(rows, 2, 6, rounds)


def test_few_none_and_huge(spark):
    few = [(i, [float(i)] * 64) for i in range(3)]
    assert sorted((tuple(r) for r in L.clustered(frame(spark, few)).collect()), key=repr) == brute(few, 64)
    assert L.clustered(frame(spark, [])).count() == 0
    assert L.clustered(frame(spark, [(1, None), (None, [1.0] * 64)])).count() == 0
    huge = L.clustered(frame(spark, [(1, [1e300] * 64), (2, [-1e300] * 64)]), clusters=1, rounds=0).collect()
    assert sorted(r.distance for r in huge) == [0, 64 * (2 * L.LIMIT) ** 2]


def test_transfers_are_signed(spark):
    rows = spark.createDataFrame([([1, 2], -1, 0), ([3, 4], 0, 1), ([5, 6], 1, 1)], "v array<int>, was int, cluster int")
    assert L.transfers(rows, 2) == {0: (0, [-2, -2]), 1: (1, [3, 4])}
