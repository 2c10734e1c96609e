"""Hand-made frames and invariants of bursts."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumage.functions import numbers as N
from plumage.operators import burst

SCHEMA = "camera string, path string, us long, focus double, area double, has_eye boolean"


def frames(spark, rows):
    return spark.createDataFrame([(c, p, int(s * 1_000_000), f, a, e) for c, p, s, f, a, e in rows], SCHEMA)


def plain(spark, seconds):
    return frames(spark, [("c", f"p{i}", s, 1.0, 5000.0, False) for i, s in enumerate(seconds)])


def test_boundary_gap_joins(spark):
    assert {r.n for r in burst.sessions(plain(spark, [0, 1, 2]), 1.0).collect()} == {3}


def test_just_over_splits_and_singles_have_no_id(spark):
    rows = burst.sessions(plain(spark, [0, 2]), 1.0).collect()
    assert [r.n for r in rows] == [1, 1] and all(r.burst_id is None for r in rows)


def test_dense_ids_over_singles(spark):
    rows = burst.sessions(plain(spark, [0, 10, 10.5, 20, 30, 30.2, 30.4]), 1.0).orderBy("us").collect()
    assert [r.burst_id for r in rows] == [None, 0, 0, None, 1, 1, 1]


def test_equal_times_order_by_path(spark):
    rows = burst.sessions(plain(spark, [5, 5]), 1.0).collect()
    assert {r.burst_id for r in rows} == {0}


def test_empty(spark):
    assert burst.best_frames(burst.sessions(plain(spark, [1]).filter("false"), 1.0)).count() == 0


def test_quota_table(spark):
    rows = {0: (0, 0), 1: (1, 1), 2: (2, 1), 5: (2, 2), 7: (2, 4), 12: (2, 6), 13: (3, 6), 40: (8, 20)}
    df = spark.createDataFrame([(n,) for n in rows], "n long")
    got = {r.n: (r.a, r.b) for r in df.select("n", N.keep_quota(F.col("n"), 0.2, 2).alias("a"), N.keep_quota(F.col("n"), 0.5, 1).alias("b")).collect()}
    assert got == rows


def test_top_k_ties_and_veto(spark):
    rows = [("c", "a", 0, 1.0, 5000.0, False), ("c", "b", 0.5, 1.0, 5000.0, False), ("c", "c", 1.0, 1.0, 999.0, True), ("c", "d", 1.2, 0.5, 1000.0, False)]
    s = burst.sessions(frames(spark, rows), 1.0)
    assert {r.path for r in burst.best_frames(s).filter("keep").collect()} == {"c", "a"}
    assert {r.path for r in burst.best_frames(s, min_area=1000).filter("keep").collect()} == {"a", "b"}


def test_single_small_frame_is_dropped_with_veto(spark):
    s = burst.sessions(frames(spark, [("c", "a", 0, 1.0, 10.0, False)]), 1.0)
    assert not burst.best_frames(s, min_area=1000).first().keep and burst.best_frames(s).first().keep


def test_sampled_scores(spark):
    df = frames(spark, [("c", f"p{i:02}", i * 0.1, float(i), 0.0, False) for i in range(9)])
    rows = burst.sampled_scores(burst.sessions(df, 1.0)).orderBy("path").collect()
    assert [r.sampled for r in rows] == [i in (0, 3, 6) for i in range(9)]
    assert [round(r.est_focus, 3) for r in rows] == [0, 0, 2.85, 3, 2.85, 5.7, 6, 5.7, 5.7]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 400), min_size=1, max_size=60), st.integers(1, 20))
def test_session_invariants(spark, seconds, threshold):
    rows = burst.sessions(plain(spark, seconds), threshold).orderBy("us", "path").collect()
    for a, b in zip(rows, rows[1:], strict=False):
        gap = (b.us - a.us) / 1e6
        assert (a.sid == b.sid) == (gap <= threshold)


def test_giant_folder_equals_plain(spark):
    df = plain(spark, [i * 3 % 997 for i in range(400)])
    a = {r.path: r.sid for r in burst.sessions(df, 2.0).collect()}
    b = {r.path: r.sid for r in burst.giant_folder_sessions(df, 2.0, 7).collect()}
    assert a == b


def test_sliced_sessions_equal_plain_ones(spark, monkeypatch):
    import random

    monkeypatch.setattr(burst, "BLOCK", 8)
    rng = random.Random(4)
    rows = [("hot", rng.randint(0, 900) * 1_000_000, f"h{i:04}") for i in range(500)] + [(rng.choice(["a", "b", "i", "z", None]), rng.randint(0, 300) * 1_000_000, f"p{i:04}") for i in range(120)]
    df = spark.createDataFrame(rows, "camera string, us long, path string")
    key = lambda r: (r.camera, r.path, r.sid, r.n, r.burst_id)
    for slices, threshold in ((1, 1.0), (7, 1.0), (23, 3.0)):
        want = sorted(map(key, burst.sessions(df, threshold).collect()), key=repr)
        assert sorted(map(key, burst.sliced_sessions(df, threshold, slices).collect()), key=repr) == want
    assert burst.sliced_sessions(df.filter("false"), 1.0, 3).count() == 0


def test_one_exchange(spark):
    plan = burst.burst_summary(burst.best_frames(burst.sessions(plain(spark, [0, 1]), 1.0)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
