"""Column functions against plain Python and hand-made cases."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumage.functions import boxes as B
from plumage.functions import geo as G
from plumage.functions import numbers as N
from plumage.functions import text as T


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for n, v in values.items()))
    assert names
    return df.select(column.alias("x")).first().x


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-180, 180), min_size=1, max_size=50))
def test_dms_round_trip(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    back = G.from_dms(G.to_dms(F.col("v")), F.when(F.col("v") < 0, "W").otherwise("E"))
    for r in df.select("v", back.alias("b")).collect():
        assert abs(r.v - r.b) <= 0.01 / 3600 + 1e-9


def test_offset_is_identity_outside_box(spark):
    df = spark.createDataFrame([(40.7, -74.0), (56.0, 100.0), (30.0, 120.0)], "lat double, lon double")
    lat, lon = G.gcj02(F.col("lat"), F.col("lon"))
    a, b, c = df.select("lat", "lon", lat.alias("glat"), lon.alias("glon")).collect()
    assert (a.lat, a.lon) == (a.glat, a.glon) and (b.lat, b.lon) == (b.glat, b.glon)
    assert 100 < math.hypot(c.glat - c.lat, c.glon - c.lon) * 111_000 < 1_000


def test_ring_edges(spark):
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2))])
    rows = spark.createDataFrame([(1.0, 1.0), (0.0, 1.0), (1.0, 0.0), (2.0, 1.0), (1.0, 2.0), (3.0, 1.0)], "x double, y double").select(G.in_ring(F.col("x"), F.col("y"), square).alias("i")).collect()
    assert [r.i for r in rows] == [True, True, True, False, False, False]


def test_zero_denominator_and_missing_part(spark):
    dms = F.array(F.struct(F.lit(10).alias("num"), F.lit(1).alias("den")), F.struct(F.lit(30).alias("num"), F.lit(0).alias("den")))
    assert spark.range(1).select(G.from_dms(dms, F.lit("s")).alias("v")).first().v == -10.0


def test_literal_points(spark):
    rows = spark.createDataFrame([("30.27,120.16",), ("95,1",), ("x,1",), ("5",), (None,)], "t string").select(G.literal_point(F.col("t")).alias("p")).collect()
    assert [r.p and (r.p.lat, r.p.lon) for r in rows] == [(30.27, 120.16), None, None, None, None]


def test_names(spark):
    cases = [("**红嘴鸥**；英文名称：Gull", "红嘴鸥"), ("__变色树蜥__（注：图中动物为蜥蜴，非鸟类）", "变色树蜥"), ("白鹭 Egret", "白鹭"), ("Egret", ""), ("红 嘴 鸥", "红嘴鸥"), ("", "")]
    df = spark.createDataFrame([(a,) for a, _ in cases], "t string").coalesce(1)
    assert [r.x for r in df.select(T.cn_name(F.col("t")).alias("x")).collect()] == [b for _, b in cases]
    assert one(spark, T.en_name(F.col("t")), t="**Little   Grebe**；学名：x") == "Little Grebe"
    assert one(spark, T.sci_name(F.col("t")), t="*Larus ridibundus* (Linnaeus)") == "Larus ridibundus"
    assert one(spark, T.before_next_label(F.col("t")), t="红嘴鸥、英文名称：Gull") == "红嘴鸥"


def test_percent_and_subject(spark):
    assert one(spark, T.percent(F.col("t")), t="约 95 %") == 0.95
    assert one(spark, T.percent(F.col("t")), t="250%") is None
    assert one(spark, T.subject(F.col("t")), t="鸟类。") == "bird" and one(spark, T.subject(F.col("t")), t="植物") == ""


def test_padding_keeps_long_numbers(spark):
    assert one(spark, T.padded_number(F.col("n")), n=42) == "00042" and one(spark, T.padded_number(F.col("n")), n=123456) == "123456"


def test_duration(spark):
    cases = {0.4: "0秒", 59.0: "59秒", 60.0: "1分钟", 61.0: "1分1秒", 3600.0: "1小时", 3661.0: "1小时1分1秒", 7205.0: "2小时5秒", -5.0: "0秒"}
    for seconds, shown in cases.items():
        assert one(spark, N.duration_text(F.col("s")), s=seconds) == shown


def test_expanded_box_falls_back(spark):
    cols = [F.col(c) for c in ("x1", "y1", "x2", "y2", "w", "h")]
    df = spark.createDataFrame([(10, 10, 30, 20, 100, 100), (200, 5, 220, 9, 100, 100)], "x1 int, y1 int, x2 int, y2 int, w int, h int").coalesce(1)
    rows = df.select(*[c.alias(f"o{i}") for i, c in enumerate(B.expanded(*cols, 0.12))]).collect()
    assert tuple(rows[0]) == (8, 8, 32, 22) and tuple(rows[1]) == (200, 5, 100, 9)


def test_chat_text_shapes(spark):
    bodies = ['{"choices":[{"message":{"content":" a "}}]}', '{"choices":[{"message":{"content":[{"type":"text","text":"a"},{"type":"output_text","text":"b"}]}}]}', '{"output":[{"type":"message","role":"assistant","content":[{"type":"output_text","text":"c"}]}]}', "{}", "no json"]
    df = spark.createDataFrame([(b,) for b in bodies], "b string").coalesce(1)
    assert [r.x for r in df.select(T.chat_text(F.col("b")).alias("x")).collect()] == ["a", "a\nb", "c", "", ""]


def test_backoff():
    assert N.backoff_seconds(3, 7.0) == 7.0 and N.backoff_seconds(3, None) == 8.0 and N.backoff_seconds(20, None) == 120.0
    assert 8.0 <= N.backoff_seconds(3, None, draw=0.5) <= 9.2
