"""The driver's tables seen as photos, candidates, regions, names and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.numbers import micros

#: Session gap in seconds that leaves bursts of several events a user.
GAP = 36_000.0

#: Toy map: provinces as rings, one with two parts; the first of overlapping ones wins.
PROVINCES = [
    (0, "West", [(-170.0, -60.0), (-60.0, -60.0), (-60.0, 60.0), (-170.0, 60.0)]),
    (1, "Middle", [(-60.0, -50.0), (40.0, -50.0), (60.0, 0.0), (40.0, 50.0), (-60.0, 50.0)]),
    (2, "East", [(50.0, -40.0), (150.0, -40.0), (150.0, 70.0), (50.0, 70.0)]),
    (3, "Middle", [(-20.0, 55.0), (20.0, 55.0), (0.0, 85.0)]),
]
CITIES = [(0, "East", "Port", [(80.0, -10.0), (120.0, -10.0), (120.0, 30.0), (80.0, 30.0)]), (1, "East", "Hills", [(100.0, 0.0), (140.0, 0.0), (140.0, 60.0), (100.0, 60.0)]), (2, "West", "Bay", [(-120.0, -20.0), (-90.0, -20.0), (-90.0, 20.0), (-120.0, 20.0)])]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as photos: user as camera, value as sharpness."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("camera"), F.col("event_id").alias("path"), micros(F.col("ts")).alias("us"), F.col("value").alias("focus"), F.pmod(F.col("event_id") * 37, F.lit(5000)).cast("double").alias("area"), (F.col("event_type") == "purchase").alias("has_eye"))


FRAMES_SQL = f"""
frames AS (SELECT user_id AS camera, event_id AS path, epoch_us(ts) AS us, value AS focus, CAST((event_id * 37) % 5000 AS DOUBLE) AS area, event_type = 'purchase' AS has_eye FROM events),
gaps AS (SELECT *, coalesce((us - lag(us) OVER (PARTITION BY camera ORDER BY us, path)) / 1e6, 0.0) AS time_diff FROM frames),
cut AS (SELECT *, CAST(sum(CASE WHEN time_diff > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY camera ORDER BY us, path ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sid FROM gaps),
sized AS (SELECT *, count(*) OVER (PARTITION BY camera, sid) AS n, row_number() OVER (PARTITION BY camera, sid ORDER BY us, path) AS pos FROM cut),
bursts AS (SELECT *, CASE WHEN n > 1 THEN CAST(sum(CASE WHEN n > 1 AND pos = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY camera ORDER BY us, path ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) END AS burst_id FROM sized),
quotas AS (SELECT *, least(n, greatest(2, CAST(round_even(n * 0.2, 0) AS BIGINT))) AS quota, 1.0 * focus + 0.45 * (area / 10000.0) + CASE WHEN has_eye THEN 0.8 ELSE 0.0 END AS score FROM bursts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY camera, sid ORDER BY score DESC, us, path) AS rk FROM quotas),
kept AS (SELECT *, n = 1 OR rk <= quota AS keep FROM ranked)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as species candidates: order as image, two detections each, discount as confidence."""
    li = table(spark, sf_dir, "lineitem")
    df = li.select(
        F.col("l_orderkey").alias("image"), F.pmod("l_suppkey", F.lit(2)).cast("int").alias("det"), F.when(F.pmod("l_partkey", F.lit(7)) != 0, F.pmod("l_partkey", F.lit(50)).cast("int")).alias("idx"),
        (F.col("l_discount") * 10).alias("confidence"), F.when(F.pmod("l_orderkey", F.lit(6)) != 0, F.concat(F.lit("P"), F.pmod("l_orderkey", F.lit(30)).cast("string"))).alias("province"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
    )
    order = Window.partitionBy("image", "det").orderBy(F.desc("confidence"), "line", "part")
    return df.withColumn("rank", F.row_number().over(order).cast("long"))


def regional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("P"), F.col("s_nationkey").cast("string")).alias("region"), F.pmod("s_suppkey", F.lit(50)).cast("int").alias("idx")).distinct()


def national(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.pmod("p_partkey", F.lit(50)).cast("int").alias("idx")).filter("idx < 20").distinct()


LISTS_SQL = """
regional AS (SELECT DISTINCT 'P' || s_nationkey AS region, CAST(s_suppkey % 50 AS INTEGER) AS idx FROM supplier),
national AS (SELECT DISTINCT CAST(p_partkey % 50 AS INTEGER) AS idx FROM part WHERE p_partkey % 50 < 20)"""

REFINED_SQL = """
flagged AS (SELECT c.*, EXISTS (SELECT 1 FROM national n WHERE n.idx = c.idx) AS in_national,
  CASE WHEN c.province IN (SELECT region FROM regional) THEN EXISTS (SELECT 1 FROM regional r WHERE r.region = c.province AND r.idx = c.idx) ELSE EXISTS (SELECT 1 FROM national n WHERE n.idx = c.idx) END AS listed
  FROM cand c WHERE rank <= 10),
passed AS (SELECT * FROM (SELECT *, bool_or(listed) OVER (PARTITION BY image, det) AS any_listed FROM flagged WHERE listed OR confidence > 0.75) WHERE listed OR NOT any_listed),
reranked AS (SELECT *, row_number() OVER (PARTITION BY image, det ORDER BY confidence + CASE WHEN in_national THEN 0.005 ELSE 0.0 END DESC, rank) AS new_rank FROM passed)"""

CANDIDATES_SQL = f"""
cand AS (SELECT *, row_number() OVER (PARTITION BY image, det ORDER BY confidence DESC, line, part) AS rank FROM (
  SELECT l_orderkey AS image, CAST(l_suppkey % 2 AS INTEGER) AS det, CASE WHEN l_partkey % 7 <> 0 THEN CAST(l_partkey % 50 AS INTEGER) END AS idx, l_discount * 10 AS confidence,
         CASE WHEN l_orderkey % 6 <> 0 THEN 'P' || (l_orderkey % 30) END AS province, l_linenumber AS line, l_partkey AS part FROM lineitem)),
{LISTS_SQL},
{REFINED_SQL}"""


def species(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first parts as a species table: two thirds of the classes have a name."""
    p = table(spark, sf_dir, "part").filter("p_partkey <= 44")
    return p.select((F.col("p_partkey") - 1).cast("int").alias("idx"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")).otherwise("").alias("chinese_name"), F.when(F.col("p_partkey") % 2 > 0, F.col("p_type")).alias("english_name"), F.lit("").alias("scientific_name"))


SPECIES_SQL = """
species AS (SELECT CAST(p_partkey - 1 AS INTEGER) AS idx, CASE WHEN p_partkey % 3 > 0 THEN p_name WHEN p_partkey % 2 > 0 THEN p_type ELSE '未知' END AS name FROM part WHERE p_partkey <= 44)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as photos with positions; some have none."""
    c = table(spark, sf_dir, "customer")
    spread = lambda f, n: F.pmod(F.col("c_custkey") * f, F.lit(n))
    known = F.pmod("c_custkey", F.lit(11)) != 0
    return c.select(F.col("c_custkey").alias("pid"), F.when(known, spread(7919, 18000) / 100.0 - 90.0).alias("lat"), F.when(known, spread(104729, 36000) / 100.0 - 180.0).alias("lon"))


POINTS_SQL = """
points AS (SELECT c_custkey AS pid, CASE WHEN c_custkey % 11 <> 0 THEN ((c_custkey * 7919) % 18000) / 100.0 - 90.0 END AS lat, CASE WHEN c_custkey % 11 <> 0 THEN ((c_custkey * 104729) % 36000) / 100.0 - 180.0 END AS lon FROM customer)"""


def rings(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    return spark.createDataFrame([(*r[:-1], [{"x": x, "y": y} for x, y in r[-1]]) for r in rows], f"{names}, ring array<struct<x:double,y:double>>")


def edges_sql(name: str, rows: list[tuple]) -> str:
    """Edges of rings as a VALUES list: ord, name (and parent), corner and the corner before."""
    out = []
    for r in rows:
        ring = r[-1]
        for i, (x, y) in enumerate(ring):
            px, py = ring[i - 1]
            parent = f"'{r[1]}', " if len(r) == 4 else ""
            out.append(f"({r[0]}, {parent}'{r[-2]}', CAST({x} AS DOUBLE), CAST({y} AS DOUBLE), CAST({px} AS DOUBLE), CAST({py} AS DOUBLE))")
    columns = "ord, parent, name, xi, yi, xj, yj" if len(rows[0]) == 4 else "ord, name, xi, yi, xj, yj"
    return f"{name}({columns}) AS (VALUES {', '.join(out)})"


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("species_cn"), F.concat(F.lit("O-"), "p_brand").alias("order_cn"), F.concat(F.lit("F-"), "p_type").alias("family_cn"), F.concat(F.lit("G-"), F.col("p_size").cast("string")).alias("genus_cn"), F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")).alias("name_la"), F.col("p_brand").alias("genus_la"))


TAXONOMY_SQL = """
tax AS (SELECT p_partkey AS ord, p_name AS species_cn, 'O-' || p_brand AS order_cn, 'F-' || p_type AS family_cn, 'G-' || p_size AS genus_cn, p_brand || ' ' || p_size AS name_la, p_brand AS genus_la FROM part)"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as names to classify: a quarter by each way."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    k = F.pmod(F.col("l_partkey") + F.col("l_linenumber"), F.lit(4))
    df = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    sci = F.when(k == 0, F.concat_ws(" ", "p_brand", F.col("p_size").cast("string"))).when(k == 1, F.concat(F.col("p_brand"), F.lit(" sp"))).when(k == 2, F.lit("")).otherwise(F.when(F.pmod("l_suppkey", F.lit(2)) == 0, "Larus sp").otherwise("Zzz sp"))
    cn = F.when(k == 2, F.col("p_name")).when(k == 1, F.lit("given")).otherwise("")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cn.alias("cn"), sci.alias("sci"))


NAMES_SQL = """
names AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE k WHEN 2 THEN p_name WHEN 1 THEN 'given' ELSE '' END AS cn,
  CASE k WHEN 0 THEN p_brand || ' ' || p_size WHEN 1 THEN p_brand || ' sp' WHEN 2 THEN '' ELSE CASE WHEN l_suppkey % 2 = 0 THEN 'Larus sp' ELSE 'Zzz sp' END END AS sci
  FROM (SELECT *, (l_partkey + l_linenumber) % 4 AS k FROM lineitem JOIN part ON l_partkey = p_partkey))"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as detection boxes in frames of 640 x 480."""
    li = table(spark, sf_dir, "lineitem")
    x1, y1 = F.pmod("l_partkey", F.lit(620)).cast("int"), F.pmod("l_suppkey", F.lit(470)).cast("int")
    return li.select(
        F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("det"), F.pmod("l_partkey", F.lit(3)).cast("int").alias("key"), (x1 - 5).alias("x1"), (y1 - 5).alias("y1"),
        (x1 + F.col("l_quantity").cast("int")).alias("x2"), (y1 + F.col("l_linenumber") * 9).cast("int").alias("y2"), F.lit(640).alias("width"), F.lit(480).alias("height"), F.col("l_partkey").alias("part"),
    )


BOXES_SQL = """
boxes AS (SELECT l_orderkey AS image, l_linenumber AS det, CAST(l_partkey % 3 AS INTEGER) AS key, CAST(l_partkey % 620 AS INTEGER) - 5 AS x1, CAST(l_suppkey % 470 AS INTEGER) - 5 AS y1,
  CAST(l_partkey % 620 AS INTEGER) + CAST(trunc(l_quantity) AS INTEGER) AS x2, CAST(l_suppkey % 470 + l_linenumber * 9 AS INTEGER) AS y2, 640 AS width, 480 AS height, l_partkey AS part FROM lineitem)"""
