"""Catalogue of the registered queries and their DuckDB equivalents.

Each entry applies operators of this package to the driver's tables and carries the
SQL that gives the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import geo as G
from ..functions import layout as L
from ..functions import numbers as N
from ..functions import text as T
from ..operators import answers, archive, burst, detection, evaluation, recognition, refine, report, routing, spatial, taxonomy
from ..sources import images
from ..streaming import bursts as stream
from . import adapters as A

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(function):
        _QUERIES[function.__name__] = function
        if sql:
            _SQL[function.__name__] = sql
        return function

    return add


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _bursts(spark, d) -> DataFrame:
    return burst.sessions(A.frames(spark, d), A.GAP)


def _kept(spark, d) -> DataFrame:
    return burst.best_frames(_bursts(spark, d))


# --- bursts -----------------------------------------------------------------


@_query(f"WITH {A.FRAMES_SQL} SELECT camera, burst_id, count(*) AS n, count(*) FILTER (keep) AS kept, min(us) AS first_us, max(us) AS last_us, max(focus) AS best_focus FROM kept WHERE burst_id IS NOT NULL GROUP BY 1, 2")
def burst_summary(spark, d):
    return burst.burst_summary(_kept(spark, d))


@_query(f"WITH {A.FRAMES_SQL} SELECT path, camera, time_diff FROM gaps")
def burst_gap(spark, d):
    return burst.gaps(A.frames(spark, d)).select("path", "camera", "time_diff")


@_query(f"WITH {A.FRAMES_SQL} SELECT path, camera, sid, n, burst_id FROM bursts")
def burst_sessions(spark, d):
    return _bursts(spark, d).select("path", "camera", "sid", "n", "burst_id")


@_query(f"WITH {A.FRAMES_SQL} SELECT path, camera, sid, n, burst_id FROM bursts")
def burst_sessions_sliced(spark, d):
    return burst.sliced_sessions(A.frames(spark, d), A.GAP, 16).select("path", "camera", "sid", "n", "burst_id")


@_query(f"WITH {A.FRAMES_SQL} SELECT camera, min(us) AS started_us, count(*) AS n FROM cut GROUP BY camera, sid")
def burst_sessions_native(spark, d):
    frames = A.frames(spark, d).select("camera", F.timestamp_micros("us").alias("ts"))
    return stream.batch_sessions(frames, f"{int(A.GAP)} seconds")


@_query(f"WITH {A.FRAMES_SQL} SELECT path, camera FROM bursts WHERE n = 1")
def burst_singletons(spark, d):
    return _bursts(spark, d).filter("n = 1").select("path", "camera")


@_query(f"WITH {A.FRAMES_SQL} SELECT DISTINCT camera, burst_id, n, quota, least(n, greatest(1, CAST(round_even(n * 0.5, 0) AS BIGINT))) AS half_quota FROM quotas WHERE burst_id IS NOT NULL")
def burst_quota(spark, d):
    df = _bursts(spark, d).filter("burst_id is not null").select("camera", "burst_id", "n").distinct()
    return df.withColumns({"quota": N.keep_quota(F.col("n"), 0.2, 2), "half_quota": N.keep_quota(F.col("n"), 0.5, 1)})


@_query(f"WITH {A.FRAMES_SQL} SELECT path, camera, burst_id, rk, quota FROM kept WHERE keep AND n > 1")
def burst_topk(spark, d):
    return _kept(spark, d).filter("keep and n > 1").select("path", "camera", "burst_id", "rk", "quota")


@_query(f"WITH {A.FRAMES_SQL} SELECT count(*) AS total, count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS discarded, count(*) FILTER (n > 1 AND pos = 1) AS bursts, count(*) FILTER (n = 1) AS singles FROM kept")
def burst_totals(spark, d):
    first = F.row_number().over(Window.partitionBy("camera", "sid").orderBy("us", "path")) == 1
    return burst.totals(_kept(spark, d).withColumn("first_of_session", first))


@_query(f"""WITH {A.FRAMES_SQL}, vetoed AS (SELECT *, area >= 1000 AS eligible, row_number() OVER (PARTITION BY camera, sid ORDER BY (area >= 1000) DESC, score DESC, us, path) AS vrk FROM quotas)
SELECT path, camera, burst_id, eligible, eligible AND (n = 1 OR vrk <= quota) AS keep FROM vetoed""")
def burst_veto(spark, d):
    return burst.best_frames(_bursts(spark, d), min_area=1000).select("path", "camera", "burst_id", "eligible", "keep")


@_query(f"""WITH {A.FRAMES_SQL}, p AS (SELECT *, pos - 1 AS place, greatest(3, n // 3) AS cnt FROM bursts),
s AS (SELECT DISTINCT camera, sid, CAST(round_even(i * (n / cnt), 0) AS BIGINT) AS place FROM (SELECT DISTINCT camera, sid, n, cnt, unnest(range(cnt)) AS i FROM p WHERE n > 3)),
j AS (SELECT p.camera, p.path, p.place, p.n, p.focus, p.sid, s.place AS splace, q.focus AS sfocus, row_number() OVER (PARTITION BY p.camera, p.path ORDER BY abs(s.place - p.place), s.place) AS r
  FROM p JOIN s ON p.camera = s.camera AND p.sid = s.sid JOIN p q ON q.camera = s.camera AND q.sid = s.sid AND q.place = s.place)
SELECT camera, path, place = splace AS sampled, CASE WHEN place = splace THEN focus ELSE sfocus * 0.95 END AS est_focus FROM j WHERE r = 1
UNION ALL SELECT camera, path, true, focus FROM p WHERE n <= 3""")
def burst_fast_sample(spark, d):
    return burst.sampled_scores(_bursts(spark, d)).select("camera", "path", "sampled", "est_focus")


@_query(f"""WITH {A.FRAMES_SQL}, p AS (SELECT *, pos - 1 AS place, greatest(3, n // 3) AS cnt FROM quotas),
s AS (SELECT DISTINCT camera, sid, CAST(round_even(i * (n / cnt), 0) AS BIGINT) AS place FROM (SELECT DISTINCT camera, sid, n, cnt, unnest(range(cnt)) AS i FROM p WHERE n > 3))
SELECT p.camera, p.path, p.place AS at, CASE WHEN n > 1 AND quota >= n THEN 'whole' WHEN n <= 3 OR s.place IS NOT NULL THEN 'measure' ELSE 'estimate' END AS plan
FROM p LEFT JOIN s ON p.camera = s.camera AND p.sid = s.sid AND p.place = s.place""")
def burst_plan(spark, d):
    return evaluation.planned(_bursts(spark, d), False, True).select("camera", "path", "at", "plan")


@_query(f"WITH {A.FRAMES_SQL} SELECT camera, burst_id, path, strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S') AS time, time_diff, has_eye, keep AS kept FROM kept WHERE burst_id IS NOT NULL")
def burst_report_nested(spark, d):
    frames = _kept(spark, d)
    nested = report.nested_report(frames.withColumn("path", F.col("path").cast("string")))
    return nested.select("camera", "burst_id", F.explode("images").alias("i")).select("camera", "burst_id", F.col("i.path").cast("long").alias("path"), "i.time", "i.time_diff", "i.has_eye", "i.kept")


@_query(f"WITH {A.FRAMES_SQL} SELECT 0 AS part, camera, path FROM kept WHERE keep AND n > 1 UNION ALL SELECT 1, camera, path FROM kept WHERE keep AND n = 1")
def kept_union(spark, d):
    return burst.kept_frames(_kept(spark, d)).select("part", "camera", "path")


@_query(f"WITH {A.FRAMES_SQL}, g AS (SELECT path, us, coalesce((us - lag(us) OVER (ORDER BY us, path)) / 1e6, 0.0) AS gap FROM frames) SELECT path, CAST(sum(CASE WHEN gap > 300 THEN 1 ELSE 0 END) OVER (ORDER BY us, path ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sid FROM g")
def burst_giant_folder(spark, d):
    return burst.giant_folder_sessions(A.frames(spark, d), 300.0, 16).select("path", F.col("sid").cast("long").alias("sid"))


# --- classifier candidates ----------------------------------------------------

_SOFTMAX = """
e AS (SELECT vec_id, embedding, list_max(embedding) AS top FROM embeddings),
x AS (SELECT vec_id, list_transform(embedding, lambda v: exp(CAST(v AS DOUBLE) - CAST(top AS DOUBLE))) AS ex FROM e),
u AS (SELECT vec_id, list_sum(ex) AS total, unnest(ex) AS v, unnest(range(len(ex))) AS idx FROM x),
r AS (SELECT vec_id, CAST(idx AS INTEGER) AS idx, v / total AS p, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, idx) AS rank FROM u)"""


@_query(f"WITH {_SOFTMAX} SELECT vec_id, rank, idx, round(p, 4) AS p FROM r WHERE rank <= 5")
def logits_topk(spark, d):
    return refine.softmax_top(A.table(spark, d, "embeddings"), 5, "embedding").select("vec_id", "rank", "idx", F.round("p", 4).alias("p"))


@_query(f"""WITH {_SOFTMAX}, c AS (SELECT vec_id, count(*) FILTER (rank <= 5) AS raw_count, count(*) FILTER (rank <= 5 AND p >= 0.03) AS post_count, max(p) AS top FROM r GROUP BY vec_id)
SELECT vec_id, raw_count, post_count, CASE WHEN post_count = 0 THEN 'all_candidates_filtered_below_unknown_kind_threshold' WHEN top < 0.06 THEN 'top1_conf_below_min_accept' END AS unknown_reason FROM c""")
def logits_accept(spark, d):
    top = refine.softmax_top(A.table(spark, d, "embeddings"), 5, "embedding")
    counts = top.groupBy("vec_id").agg(F.count(F.lit(1)).alias("raw_count"), F.count_if(F.col("p") >= 0.03).alias("post_count"), F.max("p").alias("top_confidence")).withColumn("is_bird", F.lit(True))
    return refine.accepted(counts, 0.06).select("vec_id", "raw_count", "post_count", "unknown_reason")


@_query(f"""WITH {_SOFTMAX}, {A.LISTS_SQL}, {A.SPECIES_SQL},
boxes AS (SELECT vec_id AS image, CAST(label % 2 AS INTEGER) AS det, CASE WHEN vec_id % 6 <> 0 THEN 'P' || (vec_id % 30) END AS province FROM embeddings),
cand AS (SELECT b.*, rank, r.idx, round(p, 4) AS confidence, name FROM boxes b JOIN r ON b.image = r.vec_id JOIN species USING (idx) WHERE rank <= 2),
{A.REFINED_SQL},
raw AS (SELECT image, det, count(*) AS raw_count, arg_min(name, rank) AS raw_top_name, arg_min(confidence, rank) AS raw_top_confidence FROM cand GROUP BY ALL),
post AS (SELECT image, det, count(*) AS post_count, arg_min(name, new_rank) AS post_top_name, arg_min(confidence, new_rank) AS post_top_confidence FROM reranked GROUP BY ALL),
o AS (SELECT boxes.image, boxes.det, coalesce(raw_count, 0) AS raw_count, raw_top_name, raw_top_confidence, coalesce(post_count, 0) AS post_count, post_top_name, post_top_confidence, f.floor
  FROM boxes LEFT JOIN raw USING (image, det) LEFT JOIN post USING (image, det), (VALUES (CAST(NULL AS DOUBLE)), (0.025)) f(floor))
SELECT *, CASE WHEN raw_count = 0 THEN 'no_model_candidates' WHEN post_count = 0 AND floor IS NULL THEN 'all_candidates_removed_by_geo_rules'
  WHEN post_count = 0 THEN 'all_candidates_filtered_below_unknown_kind_threshold' WHEN post_top_confidence < floor THEN 'top1_conf_below_min_accept' END AS unknown_reason FROM o""")
def recognition_outcomes(spark, d):
    e = A.table(spark, d, "embeddings")
    boxes = e.select(F.col("vec_id").alias("image"), F.pmod("label", F.lit(2)).cast("int").alias("det"), F.col("embedding").alias("logits"))
    place = F.when(F.pmod("image", F.lit(6)) != 0, F.concat(F.lit("P"), F.pmod("image", F.lit(30)).cast("string")))
    raw = recognition.candidates(boxes, A.species(spark, d), 2).withColumn("province", place)
    passed = refine.refined(raw, A.regional(spark, d), A.national(spark, d))
    judged = [recognition.outcomes(boxes, raw, passed, floor).withColumn("floor", F.lit(floor).cast("double")) for floor in (None, 0.025)]
    return judged[0].unionByName(judged[1]).drop("is_bird", "accepted", "detail")


@_query(f"WITH {A.CANDIDATES_SQL} SELECT image, det, rank, idx, listed, in_national FROM flagged")
def geo_flag(spark, d):
    return refine.whitelist_flags(A.candidates(spark, d).filter("rank <= 10"), A.regional(spark, d), A.national(spark, d)).select("image", "det", "rank", "idx", "listed", "in_national")


@_query(f"WITH {A.CANDIDATES_SQL} SELECT image, det, rank, idx, confidence, listed FROM passed")
def geo_admit(spark, d):
    flagged = refine.whitelist_flags(A.candidates(spark, d).filter("rank <= 10"), A.regional(spark, d), A.national(spark, d))
    return refine.admitted(flagged).select("image", "det", "rank", "idx", "confidence", "listed")


@_query(f"WITH {A.CANDIDATES_SQL} SELECT image, det, rank, row_number() OVER (PARTITION BY image, det ORDER BY confidence + CASE WHEN in_national THEN 0.005 ELSE 0.0 END DESC, rank) AS new_rank FROM flagged")
def geo_rank_bonus(spark, d):
    flagged = refine.whitelist_flags(A.candidates(spark, d).filter("rank <= 10"), A.regional(spark, d), A.national(spark, d))
    return refine.reranked(flagged).select("image", "det", "rank", "new_rank")


@_query(f"WITH {A.CANDIDATES_SQL} SELECT image, det, rank, idx, confidence, new_rank FROM reranked")
def geo_refine_full(spark, d):
    return refine.refined(A.candidates(spark, d), A.regional(spark, d), A.national(spark, d)).select("image", "det", "rank", "idx", "confidence", "new_rank")


@_query(f"""WITH {A.CANDIDATES_SQL}, t AS (SELECT c.*, r.region IS NOT NULL AS is_in, first_value(confidence) OVER w AS top, first_value(r.region IS NOT NULL) OVER w AS top_in FROM cand c LEFT JOIN regional r ON c.province = r.region AND c.idx = r.idx
  WINDOW w AS (PARTITION BY image, det ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
b AS (SELECT *, CASE WHEN is_in AND NOT top_in AND rank <= 5 AND confidence + 0.35 >= top THEN row_number() OVER (PARTITION BY image, det, (is_in AND NOT top_in AND rank <= 5 AND confidence + 0.35 >= top) ORDER BY confidence DESC, rank) END AS pick FROM t)
SELECT image, det, rank, row_number() OVER (PARTITION BY image, det ORDER BY CASE WHEN pick = 1 THEN 0 ELSE 1 END, rank) AS new_rank FROM b""")
def geo_promote(spark, d):
    return refine.promoted(A.candidates(spark, d), A.regional(spark, d)).select("image", "det", "rank", "new_rank")


@_query(f"WITH {A.CANDIDATES_SQL} SELECT image, det, max(CAST(province IN (SELECT region FROM regional) AS INTEGER)) = 1 AS has_region, count(*) FILTER (listed) AS listed FROM flagged GROUP BY image, det")
def province_or_country(spark, d):
    flagged = refine.whitelist_flags(A.candidates(spark, d).filter("rank <= 10"), A.regional(spark, d), A.national(spark, d))
    known = F.max(F.when(F.col("province").isNull(), F.lit(None)).otherwise(F.col("has_region")))
    return flagged.groupBy("image", "det").agg(known.alias("has_region"), F.count_if("listed").alias("listed"))


def _region_tables(spark, d):
    s, n, p = (A.table(spark, d, t) for t in ("supplier", "nation", "part"))
    regions = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("CN-"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("region_key"), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("shared "), F.col("n_regionkey").cast("string"))).otherwise(F.col("n_name")).alias("region_name"), (24 - F.col("n_nationkey")).alias("ord"), F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("species_code"))
    codes = p.filter("p_partkey % 3 <> 0").select(F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("code"), F.col("p_partkey").alias("idx"))
    return regions, codes


_REGION_SQL = """
rs AS (SELECT 'CN-' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS region_key, CASE WHEN n_nationkey % 3 = 0 THEN 'shared ' || n_regionkey ELSE n_name END AS region_name, 24 - n_nationkey AS ord, 'c' || s_suppkey AS species_code FROM supplier JOIN nation ON s_nationkey = n_nationkey),
codes AS (SELECT 'c' || p_partkey AS code, p_partkey AS idx FROM part WHERE p_partkey % 3 <> 0)"""


@_query(f"WITH {_REGION_SQL}, k AS (SELECT * FROM rs JOIN codes ON species_code = code), owner AS (SELECT region_name, arg_max(region_key, ord) AS region_key FROM k GROUP BY region_name) SELECT DISTINCT region_name AS region, idx FROM k JOIN owner USING (region_name, region_key)")
def code_index_inner(spark, d):
    return taxonomy.whitelist(*_region_tables(spark, d))


@_query(f"WITH {_REGION_SQL} SELECT DISTINCT idx FROM rs JOIN codes ON species_code = code")
def national_union(spark, d):
    return taxonomy.national_list(*_region_tables(spark, d))


_GENERA = [("Larus", "鸻形目", "鸥科"), ("Falco", "隼形目", "隼科")]


@_query(f"""WITH {A.TAXONOMY_SQL}, {A.NAMES_SQL},
by_sci AS (SELECT DISTINCT ON (name_la) * FROM tax ORDER BY name_la, ord DESC), by_genus AS (SELECT DISTINCT ON (genus_la) * FROM tax ORDER BY genus_la, ord), by_cn AS (SELECT DISTINCT ON (species_cn) * FROM tax ORDER BY species_cn, ord DESC),
genera(genus, order_cn, family_cn) AS (VALUES ('Larus', '鸻形目', '鸥科'), ('Falco', '隼形目', '隼科'))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN s.ord IS NOT NULL THEN 'sci' WHEN g.ord IS NOT NULL THEN 'genus' WHEN c.ord IS NOT NULL THEN 'cn' WHEN t.genus IS NOT NULL THEN 'table' ELSE 'none' END AS matched,
  CASE WHEN s.ord IS NOT NULL THEN s.order_cn WHEN g.ord IS NOT NULL THEN g.order_cn WHEN c.ord IS NOT NULL THEN c.order_cn ELSE coalesce(t.order_cn, '未知目') END AS order_cn,
  CASE WHEN s.ord IS NOT NULL THEN s.family_cn WHEN g.ord IS NOT NULL THEN g.family_cn WHEN c.ord IS NOT NULL THEN c.family_cn ELSE coalesce(t.family_cn, '未知科') END AS family_cn,
  CASE WHEN s.ord IS NOT NULL THEN s.genus_cn WHEN g.ord IS NOT NULL THEN g.genus_cn WHEN c.ord IS NOT NULL THEN c.genus_cn ELSE coalesce(t.genus, nullif(split_part(sci, ' ', 1), ''), '未知属') END AS genus_cn,
  CASE WHEN s.ord IS NOT NULL THEN s.species_cn WHEN g.ord IS NOT NULL THEN coalesce(nullif(cn, ''), g.species_cn) WHEN c.ord IS NOT NULL THEN c.species_cn ELSE coalesce(nullif(cn, ''), '未知种') END AS species_cn
FROM names LEFT JOIN by_sci s ON sci = s.name_la LEFT JOIN by_genus g ON split_part(sci, ' ', 1) = g.genus_la LEFT JOIN by_cn c ON cn = c.species_cn LEFT JOIN genera t ON split_part(sci, ' ', 1) = t.genus""")
def classify_cascade(spark, d):
    genera = spark.createDataFrame(_GENERA, "genus string, order_cn string, family_cn string")
    return taxonomy.classified(A.names(spark, d), A.taxonomy(spark, d), genera).drop("cn", "sci")


@_query(f"""WITH {A.TAXONOMY_SQL}, {A.NAMES_SQL},
canon AS (SELECT DISTINCT ON (name_la) name_la, species_cn FROM tax ORDER BY name_la, ord DESC), i1 AS (SELECT p_brand || ' ' || p_size AS sci, min(p_partkey) AS idx FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), i2 AS (SELECT p_name AS cn, min(p_partkey) AS idx FROM part WHERE p_partkey % 2 = 0 GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(CASE WHEN l_suppkey % 5 = 0 THEN l_partkey END, i1.idx, i2.idx) AS idx, coalesce(c.species_cn, n.cn) AS cn, CASE WHEN n.cn <> '' AND c.species_cn <> n.cn THEN n.cn END AS cn_raw
FROM names n LEFT JOIN canon c ON n.sci = c.name_la LEFT JOIN i1 ON n.sci = i1.sci LEFT JOIN i2 ON n.cn = i2.cn""")
def name_backfill(spark, d):
    given = A.names(spark, d).withColumn("idx", F.when(F.pmod("l_suppkey", F.lit(5)) == 0, F.col("l_partkey")).otherwise(F.lit(-1)))
    species = A.table(spark, d, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("cn"), F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")).alias("sci"))
    return taxonomy.normalised_names(given, A.taxonomy(spark, d), species).drop("sci")


@_query(f"WITH {A.TAXONOMY_SQL} SELECT genus_la, min(ord) AS first_ord, max(ord) AS last_ord, arg_min(species_cn, ord) AS first_cn, arg_max(species_cn, ord) AS last_cn FROM tax GROUP BY genus_la")
def first_last_wins(spark, d):
    tax = A.taxonomy(spark, d)
    first = taxonomy.first_wins(tax, "genus_la", "ord").select(F.col("_key").alias("genus_la"), F.col("ord").alias("first_ord"), F.col("species_cn").alias("first_cn"))
    return first.join(taxonomy.last_wins(tax, "genus_la", "ord").select(F.col("_key").alias("genus_la"), F.col("ord").alias("last_ord"), F.col("species_cn").alias("last_cn")), "genus_la")


# --- positions ----------------------------------------------------------------

_HIT = "bit_xor(CAST((e.yi > p.lat) <> (e.yj > p.lat) AND p.lon < (e.xj - e.xi) * (p.lat - e.yi) / (e.yj - e.yi + 1e-15) + e.xi AS INTEGER)) = 1"


@_query(f"""WITH {A.POINTS_SQL}, {A.edges_sql('edges', A.PROVINCES)},
hits AS (SELECT pid, ord, name FROM points p CROSS JOIN edges e WHERE p.lat IS NOT NULL GROUP BY pid, ord, name HAVING {_HIT})
SELECT pid, (SELECT arg_min(name, ord) FROM hits h WHERE h.pid = points.pid) AS region FROM points WHERE lat IS NOT NULL""")
def pip_region(spark, d):
    regions = A.rings(spark, A.PROVINCES, "ord int, name string")
    return spatial.located(A.points(spark, d).filter("lat is not null"), regions, ["pid"]).select("pid", "region")


_GCJ_X, _GCJ_Y = "(lon - 105.0)", "(lat - 35.0)"
_WAVE = lambda x, *t: "(" + " + ".join(f"{w} * sin({x} * {math.pi / p!r})" for w, p in t) + f") * {2.0 / 3.0!r}"
_GCJ_SQL = f"""
moved AS (SELECT pid, lat, lon, (-100.0 + 2.0 * {_GCJ_X} + 3.0 * {_GCJ_Y} + 0.2 * {_GCJ_Y} * {_GCJ_Y} + 0.1 * {_GCJ_X} * {_GCJ_Y} + 0.2 * sqrt(abs({_GCJ_X})) + {_WAVE(_GCJ_X, (20.0, 1 / 6), (20.0, 1 / 2))} + {_WAVE(_GCJ_Y, (20.0, 1), (40.0, 3))} + {_WAVE(_GCJ_Y, (160.0, 12), (320.0, 30))}) AS north,
  (300.0 + {_GCJ_X} + 2.0 * {_GCJ_Y} + 0.1 * {_GCJ_X} * {_GCJ_X} + 0.1 * {_GCJ_X} * {_GCJ_Y} + 0.1 * sqrt(abs({_GCJ_X})) + {_WAVE(_GCJ_X, (20.0, 1 / 6), (20.0, 1 / 2))} + {_WAVE(_GCJ_X, (20.0, 1), (40.0, 3))} + {_WAVE(_GCJ_X, (150.0, 12), (300.0, 30))}) AS east,
  1.0 - 0.00669342162296594323 * sin(radians(lat)) * sin(radians(lat)) AS magic, lon BETWEEN 72.004 AND 137.8347 AND lat BETWEEN 0.8293 AND 55.8271 AS inside FROM points WHERE lat IS NOT NULL),
gcj AS (SELECT pid, lat, lon, CASE WHEN inside THEN lat + north * 180.0 / (6378245.0 * (1 - 0.00669342162296594323) / (magic * sqrt(magic)) * pi()) ELSE lat END AS glat, CASE WHEN inside THEN lon + east * 180.0 / (6378245.0 / sqrt(magic) * cos(radians(lat)) * pi()) ELSE lon END AS glon FROM moved)"""


@_query(f"""WITH {A.POINTS_SQL}, {_GCJ_SQL}, {A.edges_sql('edges', A.PROVINCES)}, {A.edges_sql('cedges', A.CITIES)},
att AS (SELECT pid, 0 AS attempt, lat, lon FROM gcj UNION ALL SELECT pid, 1, glat, glon FROM gcj UNION ALL SELECT pid, 2, lon, lat FROM gcj),
hits AS (SELECT pid, attempt, p.lat, p.lon, ord, name FROM att p CROSS JOIN edges e GROUP BY pid, attempt, p.lat, p.lon, ord, name HAVING {_HIT}),
best AS (SELECT DISTINCT ON (pid) pid, lat, lon, name AS province FROM hits ORDER BY pid, attempt, ord),
chits AS (SELECT pid, ord, name FROM best p JOIN cedges e ON e.parent = p.province GROUP BY pid, ord, name HAVING {_HIT})
SELECT pid, CASE WHEN points.lat IS NULL THEN 'no_coords' WHEN province IS NULL THEN 'no_match' ELSE 'ok' END AS status, province, (SELECT arg_min(name, ord) FROM chits c WHERE c.pid = points.pid) AS city FROM points LEFT JOIN best USING (pid)""")
def pip_city_nested(spark, d):
    provinces, cities = A.rings(spark, A.PROVINCES, "ord int, name string"), A.rings(spark, A.CITIES, "ord int, parent string, name string")
    return spatial.location_meta(A.points(spark, d), provinces, cities, "pid").select("pid", "status", "province", "city")


@_query("SELECT c_custkey AS pid, coalesce(province, 'Given') AS province, CASE WHEN province IS NULL THEN 'Town' ELSE city END AS city FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS province, CASE WHEN c_custkey % 6 = 0 THEN c_name END AS city FROM customer)")
def manual_override(spark, d):
    df = A.table(spark, d, "customer").select(F.col("c_custkey").alias("pid"), F.when(F.pmod("c_custkey", F.lit(3)) == 0, F.col("c_mktsegment")).alias("province"), F.when(F.pmod("c_custkey", F.lit(6)) == 0, F.col("c_name")).alias("city"))
    return spatial.with_override(df, "Given", "Town")


_PLACE_KEYS = [("BUILD", "Build"), ("MACHINE", "Machine"), ("AUTO", "Auto")]


@_query("""WITH n AS (SELECT c_custkey AS pid, CASE c_custkey % 4 WHEN 0 THEN ' "' || c_mktsegment || '" ' WHEN 1 THEN (c_custkey % 100) || ', ' || (c_custkey % 200) WHEN 2 THEN 'x,1' ELSE c_name END AS name FROM customer),
clean AS (SELECT *, trim(trim(trim(name, ' '), '"'), '''') AS c FROM n),
lit AS (SELECT *, TRY_CAST(trim(split_part(c, ',', 1)) AS DOUBLE) AS a, TRY_CAST(trim(split_part(c, ',', 2)) AS DOUBLE) AS b FROM clean)
SELECT pid, CASE WHEN c = 'BUILDING' THEN 1.5 WHEN c = 'MACHINERY' THEN -2.5 WHEN a BETWEEN -90 AND 90 AND b BETWEEN -180 AND 180 THEN a END AS lat, CASE WHEN c = 'BUILDING' THEN 2.5 WHEN c = 'MACHINERY' THEN 3.5 WHEN a BETWEEN -90 AND 90 AND b BETWEEN -180 AND 180 THEN b END AS lon,
  CASE WHEN c IN ('BUILDING', 'MACHINERY') THEN 'dictionary' WHEN a BETWEEN -90 AND 90 AND b BETWEEN -180 AND 180 THEN 'literal' END AS tier,
  CASE WHEN contains(name, 'BUILD') THEN 'Build' WHEN contains(name, 'MACHINE') THEN 'Machine' WHEN contains(name, 'AUTO') THEN 'Auto' END AS keyword_en FROM lit""")
def geocode_cascade(spark, d):
    c = A.table(spark, d, "customer")
    k = F.pmod("c_custkey", F.lit(4))
    number = lambda n: F.pmod("c_custkey", F.lit(n)).cast("string")
    name = F.when(k == 0, F.concat(F.lit(' "'), F.col("c_mktsegment"), F.lit('" '))).when(k == 1, F.concat(number(100), F.lit(", "), number(200))).when(k == 2, "x,1").otherwise(F.col("c_name"))
    places = spark.createDataFrame([("BUILDING", 1.5, 2.5), ("MACHINERY", -2.5, 3.5)], "name string, lat double, lon double")
    none = spark.createDataFrame([], "zh string, en string")
    found = spatial.geocoded(c.select(F.col("c_custkey").alias("pid"), name.alias("name")), places)
    return spatial.english_names(found, _PLACE_KEYS, none).select("pid", "lat", "lon", "tier", "keyword_en")


@_query(f"WITH {A.POINTS_SQL}, {_GCJ_SQL} SELECT pid, round(glat, 6) AS lat, round(glon, 6) AS lon FROM gcj")
def gcj02(spark, d):
    lat, lon = G.gcj02(F.col("lat"), F.col("lon"))
    return A.points(spark, d).filter("lat is not null").select("pid", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@_query(f"""WITH {A.POINTS_SQL}, v AS (SELECT pid, lat, abs(lat) AS v FROM points WHERE lat IS NOT NULL), p AS (SELECT *, CAST(floor(v) AS INTEGER) AS deg, CAST(floor((v - floor(v)) * 60) AS INTEGER) AS mins FROM v),
q AS (SELECT *, CAST(floor(((v - deg) * 60 - mins) * 60 * 100) AS INTEGER) AS secs FROM p)
SELECT pid, deg, mins, secs, (CASE WHEN lat < 0 THEN -1 ELSE 1 END) * (deg / 1 + (mins / 1) / 60.0 + (secs / 100) / 3600.0) AS back FROM q""")
def dms_roundtrip(spark, d):
    df = A.points(spark, d).filter("lat is not null").withColumn("dms", G.to_dms(F.col("lat")))
    back = G.from_dms(F.col("dms"), F.when(F.col("lat") < 0, "S").otherwise("N"))
    return df.select("pid", F.col("dms")[0]["num"].alias("deg"), F.col("dms")[1]["num"].alias("mins"), F.col("dms")[2]["num"].alias("secs"), back.alias("back"))


@_query(f"""WITH {A.POINTS_SQL}, x AS (SELECT pid, '<exif:GPSLatitude>' || CASE WHEN pid % 2 = 0 THEN CAST(pid % 95 AS VARCHAR) || '.5' ELSE (pid % 90) || ', 30, 18' END || '</exif:GPSLatitude><exif:GPSLatitudeRef>' || CASE WHEN pid % 3 = 0 THEN 'South' ELSE 'N' END || '</exif:GPSLatitudeRef><exif:GPSLongitude>' || (pid % 180) || '</exif:GPSLongitude><exif:GPSLongitudeRef>W</exif:GPSLongitudeRef>' AS xml FROM points),
a AS (SELECT pid, regexp_extract(xml, 'GPSLatitude>([^<]+)<', 1) AS la, CASE WHEN contains(xml, 'South') THEN -1 ELSE 1 END AS s, CAST(regexp_extract(xml, 'GPSLongitude>([^<]+)<', 1) AS DOUBLE) AS lo FROM x),
b AS (SELECT pid, s * CASE WHEN contains(la, ',') THEN CAST(split_part(la, ',', 1) AS DOUBLE) + CAST(trim(split_part(la, ',', 2)) AS DOUBLE) / 60.0 + CAST(trim(split_part(la, ',', 3)) AS DOUBLE) / 3600.0 ELSE CAST(la AS DOUBLE) END AS lat, CASE WHEN lo > 0 THEN -lo ELSE lo END AS lon FROM a)
SELECT pid, CASE WHEN lat BETWEEN -90 AND 90 THEN lat END AS lat, CASE WHEN lat BETWEEN -90 AND 90 THEN lon END AS lon FROM b""")
def xmp_axis(spark, d):
    pid = F.col("pid")
    text = lambda n: F.pmod(pid, F.lit(n)).cast("string")
    body = F.when(F.pmod(pid, F.lit(2)) == 0, F.concat(text(95), F.lit(".5"))).otherwise(F.concat(text(90), F.lit(", 30, 18")))
    ref = F.when(F.pmod(pid, F.lit(3)) == 0, "South").otherwise("N")
    xml = F.concat(F.lit("<exif:GPSLatitude>"), body, F.lit("</exif:GPSLatitude><exif:GPSLatitudeRef>"), ref, F.lit("</exif:GPSLatitudeRef><exif:GPSLongitude>"), text(180), F.lit("</exif:GPSLongitude><exif:GPSLongitudeRef>W</exif:GPSLongitudeRef>"))
    at = images.xmp_position(F.col("xml"))
    return A.points(spark, d).withColumn("xml", xml).select("pid", at["lat"].alias("lat"), at["lon"].alias("lon"))


# --- boxes and archive ----------------------------------------------------------


@_query(f"""WITH {A.BOXES_SQL}, m AS (SELECT *, CAST(floor(greatest(x2 - x1, y2 - y1, 1) * 0.12) AS INTEGER) AS m FROM boxes)
SELECT image, det, part, (x2 - x1) * (y2 - y1) AS area, greatest(0, x1 - m) AS ex1, greatest(0, y1 - m) AS ey1, least(640, x2 + m) AS ex2, least(480, y2 + m) AS ey2, greatest(0, x1 - 10) AS px1, least(480, y2 + 10) AS py2, greatest(0, x1 - (x2 - x1)) AS ax1, least(480, y2 + (y2 - y1)) AS ay2 FROM m""")
def bbox_expand(spark, d):
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2", "width", "height")]
    e, p, a = B.expanded(*box, 0.12), B.padded(*box), B.by_axis(*box)
    return A.boxes(spark, d).select("image", "det", "part", B.area(*box[:4]).alias("area"), *[c.alias(n) for c, n in zip(e, ("ex1", "ey1", "ex2", "ey2"), strict=True)], p[0].alias("px1"), p[3].alias("py2"), a[0].alias("ax1"), a[3].alias("ay2"))


@_query(f"WITH {A.BOXES_SQL} SELECT image, key, greatest(min(x1), 0) AS x1, greatest(min(y1), 0) AS y1, least(max(x2), 640) AS x2, least(max(y2), 480) AS y2, count(*) AS boxes FROM boxes GROUP BY image, key HAVING least(max(x2), 640) > greatest(min(x1), 0) AND least(max(y2), 480) > greatest(min(y1), 0)")
def bbox_union(spark, d):
    return archive.union_boxes(A.boxes(spark, d), ["image", "key"]).select("image", "key", "x1", "y1", "x2", "y2", "boxes")


@_query(f"WITH {A.BOXES_SQL}, e AS (SELECT *, x1 + (part % 40) AS px, y1 + (part % 25) AS py FROM boxes) SELECT image, det, part, px BETWEEN x1 - (x2 - x1) * 0.06 AND x2 + (x2 - x1) * 0.06 AND py BETWEEN y1 - (y2 - y1) * 0.06 AND y2 + (y2 - y1) * 0.06 AS eye_inside FROM e")
def eye_in_box(spark, d):
    df = A.boxes(spark, d).withColumns({"px": F.col("x1") + F.pmod("part", F.lit(40)), "py": F.col("y1") + F.pmod("part", F.lit(25))})
    return df.select("image", "det", "part", B.holds(*[F.col(c) for c in ("px", "py", "x1", "y1", "x2", "y2")], 0.06).alias("eye_inside"))


#: Line items as detections with four eyes each, placed by arithmetic; some lie outside.
_DETECTED_SQL = f"""WITH {A.BOXES_SQL}, d AS (SELECT *, row_number() OVER () AS rid, CASE WHEN part % 4 = 0 THEN 2 ELSE 14 END AS cls, (part % 10) / 10e0 AS conf FROM boxes), b AS (SELECT * FROM d WHERE cls = 14 AND conf >= 0.3e0),
e AS (SELECT b.*, j, (part * (j + 7)) % 10 / 10e0 AS eye_conf, x1 + (part * (j + 3)) % 60 AS px, y1 + (part * (j + 5)) % 30 AS py FROM b, (SELECT unnest(range(4)) AS j)),
k AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY eye_conf DESC, j) AS r FROM e
  WHERE px BETWEEN x1 - (x2 - x1) * 0.06 AND x2 + (x2 - x1) * 0.06 AND py BETWEEN y1 - (y2 - y1) * 0.06 AND y2 + (y2 - y1) * 0.06)"""


def _detected(spark, d) -> DataFrame:
    eye = lambda j: F.struct(
        F.lit(j).alias("ord"), *[(F.col(c) + F.pmod(F.col("part") * (j + f), F.lit(m)) + s).cast("double").alias(n) for n, c, f, m, s in (("x1", "x1", 3, 60, -1), ("y1", "y1", 5, 30, -2), ("x2", "x1", 3, 60, 1), ("y2", "y1", 5, 30, 2))],
        (F.pmod(F.col("part") * (j + 7), F.lit(10)) / 10.0).alias("conf"), F.lit(0).alias("cls"),
    )
    bird = F.struct(F.col("det").cast("int").alias("ord"), "x1", "y1", "x2", "y2", (F.pmod("part", F.lit(10)) / 10.0).alias("conf"), F.when(F.pmod("part", F.lit(4)) == 0, 2).otherwise(14).alias("cls"), F.array(*[eye(j) for j in range(4)]).alias("eyes"))
    return A.boxes(spark, d).groupBy("image").agg(F.array_sort(F.collect_list(bird)).alias("birds"))  # some seven boxes an image


@_query(_DETECTED_SQL + """, n AS (SELECT image, count(*) AS n_birds, max((x2 - x1) * (y2 - y1)) AS area FROM b GROUP BY image),
f AS (SELECT image, det FROM (SELECT image, det, row_number() OVER (PARTITION BY image ORDER BY (x2 - x1) * (y2 - y1) DESC, det) AS r FROM b) WHERE r = 1), c AS (SELECT image, count(*) AS n_eyes FROM k WHERE r <= 2 GROUP BY image)
SELECT i.image, coalesce(n_birds, 0) AS n_birds, coalesce(area, 0)::DOUBLE AS area, f.det AS best, coalesce(n_eyes, 0) AS n_eyes, coalesce(n_eyes, 0) > 0 AS has_eye FROM (SELECT DISTINCT image FROM boxes) i LEFT JOIN n USING (image) LEFT JOIN f USING (image) LEFT JOIN c USING (image)""")
def screened_images(spark, d):
    return detection.screened(_detected(spark, d)).select("image", "n_birds", "area", F.col("best.ord").alias("best"), "n_eyes", "has_eye")


@_query(_DETECTED_SQL + " SELECT image, det, CAST(r AS INTEGER) AS place, j AS eye, eye_conf FROM k WHERE r <= 2")
def surest_eyes(spark, d):
    df = detection.screened(_detected(spark, d)).select("image", F.explode("birds").alias("b"))
    df = df.select("image", F.col("b.ord").alias("det"), F.posexplode("b.eyes").alias("at", "e"))
    return df.select("image", "det", (F.col("at") + 1).alias("place"), F.col("e.ord").cast("long").alias("eye"), F.col("e.conf").alias("eye_conf"))


@_query(f"WITH {A.CANDIDATES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY confidence DESC, det, rank) AS r FROM cand) SELECT image, confidence, det, rank, idx FROM o WHERE r = 1")
def best_candidate(spark, d):
    return archive.best_candidate(A.candidates(spark, d), ["det", "rank", "idx"])


def _archive_rows(spark, d) -> DataFrame:
    p = A.table(spark, d, "part")
    k = F.col("p_partkey")
    return p.select(
        k, (F.pmod(k, F.lit(5)) == 0).alias("other"), F.when(F.pmod(k, F.lit(7)) != 0, F.concat(F.lit("a/b:"), "p_brand")).alias("order_cn"), F.col("p_type").alias("family_cn"), F.when(F.pmod(k, F.lit(3)) == 0, "").otherwise(F.concat(F.lit("g?"), F.col("p_size").cast("string"))).alias("genus_cn"), F.col("p_name").alias("species_cn"),
        F.when(F.pmod(k, F.lit(2)) == 0, F.lit("浙江")).alias("province"), F.when(F.pmod(k, F.lit(4)) == 0, F.lit("杭|州")).otherwise("").alias("city"), (k * 97).alias("seq"), F.concat(F.lit("/in/IMG "), k.cast("string"), F.when(F.pmod(k, F.lit(6)) == 0, "").otherwise(".JPG")).alias("path"),
    )


_SAFE = lambda x: f"regexp_replace({x}, '[\\\\/:*?\"<>|]', '_', 'g')"
_ARCHIVE_SQL = f"""
a AS (SELECT p_partkey, p_partkey % 5 = 0 AS other, {_SAFE("CASE WHEN p_partkey % 7 <> 0 THEN 'a/b:' || p_brand ELSE '未知目' END")} AS o, {_SAFE('p_type')} AS f, {_SAFE("CASE WHEN p_partkey % 3 = 0 THEN '未知属' ELSE 'g?' || p_size END")} AS g, {_SAFE('p_name')} AS s,
  CASE WHEN p_partkey % 2 = 0 THEN '浙江' ELSE '未知省' END AS prov, CASE WHEN p_partkey % 4 = 0 THEN '杭_州' ELSE '未知市' END AS city, p_partkey * 97 AS seq FROM part),
z AS (SELECT *, CASE WHEN length(CAST(seq AS VARCHAR)) >= 5 THEN CAST(seq AS VARCHAR) ELSE lpad(CAST(seq AS VARCHAR), 5, '0') END AS num FROM a)"""


@_query(f"""WITH {_ARCHIVE_SQL} SELECT p_partkey, CASE WHEN other THEN o || '/' || f ELSE o || '/' || f || '/' || g || '/' || s END AS directory,
CASE WHEN other THEN concat_ws('_', o, f, prov, city, num) ELSE concat_ws('_', o, f, g, s, prov, city, num) END || '.jpg' AS filename,
'IMG ' || p_partkey || '_' || prov || '_' || city || '_' || num || CASE WHEN p_partkey % 6 = 0 THEN '.jpg' ELSE '.JPG' END AS copy_name FROM z""")
def archive_path(spark, d):
    named = archive.crop_names(_archive_rows(spark, d)).withColumnRenamed("filename", "crop_name")
    return archive.copy_names(named).select("p_partkey", "directory", F.col("crop_name").alias("filename"), F.col("filename").alias("copy_name"))


@_query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '__nb__|其它|' || CASE WHEN p_size % 2 = 0 THEN p_type ELSE '未分类' END ELSE coalesce(nullif(CASE WHEN p_partkey % 4 = 1 THEN p_brand ELSE '' END, ''), nullif(CASE WHEN p_partkey % 4 = 2 THEN p_name ELSE '' END, ''), '未知物种') END AS key FROM part""")
def archive_key(spark, d):
    k = F.pmod("p_partkey", F.lit(4))
    key = archive.species_key(F.when(k == 1, F.col("p_brand")).otherwise(""), F.when(k == 2, F.col("p_name")).otherwise(""), F.when(k == 0, "其它"), F.when(F.pmod("p_size", F.lit(2)) == 0, F.col("p_type")))
    return A.table(spark, d, "part").select("p_partkey", key.alias("key"))


@_query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS seq, CASE WHEN row_number() OVER (ORDER BY o_orderkey) > 99999 THEN CAST(row_number() OVER (ORDER BY o_orderkey) AS VARCHAR) ELSE lpad(CAST(row_number() OVER (ORDER BY o_orderkey) AS VARCHAR), 5, '0') END AS padded FROM orders")
def archive_seq(spark, d):
    df = archive.numbered(A.table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 16)
    return df.withColumn("padded", T.padded_number(F.col("seq")))


@_query("""SELECT r_name AS order_cn, n_name AS family_cn, c_mktsegment AS genus_cn, 'x' || (c_custkey % 3) AS species_cn, count(*) AS n, CAST(grouping(r_name, n_name, c_mktsegment, 'x' || (c_custkey % 3)) AS INTEGER) AS level
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment, 'x' || (c_custkey % 3))""")
def archive_rollup(spark, d):
    c, n, r = (A.table(spark, d, t) for t in ("customer", "nation", "region"))
    df = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return archive.species_rollup(df.select(F.col("r_name").alias("order_cn"), F.col("n_name").alias("family_cn"), F.col("c_mktsegment").alias("genus_cn"), F.concat(F.lit("x"), F.pmod("c_custkey", F.lit(3)).cast("string")).alias("species_cn")))


@_query("SELECT o_orderkey AS path, 'IMG_' || (o_custkey % 200) || CASE WHEN r = 0 THEN '' ELSE '_' || r END || '.jpg' AS target FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey % 200 ORDER BY o_orderkey) - 1 AS r FROM orders)")
def name_collision(spark, d):
    files = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.concat(F.lit("IMG_"), F.pmod("o_custkey", F.lit(200)).cast("string")).alias("stem"), F.lit(".jpg").alias("ext"))
    return archive.collision_names(files).select("path", "target")


@_query(r"""WITH files AS (SELECT o_orderkey AS path, 'IMG_' || (o_custkey % 40) || CASE WHEN o_orderkey % 4 = 0 THEN '_' || (o_orderkey % 23) ELSE '' END AS stem, '.jpg' AS ext FROM orders),
there AS (SELECT DISTINCT 'IMG_' || (c_custkey % 60) || CASE WHEN c_custkey % 3 > 0 THEN '_' || (c_custkey % 50) ELSE '' END AS stem, '.jpg' AS ext FROM customer),
names AS (SELECT stem, ext FROM files UNION SELECT stem, ext FROM there),
taken AS (SELECT DISTINCT regexp_extract(stem, '^(.*)_([1-9][0-9]{0,17})$', 1) AS stem, ext, CAST(regexp_extract(stem, '^(.*)_([1-9][0-9]{0,17})$', 2) AS BIGINT) AS t FROM names WHERE regexp_matches(stem, '^(.*)_([1-9][0-9]{0,17})$')),
sized AS (SELECT stem, ext, count(*) + (SELECT count(*) FROM taken t WHERE t.stem = f.stem AND t.ext = f.ext) + 1 AS top FROM files f GROUP BY stem, ext),
free AS (SELECT stem, ext, i, row_number() OVER (PARTITION BY stem, ext ORDER BY i) AS k FROM (SELECT stem, ext, unnest(range(1, top + 1)) AS i FROM sized) s WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.stem = s.stem AND t.ext = s.ext AND t.t = s.i)),
nth AS (SELECT f.*, row_number() OVER (PARTITION BY f.stem, f.ext ORDER BY path) - CASE WHEN there.stem IS NULL THEN 1 ELSE 0 END AS k FROM files f LEFT JOIN there ON f.stem = there.stem AND f.ext = there.ext)
SELECT path, CASE WHEN nth.k = 0 THEN nth.stem || nth.ext ELSE nth.stem || '_' || i || nth.ext END AS target FROM nth LEFT JOIN free ON nth.stem = free.stem AND nth.ext = free.ext AND nth.k = free.k""")
def name_dodging(spark, d):
    name = lambda key, n: F.concat(F.lit("IMG_"), F.pmod(key, F.lit(n)).cast("string"))
    more = lambda key, n: F.concat(F.lit("_"), F.pmod(key, F.lit(n)).cast("string"))
    files = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.concat(name("o_custkey", 40), F.when(F.col("o_orderkey") % 4 == 0, more("o_orderkey", 23)).otherwise("")).alias("stem"), F.lit(".jpg").alias("ext"))
    there = A.table(spark, d, "customer").select(F.concat(name("c_custkey", 60), F.when(F.col("c_custkey") % 3 > 0, more("c_custkey", 50)).otherwise("")).alias("stem"), F.lit(".jpg").alias("ext"))
    return archive.collision_names(files, there).select("path", "target")



@_query("""WITH p AS (SELECT 'src/' || o_orderkey || CASE o_custkey % 3 WHEN 0 THEN '.NEF' WHEN 1 THEN '.jpg' ELSE '.png' END AS path, o_orderkey FROM orders)
SELECT o_orderkey, 'out/' || o_orderkey || CASE WHEN path LIKE '%.NEF' THEN '.jpg' ELSE right(path, 4) END AS screened FROM p WHERE o_orderkey % 5 <> 0""")
def screened_copies(spark, d):
    o = A.table(spark, d, "orders")
    ext = F.when(F.pmod("o_custkey", F.lit(3)) == 0, ".NEF").when(F.pmod("o_custkey", F.lit(3)) == 1, ".jpg").otherwise(".png")
    kept = o.select("o_orderkey", F.concat(F.lit("src/"), F.col("o_orderkey").cast("string"), ext).alias("path"))
    plan = archive.screened_paths(kept, "src", "out", list(images.RAW))
    there = plan.filter("o_orderkey % 5 <> 0").select(F.col("screened").alias("path"))
    return archive.existing(plan, there).select("o_orderkey", "screened")


@_query("""SELECT o_orderkey, CASE WHEN o_orderkey % 12 = 0 THEN 'none' ELSE concat_ws('  |  ', CASE WHEN o_orderkey % 2 <> 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END, CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END) END AS left_text,
concat_ws('  ', 'CamX', CASE WHEN o_custkey % 3 <> 0 THEN printf('f/%.1f', (o_custkey % 80 + 10) / 10) END, CASE WHEN o_custkey % 2 = 0 THEN '1/' || (o_custkey % 1000 + 2) || 's' ELSE printf('%.1fs', CAST(o_custkey % 30 + 1 AS DOUBLE)) END, (o_custkey % 600 + 1) || 'mm', 'ISO' || (o_custkey % 6400 + 100)) AS right_text FROM orders""")
def caption(spark, d):
    o = A.table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    some = lambda n, v: F.when(F.pmod(k, F.lit(n)) != 0, v).otherwise("")
    ratio = lambda n, den: F.struct(n.cast("int").alias("num"), F.lit(den).cast("int").alias("den") if isinstance(den, int) else den.cast("int").alias("den"))
    left = T.caption(some(2, F.col("o_orderpriority")), some(3, F.col("o_orderstatus")), some(4, images.caption_date(F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss"), F.lit(None))), default="none")
    f_number = F.when(F.pmod(c, F.lit(3)) != 0, ratio(F.pmod(c, F.lit(80)) + 10, 10))
    exposure = F.when(F.pmod(c, F.lit(2)) == 0, ratio(F.lit(1), F.pmod(c, F.lit(1000)) + 2)).otherwise(ratio(F.pmod(c, F.lit(30)) + 1, 1))
    return o.select(k, left.alias("left_text"), T.camera_line(F.lit("CamX"), f_number, exposure, ratio(F.pmod(c, F.lit(600)) + 1, 1), F.pmod(c, F.lit(6400)) + 100).alias("right_text"))


# --- budgets ----------------------------------------------------------------------


def _usage(spark, d) -> DataFrame:
    e = A.table(spark, d, "events")
    k = F.col("event_id")
    return e.select("ts", F.col("event_type").alias("model"), F.when(F.pmod(k, F.lit(3)) != 0, F.pmod(k * 131, F.lit(9000)) - 500).alias("total_tokens"), F.pmod(k, F.lit(700)).alias("prompt_tokens"), F.when(F.pmod(k, F.lit(2)) == 0, F.pmod(k, F.lit(300))).alias("completion_tokens"))


_USAGE_SQL = """
u AS (SELECT CAST(ts AS DATE) AS day, event_type AS model, coalesce(CASE WHEN event_id % 3 <> 0 THEN (event_id * 131) % 9000 - 500 END, event_id % 700 + coalesce(CASE WHEN event_id % 2 = 0 THEN event_id % 300 END, 0)) AS t FROM events),
daily AS (SELECT day, model, CAST(sum(t) AS BIGINT) AS tokens FROM u WHERE t > 0 GROUP BY day, model)"""


@_query(f"WITH {_USAGE_SQL} SELECT day, model, tokens FROM daily")
def token_daily(spark, d):
    return routing.daily_usage(_usage(spark, d))


@_query(f"""WITH {_USAGE_SQL}, m(ord, model) AS (VALUES (0, 'purchase'), (1, 'click'), (2, 'absent'), (3, 'view')), x AS (SELECT days.day, ord, m.model, coalesce(tokens, 0) AS tk FROM (SELECT DISTINCT day FROM daily) days CROSS JOIN m LEFT JOIN daily ON daily.day = days.day AND daily.model = m.model WHERE m.model <> 'absent')
SELECT day, coalesce(arg_min(model, ord) FILTER (tk < 187500), arg_min(model, tk * 10 + ord)) AS model FROM x GROUP BY day""")
def model_pick(spark, d):
    return routing.picked_models(routing.daily_usage(_usage(spark, d)), [" purchase", "click", "view", "click"], limit=250_000)


@_query("""SELECT o_orderkey, list_distinct_ordered AS models FROM (SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 'a;b,c' WHEN 1 THEN 'b;a' ELSE 'c' END AS list_distinct_ordered FROM orders)""")
def model_names(spark, d):
    k = F.pmod("o_custkey", F.lit(3))
    text = F.when(k == 0, " a , ,b;a\n c").when(k == 1, "b;;a,b").otherwise("c\nc")
    names = T.distinct_names(text)
    shown = F.when(F.size(names) == 3, F.concat(names[0], F.lit(";"), F.get(names, F.lit(1)), F.lit(","), F.get(names, F.lit(2)))).otherwise(F.array_join(names, ";"))
    return A.table(spark, d, "orders").select("o_orderkey", shown.alias("models"))


@_query("SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 'b' WHEN 1 THEN 'a,b' ELSE 'a' END AS usable FROM orders")
def model_blocks(spark, d):
    k = F.pmod("o_custkey", F.lit(3))
    blocked = F.when(k == 0, F.array(F.lit("a"))).when(k == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b")))
    return A.table(spark, d, "orders").select("o_orderkey", F.array_join(routing.unblocked(F.array(F.lit("a"), F.lit("b")), blocked), ",").alias("usable"))


@_query("""WITH p AS (SELECT o_orderkey, 'first' AS method, o_totalprice AS score FROM orders WHERE o_orderstatus = 'F') SELECT * FROM p UNION ALL SELECT o_orderkey, 'second', -o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM p) AND o_orderstatus = 'O'""")
def two_pass_routing(spark, d):
    first = lambda items: items.filter("o_orderstatus = 'F'").select("o_orderkey", F.col("o_totalprice").alias("score"))
    second = lambda items: items.filter("o_orderstatus = 'O'").select("o_orderkey", (-F.col("o_totalprice")).alias("score"))
    return routing.routed(A.table(spark, d, "orders"), "o_orderkey", first, second, ("first", "second")).select("o_orderkey", "method", "score")


_ROUTES = """
o AS (SELECT o_orderkey, o_orderkey % 3 = 0 AS here, (o_orderkey // 4) % 3 AS lo, (o_orderkey // 16) % 3 AS re, ['ok', 'empty', 'raised'] AS names, 'm' || (o_custkey % 2) AS model FROM orders),
s AS (SELECT *, CASE WHEN here THEN lo = 2 ELSE true END AS asks_remote, CASE WHEN here THEN true ELSE re > 0 END AS asks_local FROM o),
t AS (SELECT o_orderkey, here, CASE WHEN asks_remote THEN names[re + 1] END AS remote_status, CASE WHEN asks_local THEN names[lo + 1] END AS local_status, '豆包API(' || model || ')' AS served FROM s)"""


@_query(f"""WITH {_ROUTES} SELECT o_orderkey, remote_status, local_status,
CASE WHEN here AND local_status <> 'raised' THEN '本地模型' WHEN here AND remote_status <> 'raised' THEN served || '(回退)' WHEN here THEN 'unknown' WHEN remote_status = 'ok' THEN served
  WHEN local_status <> 'raised' THEN '本地模型(豆包无可用结果，已回退)' WHEN remote_status = 'empty' THEN served ELSE 'unknown' END AS method,
CASE WHEN here AND local_status = 'ok' THEN 'local' WHEN here AND local_status = 'empty' THEN NULL WHEN remote_status = 'ok' THEN 'remote' WHEN NOT here AND local_status = 'ok' THEN 'local' END AS first FROM t""")
def hybrid_routes(spark, d):
    def way(divisor, name):
        k = F.pmod(F.call_function("div", F.col("o_orderkey"), F.lit(divisor)), F.lit(3))
        one = F.array(F.struct(F.lit(1).alias("rank"), F.lit(name).alias("name"), F.lit(0.9).alias("confidence")))
        status = F.when(k == 0, "ok").when(k == 1, "empty").otherwise("raised")
        model = F.concat(F.lit("m"), F.pmod("o_custkey", F.lit(2)).cast("string"))
        return lambda rows: rows.select("o_orderkey", status.alias("status"), model.alias("model"), F.when(k == 0, one).alias("candidates"))

    routed = routing.hybrid(A.table(spark, d, "orders"), "o_orderkey", way(4, "local"), way(16, "remote"), F.col("o_orderkey") % 3 == 0)
    return routed.select("o_orderkey", "remote_status", "local_status", "method", F.get("candidates", F.lit(0))["name"].alias("first"))



# --- text ----------------------------------------------------------------------------


@_query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_partkey % 130 <= 100 THEN (l_partkey % 130) / 100.0 END AS share FROM lineitem")
def parse_percent(spark, d):
    text = F.when(F.pmod("l_partkey", F.lit(5)) == 0, "准确率：高").otherwise(F.concat(F.lit("准确率：约"), F.pmod("l_partkey", F.lit(130)).cast("string"), F.lit(" %。")))
    return A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.percent(text).alias("share"))


_TOKENS = [("鸟类。", "bird"), ("人像", "human"), ("其他动物；", "other_animal"), ("其它", "other"), ("小鸟儿", "bird"), ("一只小小的鸟儿", ""), ("人像照", "human"), ("海洋动物群", "other_animal"), ("", ""), ("植物", "")]


@_query("SELECT p_partkey, CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN '{m}'" for i, (_, m) in enumerate(_TOKENS)) + " END AS subject FROM part")
def parse_subject(spark, d):
    token = F.element_at(F.array(*[F.lit(t) for t, _ in _TOKENS]), (F.pmod("p_partkey", F.lit(10)) + 1).cast("int"))
    return A.table(spark, d, "part").select("p_partkey", T.subject(token).alias("subject"))


_CN = ["红嘴鸥", "白鹭", "小鸊鷉", "黑鹳"]
_CN_SQL = "CASE p_partkey % 4 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_CN)) + " END"


@_query(f"""WITH t AS (SELECT p_partkey, {_CN_SQL} AS name, p_partkey % 101 AS pc FROM part),
a AS (SELECT *, CASE p_partkey % 3 WHEN 0 THEN '主体类型：鸟类；中文名称：' || name || '；英文名称：Some Gull；学名：Larus sp；识别准确率：' || pc || '%。' WHEN 1 THEN '中文名称：' || name || '、英文名称：Some Gull、学名：Larus sp、识别准确率：' || pc || '%' ELSE '__' || name || '__（注：图中为水鸟；清晰）' END AS answer FROM t)
SELECT p_partkey, regexp_extract(answer, '({'|'.join(_CN)})', 1) AS cn, CASE WHEN contains(answer, '英文名称') THEN regexp_extract(answer, '英文名称：([A-Za-z ]+)', 1) ELSE '' END AS en, CASE WHEN contains(answer, '学名') THEN regexp_extract(answer, '学名：([A-Za-z ]+)', 1) ELSE '' END AS sci,
 coalesce(TRY_CAST(nullif(regexp_extract(answer, '([0-9]+)%', 1), '') AS DOUBLE) / 100.0, 0.9) AS confidence, 'bird' AS subject FROM a""")
def parse_fields(spark, d):
    name = F.element_at(F.array(*map(F.lit, _CN)), (F.pmod("p_partkey", F.lit(4)) + 1).cast("int"))
    pc, k = F.pmod("p_partkey", F.lit(101)).cast("string"), F.pmod("p_partkey", F.lit(3))
    answer = (
        F.when(k == 0, F.concat(F.lit("主体类型：鸟类；中文名称："), name, F.lit("；英文名称：Some Gull；学名：Larus sp；识别准确率："), pc, F.lit("%。")))
        .when(k == 1, F.concat(F.lit("中文名称："), name, F.lit("、英文名称：Some Gull、学名：Larus sp、识别准确率："), pc, F.lit("%")))
        .otherwise(F.concat(F.lit("__"), name, F.lit("__（注：图中为水鸟；清晰）")))
    )
    rows = A.table(spark, d, "part").select("p_partkey", answer.alias("answer"))
    return answers.parsed(rows).select("p_partkey", "cn", "en", "sci", "confidence", "subject")


@_query("""WITH a AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"choices":[{"message":{"content":" ' || event_type || ' "}}]}' WHEN 1 THEN '{"choices":[{"message":{"content":[{"type":"text","text":"' || event_type || '"},{"type":"image"},{"type":"output_text","text":"end"}]}}]}' ELSE '{"output":[{"type":"message","role":"assistant","content":[{"type":"output_text","text":"' || event_type || '"}]}]}' END AS body, props FROM events)
SELECT event_id, CASE event_id % 3 WHEN 0 THEN trim(json_extract_string(body, '$.choices[0].message.content')) WHEN 1 THEN json_extract_string(body, '$.choices[0].message.content[0].text') || chr(10) || json_extract_string(body, '$.choices[0].message.content[2].text') ELSE json_extract_string(body, '$.output[0].content[0].text') END AS text, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM a""")
def parse_json_chat(spark, d):
    e = A.table(spark, d, "events")
    k, t = F.pmod("event_id", F.lit(3)), F.col("event_type")
    body = (
        F.when(k == 0, F.concat(F.lit('{"choices":[{"message":{"content":" '), t, F.lit(' "}}]}')))
        .when(k == 1, F.concat(F.lit('{"choices":[{"message":{"content":[{"type":"text","text":"'), t, F.lit('"},{"type":"image"},{"type":"output_text","text":"end"}]}}]}')))
        .otherwise(F.concat(F.lit('{"output":[{"type":"message","role":"assistant","content":[{"type":"output_text","text":"'), t, F.lit('"}]}]}')))
    )
    return e.select("event_id", T.chat_text(body).alias("text"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@_query("SELECT doc_id, name <> '' AND (length(name) > 8 OR regexp_matches(name, '[\\n\\r:：;；,，。.!?？（）()]')) AS implausible FROM (SELECT doc_id, split_part(text, ' ', 1) AS name FROM documents)")
def long_name_filter(spark, d):
    name = F.get(F.split("text", " "), F.lit(0))
    return A.table(spark, d, "documents").select("doc_id", T.implausible_name(name, 8).alias("implausible"))


_SUFFIX_SQL = "regexp_extract(CASE WHEN page_id % 3 = 0 THEN '/a/p.' || page_id || '.JPG' WHEN page_id % 3 = 1 THEN '/a.b/p' || page_id ELSE '/a/p' || page_id || '.cr3' END, '[^/](\\.[^./]+)$', 1)"


@_query(f"SELECT page_id, lower({_SUFFIX_SQL}) AS suffix, lower({_SUFFIX_SQL}) = '.cr3' AS raw FROM pages WHERE lower({_SUFFIX_SQL}) IN ('.jpg', '.cr3')")
def ext_filter(spark, d):
    p = A.table(spark, d, "pages")
    k, n = F.pmod("page_id", F.lit(3)), F.col("page_id").cast("string")
    path = F.when(k == 0, F.concat(F.lit("/a/p."), n, F.lit(".JPG"))).when(k == 1, F.concat(F.lit("/a.b/p"), n)).otherwise(F.concat(F.lit("/a/p"), n, F.lit(".cr3")))
    df = p.withColumn("suffix", T.suffix(path)).filter(F.col("suffix").isin(*images.STANDARD, *images.RAW))
    return df.select("page_id", "suffix", F.col("suffix").isin(*images.RAW).alias("raw"))


@_query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN '内蒙古' WHEN 1 THEN '新疆' WHEN 2 THEN '上海' ELSE '浙江' END AS base FROM nation")
def admin_names(spark, d):
    k = F.pmod("n_nationkey", F.lit(4))
    name = F.when(k == 0, " 内蒙古自治区").when(k == 1, "新疆维吾尔自治区").when(k == 2, "上海市 ").otherwise("浙江省")
    return A.table(spark, d, "nation").select("n_nationkey", T.admin_base(name).alias("base"))


# --- layout of pictures ----------------------------------------------------------------

_WIDTHS = {" ": 0.25, "i": 0.25, "l": 0.25, "m": 0.875, "W": 1.0}
_EMS = "CASE ch " + " ".join(f"WHEN '{c}' THEN {w}" for c, w in _WIDTHS.items()) + " ELSE 0.5 END"


@_query(f"""WITH RECURSIVE t AS (SELECT p_partkey, trim(p_name || ' ' || p_type || ' ' || p_brand) AS s, CAST(60 + p_partkey % 90 AS DOUBLE) AS most FROM part),
f AS (SELECT p_partkey, s, most, 0 AS i, '' AS line, CAST(0 AS DOUBLE) AS width, CAST([] AS VARCHAR[]) AS lines FROM t
UNION ALL SELECT p_partkey, s, most, i + 1, CASE WHEN width + w <= most THEN line || ch ELSE ch END, CASE WHEN width + w <= most THEN width + w ELSE w END,
  CASE WHEN width + w <= most OR line = '' THEN lines ELSE list_append(lines, line) END FROM (SELECT *, substr(s, i + 1, 1) AS ch, CAST(16 * {_EMS.replace("ch", "substr(s, i + 1, 1)")} AS DOUBLE) AS w FROM f WHERE i < length(s)))
SELECT p_partkey, array_to_string(list_append(lines, line), '|') AS lines, len(lines) + 1 AS n FROM f WHERE i = length(s)""")
def caption_wrap(spark, d):
    p = A.table(spark, d, "part")
    text, most = F.concat_ws(" ", "p_name", "p_type", "p_brand"), (F.pmod("p_partkey", F.lit(90)) + 60).cast("double")
    df = p.select("p_partkey", L.wrapped(text, most, F.lit(16), _WIDTHS).alias("l"))
    return df.select("p_partkey", F.array_join("l", "|").alias("lines"), F.size("l").cast("long").alias("n"))


@_query("""WITH p AS (SELECT o_orderkey, CAST(100 + o_orderkey % 6000 AS INTEGER) AS w, CAST(100 + (o_orderkey * 7) % 4000 AS INTEGER) AS h, CAST(o_custkey % 900 AS INTEGER) AS lw, CAST(o_orderkey % 400 AS INTEGER) AS lh FROM orders),
a AS (SELECT *, greatest(2, CAST(floor(CAST(0.01 AS DOUBLE) * (w + h)) AS INTEGER)) AS side, greatest(40, CAST(floor(w * CAST(0.3 AS DOUBLE)) AS INTEGER)) AS rw, greatest(28, CAST(floor(h * CAST(0.16 AS DOUBLE)) AS INTEGER)) AS rh FROM p),
s AS (SELECT *, CASE WHEN lw <= 0 OR lh <= 0 THEN lw ELSE greatest(1, CAST(floor(lw * least(rw / lw, rh / lh)) AS INTEGER)) END AS nw, CASE WHEN lw <= 0 OR lh <= 0 THEN lh ELSE greatest(1, CAST(floor(lh * least(rw / lw, rh / lh)) AS INTEGER)) END AS nh FROM a)
SELECT o_orderkey, nw AS logo_w, nh AS logo_h, side + 1 + greatest(0, (w - nw) // 2) AS logo_x, side + 1 + h - nh - greatest(8, CAST(floor(h * CAST(0.02 AS DOUBLE)) AS INTEGER)) AS logo_y, w + 2 * side + 2 AS canvas_width FROM s""")
def logo_layout(spark, d):
    o = A.table(spark, d, "orders")
    size = lambda key, n: F.pmod(F.col(key), F.lit(n)).cast("int")
    df = o.select("o_orderkey", (size("o_orderkey", 6000) + 100).alias("w"), (F.pmod(F.col("o_orderkey") * 7, F.lit(4000)).cast("int") + 100).alias("h"), size("o_custkey", 900).alias("lw"), size("o_orderkey", 400).alias("lh"))
    df = df.withColumn("f", L.caption_frame(F.col("w"), F.col("h"))).withColumn("l", L.logo_place(F.col("f"), F.col("w"), F.col("h"), F.col("lw"), F.col("lh")))
    return df.select("o_orderkey", F.col("l.width").alias("logo_w"), F.col("l.height").alias("logo_h"), F.col("l.x").alias("logo_x"), F.col("l.y").alias("logo_y"), "f.canvas_width")


@_query(f"""WITH {A.BOXES_SQL}, b AS (SELECT *, CAST(40 + part % 90 AS INTEGER) AS tw, CAST(24 + det * 6 AS INTEGER) AS lh FROM boxes)
SELECT image, det, part, CASE WHEN x1 + tw + 6 > width THEN greatest(0, x1 - (x1 + tw + 6 - width)) ELSE x1 END AS label_x, CASE WHEN y1 - lh - 4 >= 0 THEN y1 - lh - 4 WHEN y2 + 4 + lh <= height THEN y2 + 4 ELSE greatest(0, y1 - lh - 4) END AS label_y FROM b""")
def label_plan(spark, d):
    b = A.boxes(spark, d).withColumns({"tw": (F.pmod("part", F.lit(90)) + 40).cast("int"), "lh": (F.col("det") * 6 + 24).cast("int")})
    at = L.label_spot(*[F.col(c) for c in ("x1", "y1", "y2", "tw", "lh", "width", "height")], F.lit(6), F.lit(4))
    return b.withColumn("at", at).select("image", "det", "part", F.col("at.x").alias("label_x"), F.col("at.y").alias("label_y"))


# --- progress --------------------------------------------------------------------------


@_query("""WITH w AS (SELECT s_suppkey, s_nationkey, (s_suppkey % 9 + 1) / 100.0 AS w FROM supplier), r AS (SELECT *, sum(w) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY s_nationkey) AS t FROM w)
SELECT s_suppkey, round(100.0 * (c - w) / t, 6) AS lo, round(100.0 * c / t, 6) AS hi FROM r""")
def phase_ranges(spark, d):
    df = A.table(spark, d, "supplier").withColumn("weight", (F.pmod("s_suppkey", F.lit(9)) + 1) / 100.0)
    return report.phase_ranges(df, "s_suppkey", "s_nationkey").select("s_suppkey", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@_query("""WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events),
f AS (SELECT user_id, r, n, value AS ema FROM o WHERE r = 1 UNION ALL SELECT o.user_id, o.r, o.n, 0.65 * f.ema + 0.35 * o.value FROM f JOIN o ON o.user_id = f.user_id AND o.r = f.r + 1)
SELECT user_id AS job, round(ema, 6) AS ema, n FROM f WHERE r = n""")
def ema_rate(spark, d):
    ticks = A.table(spark, d, "events").select(F.col("user_id").alias("job"), F.struct("ts", "event_id").alias("ord"), "value")
    return stream.ema(ticks).select("job", F.round("ema", 6).alias("ema"), "n")


@_query("""SELECT c_custkey, greatest(18.0, n * 2.8e0) AS burst, least(120.0, greatest(10.0, 15e0 + n * 0.12e0)) AS burst_report, least(120.0, greatest(4.0, 6e0 + n * 0.08e0)) AS gps, greatest(25.0, n * 5.0e0) AS species_local, greatest(25.0, n * 14.0e0) AS species_remote, greatest(12.0, n * 0.8e0) AS watermark FROM (SELECT c_custkey, c_custkey % 1000 AS n FROM customer)""")
def eta_phases(spark, d):
    n = F.pmod("c_custkey", F.lit(1000))
    return A.table(spark, d, "customer").select("c_custkey", *[N.clamped_line(n, *v).alias(k) for k, v in N.STAGE_ESTIMATES.items()])


@_query("""WITH s AS (SELECT o_orderkey, greatest(0, CAST(round_even(o_totalprice / 7.0 - 100, 0) AS BIGINT)) AS s FROM orders), p AS (SELECT *, s // 3600 AS h, (s % 3600) // 60 AS m, s % 60 AS r FROM s)
SELECT o_orderkey, CASE WHEN s < 60 THEN s || '秒' WHEN s < 3600 THEN CASE WHEN r > 0 THEN m || '分' || r || '秒' ELSE m || '分钟' END ELSE h || '小时' || CASE WHEN m > 0 THEN m || '分' ELSE '' END || CASE WHEN r > 0 THEN r || '秒' ELSE '' END END AS shown FROM p""")
def duration_text(spark, d):
    return A.table(spark, d, "orders").select("o_orderkey", N.duration_text(F.col("o_totalprice") / 7.0 - 100).alias("shown"))


@_query("SELECT count(*) AS images, CAST(sum(l_linenumber) AS BIGINT) AS birds, CAST(sum(l_linenumber % 3) AS BIGINT) AS eyes, CAST(sum(l_partkey % 2) AS BIGINT) AS crops, count(*) FILTER (l_returnflag <> 'R') AS ok, count(*) FILTER (l_returnflag = 'R') AS failed FROM lineitem")
def run_totals(spark, d):
    li = A.table(spark, d, "lineitem")
    return report.run_totals(li.select(F.col("l_linenumber").alias("birds"), F.pmod("l_linenumber", F.lit(3)).alias("eyes"), F.pmod("l_partkey", F.lit(2)).alias("crops"), (F.col("l_returnflag") != "R").alias("ok")))
