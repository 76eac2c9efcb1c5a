"""Detections derived from `lineitem`: an order is an image, a line is a box."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens.operators import vision as vi
from airlens.plans.registry import query

c = F.col
_D = ["l_orderkey as image", "l_orderkey % 4 as site", "concat_ws('-', l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_shipdate) as det_id", "l_partkey % 2 = 1 as odd", "round(1 - l_discount * 5, 3) as conf", "(l_partkey % 20) / 20e0 + 0.02e0 as cx", "(l_suppkey % 10) / 10e0 + 0.05e0 as cy", "0.05e0 + l_tax as w", "0.08e0 as h"]
_Z = "z AS (SELECT s AS site, 'Z' || i AS zone, i * 0.25 AS x0, i * 0.25 + 0.25 AS x1, 1 + i % 2 AS capacity FROM range(4) AS a(s), range(4) AS b(i))"


def dets(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(*_D)


def zones(spark: SparkSession) -> DataFrame:
    """Four strips at each of four sites (a fixed table)."""
    rows = [(s, f"Z{i}", [[i * 0.25, 0.0], [i * 0.25 + 0.25, 0.0], [i * 0.25 + 0.25, 1.0], [i * 0.25, 1.0]], 1 + i % 2) for s in range(4) for i in range(4)]
    return spark.createDataFrame(rows, "site long, zone string, polygon array<array<double>>, capacity int")


_DS = f"dd AS (SELECT {', '.join(_D)} FROM lineitem), {_Z}, oc AS (SELECT g.site, g.image, z.zone, z.capacity, count(dd.det_id) AS n FROM (SELECT DISTINCT site, image FROM dd) AS g JOIN z USING (site) LEFT JOIN dd ON dd.image = g.image AND dd.cx >= z.x0 AND dd.cx < z.x1 AND dd.cy < 1 GROUP BY ALL)"


@query("zone_occupancy", f"WITH {_DS} SELECT site, image, zone, n AS count FROM oc")
def zone_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-19."""
    return vi.occupancy(dets(spark, sf), F.broadcast(zones(spark))).select("site", "image", "zone", "count")


@query("rule_zone_capacity", f"WITH {_DS} SELECT site, image, zone, n AS count, CASE WHEN n > capacity THEN 'OPS-VIS-001' ELSE 'OPS-VIS-002' END AS rule_id FROM oc WHERE n > capacity OR n = 0")
def rule_zone_capacity(spark: SparkSession, sf: str) -> DataFrame:
    """RUL-20."""
    return vi.zone_findings(vi.occupancy(dets(spark, sf), F.broadcast(zones(spark)))).select("site", "image", "zone", "count", "rule_id")


_SIDE = lambda a, s: f"greatest(0, least(a.{a} + a.{s} / 2, b.{a} + b.{s} / 2) - greatest(a.{a} - a.{s} / 2, b.{a} - b.{s} / 2))"


@query("box_overlaps", f"WITH {_DS}, p AS (SELECT a.image, a.det_id AS a, b.det_id AS b, {_SIDE('cx', 'w')} * {_SIDE('cy', 'h')} AS i, a.w * a.h + b.w * b.h AS s FROM dd AS a JOIN dd AS b ON a.image = b.image AND a.det_id < b.det_id) SELECT image, a, b, round(i / (s - i), 5) AS iou FROM p WHERE i / (s - i) > 0.01")
def box_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """SCL-25: overlapping boxes of an image."""
    return vi.overlaps(dets(spark, sf)).filter("iou > 0.01").select("image", "a", "b", F.round("iou", 5).alias("iou"))


_KIOU = "greatest(0, least(k.cx + k.w / 2, o.cx + o.w / 2) - greatest(k.cx - k.w / 2, o.cx - o.w / 2)) * greatest(0, least(k.cy + k.h / 2, o.cy + o.h / 2) - greatest(k.cy - k.h / 2, o.cy - o.h / 2))"


# one box a step, by falling confidence: it stays if no box that stayed overlaps it by half
@query("suppressed_detections", f"""WITH RECURSIVE {_DS}, rk AS (SELECT image, {{'det_id': det_id, 'conf': conf, 'cx': cx, 'cy': cy, 'w': w, 'h': h}} AS o, row_number() OVER (PARTITION BY image ORDER BY conf DESC, det_id) AS n FROM dd),
  g(image, n, kept) AS (SELECT image, n, [o] FROM rk WHERE n = 1 UNION ALL
    SELECT rk.image, rk.n, CASE WHEN len(list_filter(g.kept, lambda k: {_KIOU.replace('o.', 'rk.o.')} / (k.w * k.h + rk.o.w * rk.o.h - {_KIOU.replace('o.', 'rk.o.')}) >= 0.5)) = 0 THEN list_append(g.kept, rk.o) ELSE g.kept END FROM g JOIN rk ON rk.image = g.image AND rk.n = g.n + 1)
  SELECT image, k.det_id AS det_id, k.conf AS conf FROM (SELECT image, unnest(arg_max(kept, n)) AS k FROM g GROUP BY image) AS q""")
def suppressed_detections(spark: SparkSession, sf: str) -> DataFrame:
    """FLD-04."""
    return vi.suppress(dets(spark, sf)).select("image", "det_id", "conf")


_DIST = "sqrt(pow(k.cx - rk.cx, 2) + pow(k.cy - rk.cy, 2))"


# one detection a step, by falling confidence: it takes the nearest box of truth that is left, if that is near enough
@query("detection_matching", f"""WITH RECURSIVE {_DS}, tr AS (SELECT image, list({{'det_id': det_id, 'cx': cx + CASE WHEN odd THEN 0.01 ELSE 0.4 END, 'cy': cy}} ORDER BY det_id) AS t FROM dd GROUP BY image),
  rk AS (SELECT image, cx, cy, row_number() OVER (PARTITION BY image ORDER BY conf DESC, det_id) AS n FROM dd),
  g(image, n, rest, tp) AS (SELECT image, CAST(0 AS BIGINT), t, 0 FROM tr UNION ALL
    SELECT image, n, CASE WHEN near.m <= 0.03 THEN list_filter(rest, lambda k: k.det_id <> near.id) ELSE rest END, tp + CASE WHEN near.m <= 0.03 THEN 1 ELSE 0 END
    FROM (SELECT rk.image, rk.n, g.rest, g.tp, list_sort(list_transform(g.rest, lambda k: {{'m': {_DIST}, 'id': k.det_id}}))[1] AS near FROM g JOIN rk ON rk.image = g.image AND rk.n = g.n + 1) AS q)
  SELECT image, CAST(arg_max(tp, n) AS BIGINT) AS tp, max(n) - CAST(arg_max(tp, n) AS BIGINT) AS fp, CAST(len(arg_max(rest, n)) AS BIGINT) AS fn FROM g GROUP BY image""")
def detection_matching(spark: SparkSession, sf: str) -> DataFrame:
    """FLD-05: truth is the same boxes, half of them moved too far to match."""
    d = dets(spark, sf)
    truth = d.withColumn("cx", c("cx") + F.when(c("odd"), 0.01).otherwise(0.4))
    return vi.match(d, truth)
