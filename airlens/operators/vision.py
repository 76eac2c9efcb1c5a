"""Detections in images: zones, suppression, matching with truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlens.functions.geo import point_in_polygon

c = F.col
IOU_LIMIT, MATCH_DIST = 0.5, 0.03


def iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes given as structs cx, cy, w, h."""
    side = lambda p, q, s: F.greatest(F.lit(0.0), F.least(p + s[0] / 2, q + s[1] / 2) - F.greatest(p - s[0] / 2, q - s[1] / 2))
    inter = side(a["cx"], b["cx"], (a["w"], b["w"])) * side(a["cy"], b["cy"], (a["h"], b["h"]))
    return F.coalesce(F.try_divide(inter, a["w"] * a["h"] + b["w"] * b["h"] - inter), F.lit(0.0))


def overlaps(dets: DataFrame, edge: float = 0.1) -> DataFrame:
    """Overlapping boxes of an image: boxes are copied to the grid cells they touch and meet there.

    A pair shares several cells; it is kept in the one that holds the corner of the overlap, so nothing is distinct-ed.
    """
    x0, y0 = F.floor((c("cx") - c("w") / 2) / edge), F.floor((c("cy") - c("h") / 2) / edge)
    d = dets.select("image", "det_id", F.struct("cx", "cy", "w", "h").alias("box"), x0.alias("x0"), y0.alias("y0"), F.floor((c("cx") + c("w") / 2) / edge).alias("x1"), F.floor((c("cy") + c("h") / 2) / edge).alias("y1"))
    d = d.withColumn("gx", F.explode(F.sequence("x0", "x1"))).withColumn("gy", F.explode(F.sequence("y0", "y1"))).drop("x1", "y1")
    a, b = d.alias("a"), d.alias("b")
    j = a.join(b, (c("a.image") == c("b.image")) & (c("a.gx") == c("b.gx")) & (c("a.gy") == c("b.gy")) & (c("a.det_id") < c("b.det_id")))
    j = j.filter((c("a.gx") == F.greatest("a.x0", "b.x0")) & (c("a.gy") == F.greatest("a.y0", "b.y0")))
    return j.select("a.image", c("a.det_id").alias("a"), c("b.det_id").alias("b"), iou(c("a.box"), c("b.box")).alias("iou")).filter("iou > 0")


def occupancy(dets: DataFrame, zones: DataFrame) -> DataFrame:
    """Detections per image and zone, zeros included; zones (zone, polygon [[x, y]], capacity) are joined by image set."""
    pairs = dets.join(zones, "site").filter(point_in_polygon(c("cx"), c("cy"), c("polygon")))
    n = pairs.groupBy("site", "image", "zone").agg(F.count(F.lit(1)).alias("count"))
    grid = dets.select("site", "image").distinct().join(zones.select("site", "zone", "capacity"), "site")
    return grid.join(n, ["site", "image", "zone"], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def zone_findings(occ: DataFrame) -> DataFrame:
    rule = F.when(c("count") > c("capacity"), "OPS-VIS-001").when(c("count") == 0, "OPS-VIS-002")
    return occ.select("site", "image", "zone", "count", "capacity", rule.alias("rule_id")).filter("rule_id is not null")


def suppress(dets: DataFrame, limit: float = IOU_LIMIT) -> DataFrame:
    """Greedy suppression per image, by falling confidence: a fold over the boxes of one image, inside the JVM."""
    order = F.struct((-c("conf")).alias("_c"), "det_id")
    box = F.struct(order.alias("o"), *dets.columns)
    g = dets.groupBy("image").agg(F.array_sort(F.collect_list(box)).alias("_b"))
    empty = F.slice("_b", 1, 0)
    kept = F.aggregate("_b", empty, lambda s, x: F.when(F.exists(s, lambda k: iou(k, x) >= limit), s).otherwise(F.concat(s, F.array(x))))
    return g.select(F.explode(kept).alias("_k")).select(*[c(f"_k.{n}").alias(n) for n in dets.columns])


def match(dets: DataFrame, truth: DataFrame, max_dist: float = MATCH_DIST) -> DataFrame:
    """Greedy one-to-one matching per image, by falling confidence: true and false positives and misses."""
    d = dets.groupBy("image").agg(F.array_sort(F.collect_list(F.struct((-c("conf")).alias("o"), "det_id", "cx", "cy"))).alias("d"))
    t = truth.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("det_id", "cx", "cy"))).alias("t"))
    j = d.join(t, "image", "full_outer").withColumn("t", F.coalesce("t", F.array().cast(t.schema["t"].dataType))).withColumn("_n", F.size(F.coalesce("d", F.array().cast(d.schema["d"].dataType))))

    def step(s, x):
        near = F.array_min(F.transform(s, lambda k: F.struct(F.sqrt(F.pow(k["cx"] - x["cx"], 2) + F.pow(k["cy"] - x["cy"], 2)).alias("m"), k["det_id"].alias("id"))))
        return F.when(near["m"] <= max_dist, F.filter(s, lambda k: k["det_id"] != near["id"])).otherwise(s)

    left = F.when(c("d").isNull(), F.size("t")).otherwise(F.aggregate("d", c("t"), step, lambda s: F.size(s)))
    j = j.withColumn("_left", left)
    return j.select("image", (F.size("t") - c("_left")).cast("long").alias("tp"), (c("_n") - F.size("t") + c("_left")).cast("long").alias("fp"), c("_left").cast("long").alias("fn"))
