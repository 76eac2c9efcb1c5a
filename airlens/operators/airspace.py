"""Traffic against restricted volumes and launch windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from airlens.functions.geo import planar_nm, point_in_polygon
from airlens.operators import occupancy
from airlens.operators.bandjoin import LEAST_BUCKETS, cover_cells, floor_cell, salted_join

c = F.col
HAZARD_NM = 50.0
PAD_SLACK_NM = 30.0
LOOKAHEAD_S = 72 * 3600.0
TFR_STALE_S = 6 * 3600.0
LAUNCH_STALE_S = 24 * 3600.0
CELL_DEG = 0.5
#: polls of a recording that stay together in joins with places
SLAB_POLLS = 64
HOUR_S = 3600.0
US_MARKERS = ["usa", "united states", "puerto rico", "guam", "marshall islands"]  # fixed values
IDLE_STATUS = ["hold", "tbd", "scrubbed", "failure", "success", "partial failure"]  # fixed values


def flying(states: DataFrame) -> DataFrame:
    return states.filter("lat is not null and lon is not null and not on_ground")


def active(ts: Column) -> Column:
    """Open ends hold."""
    return (c("effective_ts").isNull() | (ts >= c("effective_ts"))) & (c("expire_ts").isNull() | (ts <= c("expire_ts")))


def inside(lat: Column, lon: Column, alt: Column | None = None) -> Column:
    """Inside the polygon or the circle, and between the altitude limits where both are known."""
    flat = F.coalesce(point_in_polygon(lat, lon, c("polygon")), F.lit(False)) | F.coalesce(
        planar_nm(lat, lon, c("circle.lat"), c("circle.lon")) <= c("circle.radius_nm"), F.lit(False))
    if alt is None:
        return flat
    low = F.coalesce(alt < c("lower_ft"), F.lit(False))
    high = F.coalesce(alt > c("upper_ft"), F.lit(False))
    return ~low & ~high & flat


def with_bbox(features: DataFrame) -> DataFrame:
    """Bounding box of each volume's polygon and circle; volumes without geometry drop out."""
    lat = F.concat(F.coalesce(F.transform("polygon", lambda p: F.get(p, 0)), F.array().cast("array<double>")),
                   F.when(c("circle").isNotNull(), F.array(c("circle.lat") - c("circle.radius_nm") / 60.0, c("circle.lat") + c("circle.radius_nm") / 60.0)).otherwise(F.array().cast("array<double>")))
    reach = c("circle.radius_nm") / (60.0 * F.greatest(F.cos(F.radians(F.abs(c("circle.lat")) + c("circle.radius_nm") / 60.0)), F.lit(0.1)))
    lon = F.concat(F.coalesce(F.transform("polygon", lambda p: F.get(p, 1)), F.array().cast("array<double>")),
                   F.when(c("circle").isNotNull(), F.array(c("circle.lon") - reach, c("circle.lon") + reach)).otherwise(F.array().cast("array<double>")))
    f = features.withColumn("_lat", lat).withColumn("_lon", lon).filter(F.size("_lat") > 0)
    return f.select("*", F.array_min("_lat").alias("lamin"), F.array_max("_lat").alias("lamax"), F.array_min("_lon").alias("lomin"), F.array_max("_lon").alias("lomax")).drop("_lat", "_lon")


# fixed values: the types that traffic and launches are joined with unless others are asked for
SPACE_TYPES = ("SPACE OPERATIONS",)


def of_types(features: DataFrame, types: tuple[str, ...] | None = SPACE_TYPES) -> DataFrame:
    """Volumes of the given types; None: all."""
    return features if types is None else features.filter(c("type").isin(*types))


def volume_rows(features: DataFrame, states: DataFrame) -> DataFrame:
    """One row per volume with a shape, entered or not: recordings with traffic in it, aircraft inside while it was in
    effect and outside its times."""
    per = aircraft_inside(states, features, ["notam_id", "recording"], nulls=True).groupBy("notam_id")
    seen = per.agg(F.count("recording").alias("recordings"), F.sum("during").alias("aircraft_active"), F.sum("outside").alias("aircraft_outside"))
    rows = with_bbox(features).select("notam_id", "type", "effective_ts", "expire_ts")
    return rows.join(seen, "notam_id", "left").fillna(0, ["recordings", "aircraft_active", "aircraft_outside"])


def _sides(hits: DataFrame, keys: list[str], nulls: bool = False) -> DataFrame:
    """Distinct addresses of a key with a hit while the volume was in effect (`during`) and outside its times. The hits of an
    address become one row before they are shuffled. nulls: reports without an address count as one."""
    one = hits.groupBy(*keys, "icao24").agg(F.max("is_active").alias("_d"), F.min("is_active").alias("_o"))
    known = F.lit(True) if nulls else c("icao24").isNotNull()
    return one.groupBy(*keys).agg(F.count_if(known & c("_d")).alias("during"), F.count_if(known & ~c("_o")).alias("outside"))


def aircraft_inside(states: DataFrame, features: DataFrame, keys: list[str], nulls: bool = False, **limits: int) -> DataFrame:
    """`_sides` of the traffic inside the volumes, without a row for every report and volume. keys: recording and notam_id,
    and the times of volumes if those that are listed more than once are counted apart."""
    def by_pairs(rows: DataFrame, volumes: DataFrame) -> DataFrame:
        sides = _sides(traffic_inside(rows, volumes), keys, nulls)
        return sides.withColumns({n: F.lit(None).cast("double") for n in ("effective_ts", "expire_ts") if n not in keys})

    f = with_bbox(features).select("notam_id", "lower_ft", "upper_ft", "effective_ts", "expire_ts", "polygon", "circle", "lamin", "lamax", "lomin", "lomax")
    return occupancy.aircraft_inside(flying(states), f, by_pairs, CELL_DEG, nulls, **limits).select(*keys, "during", "outside")


def traffic_inside(states: DataFrame, features: DataFrame, only_active: bool = False) -> DataFrame:
    """State rows inside a volume, with `is_active` for the volume's times; only_active: rows within them, told before
    any outline is looked at.

    Equi-join on grid cells of the volumes' boxes, salted by recording and slab of polls: a cell over a busy hub is not
    one task, and the reports of an aircraft meet a volume in the same one.
    """
    f = features if "lamin" in features.columns else with_bbox(features)
    f = cover_cells(f, c("lamin"), c("lomin"), c("lamax"), c("lomax"), CELL_DEG)
    s = flying(states).select("recording", "batch_seq", "pos", "icao24", "callsign", "ts", "lat", "lon", "baro_alt_ft",
                              floor_cell(c("lat"), CELL_DEG).alias("cell_y"), floor_cell(c("lon"), CELL_DEG).alias("cell_x"))
    j = salted_join(s, f, ["cell_y", "cell_x"], F.hash("recording", F.floor(c("batch_seq") / SLAB_POLLS)))
    if only_active:
        j = j.filter(active(c("ts")))
    j = j.filter(c("lat").between(c("lamin"), c("lamax")) & c("lon").between(c("lomin"), c("lomax")))
    return j.filter(inside(c("lat"), c("lon"), c("baro_alt_ft"))).withColumn("is_active", active(c("ts")))


def dwell(hits: DataFrame) -> DataFrame:
    """Per aircraft inside an active volume: first and last time, samples, newest known altitude."""
    order = F.struct("batch_seq", "pos")
    return hits.filter("is_active").groupBy("recording", "notam_id", "icao24").agg(
        F.min_by("ts", order).alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("samples"),
        F.max_by(F.when(c("baro_alt_ft").isNotNull(), c("baro_alt_ft")), F.when(c("baro_alt_ft").isNotNull(), order)).alias("alt_ft"))


def volume_summary(hits: DataFrame) -> DataFrame:
    """Aircraft inside while active and outside the times, per recording and volume."""
    return _sides(hits, ["recording", "notam_id"]).withColumnsRenamed({"during": "aircraft_active", "outside": "aircraft_outside"})


def displacement(states: DataFrame, features: DataFrame) -> DataFrame:
    """Distinct aircraft per observed minute inside the volume, during against outside its times.

    Only pairs of volume and recording with traffic inside are kept: the others have nothing to compare. A minute counts
    for a side when its first or last fix falls on it, so volumes are taken to last longer than a minute.
    """
    keys = ["recording", "notam_id", "effective_ts", "expire_ts"]
    per = aircraft_inside(states, features, keys).withColumnsRenamed({"during": "inside_during", "outside": "inside_outside"})
    minutes = flying(states).groupBy("recording", F.floor(c("ts") / 60).alias("minute")).agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    # first and last fixes of a recording's minutes and the ends of its volumes' times are put in one order: a running
    # count says how many minutes lie before each end, so minutes and volumes are added, not multiplied. The counts of
    # aircraft go along, so they are not computed a second time
    none = [F.lit(None).cast(per.schema[k].dataType).alias(k) for k in per.columns if k != "recording"]
    mark = lambda side, at, order, name: F.struct(F.lit(side).alias("side"), c(at).alias("at"), F.lit(order).alias("o"), F.lit(name).alias("name"))
    seen = minutes.select("recording", *none, F.inline(F.array(mark("t0", "t0", 1, None), mark("t1", "t1", 1, None))))
    marks = [mark("t1", "effective_ts", 0, "ended"), mark("t0", "expire_ts", 2, "begun"), mark("t0", "effective_ts", 0, "early"), mark("t1", "expire_ts", 2, "over")]
    ends = per.select(*per.columns, F.inline(F.array(*marks)))
    w = W.partitionBy("recording", "side").orderBy("at", "o").rowsBetween(W.unboundedPreceding, 0)
    counted = seen.unionByName(ends).withColumn("n", F.count(F.when(c("o") == 1, 1)).over(w)).filter("o <> 1")
    counted = counted.groupBy(*keys).agg(F.first("inside_during").alias("inside_during"), F.first("inside_outside").alias("inside_outside"), *[
        F.max(F.when((c("name") == n) & c("at").isNotNull(), c("n"))).alias(n) for n in ("ended", "begun", "early", "over")])
    total = minutes.groupBy("recording").agg(F.count(F.lit(1)).alias("total"))
    j = counted.join(total, "recording")
    ended, begun, early, over = F.coalesce("ended", F.lit(0)), F.coalesce("begun", c("total")), F.coalesce("early", F.lit(0)), F.coalesce("over", c("total"))
    j = j.withColumn("minutes_during", F.greatest(F.lit(0), begun - ended)).withColumn("minutes_outside", early + c("total") - over - F.greatest(F.lit(0), early - over))
    rd, ro = F.try_divide("inside_during", "minutes_during"), F.try_divide("inside_outside", "minutes_outside")
    return j.select("recording", "notam_id", "minutes_during", "minutes_outside", "inside_during", "inside_outside",
                    F.round(rd, 3).alias("rate_during"), F.round(ro, 3).alias("rate_outside"), F.round(F.try_divide(rd, ro), 3).alias("displacement_ratio"))


def launch_windows(launches: DataFrame) -> DataFrame:
    """Launches with a window and a pad: w0 from window start or net, w1 one second past window end."""
    w0 = F.coalesce("window_start", "net")
    return launches.withColumn("w0", w0).withColumn("w1", F.coalesce("window_end", "net", w0) + 1.0).filter("w0 is not null and pad_lat is not null and pad_lon is not null")


def _near_places(states: DataFrame, places: DataFrame, hazard_nm: float, on: tuple[str, ...] = ()) -> DataFrame:
    """State rows within the hazard radius of a place (pad_lat, pad_lon), with the distance; rows and places may have to
    agree in further columns."""
    dlat = F.lit(hazard_nm / 60.0)
    dlon = hazard_nm / (60.0 * F.greatest(F.cos(F.radians(F.abs("pad_lat") + hazard_nm / 60.0)), F.lit(0.1)))
    f = cover_cells(places, c("pad_lat") - dlat, c("pad_lon") - dlon, c("pad_lat") + dlat, c("pad_lon") + dlon, CELL_DEG)
    s = flying(states).select("recording", "batch_seq", "pos", "icao24", "callsign", "ts", "lat", "lon", "baro_alt_ft", F.floor(c("ts") / HOUR_S).alias("_h"),
                              floor_cell(c("lat"), CELL_DEG).alias("cell_y"), floor_cell(c("lon"), CELL_DEG).alias("cell_x"))
    j = salted_join(s if on else s.drop("_h"), f, ["cell_y", "cell_x", *on], F.hash("recording", F.floor(c("batch_seq") / SLAB_POLLS)))
    return j.withColumn("nm", planar_nm(c("lat"), c("lon"), c("pad_lat"), c("pad_lon"))).filter(c("nm") <= hazard_nm).drop("cell_y", "cell_x")


def traffic_near_pads(states: DataFrame, launches: DataFrame, hazard_nm: float = HAZARD_NM) -> DataFrame:
    """State rows within the hazard radius of a pad, with `in_window`: a row for every launch of the pad, whenever it was."""
    return _near_places(states, launch_windows(launches), hazard_nm).withColumn("in_window", c("ts").between(c("w0"), c("w1")))


def _hourly(launches: DataFrame) -> DataFrame:
    """Launch windows, once for every hour that they touch."""
    lw = launch_windows(launches).filter(c("w0") <= c("w1"))
    return lw.withColumn("_h", F.explode(F.sequence(F.floor(c("w0") / HOUR_S), F.floor(c("w1") / HOUR_S))))


def traffic_in_windows(states: DataFrame, launches: DataFrame, hazard_nm: float = HAZARD_NM) -> DataFrame:
    """State rows within the hazard radius of a pad during a launch window, a row for every launch.

    Reports meet the pads that have a window in their hour, once a pad, and then the windows of that pad and hour: the
    work follows the traffic of those hours and the result, not reports times launches.
    """
    lh = _hourly(launches)
    near = _near_places(states, lh.select("pad_lat", "pad_lon", "_h").distinct(), hazard_nm, ("_h",))
    w = lh.select("launch_id", "pad_lat", "pad_lon", "_h", "w0", "w1")
    j = salted_join(near, w, ["pad_lat", "pad_lon", "_h"], F.hash("recording", F.floor(c("batch_seq") / SLAB_POLLS)), LEAST_BUCKETS)
    return j.filter(c("ts").between(c("w0"), c("w1"))).drop("_h")


def aircraft_in_windows(hits: DataFrame) -> DataFrame:
    """Distinct addresses of `traffic_in_windows` per recording and launch."""
    one = hits.select("recording", "launch_id", "icao24").distinct()
    return one.groupBy("recording", "launch_id").agg(F.count("icao24").alias("aircraft_in_window"))


def _exposure_by_pairs(near: DataFrame) -> DataFrame:
    return near.groupBy("recording", "launch_id").agg(
        F.countDistinct(F.when(c("in_window"), c("icao24"))).alias("aircraft_in_window"), F.countDistinct(F.when(~c("in_window"), c("icao24"))).alias("aircraft_outside_window"))


def _once(df: DataFrame, *key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key stands once and the others; nulls are one key."""
    n = df.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*key)))
    return n.filter("_n = 1").drop("_n"), n.filter("_n > 1").drop("_n")


def launch_exposure(states: DataFrame, launches: DataFrame, hazard_nm: float = HAZARD_NM) -> DataFrame:
    """Per recording and launch: aircraft inside during the window and outside it.

    A pad's traffic is reduced to first and last time of each aircraft once, whatever the number of its launches. A launch
    whose window misses the recording sees all of them outside. For the others, an aircraft is not outside only if its
    first and last time are in the window; who is inside is looked up by report. Launches that are listed with more than
    one window are counted pair by pair.
    """
    lw = launch_windows(launches).select("launch_id", "pad_lat", "pad_lon", "window_start", "window_end", "net", "w0", "w1").distinct()
    lw, repeated = _once(lw, "launch_id")
    pads = lw.select("pad_lat", "pad_lon").distinct()
    per = _near_places(states, pads, hazard_nm).groupBy("recording", "pad_lat", "pad_lon", "icao24").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    base = per.groupBy("recording", "pad_lat", "pad_lon").agg(F.count_if(c("icao24").isNotNull() & c("t0").isNotNull()).alias("n"), F.min("t0").alias("r0"), F.max("t1").alias("r1"))
    pairs = salted_join(base, lw.select("launch_id", "pad_lat", "pad_lon", "w0", "w1"), ["pad_lat", "pad_lon"], F.hash("recording"), LEAST_BUCKETS)
    meets = F.coalesce((c("r0") <= c("w1")) & (c("r1") >= c("w0")), F.lit(False))
    apart = pairs.filter(~meets).select("recording", "launch_id", F.lit(0).cast("long").alias("aircraft_in_window"), c("n").alias("aircraft_outside_window"))

    within = aircraft_in_windows(traffic_in_windows(states, lw, hazard_nm)).select("recording", "launch_id", "aircraft_in_window", F.lit(0).cast("long").alias("enclosed"))
    stay = per.filter("icao24 is not null").withColumn("_h", F.floor(c("t0") / HOUR_S))
    stay = salted_join(stay, _hourly(lw).select("launch_id", "pad_lat", "pad_lon", "_h", "w0", "w1"), ["pad_lat", "pad_lon", "_h"], F.hash("recording"), LEAST_BUCKETS)
    stay = stay.filter((c("t0") >= c("w0")) & (c("t1") <= c("w1"))).groupBy("recording", "launch_id").agg(F.count(F.lit(1)).alias("enclosed"))
    within = within.unionByName(stay.withColumn("aircraft_in_window", F.lit(0).cast("long"))).withColumn("n", F.lit(0).cast("long"))
    met = pairs.filter(meets).select("recording", "launch_id", "n", F.lit(0).cast("long").alias("aircraft_in_window"), F.lit(0).cast("long").alias("enclosed"))
    met = met.unionByName(within).groupBy("recording", "launch_id").agg(*[F.sum(x).alias(x) for x in ("n", "aircraft_in_window", "enclosed")])
    met = met.select("recording", "launch_id", "aircraft_in_window", (c("n") - c("enclosed")).alias("aircraft_outside_window"))
    once = apart.unionByName(met)
    return once if repeated.isEmpty() else once.unionByName(_exposure_by_pairs(traffic_near_pads(states, repeated, hazard_nm)))


def closest_per_launch(hits: DataFrame, k: int = 10) -> DataFrame:
    """Closest sample of each aircraft of `traffic_in_windows`, the k closest aircraft per launch."""
    best = hits.groupBy("recording", "launch_id", "icao24").agg(
        F.min_by(F.struct("nm", "baro_alt_ft", "ts"), F.struct("nm", "batch_seq", "pos")).alias("_s")).select("recording", "launch_id", "icao24", "_s.*")
    w = W.partitionBy("recording", "launch_id").orderBy("nm", "icao24")
    return best.withColumn("rank", F.row_number().over(w)).filter(c("rank") <= k)


def launch_findings(states: DataFrame, launches: DataFrame, hits: DataFrame, now: float) -> DataFrame:
    """Aircraft of `traffic_in_windows`, stale record in an open window, pad outside the recorded box."""
    boxes = flying(states).groupBy("recording").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.min("lat").alias("lamin"), F.max("lat").alias("lamax"), F.min("lon").alias("lomin"), F.max("lon").alias("lomax"))
    inside_rows = aircraft_in_windows(hits).filter("aircraft_in_window > 0").select("recording", "launch_id", F.lit("LCH-001").alias("rule_id"), F.lit("medium").alias("severity"), c("aircraft_in_window").cast("double").alias("measure"))
    lw = launch_windows(launches)
    age = now - c("last_updated")
    stale = lw.filter((age > LAUNCH_STALE_S) & (c("w0") <= now) & (c("w1") >= now)).select(
        F.lit(None).cast("string").alias("recording"), "launch_id", F.lit("LCH-002").alias("rule_id"), F.lit("low").alias("severity"), F.round(age / 3600.0, 1).alias("measure"))
    # windows overlap recordings: both sides are cut into hours, so the interval join is an equi-join
    lh = lw.withColumn("_h", F.explode(F.sequence(F.floor(c("w0") / HOUR_S), F.floor(c("w1") / HOUR_S))))
    bh = boxes.withColumn("_h", F.explode(F.sequence(F.floor(c("t0") / HOUR_S), F.floor(c("t1") / HOUR_S))))
    out_of_box = ~(c("pad_lat").between(c("lamin") - 1, c("lamax") + 1) & c("pad_lon").between(c("lomin") - 1, c("lomax") + 1))
    away = lh.join(bh, "_h").filter((c("w0") <= c("t1")) & (c("w1") >= c("t0")) & out_of_box).select("recording", "launch_id").distinct().select(
        "recording", "launch_id", F.lit("LCH-003").alias("rule_id"), F.lit("low").alias("severity"), F.lit(1.0).alias("measure"))
    return inside_rows.unionByName(stale).unionByName(away)


def _pads_covered(pads: DataFrame, features: DataFrame, slack_nm: float) -> DataFrame:
    """Rows with a pad and volume pairs: the pad is inside or close to the centroid. A pair meets in the pad's cell only."""
    at = pads.withColumn("cell_y", floor_cell(c("pad_lat"), CELL_DEG)).withColumn("cell_x", floor_cell(c("pad_lon"), CELL_DEG))
    f = with_bbox(features)
    dlat = slack_nm / 60.0
    dlon = slack_nm / (60.0 * F.greatest(F.cos(F.radians(F.abs("centroid_lat") + dlat)), F.lit(0.1)))
    f = cover_cells(
        f, F.least("lamin", c("centroid_lat") - dlat), F.least("lomin", c("centroid_lon") - dlon), F.greatest("lamax", c("centroid_lat") + dlat), F.greatest("lomax", c("centroid_lon") + dlon), CELL_DEG)
    near = F.coalesce(planar_nm(c("pad_lat"), c("pad_lon"), c("centroid_lat"), c("centroid_lon")) <= slack_nm, F.lit(False))
    return at.join(f, ["cell_y", "cell_x"]).filter(near | inside(c("pad_lat"), c("pad_lon"))).drop("cell_y", "cell_x")


_PAD = ["pad_lat", "pad_lon"]
_OVERLAP = "(effective_ts is null or effective_ts <= w1) and (expire_ts is null or expire_ts >= w0)"


def _over_pads(launches: DataFrame, features: DataFrame, slack_nm: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Launches listed with one window, volumes listed once over a pad, and the distinct pairs that any others are part of."""
    lw = launch_windows(launches).select("launch_id", *_PAD, "w0", "w1").distinct()
    at = _pads_covered(lw.select(*_PAD).distinct(), features, slack_nm).select("notam_id", *_PAD, "effective_ts", "expire_ts").distinct()
    once, repeated = _once(lw, "launch_id")
    single, more = _once(at, "notam_id", *_PAD)
    pairs = more.join(once, _PAD).unionByName(at.join(repeated, _PAD)).filter(_OVERLAP)
    return once, single, pairs.select("launch_id", "notam_id").distinct()


def covering(launches: DataFrame, features: DataFrame, slack_nm: float = PAD_SLACK_NM) -> DataFrame:
    """Launch and volume pairs: times overlap, and the pad is inside or close to the centroid. Geometry is decided once a
    pad; the pairs of its launches follow by an equi-join."""
    lw, at, others = _over_pads(launches, features, slack_nm)
    j = salted_join(at, lw, _PAD, F.hash("notam_id"), LEAST_BUCKETS)
    return j.filter(_OVERLAP).select("launch_id", "notam_id").unionByName(others)


def covering_counts(launches: DataFrame, features: DataFrame, slack_nm: float = PAD_SLACK_NM) -> DataFrame:
    """Launches with the number of volumes that `covering` pairs with them, at least one, without the pairs.

    Of the volumes over a pad, those that expire before the window leave the ones that took effect up to its end: both are
    running counts over times. Volumes that expire before they take effect and windows that end before they begin can miss
    both ways and are looked at one by one, as are launches and volumes that are listed with more than one row.
    """
    lw, at, others = _over_pads(launches, features, slack_nm)
    pad = _PAD
    # a row is a time of a pad: n volumes begin (side b) or expire (side x) there, or a window asks for the count so far
    per = lambda side, when, o: at.withColumn("at", when).groupBy(*pad, "at").agg(F.count(F.lit(1)).alias("n")).select(*pad, F.lit(side).alias("side"), "at", F.lit(o).alias("o"), "n", F.lit(None).cast("string").alias("launch_id"), F.lit(False).alias("asks"))
    ask = lambda side, when, o: lw.select(*pad, F.lit(side).alias("side"), c(when).alias("at"), F.lit(o).alias("o"), F.lit(0).cast("long").alias("n"), "launch_id", F.lit(True).alias("asks"))
    began = per("b", F.coalesce("effective_ts", F.lit(float("-inf"))), 0).unionByName(ask("b", "w1", 1))
    gone = per("x", c("expire_ts"), 1).filter("at is not null").unionByName(ask("x", "w0", 0))
    w = W.partitionBy(*pad, "side").orderBy("at", "o").rowsBetween(W.unboundedPreceding, 0)
    marks = began.unionByName(gone).withColumn("n", F.sum("n").over(w)).filter("asks")
    counted = marks.select("launch_id", F.when(c("side") == "b", c("n")).otherwise(-c("n")).alias("volumes"))
    # not begun and gone at once: taken away above though never counted
    missed = (c("effective_ts") > c("w1")) & (c("expire_ts") < c("w0"))
    odd = at.filter("expire_ts < effective_ts").join(lw, pad).filter(missed).unionByName(
        at.filter("not coalesce(expire_ts < effective_ts, false)").join(lw.filter("w1 < w0"), pad).filter(missed))
    others = others.select("launch_id", F.lit(1).cast("long").alias("volumes"))
    return counted.unionByName(odd.select("launch_id", F.lit(1).cast("long").alias("volumes"))).unionByName(others).groupBy("launch_id").agg(F.sum("volumes").alias("volumes")).filter("volumes > 0")


def is_us() -> Column:
    where = F.lower(F.concat_ws(" ", F.coalesce("location", F.lit("")), F.coalesce("pad", F.lit(""))))
    out = F.lit(False)
    for m in US_MARKERS:
        out = out | where.contains(m)
    return out


def launches_covered(launches: DataFrame, features: DataFrame, now: float, lookahead_s: float = LOOKAHEAD_S) -> DataFrame:
    """Every launch with a window: how many volumes cover it, and TFR-002 for a near US launch that none does."""
    # the number of volumes over one pad in one window is what matters, so they are counted, not listed
    cov = covering_counts(launches, features)
    lw = launch_windows(launches).join(cov, "launch_id", "left").withColumn("volumes", F.coalesce("volumes", F.lit(0)))
    soon = (c("w1") >= now) & (c("w0") - now <= lookahead_s)
    gap = is_us() & soon & (c("volumes") == 0) & ~F.lower(F.coalesce("status", F.lit(""))).isin(IDLE_STATUS)
    return lw.select("launch_id", "volumes", is_us().alias("us_airspace"), soon.alias("within_lookahead"), gap.alias("uncovered"))


def stale_products(features: DataFrame, products: DataFrame, now: float) -> DataFrame:
    """TFR-003: products (product, fetched_ts) older than six hours with volumes in effect."""
    live = features.filter(active(F.lit(now))).groupBy("product").agg(F.count(F.lit(1)).alias("active"))
    old = products.filter(now - c("fetched_ts") > TFR_STALE_S)
    return old.join(live, "product").select("product", "active", F.round((now - c("fetched_ts")) / 3600.0, 1).alias("age_h"), F.lit("TFR-003").alias("rule_id"), F.lit("low").alias("severity"))
