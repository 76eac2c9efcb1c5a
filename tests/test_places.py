"""Traffic against launches and volumes: the short ways give what pairs of rows give, odd rows included."""

import random

from pyspark.sql import functions as F

from airlens.operators import airspace as asp

STATES = "recording string, batch_seq int, pos int, icao24 string, callsign string, ts double, lat double, lon double, on_ground boolean, baro_alt_ft double"
LAUNCHES = "launch_id string, pad_lat double, pad_lon double, window_start double, window_end double, net double, location string, pad string, status string, last_updated double"
VOLUMES = ("notam_id string, type string, lower_ft double, upper_ft double, effective_ts double, expire_ts double, polygon array<array<double>>, "
           "circle struct<lat: double, lon: double, radius_nm: double>, centroid_lat double, centroid_lon double")


def states(spark, n=400):
    r = random.Random(3)
    rows = []
    for i in range(n):
        rec = r.choice(["a", "b", "c", None])
        ts = r.choice([None, 7200.0 * "abc".find(rec or "a") + r.randrange(0, 4000)])
        rows.append((rec, i // 10, i, r.choice(["x", "y", "z", None]), None, ts, 32 + r.random() * 2, -97 + r.random() * 2, False, r.choice([None, 3000.0, 9000.0])))
    return spark.createDataFrame(rows, STATES)


def launches(spark, n=40):
    r = random.Random(4)
    rows = [(r.choice([f"L{i}", f"L{i // 4}", None]), 32.0 + i % 3, -96.0, r.choice([None, 500.0 * (i % 35)]), r.choice([None, 500.0 * (i % 35) + 900, 100.0]), 1000.0 * (i % 5), "Kourou", "P", "Go", 0.0) for i in range(n)]
    return spark.createDataFrame(rows, LAUNCHES)


def volumes(spark, n=60):
    r = random.Random(5)
    rows = []
    for i in range(n):
        y, x = 32 + r.random() * 2, -97 + r.random() * 2
        poly = [[y - 0.3, x - 0.3], [y + 0.3, x - 0.3], [y, x + 0.3]] if i % 2 else None
        e = r.choice([None, float(r.randrange(0, 15000))])
        rows.append((r.choice([f"R{i}", f"R{i // 3}"]), "SPACE OPERATIONS", r.choice([None, 1000.0]), r.choice([None, 8000.0]), e, r.choice([None, 5000.0, 500.0, (e or 0.0) + 2000]), poly, None if poly else (y, x, 25.0), y, x))
    return spark.createDataFrame(rows, VOLUMES)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_launch_exposure_against_pairs(spark):
    st, l = states(spark), launches(spark)
    near = asp.traffic_near_pads(st, l)
    want = near.groupBy("recording", "launch_id").agg(F.countDistinct(F.when(F.col("in_window"), F.col("icao24"))), F.countDistinct(F.when(~F.col("in_window"), F.col("icao24"))))
    got = asp.launch_exposure(st, l)
    assert rows(got) == rows(want) and got.filter("aircraft_in_window > 0").count() > 5


def test_traffic_in_windows_against_pairs(spark):
    st, l = states(spark), launches(spark)
    cols = ["recording", "batch_seq", "pos", "icao24", "launch_id", "nm"]
    got = asp.traffic_in_windows(st, l)
    assert rows(got.select(*cols)) == rows(asp.traffic_near_pads(st, l).filter("in_window").select(*cols)) != []
    assert rows(asp.closest_per_launch(got)) == rows(asp.closest_per_launch(asp.traffic_near_pads(st, l).filter("in_window").drop("in_window")))


def test_covering_counts_against_pairs(spark):
    l, v = launches(spark), volumes(spark)
    lw = asp.launch_windows(l)
    near = F.coalesce(asp.planar_nm(F.col("pad_lat"), F.col("pad_lon"), F.col("centroid_lat"), F.col("centroid_lon")) <= asp.PAD_SLACK_NM, F.lit(False))
    pairs = lw.crossJoin(v).filter((asp.inside(F.col("pad_lat"), F.col("pad_lon")) | near) & F.expr(asp._OVERLAP)).select("launch_id", "notam_id").distinct()
    assert rows(asp.covering(l, v)) == rows(pairs) != []
    assert rows(asp.covering_counts(l, v)) == rows(pairs.groupBy("launch_id").count())


def test_traffic_inside_against_pairs(spark):
    st, v = states(spark), volumes(spark)
    cols = ["recording", "batch_seq", "pos", "icao24", "notam_id", "is_active"]
    want = asp.flying(st).crossJoin(v).filter(asp.inside(F.col("lat"), F.col("lon"), F.col("baro_alt_ft"))).withColumn("is_active", asp.active(F.col("ts")))
    hits = asp.traffic_inside(st, v)
    assert rows(hits.select(*cols)) == rows(want.select(*cols)) != []
    assert rows(asp.traffic_inside(st, v, only_active=True).select(*cols)) == rows(want.filter("is_active").select(*cols))
    a, b = F.when(F.col("is_active"), F.col("icao24")), F.when(~F.col("is_active"), F.col("icao24"))
    assert rows(asp.volume_summary(hits)) == rows(want.groupBy("recording", "notam_id").agg(F.countDistinct(a), F.countDistinct(b)))


def test_aircraft_inside_against_pairs(spark):
    st = states(spark, 1200).unionByName(states(spark, 40).withColumn("lat", F.lit(float("nan"))))
    v = volumes(spark).unionByName(volumes(spark, 6).withColumn("notam_id", F.lit(None).cast("string")))
    wide = v.filter("notam_id = 'R7'").withColumns({"notam_id": F.lit("wide"), "polygon": F.array(*[F.array(F.lit(y), F.lit(x)) for y, x in ((20.0, -110.0), (50.0, -110.0), (50.0, -96.1), (20.0, -96.1))])})
    v = v.unionByName(wide)
    hits = asp.flying(st).crossJoin(v).filter(asp.inside(F.col("lat"), F.col("lon"), F.col("baro_alt_ft"))).filter("lat <= 90").withColumn("is_active", asp.active(F.col("ts")))
    plain = asp.with_bbox(v).select("notam_id", "lamin", "lomin")
    assert plain.count() == v.count()
    for keys in (["recording", "notam_id"], ["recording", "notam_id", "effective_ts", "expire_ts"]):
        for nulls in (False, True):
            who = F.coalesce("icao24", F.lit("none")) if nulls else F.col("icao24")
            want = rows(hits.groupBy(*keys).agg(F.countDistinct(F.when(F.col("is_active"), who)), F.countDistinct(F.when(~F.col("is_active"), who))))
            assert rows(asp.aircraft_inside(st, v, keys, nulls)) == want and len(want) > 100
            assert rows(asp.aircraft_inside(st, v, keys, nulls, most=300)) == want


def test_volumes_reach_no_row_for_every_report(spark, tmp_path):
    """The queries that count aircraft inside volumes join groups, not pairs of report and volume."""
    st, v = states(spark), volumes(spark).dropDuplicates(["notam_id"])
    for df in (asp.aircraft_inside(st, v, ["recording", "notam_id"]), asp.volume_rows(v, st), asp.displacement(st, v)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "CoGroup" in plan and "_salt" not in plan


def test_displacement_against_pairs(spark):
    st, v = states(spark), volumes(spark)
    keys = ["recording", "notam_id", "effective_ts", "expire_ts"]
    hits = asp.flying(st).crossJoin(v).filter(asp.inside(F.col("lat"), F.col("lon"), F.col("baro_alt_ft"))).withColumn("is_active", asp.active(F.col("ts")))
    per = hits.groupBy(*keys).agg(F.countDistinct(F.when(F.col("is_active"), F.col("icao24"))), F.countDistinct(F.when(~F.col("is_active"), F.col("icao24")))).filter("recording is not null")
    got = asp.displacement(st, v).select("recording", "notam_id", "inside_during", "inside_outside")
    assert rows(got) == rows(per.drop("effective_ts", "expire_ts")) != []


def test_cells_that_meet_as_one_give_the_same_pairs(spark):
    """Cells dealt out three by three: the same pairs once each as cell by cell, from fewer copies."""
    from airlens.operators import proximity
    from airlens.operators.bandjoin import band_join

    rows = spark.range(300).selectExpr("id % 3 as poll", "id", "id * 7919 % 23 - 11 as y", "id * 104729 % 17 - 8 as x", "if(id % 50 = 0, null, id * 31 % 5) as z")
    cells = [F.col(n) for n in "yxz"]
    pairs = lambda span: sorted((r.a, r.b) for r in band_join(rows, rows, ["poll"], cells, cells, span=span).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).collect())
    assert pairs(1) == pairs(2) == pairs(3) == pairs(4) and len(pairs(1)) > 300
    assert proximity.CELLS > 1
