"""Track memory against a plain Python fold, on generated traffic with repeats, late fixes and silence."""

import math
import random

from pyspark.sql import functions as F

from airlens.operators import density, tracks
from airlens.plans import bridge

COLS = "recording string, icao24 string, batch_seq int, pos int, batch_ts double, prev_batch_ts double, ts double, lat double, lon double, baro_alt_ft double, on_ground boolean, gs_kt double, track_deg double, vrate_fpm double, squawk string, selected_alt_ft double"


def make(seed, step, n=90, aircraft=4):
    rnd = random.Random(seed)
    rows, prev, t = [], None, 1.7e9
    for b in range(n):
        t += step if b % 31 else 900.0
        pos = 0
        for a in range(aircraft):
            for _ in range(rnd.choice([0, 1, 1, 1, 3]) if a else 4):
                lag = rnd.choice([0.0, 0.2, 0.4, 1.0, 3.0, 3.0, 70.0])
                fixed = rnd.random() < 0.3
                lat = None if rnd.random() < 0.05 else (30.0 if fixed else round(30 + rnd.random(), 3))
                rows.append(("r", f"a{a}", b, pos, t, prev, t - lag, lat, 10.0 if fixed else round(10 + rnd.random(), 3), 5000.0, False, rnd.choice([None, 200.0, 250.0]), rnd.choice([None, 10.0, 350.0, 200.0]), 0.0, "1200", None))
                pos += 1
        prev = t
    return rows


def fold(rows):
    """Accepted flags and window features, one row after the other."""
    memory, out = {}, {}
    by_batch = {}
    for r in rows:
        by_batch.setdefault(r[2], []).append(r)
    for b in sorted(by_batch):
        for r in by_batch[b]:
            k = r[1]
            if r[7] is None:
                continue
            q = memory.setdefault(k, [])
            if q:
                dt = r[6] - q[-1][6]
                if dt < 0.5 or (r[7] == q[-1][7] and r[8] == q[-1][8] and dt < 5):
                    continue
            q.append(r)
            del q[:-12]
            out[(b, r[3])] = (len(q), round(r[6] - q[0][6], 3))
        now = by_batch[b][0][4]
        for k in [k for k, q in memory.items() if q and now - q[-1][6] > 600]:
            del memory[k]
    return out


def test_memory_equals_plain_fold(spark):
    for seed, step, slab in [(1, 12.0, 3600.0), (2, 12.0, 120.0), (3, 1.0, 20.0), (4, 0.4, 5.0)]:
        rows = make(seed, step)
        df = spark.createDataFrame(rows, COLS)
        got = {(r.batch_seq, r.pos): (r.n_fixes, round(r.window_span_s, 3)) for r in tracks.track_fixes(df, slab).collect()}
        assert got == fold(rows)


def test_slab_width_does_not_change_features(spark, sf):
    st = bridge.states(spark, sf)
    a = tracks.with_features(st, 3600.0).select("recording", "batch_seq", "pos", "n_fixes", F.round("window_path_nm", 6).alias("p"), F.size("track").alias("k"))
    b = tracks.with_features(st, 100.0).select("recording", "batch_seq", "pos", "n_fixes", F.round("window_path_nm", 6).alias("p"), F.size("track").alias("k"))
    assert a.exceptAll(b).count() == 0 and a.count() == st.count()


def test_batch_clock(spark, sf):
    st = bridge.states(spark, sf)
    again = tracks.with_batch_clock(st).select("batch_seq", "pos", "prev_batch_ts")
    assert again.exceptAll(st.select("batch_seq", "pos", "prev_batch_ts")).count() == 0


def test_presence_is_independent_of_slabs(spark, sf):
    st = bridge.states(spark, sf)
    cols = ["recording", "batch_seq", "pos", "presence_s"]
    assert density.presence(st, 60.0).select(*cols).exceptAll(density.presence(st, 1e6).select(*cols)).count() == 0


def test_haversine_by_hand(spark):
    from airlens.functions.geo import haversine_nm, heading_delta

    r = spark.range(1).select(haversine_nm(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("d"), heading_delta(F.lit(350.0), F.lit(10.0)).alias("a"), heading_delta(F.lit(0.0), F.lit(180.0)).alias("b"), haversine_nm(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("n")).first()
    assert math.isclose(r.d, 3440.065 * math.pi / 180, rel_tol=1e-9) and r.a == 20 and r.b == 180 and r.n is None
