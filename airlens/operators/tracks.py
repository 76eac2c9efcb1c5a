"""Track memory and kinematics per aircraft.

The memory is a fold over accepted fixes, so a plain `lag` is not enough, and one address may carry a third of all
rows, so a group per address is not affordable either. Both are handled the same way: an aircraft's rows are
partitioned by (recording, address, time slab), and what must cross a slab boundary is carried explicitly:

* the largest fix time of all earlier slabs (one number per slab) decides which rows are accepted whatever came
  before them; the remaining rows form short segments behind such a row, and only a segment is folded;
* the last eleven accepted fixes before a slab are copied into it, which is all a window of twelve can reach.

What is joined to the rows has one row an aircraft and slab and grows with the traffic, so it is merged where the rows
lie: a planner that found it small would send it through the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from airlens.functions.geo import haversine_nm, heading_delta
from airlens.thresholds import DEFAULT, Thresholds

KEYS = ["recording", "icao24"]
ORDER = ["batch_seq", "pos"]
SLAB_S = 3600.0
MIN_GAP_S = 0.5  # closer than this is the same fix
SAME_POS_GAP_S = 5.0  # an unchanged position is a repeat for this long


def with_batch_clock(states: DataFrame) -> DataFrame:
    """Add `prev_batch_ts`, the time of the poll before, for sources that do not carry it.

    The clock has one row per poll and is joined on the poll, so no single aircraft or region concentrates rows.
    """
    clock = states.groupBy("recording", "batch_seq").agg(F.max("batch_ts").alias("_ts"))
    w = W.partitionBy("recording").orderBy("batch_seq")
    clock = clock.select("recording", "batch_seq", F.lag("_ts").over(w).alias("prev_batch_ts"))
    return states.drop("prev_batch_ts").join(clock, ["recording", "batch_seq"])


def _has_position() -> Column:
    return F.col("lat").isNotNull() & F.col("lon").isNotNull()


def _segments(states: DataFrame, slab_s: float) -> DataFrame:
    """Assign every row to a segment that starts at a row accepted whatever came before it."""
    s = states.withColumn("_slab", F.floor(F.col("batch_ts") / slab_s)).withColumn("_pos_ts", F.when(_has_position(), F.col("ts")))
    part = [*KEYS, "_slab"]
    carry = s.groupBy(*part).agg(F.max("_pos_ts").alias("_slab_max")).select(
        *part,
        F.max("_slab_max").over(W.partitionBy(*KEYS).orderBy("_slab").rowsBetween(W.unboundedPreceding, -1)).alias("_carry"),
    )
    w = W.partitionBy(*part).orderBy(*ORDER)
    before = F.greatest(F.max("_pos_ts").over(w.rowsBetween(W.unboundedPreceding, -1)), F.col("_carry"))
    far = F.greatest(F.max("_pos_ts").over(w.rowsBetween(W.unboundedPreceding, -12)), F.col("_carry"))
    near = F.collect_list(F.struct("lat", "lon")).over(w.rowsBetween(-11, -1))
    s = (
        s.join(carry.hint("merge"), part)
        .withColumn("_before", before)
        .withColumn("_far", far)
        .withColumn("_near", near)
    )
    repeated = F.exists("_near", lambda p: (p["lat"] == F.col("lat")) & (p["lon"] == F.col("lon")))
    moved = (
        (F.col("ts") >= F.col("_before") + MIN_GAP_S)
        & (F.col("_far").isNull() | (F.col("_far") <= F.col("ts") - SAME_POS_GAP_S))
        & ~F.coalesce(repeated, F.lit(False))
    )
    sure = _has_position() & (F.col("_before").isNull() | (F.col("ts") >= F.col("_before") + SAME_POS_GAP_S) | moved)
    s = (
        s.withColumn("_sure", F.coalesce(sure, F.lit(False)).cast("int"))
        .drop("_carry", "_before", "_far", "_near", "_pos_ts")
        .withColumn("_seg", F.sum("_sure").over(w.rowsBetween(W.unboundedPreceding, 0)))
    )
    # rows in front of a slab's first sure row continue the last segment of an earlier slab
    ends = s.groupBy(*part).agg(F.max("_seg").alias("_last")).select(
        *part,
        F.last(F.when(F.col("_last") > 0, F.struct("_slab", "_last")), ignorenulls=True)
        .over(W.partitionBy(*KEYS).orderBy("_slab").rowsBetween(W.unboundedPreceding, -1))
        .alias("_prev"),
    )
    orphan = F.col("_seg") == 0
    return (
        s.join(ends.hint("merge"), part)
        .withColumn("_seg_slab", F.when(orphan & F.col("_prev").isNotNull(), F.col("_prev._slab")).otherwise(F.col("_slab")))
        .withColumn("_seg_no", F.when(orphan & F.col("_prev").isNotNull(), F.col("_prev._last")).otherwise(F.col("_seg")))
        .drop("_prev", "_sure", "_seg")
    )


def flag_accepted(states: DataFrame, slab_s: float = SLAB_S, t: Thresholds = DEFAULT) -> DataFrame:
    """Add `accepted`: the fix enters the track memory (not a repeat of the last accepted one)."""
    seg = _segments(states, slab_s)
    payload = [c for c in seg.columns if c not in (*KEYS, "_seg_slab", "_seg_no")]
    lead = [*ORDER, *[c for c in payload if c not in ORDER]]
    grouped = seg.groupBy(*KEYS, "_seg_slab", "_seg_no").agg(F.array_sort(F.collect_list(F.struct(*lead))).alias("_rows"))
    accept = (
        "x.lat is not null and x.lon is not null and (s.ts is null"
        f" or (x.batch_seq > s.b and x.prev_batch_ts - s.ts > {t.track_max_age_s}D)"
        f" or (x.ts - s.ts >= {MIN_GAP_S}D and not (x.lat = s.lat and x.lon = s.lon and x.ts - s.ts < {SAME_POS_GAP_S}D)))"
    )
    start = (
        "named_struct('ts', cast(null as double), 'lat', cast(null as double), 'lon', cast(null as double),"
        " 'b', cast(null as int), 'flags', cast(array() as array<boolean>))"
    )
    fold = (
        f"aggregate(_rows, {start}, (s, x) -> if({accept},"
        " named_struct('ts', x.ts, 'lat', x.lat, 'lon', x.lon, 'b', x.batch_seq, 'flags', concat(s.flags, array(true))),"
        " named_struct('ts', s.ts, 'lat', s.lat, 'lon', s.lon, 'b', s.b, 'flags', concat(s.flags, array(false)))), s -> s.flags)"
    )
    flags = F.expr(f"if(size(_rows) = 1, array(_rows[0].lat is not null and _rows[0].lon is not null), {fold})")
    return (
        grouped.select(*KEYS, F.explode(F.arrays_zip("_rows", flags.alias("_flags"))).alias("_z"))
        .select(*KEYS, "_z._rows.*", F.col("_z._flags").alias("accepted"))
    )


def _with_halo(flagged: DataFrame, n: int) -> DataFrame:
    """Copy the last n accepted fixes before each slab into it, marked `_halo`."""
    part = [*KEYS, "_slab"]
    newest_first = W.partitionBy(*part).orderBy(*[F.desc(c) for c in ORDER])
    payload = [c for c in flagged.columns if c not in part]
    lead = [*ORDER, *[c for c in payload if c not in ORDER]]
    ranked = flagged.withColumn("_rank", F.sum(F.col("accepted").cast("int")).over(newest_first.rowsBetween(W.unboundedPreceding, 0)))
    tails = ranked.groupBy(*part).agg(
        F.array_sort(F.collect_list(F.when(F.col("accepted") & (F.col("_rank") <= n), F.struct(*lead)))).alias("_tail")
    )
    # `_before` counts earlier slabs that have an accepted fix; ranging over it skips the slabs that have none
    has = F.size("_tail") > 0
    tails = tails.withColumn("_before", F.coalesce(F.sum(has.cast("long")).over(W.partitionBy(*KEYS).orderBy("_slab").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    reach = W.partitionBy(*KEYS).orderBy("_before").rangeBetween(-n, -1)
    halo = (
        tails.withColumn("_rows", F.flatten(F.collect_list(F.when(has, F.col("_tail"))).over(reach)))
        .select(*part, F.explode(F.expr(f"slice(_rows, greatest(size(_rows) - {n - 1}, 1), {n})")).alias("_r"))
        .select(*part, "_r.*")
        .select(*flagged.columns)
    )
    both = flagged.withColumn("_halo", F.lit(False)).unionByName(halo.withColumn("_halo", F.lit(True)))
    # dealt out once for all windows behind: those of a fix's history are by (slab, accepted), and the rows with their
    # histories, several times as long, would be dealt out again by slab
    return both.repartition(*part)


def _features(rows: DataFrame, t: Thresholds) -> DataFrame:
    """Kinematics of every accepted fix against the ones before it in its session."""
    part = [*KEYS, "_slab", "accepted"]
    w = W.partitionBy(*part).orderBy(*ORDER)
    prev_cols = ["batch_seq", "ts", "lat", "lon", "baro_alt_ft", "on_ground", "gs_kt", "track_deg"]
    rows = rows.withColumn("_p", F.lag(F.struct(*prev_cols)).over(w))
    evicted = (F.col("batch_seq") > F.col("_p.batch_seq")) & (F.col("prev_batch_ts") - F.col("_p.ts") > t.track_max_age_s)
    rows = rows.withColumn("_new", F.when(F.col("_p").isNull() | evicted, 1).otherwise(0))
    rows = rows.withColumn("_session", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("_p", F.when(F.col("accepted") & (F.col("_new") == 0), F.col("_p")))
    p, c = (lambda n: F.col(f"_p.{n}")), F.col
    dt = c("ts") - p("ts")
    rows = rows.withColumn("dt_s", dt).withColumn("dist_nm", haversine_nm(p("lat"), p("lon"), c("lat"), c("lon")))
    rows = rows.withColumn("implied_gs_kt", c("dist_nm") / c("dt_s") * 3600.0)
    airborne = ~(c("on_ground") | p("on_ground"))
    rows = (
        rows.withColumn("gs_mismatch_kt", c("implied_gs_kt") - c("gs_kt"))
        .withColumn("implied_vrate_fpm", F.when(airborne, (c("baro_alt_ft") - p("baro_alt_ft")) / c("dt_s") * 60.0))
        .withColumn("_turn", heading_delta(p("track_deg"), c("track_deg")))
        .withColumn("turn_rate_dps", c("_turn") / c("dt_s"))
        .withColumn("accel_kt_s", (c("gs_kt") - p("gs_kt")) / c("dt_s"))
        .withColumn("vrate_mismatch_fpm", c("implied_vrate_fpm") - c("vrate_fpm"))
        .withColumn("gs_mismatch_ratio", c("gs_mismatch_kt") / F.greatest(c("gs_kt"), F.lit(50.0)))
    )
    n = t.track_window
    ws = W.partitionBy(*part, "_session").orderBy(*ORDER)
    whole, steps = ws.rowsBetween(-(n - 1), 0), ws.rowsBetween(-(n - 2), 0)
    rows = (
        rows.withColumn("n_fixes", F.count(F.lit(1)).over(whole).cast("int"))
        .withColumn("window_heading_sum_deg", F.coalesce(F.sum("_turn").over(steps), F.lit(0.0)))
        .withColumn("window_path_nm", F.coalesce(F.sum("dist_nm").over(steps), F.lit(0.0)))
        .withColumn("_gs_n", F.count("gs_kt").over(whole))
        .withColumn("_gs_sd", F.stddev_samp("gs_kt").over(whole))
        .withColumn("_first", F.first(F.struct("ts", "lat", "lon")).over(whole))
        .withColumn("history", F.collect_list(F.struct("ts", "squawk", "baro_alt_ft", "selected_alt_ft", "vrate_fpm")).over(whole))
    )
    return (
        rows.withColumn("window_gs_std_kt", F.when(c("_gs_n") >= 2, c("_gs_sd")))
        .withColumn("window_net_nm", haversine_nm(F.col("_first.lat"), F.col("_first.lon"), c("lat"), c("lon")))
        .withColumn("window_span_s", c("ts") - F.col("_first.ts"))
        .drop("_p", "_new", "_turn", "_gs_n", "_gs_sd", "_first")
    )


FEATURES = [
    "n_fixes", "dt_s", "dist_nm", "implied_gs_kt", "gs_mismatch_kt", "implied_vrate_fpm", "turn_rate_dps", "window_heading_sum_deg",
    "window_net_nm", "window_path_nm", "window_span_s", "accel_kt_s", "vrate_mismatch_fpm", "gs_mismatch_ratio", "window_gs_std_kt",
]


def track_fixes(states: DataFrame, slab_s: float = SLAB_S, t: Thresholds = DEFAULT) -> DataFrame:
    """One row per accepted fix with its features (null on the first fix of a session) and the session's history."""
    rows = _with_halo(flag_accepted(states, slab_s, t), t.track_window - 1)
    return _features(rows, t).filter("accepted and not _halo").drop("_slab", "accepted", "_halo", "_session")


def with_features(states: DataFrame, slab_s: float = SLAB_S, t: Thresholds = DEFAULT, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Every state row with what its poll left in the track memory.

    Feature columns are those of the aircraft's last accepted fix of the same poll (null when there is none or it is the
    first of its session). `track` holds up to twelve remembered fixes at the end of the poll, oldest first. `keep` may
    store the flagged rows, which are read twice, so that no plan holds the whole way to the features.
    """
    rows = _features(_with_halo(keep(flag_accepted(states, slab_s, t)), t.track_window - 1), t)
    snap = F.when(
        F.col("accepted"),
        F.struct("batch_seq", "pos", "ts", F.struct(*FEATURES).alias("f"), F.col("gs_kt").alias("reported_gs_kt"),
                 F.col("baro_alt_ft").alias("fix_alt_ft"), F.col("vrate_fpm").alias("fix_vrate_fpm"), "history"),
    )
    # peers of one poll share the frame, so each row sees the memory as the poll left it
    w = W.partitionBy(*KEYS, "_slab").orderBy("batch_seq").rangeBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_snap", F.max(snap).over(w)).filter("not _halo")
    same_poll = (F.col("_snap.batch_seq") == F.col("batch_seq")) & (F.col("_snap.f.n_fixes") >= 2)
    kept = F.col("batch_ts") - F.col("_snap.ts") <= t.track_max_age_s
    base = [c for c in states.columns]
    return rows.select(
        *base,
        *[F.when(same_poll, F.col(f"_snap.f.{c}")).alias(c) for c in FEATURES],
        F.when(same_poll, F.col("_snap.ts")).alias("feature_ts"),
        F.when(same_poll, F.col("_snap.reported_gs_kt")).alias("reported_gs_kt"),
        F.when(kept, F.col("_snap.history")).otherwise(F.array().cast(rows.schema["history"].dataType)).alias("track"),
        "accepted",
    )
