"""Streams give what the batch jobs give, wherever the input is cut."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from airlens.operators import airspace, audit, folds, rules, tracks, watchlist
from airlens.plans import bridge, places
from airlens.sources import sinks
from airlens.streaming import pipeline as p
from airlens.streaming.audit import StreamingAudit


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", tempfile.mkdtemp(prefix="ck-")).trigger(availableNow=True).start()
    q.awaitTermination()


def run_each(df, fn):
    q = df.writeStream.foreachBatch(fn).option("checkpointLocation", tempfile.mkdtemp(prefix="ck-")).trigger(availableNow=True).start()
    q.awaitTermination()


def landing(spark, sf, parts=3):
    """State rows in a few files in time order."""
    st = bridge.states(spark, sf).cache()
    folder = tempfile.mkdtemp(prefix="land-")
    for i in range(parts):
        st.filter(F.floor(F.col("batch_seq") * parts / 20) == i).coalesce(1).write.mode("append").parquet(folder)
    return st, folder


def every_rule(spark):
    """Two short recordings in which every state rule, both poll rules, a burst and a collapse fire."""
    r, rows = random.Random(2), []
    for rec, polls in (("r1", 26), ("r2", 14)):
        for b in range(polls):
            ts = 1.7e9 + 15.0 * b + (900 if b >= 20 else 0)
            prev = None if b == 0 else 1.7e9 + 15.0 * (b - 1) + (900 if b - 1 >= 20 else 0)
            names = [f"a{i:02d}" for i in range(24 if not 17 <= b < 19 else 6)] + ([f"n{i:02d}" for i in range(30)] if b == 9 else [])
            names += ["a01"] if b % 4 == 1 else []
            for pos, icao in enumerate(names):
                i = int(icao[1:])
                turn = float((b * 45) % 360) if i in (3, 4) else 90.0
                far = 1.5 if i == 5 and b % 3 == 0 else 0.0 if pos < 24 else 0.4
                step = b * (0.02 if i not in (3, 4) else 0.0)
                alt = None if i == 8 and b % 5 == 0 else 12_000.0 + 500 * i + (9000 if i == 6 and b % 2 else 0) + (1000 if i == 9 and b > 4 else 0)
                rows.append((rec, b, pos, ts, prev, "dfw" if b % 2 else "iah", "x", icao, None if i == 7 else f"ABC{i}", f"N{i}", "B738", ts - (200.0 if i == 10 and b > 2 else i % 3), 32.0 + i * 0.3 + far + (0.01 * (b % 4) if i in (3, 4) else 0), -97.0 + step + (0.01 * (b % 3) if i in (3, 4) else 0) if not (i == 11 and b % 4 == 0) else None,
                             alt if i != 4 else 2000.0, None, {12: 600.0, 4: 90.0}.get(i, 280.0), turn, 7000.0 if i == 13 and b % 3 == 0 else 0.0, {14: "7700", 15: "1200", 16: "7500" if b > 6 else "2000"}.get(i, "2000"), i == 17 and b < 3,
                             "medical" if i == 18 and b % 6 == 2 else None, 12_000.0 + 500 * i if i == 9 else None, 4 if i == 19 else 8, 9, 3, r.choice(["adsb", "mlat"]) if i == 20 else "adsb", "x"))
    # a second aircraft close to a22
    rows += [(*x[:2], 90, *x[3:7], "z22", *x[8:12], x[12] + 0.01, x[13], x[14] + 200, *x[15:]) for x in rows if x[7] == "a22" and x[1] % 2]
    return spark.createDataFrame(rows, "recording string, batch_seq int, pos int, batch_ts double, prev_batch_ts double, region string, provider string, icao24 string, callsign string, registration string, aircraft_type string, ts double, lat double, lon double, baro_alt_ft double, geo_alt_ft double, gs_kt double, track_deg double, vrate_fpm double, squawk string, "
                                 "on_ground boolean, emergency string, selected_alt_ft double, nic int, nac_p int, sil int, position_source string, source string").checkpoint()


def test_audit_in_a_stream(spark):
    """Features, findings of every rule, occurrences, trust, polls, trails and flags, for cuts inside polls, with a late row."""
    from airlens.session import cut_lineage

    cut_lineage(spark.range(1))  # sets the checkpoint folder
    st = every_rule(spark)
    entries = spark.createDataFrame([("W1", "a02", None, None, "high", "detect", 1), ("W2", None, "ABC2", None, "critical", "protect", 2)], "entry_id string, icao24 string, callsign_prefix string, registration string, severity string, mode string, ord int")
    listed = lambda rows: watchlist.findings(rows, entries, [4])
    candidates = cut_lineage(audit.candidates(st, extra=[listed(st)]))
    accepted = cut_lineage(folds.cooldown(candidates))
    fired = {r.rule_id for r in accepted.select("rule_id").distinct().collect()}
    assert fired >= {"SEC-001", "SEC-003", "SEC-004", "SEC-010", "SEC-011", "SEC-012", "SEC-013", "SEC-014", "SEC-016", "SEC-017", "SEC-018", "SEC-020", "OPS-001", "OPS-003", "OPS-004", "OPS-005", "SAF-003", "SAF-004"}, fired

    folder = tempfile.mkdtemp(prefix="audit-")
    a = StreamingAudit(f"{folder}/audit", st.schema, extra=[listed], flagged=lambda rows: rows.filter("squawk = '7700'"), keep_features=True)
    at = F.struct("batch_seq", "pos")
    ends = [(0, 3), (4, 11), (12, 200), (19, 0), (99, 0)]
    low = F.struct(F.lit(-1), F.lit(-1))
    for b, pos in ends:
        top = F.struct(F.lit(b), F.lit(pos))
        part = st.filter((at > low) & (at <= top))
        if b == 19:  # a row of a poll that is closed
            part = part.unionByName(st.filter("recording = 'r1' and batch_seq = 2 and pos = 0"))
        part.write.mode("append").parquet(f"{folder}/land")
        q = p.read_states(spark, f"{folder}/land", st.schema, 1000).writeStream.foreachBatch(a).option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
        low = top
    before = a.results(spark, "findings").count()
    a.step(part, a.last_batch(spark))  # a retry repeats nothing
    assert a.results(spark, "findings").count() == before
    a.finish(spark)
    same = lambda x, y: (x.count(), x.exceptAll(y).count(), y.exceptAll(x).count())
    n = accepted.count()
    cols = ["recording", "batch_seq", "phase", "pos", "rule_ord", "rule_id", "severity", "icao24", "occurrences", "measure", "evidence", F.round("risk_score", 9)]
    assert same(a.results(spark, "findings").select(*cols), accepted.select(*cols)) == (n, 0, 0)
    trust = ["recording", "icao24", F.round("trust", 9), "hits"]
    want = folds.trust_scores(st, candidates, accepted).select(*trust)
    assert same(a.now(spark, "trust").select(*trust), want) == (want.count(), 0, 0)
    feats = ["recording", "batch_seq", "pos", "accepted", *[F.round(f, 6) for f in tracks.FEATURES], F.size("track")]
    assert same(a.results(spark, "work/featured").select(*feats), tracks.with_features(st).select(*feats)) == (st.count(), 0, 0)
    polls = ["recording", "batch_seq", "n_states", "n_new", "hist_new", F.round("mean_new", 9), "hist_size", F.round("mean_size", 9)]
    want = rules.poll_counts(st).select(*polls)
    assert same(a.results(spark, "polls").select(*polls), want) == (want.count(), 0, 0)
    assert [(r.recording, r.batch_seq, r.pos) for r in a.results(spark, "late").collect()] == [("r1", 2, 0)]
    trail = a.now(spark, "trail").groupBy("recording", "icao24").count().agg(F.max("count")).first()[0]
    assert trail == 24 and a.results(spark, "flags").count() > 5
    # the state does not grow with the stream
    assert a.now(spark, "fixes").groupBy("recording", "icao24").count().agg(F.max("count")).first()[0] <= 12
    assert a.now(spark, "polls").groupBy("recording").count().agg(F.max("count")).first()[0] <= 16


def test_versions_added_while_the_stream_runs(spark, sf):
    st = bridge.states(spark, sf).filter("batch_seq < 20").cache()
    folder = tempfile.mkdtemp(prefix="versions-")
    base = "entry_id string, icao24 string, callsign_prefix string, registration string, severity string, mode string, valid_from double, valid_to double"
    someone = st.groupBy("icao24").count().orderBy(F.desc("count"), "icao24").first().icao24
    cut = st.filter("batch_seq = 10").first().batch_ts
    first = [("W1", someone, None, None, "high", "detect", None, cut)]
    later = [("W2", someone, None, None, "low", "detect", cut, None)]
    sink = p.versioned_sink(f"{folder}/out", lambda: spark.read.parquet(f"{folder}/versions"), lambda rows, e: watchlist.matches(rows.drop("event_time"), e, [3]).select("entry_id", "batch_ts"))
    for rows, entries in ((st.filter(F.col("batch_ts") < cut), first), (st.filter(F.col("batch_ts") >= cut), later)):
        spark.createDataFrame(entries, base).write.mode("append").parquet(f"{folder}/versions")
        rows.write.mode("append").parquet(f"{folder}/land")
        p.read_states(spark, f"{folder}/land", st.schema, 1000).writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{folder}/out")
    assert got.filter(F.col("entry_id") == "W1").agg(F.max("batch_ts")).first()[0] < cut <= got.filter(F.col("entry_id") == "W2").agg(F.min("batch_ts")).first()[0]
    assert got.count() == st.filter(F.col("icao24") == someone).count()


def test_stateless_and_joins(spark, sf):
    st, folder = landing(spark, sf, 2)
    run(p.restricted_alerts(p.read_states(spark, folder, st.schema), places.volumes(spark, sf)), "alerts")
    want = airspace.traffic_inside(st, places.volumes(spark, sf)).filter("is_active")
    assert spark.table("alerts").count() == want.count()
    run(p.region_counts(p.read_states(spark, folder, st.schema)), "counts", "complete")
    assert spark.table("counts").agg(F.sum("reports")).first()[0] == st.count()
    other = tempfile.mkdtemp(prefix="land-")
    bridge.second_feed(spark, sf).coalesce(1).write.mode("append").parquet(other)
    j = p.corroborate_streams(p.read_states(spark, folder, st.schema), p.read_states(spark, other, st.schema))
    run(j, "feeds")
    fly = "lat is not null and lon is not null and not on_ground"
    a, b = st.filter(fly).alias("a"), bridge.second_feed(spark, sf).filter(fly).alias("b")
    near = (F.col("a.icao24") == F.col("b.icao24")) & (F.abs(F.col("a.ts") - F.col("b.ts")) <= 90) & (F.abs(F.col("a.batch_ts") - F.col("b.batch_ts")) <= 90)
    assert spark.table("feeds").count() == a.join(b, near).count()


def test_recording_round_trip_and_batch_stream(spark, sf):
    from airlens.sources import readers

    st = bridge.states(spark, sf)
    folder = tempfile.mkdtemp(prefix="rec-") + "/out"
    two = st.unionByName(st.withColumn("recording", F.lit("copy/2")))
    sinks.write_recording(two, folder)
    back = readers.recordings(spark, folder)
    cols = ["recording", "batch_seq", "pos", "prev_batch_ts", "icao24", "ts", "lat", "squawk", "nic"]
    assert back.count() == two.count()
    assert back.select(*cols).exceptAll(two.select(*cols)).count() == 0
    # equal times are two polls, and lines that are no polls are kept apart
    lines = tempfile.mkdtemp(prefix="rec-")
    with open(f"{lines}/a.jsonl", "w") as f:
        f.write('{"ts": 1, "region": "x", "states": [{"icao24": "a"}, {"icao24": "b"}]}\n{"ts": 1, "region": "x", "states": [{"icao24": "c"}]}\nbroken\n{"ts": 0, "region": "y", "states": [{"icao24": "d"}]}\n')
    got = sorted((r.batch_seq, r.pos, r.icao24, r.prev_batch_ts) for r in readers.recordings(spark, lines).collect())
    assert got == [(0, 0, "a", None), (0, 1, "b", None), (1, 0, "c", 1.0), (2, 0, "d", 1.0)]
    assert [r._corrupt_record for r in readers.corrupt_lines(spark, lines).collect()] == ["broken"]
    folder = tempfile.mkdtemp(prefix="rec-") + "/out"
    sinks.to_batches(st).drop("recording").coalesce(1).write.json(folder)
    run(p.explode_batches(p.read_batches(spark, folder)).select("batch_ts", "icao24"), "polls")
    assert spark.table("polls").count() == st.count()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_traffic_is_not_sent_through_the_driver(spark):
    """Tables that grow with the traffic are merged, even where a planner finds them small."""
    from airlens.operators import proximity
    from airlens.streaming import audit as s

    st = every_rule(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(2**30))
    try:
        key = st.select("recording", "icao24", "batch_seq")
        hits = st.select("recording", "icao24", "batch_seq", F.lit("low").alias("severity"), F.lit("security").alias("category"))
        for df in (tracks.with_features(st), proximity.close_pairs(st), folds.trust_scores(st, key, hits), s._same(st, key, s.AIRCRAFT, "left_semi")):
            plan = plan_of(df)
            assert "SortMergeJoin" in plan and "Broadcast" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_features_with_a_stored_step(spark):
    st = every_rule(spark)
    kept = []
    cols = ["recording", "batch_seq", "pos", "accepted", *[F.round(f, 6) for f in tracks.FEATURES], F.size("track")]
    got = tracks.with_features(st, keep=lambda df: kept.append(df.checkpoint()) or kept[0]).select(*cols)
    want = tracks.with_features(st).select(*cols)
    assert len(kept) == 1 and got.count() == want.count() and got.exceptAll(want).count() == 0


def test_feeds_meet_in_spans(spark):
    """The pairs are those of addresses and times alone, at the ends of spans too, and the join has the span as a key."""
    ts = [1.7e9 + x for x in (0, 0, 1, 89, 90, 91, 180, 180.5, 270, 271, 5000)]
    ts += [1_699_999_920.0, 1_700_000_010.0, 1_700_000_010.000001]  # ends of spans
    row = lambda i, t, icao: (icao, t, 32.0 + i / 100, -97.0, 200.0, 90.0, False)
    rows = [row(i, t, icao) for icao in ("a", "b") for i, t in enumerate(ts)] + [row(0, 1.7e9, None), ("a", None, 32.0, -97.0, 200.0, 90.0, False)]
    feed = spark.createDataFrame(rows, "icao24 string, ts double, lat double, lon double, gs_kt double, track_deg double, on_ground boolean").withColumn("event_time", F.timestamp_seconds("ts"))
    got = p.corroborate_streams(feed, feed)
    want = sorted((icao, x, y) for icao in ("a", "b") for x in ts for y in ts if abs(x - y) <= 90)
    assert sorted((r.icao24, r.ts, r.other_ts) for r in got.select("icao24", "ts", "other_ts").collect()) == want
    assert "_span" in next(x for x in plan_of(got).splitlines() if "Join" in x)


def test_candidates_are_written_part_by_part(spark, tmp_path):
    """No plan unites the rules: each is written alone, with nulls for what the others have."""
    a = StreamingAudit(f"{tmp_path}/audit", spark.range(0).schema)
    got = a.put_each([spark.sql("select 1 as x, 'p' as y"), spark.sql("select 2 as x, 3.0D as z"), spark.sql("select 4 as x").filter("false")], "work/candidates", 0)
    assert sorted(map(tuple, got.collect())) == [(1, "p", None), (2, None, 3.0)] and "Union" not in got._jdf.queryExecution().optimizedPlan().toString()
    again = a.put_each([spark.sql("select 1 as x, 'q' as y"), spark.sql("select 2 as x, 3.0D as z")], "work/candidates", 1)
    assert again.count() == 2 and got.count() == 2
