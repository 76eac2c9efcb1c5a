"""Cool-down and trust against plain Python, rules on hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from airlens.operators import audit, folds, rules
from airlens.plans import bridge
from airlens.session import cut_lineage
from airlens.thresholds import COOLDOWN_S, DEFAULT

COLS = "recording string, batch_seq int, phase int, pos int, rule_ord int, rule_id string, severity string, sev_rank int, category string, icao24 string, batch_ts double, position_source string"
SEV = ["critical", "high", "medium", "low", "info"]


def candidates(seed, n=400):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        b = rnd.randrange(60)
        rank = rnd.randrange(5)
        rows.append(("r", b, 0, i, 0, rnd.choice(["SEC-010", "SAF-004"]), SEV[rank], rank, "security", rnd.choice(["a", "b", None]), 1.7e9 + 37.0 * b, "adsb"))
    return rows


def fold(rows):
    out, last, sev, count = {}, {}, {}, {}
    for r in sorted(rows, key=lambda r: r[1:5]):
        k = (r[5], r[9])
        count[k] = count.get(k, 0) + 1
        if k in last and not r[7] < sev[k] and r[10] - last[k] < COOLDOWN_S.get(r[5], DEFAULT.cooldown_s):
            continue
        last[k], sev[k] = r[10], r[7]
        out[(r[1], r[3])] = count[k]
    return out


def test_cooldown_equals_plain_fold(spark):
    for seed in range(3):
        rows = candidates(seed)
        got = {(r.batch_seq, r.pos): r.occurrences for r in folds.cooldown(spark.createDataFrame(rows, COLS)).collect()}
        assert got == fold(rows)


def test_trust_bounds_and_planted_cases(spark, sf):
    st = bridge.states(spark, sf)
    cand = audit.candidates(st).cache()
    acc = folds.cooldown(cand).cache()
    t = folds.trust_scores(st, cand, acc).agg(F.min("trust"), F.max("trust"), F.sum("hits")).first()
    assert 0 <= t[0] < t[1] <= 1 and t[2] == acc.filter("icao24 is not null").count()
    found = {r[0] for r in acc.select("rule_id").distinct().collect()}
    assert {"SEC-010", "SEC-012", "SEC-013", "SAF-003", "OPS-004"} <= found
    assert acc.filter("risk_score <= 0").count() == 0


def test_thresholds_reject_unknown_names():
    assert DEFAULT.override({"rules": {"max_vrate_fpm": 5000}}).max_vrate_fpm == 5000
    with pytest.raises(KeyError):
        DEFAULT.override({"no_such_limit": 1})


def test_new_rules_can_be_registered(spark, sf):
    from pyspark.sql.functions import col, lit

    @rules.state_rule("TEST-1")
    def high(t):
        return rules.Hit(col("baro_alt_ft") > 30000, lit("TEST-1"), lit("info"), lit("operations"), lit("High"), col("baro_alt_ft"), {"x": lit(1)})

    try:
        st = bridge.states(spark, sf)
        n = rules.state_findings(st.select("*", *[lit(None).cast("double").alias(f) for f in ("dt_s",)]), only=["TEST-1"])
        assert n.count() == st.filter("baro_alt_ft > 30000").count() > 0
    finally:
        rules.STATE_RULES.pop("TEST-1")


def test_quantiles(spark):
    import numpy as np

    from airlens.operators.quantiles import quantiles

    rng = np.random.default_rng(4)
    groups = {"ties": [5.0] * 40 + [1.0, 9.0], "one": [3.0], "wide": (rng.normal(size=500) ** 7).tolist(), "even": [1.0, 2.0, 3.0, 4.0]}
    rows = [(k, v) for k, x in groups.items() for v in x] + [("ties", None), ("none", None), ("even", float("nan"))]
    points = [0.0, 0.05, 0.5, 0.77, 1.0]
    for buckets in (4096, 3):
        got = {r.k: r for r in quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", points, buckets).collect()}
        assert set(got) == set(groups)
        for k, x in groups.items():
            assert got[k].n == len(x) and np.allclose(got[k].quantiles, np.quantile(x, points))


@pytest.mark.parametrize("records", ["3", "10000"])
def test_folds_continue_from_their_state(spark, records):
    """Cut between any two polls, findings, occurrences and trust are those of one pass."""
    rows = candidates(7, 300)
    states = [("r", r[1], r[9]) for r in rows if r[9]] + [("r", b, "quiet") for b in range(0, 60, 3)]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, records)
    try:
        cut_lineage(spark.range(1))  # sets the checkpoint folder
        cand, st = spark.createDataFrame(rows, COLS), spark.createDataFrame(states, "recording string, batch_seq int, icao24 string")
        whole = folds.cooldown(cand)
        want = sorted((r.batch_seq, r.pos, r.occurrences, round(r.risk_score, 9)) for r in whole.collect())
        assert {(b, p): n for b, p, n, _ in want} == fold(rows)
        trust = sorted((r.icao24, round(r.trust, 9), r.hits) for r in folds.trust_scores(st, cand, whole).collect())
        got, known, stood = [], spark.createDataFrame([], "recording string, rule_id string, icao24 string, last_ts double, last_rank int, count long"), spark.createDataFrame([], "recording string, icao24 string, trust double, hits long")
        for lo, hi in ((0, 1), (1, 20), (20, 21), (21, 60)):
            part, some = cand.filter((F.col("batch_seq") >= lo) & (F.col("batch_seq") < hi)), st.filter((F.col("batch_seq") >= lo) & (F.col("batch_seq") < hi))
            accepted, known = folds.cooldown_from(part, known, keep=cut_lineage)
            stood = folds.trust_scores(some, part, accepted, stood)
            stood = cut_lineage(stood)
            got += [(r.batch_seq, r.pos, r.occurrences, round(r.risk_score, 9)) for r in accepted.collect()]
        assert sorted(got) == want
        assert sorted((r.icao24, round(r.trust, 9), r.hits) for r in stood.collect()) == trust
    finally:
        spark.conf.unset(name)


def test_one_address_in_a_hundred_thousand_polls(spark):
    """A condition that lasts through the recording: no array grows with it, and the folds stay exact."""
    n = 100_000
    p = spark.range(n).select(F.lit("r").alias("recording"), F.col("id").cast("int").alias("batch_seq"), F.lit(0).alias("phase"), F.lit(0).alias("pos"), F.lit(0).alias("rule_ord"), F.lit("SEC-010").alias("rule_id"), F.when(F.col("id") % 5000 == 4999, "critical").otherwise("high").alias("severity"),
                              F.when(F.col("id") % 5000 == 4999, 0).otherwise(1).alias("sev_rank"), F.lit("operations").alias("category"), F.lit("a").alias("icao24"), (F.lit(1.7e9) + F.col("id") * 5).alias("batch_ts"), F.lit("adsb").alias("position_source"))
    fired = folds.cooldown(p).cache()
    rows, last, sev = [], None, 9
    for i in range(n):
        rank = 0 if i % 5000 == 4999 else 1
        if last is None or rank < sev or 5 * (i - last) >= DEFAULT.cooldown_s:
            last, sev = i, rank
            rows.append((i, i + 1, rank))
    assert sorted((r.batch_seq, r.occurrences, r.sev_rank) for r in fired.collect()) == rows
    calm = p.select("recording", "batch_seq", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("icao24"))
    some = p.filter("batch_seq % 3 = 0 or batch_seq >= 99990")
    hits = fired.join(some.select("batch_seq"), "batch_seq")
    x, had = 1.0, {i: r for i, _, r in rows}
    for i in range(n):
        flagged = i % 3 == 0 or i >= 99_990
        d = -(0.6, 0.35)[had[i]] * 0.2 if flagged and i in had else 0.0 if flagged else 0.02
        x = min(1.0, max(0.0, x + d))
    got = {r.icao24: (r.trust, r.hits) for r in folds.trust_scores(calm, some, hits).collect()}
    assert abs(got["a"][0] - x) < 1e-9 and got["a"][1] == sum(1 for i in had if i % 3 == 0 or i >= 99_990) and got["b"] == (1.0, 0)


def test_quantiles_with_an_outlier(spark):
    """One value far out among a million leaves the others spread over the buckets, and the result exact."""
    import numpy as np

    from airlens.operators import quantiles as q

    df = spark.range(1_000_000).select(F.lit("k").alias("k"), F.when(F.col("id") == 7, 1e30).when(F.col("id") % 1000 == 1, -1e12 * F.col("id")).otherwise(F.col("id") % 65536 / 7.0).alias("v"))
    values = np.sort([r.v for r in df.select("v").collect()])
    points = [0.0, 0.001, 0.25, 0.5, 0.75, 0.9999, 1.0]
    got = q.quantiles(df, ["k"], "v", points).first()
    assert got.n == len(values) and np.allclose(got.quantiles, np.quantile(values, points))
