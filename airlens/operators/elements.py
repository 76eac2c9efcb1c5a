"""Element sets: text lines to sets, mean elements, history, decay."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from airlens.operators.ordered import sealed, with_lags, with_previous
from airlens.session import cut_lineage

c = F.col
# fixed values
MU_KM3_S2 = 398600.4418
RE_KM = 6378.137
DA_KM_PER_DAY, DA_RISE_KM, DI_DEG = 2.0, 0.5, 0.02
LOW_PERIGEE_KM, DECAY_DAYS = 200.0, 30.0
MAX_AGE_DAYS = 7.0
N_REENTRY = 86400.0 / (2 * math.pi * math.sqrt((RE_KM + 100.0) ** 3 / MU_KM3_S2))


def digit_sum(text: Column) -> Column:
    """Sum of the digits, a minus counts one: characters counted once per binary place of their digit."""
    places = [("13579-", 1), ("2367", 2), ("4567", 4), ("89", 8)]
    size, total = F.length(text), F.lit(0)
    for chars, weight in places:
        total = total + weight * (size - F.length(F.translate(text, chars, "")))
    return total


def checksum_ok(line: Column) -> Column:
    """The 69th character is the digit sum of the first 68 modulo ten."""
    last = F.substring(line, 69, 1)
    return (F.length(line) >= 69) & last.rlike("^[0-9]$") & F.coalesce((digit_sum(F.substring(line, 1, 68)) % 10).cast("string") == last, F.lit(False))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Rows (file, line_no, text) -> element sets with valid checksums; a name line is optional.

    Files are cut into slabs of lines whose ends are carried over, so one huge file is not one task.
    """
    t = lines.withColumn("text", F.rtrim("text")).filter("text <> ''")
    t = with_lags(t, ["file"], F.floor(c("line_no") / 100000), ["line_no"], "text", 3)
    t = t.select("file", "line_no", "text", c("lag1").alias("p1"), c("lag2").alias("p2"), c("lag3").alias("p3"))
    pair = c("text").startswith("2 ") & c("p1").startswith("1 ")
    taken = F.coalesce(c("p2").startswith("2 ") & c("p3").startswith("1 "), F.lit(False))
    s = t.filter(pair & checksum_ok(c("p1")) & checksum_ok(c("text")))
    return s.select("file", "line_no", F.when(c("p2").isNull() | taken, F.concat(F.lit("NORAD "), F.trim(F.substring("p1", 3, 5)))).otherwise(F.trim("p2")).alias("name"),
                    c("p1").alias("line1"), c("text").alias("line2"))


def decimal_exp(tok: Column) -> Column:
    """Assumed-decimal field with an exponent: '12345-4' is 0.12345e-4."""
    t = F.regexp_replace(tok, " ", "")
    sign = F.when(t.startswith("-"), -1.0).otherwise(1.0)
    mant = F.regexp_extract(t, r"^[+-]*([0-9]+)", 1)
    exp = F.regexp_extract(t, r"^[+-]*[0-9]+([+-][0-9]+)$", 1)
    value = F.concat(F.lit("0."), mant).try_cast("double") * F.pow(F.lit(10.0), F.coalesce(exp.try_cast("double"), F.lit(0.0)))
    return F.coalesce(sign * value, F.lit(0.0))


def mean_elements(sets: DataFrame) -> DataFrame:
    """Fixed-width fields of both lines as numbers, with semi-major axis, perigee and apogee."""
    l1, l2 = c("line1"), c("line2")
    num = lambda col, a, n: F.trim(F.substring(col, a, n)).try_cast("double")
    yy = F.substring(l1, 19, 2).try_cast("int")
    year = F.when(yy < 57, 2000 + yy).otherwise(1900 + yy)
    s = sets.select(
        "*", F.trim(F.substring(l1, 3, 5)).try_cast("int").alias("norad"),
        (F.unix_timestamp(F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))).cast("double") + (num(l1, 21, 12) - 1) * 86400.0).alias("epoch"),
        num(l1, 34, 10).alias("ndot"), decimal_exp(F.substring(l1, 54, 8)).alias("bstar"), num(l2, 9, 8).alias("inc_deg"), num(l2, 18, 8).alias("raan_deg"),
        F.concat(F.lit("0."), F.trim(F.substring(l2, 27, 7))).try_cast("double").alias("e"), num(l2, 35, 8).alias("argp_deg"), num(l2, 44, 8).alias("m_deg"), num(l2, 53, 11).alias("n_rev_day"))
    a = F.pow(MU_KM3_S2 / F.pow(c("n_rev_day") * (2 * math.pi / 86400.0), 2), 1.0 / 3.0)
    s = s.withColumn("a_km", a)
    return sealed(s.withColumn("perigee_km", c("a_km") * (1 - c("e")) - RE_KM).withColumn("apogee_km", c("a_km") * (1 + c("e")) - RE_KM))


def decay_days(n_rev_day: Column, ndot: Column) -> Column:
    """Days to re-entry at the present rate; null when the orbit is not shrinking. The field holds half the rate."""
    return F.when(ndot > 0, F.greatest((N_REENTRY - n_rev_day) / (ndot * 2.0), F.lit(0.0)))


def history(sets: DataFrame) -> DataFrame:
    """One set per object and epoch (the last file wins)."""
    cols = [x for x in sets.columns if x not in ("norad", "epoch")]
    return sets.groupBy("norad", "epoch").agg(F.max_by(F.struct(*cols), F.struct("file", "line_no")).alias("_s")).select("norad", "epoch", "_s.*")


def changes(hist: DataFrame) -> DataFrame:
    """Differences between consecutive sets of an object, with the manoeuvre flag."""
    h = with_previous(hist, ["norad"], F.floor(c("epoch") / (90 * 86400.0)), ["epoch"], ["epoch", "a_km", "inc_deg", "perigee_km"], "p").filter("p is not null")
    days = F.greatest((c("epoch") - c("p.epoch")) / 86400.0, F.lit(1e-3))
    h = h.select("norad", "name", c("p.epoch").alias("from_epoch"), c("epoch").alias("to_epoch"), days.alias("days"), (c("a_km") - c("p.a_km")).alias("da_km"),
                 (c("inc_deg") - c("p.inc_deg")).alias("di_deg"), (c("perigee_km") - c("p.perigee_km")).alias("dperigee_km"))
    flag = (c("da_km") > DA_RISE_KM) | (F.abs("da_km") > DA_KM_PER_DAY * c("days")) | (F.abs("di_deg") > DI_DEG)
    return h.withColumn("manoeuvre", flag)


def newest(sets: DataFrame) -> DataFrame:
    cols = [x for x in sets.columns if x != "norad"]
    return sets.groupBy("norad").agg(F.max_by(F.struct(*cols), F.struct("epoch", "file", "line_no")).alias("_s")).select("norad", "_s.*")


def decaying(sets: DataFrame, now: float) -> DataFrame:
    """Newest set per object with low perigee or decay inside the window, and the flags that say which."""
    n = newest(sets).withColumn("decay_days", decay_days(c("n_rev_day"), c("ndot")))
    low, soon = c("perigee_km") < LOW_PERIGEE_KM, F.coalesce(c("decay_days") < DECAY_DAYS, F.lit(False))
    flags = F.array_compact(F.array(F.when(low, "low_perigee"), F.when(soon, "decay_within_window")))
    return n.filter(low | soon).withColumn("flags", flags).withColumn("age_h", (now - c("epoch")) / 3600.0)


def stale(sets: DataFrame, now: float) -> DataFrame:
    return sets.withColumn("age_days", (now - c("epoch")) / 86400.0).filter(c("age_days") > MAX_AGE_DAYS)


def unusable(sets: DataFrame) -> DataFrame:
    """ORB-003: sets that cannot be propagated (open orbit, no motion, path below the surface, missing numbers)."""
    why = F.when(c("n_rev_day").isNull() | c("e").isNull() | c("inc_deg").isNull(), "missing numbers").when(c("e") >= 1, "open orbit").when(c("n_rev_day") <= 0, "no motion").when(c("perigee_km") < 0, "below the surface")
    return sets.select("norad", "name", why.alias("reason"), F.lit("ORB-003").alias("rule_id"), F.lit("low").alias("severity")).filter("reason is not null")


def reentry_findings(decaying_sets: DataFrame, aircraft: DataFrame, airports: DataFrame, fresh_h: float = 48.0) -> DataFrame:
    """Per decaying object: aircraft under its track (REN-001, per recording), airports (REN-002), a set too old (REN-003)."""
    row = lambda rule, category, measure, recording: ["norad", recording.alias("recording"), F.lit(rule).alias("rule_id"), F.lit("low").alias("severity"), F.lit(category).alias("category"), measure.cast("double").alias("measure")]
    none = F.lit(None).cast("string")
    a = aircraft.groupBy("norad", "recording").agg(F.count(F.lit(1)).alias("n")).select(*row("REN-001", "safety", c("n"), c("recording")))
    b = airports.groupBy("norad").agg(F.count(F.lit(1)).alias("n")).select(*row("REN-002", "operations", c("n"), none))
    old = decaying_sets.filter(c("age_h") > fresh_h).select(*row("REN-003", "data-quality", c("age_h"), none))
    return a.unionByName(b).unionByName(old)


# ---- positions -----------------------------------------------------------------------------------------------
J2 = 1.08262668e-3
GRADIENT = 4.5e-6  # 1/s2: three times the gravity parameter over the cube of the smallest radius
SLACK_KM, MIN_VV = 0.01, 1e-8  # beside bounds on curved paths, for rounding; slower pairs (km/s, squared) are looked at all along
WGS84_A = 6378.137
WGS84_F = 1 / 298.257223563
E2 = WGS84_F * (2 - WGS84_F)


def ephemeris(sets: DataFrame, start: float, steps: int, step_s: float) -> DataFrame:
    """Positions and velocities on a time grid: two-body motion with the secular drift of the second zonal harmonic.

    Kepler's equation is solved by a fixed number of Newton steps, so the whole job is one projection over
    sets x steps. A table computed elsewhere can take its place: norad, t_idx, ts, position, velocity.
    """
    s = sets.withColumn("t_idx", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("ts", start + c("t_idx") * step_s)
    return propagate(s)


def propagate(s: DataFrame) -> DataFrame:
    """Add x_km .. vz_kms for rows that carry elements and the time `ts`."""
    n0 = c("n_rev_day") * (2 * math.pi / 86400.0)
    s = s.withColumn("_dt", c("ts") - c("epoch")).withColumn("_n", n0).withColumn("_p", c("a_km") * (1 - c("e") * c("e")))
    s = s.withColumn("_k", 1.5 * J2 * F.pow(F.lit(RE_KM) / c("_p"), 2) * c("_n")).withColumn("_ci", F.cos(F.radians("inc_deg")))
    s = s.withColumn("_raan", F.radians("raan_deg") - c("_k") * c("_ci") * c("_dt")).withColumn("_w", F.radians("argp_deg") + c("_k") * (2 - 2.5 * F.pow(F.sin(F.radians("inc_deg")), 2)) * c("_dt"))
    s = s.withColumn("_m", F.radians("m_deg") + c("_n") * c("_dt"))
    s = s.withColumn("_m", c("_m") - F.floor(c("_m") / (2 * math.pi)) * (2 * math.pi)).withColumn("_e0", c("_m"))
    for i in range(6):
        prev = c(f"_e{i}")
        s = s.withColumn(f"_e{i + 1}", prev - (prev - c("e") * F.sin(prev) - c("_m")) / (1 - c("e") * F.cos(prev))).drop(f"_e{i}")
    ea = c("_e6")
    s = s.withColumn("_xp", c("a_km") * (F.cos(ea) - c("e"))).withColumn("_yp", c("a_km") * F.sqrt(1 - c("e") * c("e")) * F.sin(ea))
    s = s.withColumn("_ed", c("_n") / (1 - c("e") * F.cos(ea)))
    s = s.withColumn("_vxp", -c("a_km") * F.sin(ea) * c("_ed")).withColumn("_vyp", c("a_km") * F.sqrt(1 - c("e") * c("e")) * F.cos(ea) * c("_ed"))
    s = s.withColumn("_si", F.sin(F.radians("inc_deg"))).withColumn("_co", F.cos("_raan")).withColumn("_so", F.sin("_raan")).withColumn("_cw", F.cos("_w")).withColumn("_sw", F.sin("_w"))
    q = [[c("_co") * c("_cw") - c("_so") * c("_sw") * c("_ci"), -c("_co") * c("_sw") - c("_so") * c("_cw") * c("_ci")],
         [c("_so") * c("_cw") + c("_co") * c("_sw") * c("_ci"), -c("_so") * c("_sw") + c("_co") * c("_cw") * c("_ci")],
         [c("_sw") * c("_si"), c("_cw") * c("_si")]]
    keep = [x for x in s.columns if not x.startswith("_")]
    return sealed(s.select(*keep, *[(q[i][0] * c("_xp") + q[i][1] * c("_yp")).alias(f"{ax}_km") for i, ax in enumerate("xyz")],
                    *[(q[i][0] * c("_vxp") + q[i][1] * c("_vyp")).alias(f"v{ax}_kms") for i, ax in enumerate("xyz")]))


def geodetic(eph: DataFrame) -> DataFrame:
    """Latitude, longitude and height under each position: sidereal rotation, then four fixed iterations."""
    jd = c("ts") / 86400.0 + 2440587.5
    s = eph.withColumn("_t", (jd - 2451545.0) / 36525.0)
    sec = 67310.54841 + (876600.0 * 3600 + 8640184.812866) * c("_t") + 0.093104 * c("_t") * c("_t") - 6.2e-6 * F.pow("_t", 3)
    s = s.withColumn("_th", F.radians(sec / 240.0))
    lon = F.degrees(F.atan2("y_km", "x_km") - c("_th"))
    s = s.withColumn("lon", F.pmod(lon + 180.0, F.lit(360.0)) - 180.0).withColumn("_p", F.sqrt(c("x_km") * c("x_km") + c("y_km") * c("y_km"))).withColumn("_l0", F.atan2(c("z_km"), c("_p") * (1 - E2)))
    for i in range(4):
        la = c(f"_l{i}")
        s = s.withColumn("_nn", WGS84_A / F.sqrt(1 - E2 * F.pow(F.sin(la), 2))).withColumn("_h", c("_p") / F.cos(la) - c("_nn"))
        s = s.withColumn(f"_l{i + 1}", F.atan2(c("z_km"), c("_p") * (1 - E2 * c("_nn") / (c("_nn") + c("_h"))))).drop(f"_l{i}")
    s = s.withColumn("_nn", WGS84_A / F.sqrt(1 - E2 * F.pow(F.sin("_l4"), 2))).withColumn("height_km", c("_p") / F.cos("_l4") - c("_nn")).withColumn("lat", F.degrees("_l4"))
    return sealed(s.drop("_t", "_th", "_p", "_nn", "_h", "_l4"))


def touching_shells(sets: DataFrame, reach_km: float) -> DataFrame:
    """The sets whose shell, from perigee to apogee and half a reach wider on both sides, may touch another's: those that
    share a band of heights with another object. Bands are counted, so no pair of shells is ever formed."""
    low, high = c("a_km") * (1 - c("e")) - reach_km / 2, c("a_km") * (1 + c("e")) + reach_km / 2
    bands = sets.select("norad", F.explode(F.sequence(F.floor(low / reach_km), F.floor(high / reach_km))).alias("band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band")
    return sets.join(bands.join(shared, "band").select("norad").distinct(), "norad", "left_semi")


#: positions of a time slab, about 100 bytes each; slabs at least, so that a small catalogue makes several tasks too
SLAB_POSITIONS = 2_000_000
LEAST_SLABS = 32
#: pairs of positions that are looked at together
CANDIDATES = 2_000_000
_ELEMENTS = ["norad", "epoch", "n_rev_day", "a_km", "e", "inc_deg", "raan_deg", "argp_deg", "m_deg"]


def _reduced(code: np.ndarray, n: int, t: np.ndarray, d: np.ndarray, ok: np.ndarray, names: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """The closest time of each pair; `code` is n times the number of the one object plus the number of the other."""
    order = np.lexsort((t, d, code))
    order = order[np.append(True, code[order][1:] != code[order][:-1])]
    a, b = names[code[order] // n], names[code[order] % n]
    return pa.RecordBatch.from_arrays([pa.array(x).cast(f.type) for x, f in zip((a, b, t[order], d[order], ok[order]), schema)], schema=schema)


def _positions(s: dict[str, np.ndarray], ts: float) -> tuple[np.ndarray, np.ndarray]:
    """`propagate` of numbers at one time: x, y, z and their speeds as rows of two arrays."""
    dt, n = ts - s["epoch"], s["n_rev_day"] * (2 * math.pi / 86400.0)
    a, e, inc = s["a_km"], s["e"], np.radians(s["inc_deg"])
    ci, si = np.cos(inc), np.sin(inc)
    k = 1.5 * J2 * np.power(RE_KM / (a * (1 - e * e)), 2) * n
    raan, w = np.radians(s["raan_deg"]) - k * ci * dt, np.radians(s["argp_deg"]) + k * (2 - 2.5 * np.power(si, 2)) * dt
    m = np.radians(s["m_deg"]) + n * dt
    m = m - np.floor(m / (2 * math.pi)) * (2 * math.pi)
    ea = m
    for _ in range(6):
        ea = ea - (ea - e * np.sin(ea) - m) / (1 - e * np.cos(ea))
    cos, sin, side = np.cos(ea), np.sin(ea), a * np.sqrt(1 - e * e)
    xp, yp, ed = a * (cos - e), side * sin, n / (1 - e * cos)
    vxp, vyp = -a * sin * ed, side * cos * ed
    co, so, cw, sw = np.cos(raan), np.sin(raan), np.cos(w), np.sin(w)
    q = [(co * cw - so * sw * ci, -co * sw - so * cw * ci), (so * cw + co * sw * ci, -so * sw + co * cw * ci), (sw * si, cw * si)]
    return np.array([p * xp + r * yp for p, r in q]), np.array([p * vxp + r * vyp for p, r in q])


def _met(batches: Iterator[pa.RecordBatch], start: float, steps: int, step_s: float, per: int, reach: float, most: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pairs within reach at the times of a slab, from (slab, elements). `near`: they may come within `most` about then.

    Positions of a time are sorted by cells one reach wide; cells above each other are neighbours in this order, so the
    partners of a position are five runs of it.
    """
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    table = table.filter(pc.is_valid(table.column("norad")))
    slabs = table.column("slab").to_numpy()
    for slab in np.unique(slabs):
        part = table.filter(pa.array(slabs == slab))
        sets = {n: part.column(n).cast(pa.float64()).to_numpy().astype(np.float64) for n in _ELEMENTS[1:]}
        names, who = np.unique(part.column("norad").to_numpy(), return_inverse=True)
        yield from _met_at(sets, names, who, range(slab * per, min((slab + 1) * per, steps)), start, step_s, reach, most, schema)


def _met_at(sets: dict[str, np.ndarray], names: np.ndarray, who: np.ndarray, times: range, start: float, step_s: float, reach: float, most: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    found: list[tuple[np.ndarray, ...]] = []
    for t in times:
        with np.errstate(all="ignore"):
            at, speed = _positions(sets, start + t * step_s)
        own = np.flatnonzero(np.isfinite(at).all(0))
        if len(own) < 2:
            continue
        low, high = at[:, own].min(1), at[:, own].max(1)
        # three numbers of 20 bits make one key
        edge = max(reach, float((high - low).max()) / 2**20) * (1 + 1e-9)
        x, y, z = np.floor((at[:, own] - low[:, None]) / edge).astype(np.int64) + 1
        key = (x << 42) + (y << 21) + z
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        place, pace, whose = at[:, own], speed[:, own], who[own]
        whole = len(np.unique(whose)) == len(own)
        for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1)):
            beside = key + (dx << 42) + (dy << 21)
            first = np.arange(1, len(own) + 1) if not (dx or dy) else np.searchsorted(key, beside - 1, "left")
            n = np.maximum(0, np.searchsorted(key, beside + 1, "right") - first)
            total = np.cumsum(n)
            begin = 0
            while begin < len(own):
                done = total[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(total, done + CANDIDATES, "right")))
                k = n[begin:end]
                i = np.repeat(np.arange(begin, end), k)
                j = np.arange(len(i)) - np.repeat(total[begin:end] - k - done, k) + np.repeat(first[begin:end], k)
                begin = end
                r = [x[i] - x[j] for x in place]
                d = 0.0 + r[0] * r[0] + r[1] * r[1] + r[2] * r[2]
                hit = np.flatnonzero(d <= reach * reach * (1 + 1e-9))
                i, j, r, d = i[hit], j[hit], np.array([x[hit] for x in r]), np.sqrt(d[hit])
                hit = (np.abs(r) <= reach).all(0) & (d <= reach) & (whose[i] != whose[j])
                i, j, r, d = i[hit], j[hit], r[:, hit], d[hit]
                if not len(i):
                    continue
                v = np.array([x[i] - x[j] for x in pace])
                vv = (v * v).sum(0)
                with np.errstate(all="ignore"):
                    when = np.where(vv > 0, np.clip(-(r * v).sum(0) / vv, -step_s, step_s), 0.0)
                    bend = 0.5 * GRADIENT * (d + np.sqrt(vv) * step_s) * step_s**2
                    # what is not known, and rounding, leave the pair in; so does an object listed twice
                    near = ~(np.sqrt(((r + v * when) ** 2).sum(0)) - bend > most + SLACK_KM) if whole else np.ones(len(d), bool)
                a, b = np.minimum(whose[i], whose[j]), np.maximum(whose[i], whose[j])
                found.append((a.astype(np.int64) * len(names) + b, np.full(len(d), t), d, near))
                if sum(len(f[0]) for f in found) > CANDIDATES:
                    code, *rest = [np.concatenate(f) for f in zip(*found)]
                    found = []
                    yield _reduced(code, len(names), *rest, names, schema)
    if found:
        code, *rest = [np.concatenate(f) for f in zip(*found)]
        yield _reduced(code, len(names), *rest, names, schema)


def close_positions(sets: DataFrame, start: float, steps: int, step_s: float, reach_km: float, most_km: float | None = None) -> DataFrame:
    """Pairs a < b of objects within reach at times of the grid, a row at least for the closest time of a pair in a slab:
    a, b, ts, d, and `near`, whether straight on from there the pair may come within `most_km` in one step.

    Only elements are shuffled, a copy for each slab of time; positions are computed and meet inside their slab, one time
    after the other.
    """
    most = reach_km if most_km is None else most_km
    e = touching_shells(sets.select(*_ELEMENTS), reach_km)
    slabs = min(steps, max(LEAST_SLABS, -(-sets.count() * steps // SLAB_POSITIONS)))
    per = -(-steps // slabs)
    e = e.withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(-(-steps // per) - 1)))).repartitionByRange(-(-steps // per), "slab")
    kind = sets.schema["norad"].dataType
    fields = [("a", kind), ("b", kind), ("t_idx", T.IntegerType()), ("d", T.DoubleType()), ("near", T.BooleanType())]
    schema = T.StructType([T.StructField(*f) for f in fields])
    arrow = to_arrow_schema(schema)
    met = e.mapInArrow(lambda batches: _met(batches, start, steps, step_s, per, reach_km, most, arrow), schema)
    return met.select("a", "b", (start + c("t_idx") * step_s).alias("ts"), "d", "near")


def _closest(batches: Iterator[pa.RecordBatch], start: float, steps: int, step_s: float, threshold: float, fine_s: float, schema: pa.Schema, pairs: int = 2000) -> Iterator[pa.RecordBatch]:
    """The closest time of each pair among those `fine_s` apart around its coarse minimum; a row has a pair and its elements.

    Straight on from the coarse minimum, and what the difference of gravity can bend it within a step, decide who is looked
    at; the gradient of gravity is below GRADIENT above 100 km.
    """
    last, end = int(2 * step_s / fine_s), start + steps * step_s
    for b in (x.slice(i, pairs) for x in batches for i in range(0, x.num_rows, pairs)):
        number = lambda name: b.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)  # noqa: E731, B023
        one, two = [{n: number(f"{k}_{n}") for n in _ELEMENTS[1:]} for k in ("a", "b")]
        t0, coarse = number("t0"), number("coarse_km")
        with np.errstate(all="ignore"):
            (ra, va), (rb, vb) = _positions(one, t0), _positions(two, t0)
            r, v = ra - rb, va - vb
            vv, speed = (v * v).sum(0), np.sqrt((v * v).sum(0))
            straight = lambda at: np.sqrt(((r + v * at) ** 2).sum(0))  # noqa: E731, B023
            bend = 0.5 * GRADIENT * (coarse + speed * step_s) * step_s**2
            go = straight(np.clip(np.where(vv > 0, -(r * v).sum(0) / vv, 0.0), -step_s, step_s)) - bend <= threshold
            # only times whose straight distance is no longer than this can be the closest: the least one is near a time of
            # the fine grid, and bends are taken twice
            early, late = np.maximum(-step_s, start - t0), np.minimum(step_s, end - t0)
            slack, t = 2 * bend + SLACK_KM, -(r * v).sum(0) / vv
            most = np.minimum(straight(np.maximum(early, np.minimum(late, t))) + 2 * fine_s * speed + 2 * slack, threshold + slack)
            w = np.sqrt(np.maximum(0.0, (most * most - straight(t) ** 2) / vv))
            index = lambda at: np.clip((at + step_s) / fine_s, 0.0, float(last))
            first = np.where(vv > MIN_VV, np.floor(index(t - w)) - 1, 0)
            until = np.where(vv > MIN_VV, np.floor(index(t + w)) + 1, last)
        row = np.flatnonzero(go)
        first, until = np.maximum(first[row], 0).astype(np.int64), np.minimum(until[row], last).astype(np.int64)
        n = until - first + 1
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        row = np.repeat(row, n)
        ts = t0[row] - step_s + at * fine_s
        row, ts = row[(ts >= start) & (ts <= end)], ts[(ts >= start) & (ts <= end)]
        (ra, va), (rb, vb) = [_positions({n: x[row] for n, x in s.items()}, ts) for s in (one, two)]
        d, rel = [np.sqrt(((x - y) ** 2).sum(0)) for x, y in ((ra, rb), (va, vb))]
        order = np.lexsort((ts, d, row))
        order = order[np.diff(row[order], prepend=-1) > 0]
        keep = pa.array(row[order])
        yield pa.RecordBatch.from_arrays([b.column("a").take(keep), b.column("b").take(keep), *[pa.array(x) for x in (coarse[row[order]], ts[order], d[order], rel[order])]], schema=schema)


def screen(sets: DataFrame, start: float, steps: int, step_s: float, threshold_km: float, min_rel_kms: float = 0.05, fine_step_s: float = 1.0) -> DataFrame:
    """Closest approach of every pair that comes within five thresholds on the coarse grid; co-moving pairs are listed
    without a rule and a severity.

    Coarse pass: `close_positions`. Fine pass: only the candidate pairs, one second apart around their coarse minimum, at
    the times that may be the closest or come within the threshold; a pair is one row and is not shuffled again for it.
    """
    sets = cut_lineage(sets.select(*_ELEMENTS))
    # dealt by pair before they are sorted: nearly every pair of a slab is a row of its own
    p = close_positions(sets, start, steps, step_s, 5 * threshold_km, threshold_km).repartition("a", "b")
    best = p.groupBy("a", "b").agg(F.min_by(F.struct("ts", "d", "near"), F.struct("d", "ts")).alias("m")).filter("m.near").select("a", "b", c("m.ts").alias("t0"), c("m.d").alias("coarse_km"))
    # elements are joined while there is one row a pair
    for k in ("a", "b"):
        best = best.join(sets.select(c("norad").alias(k), *[c(n).cast("double").alias(f"{k}_{n}") for n in _ELEMENTS[1:]]), k)
    schema = T.StructType([*[T.StructField(k, sets.schema["norad"].dataType) for k in ("a", "b")], *[T.StructField(n, T.DoubleType()) for n in ("coarse_km", "tca", "min_km", "rel_speed_kms")]])
    arrow = to_arrow_schema(schema)
    fine = best.mapInArrow(lambda batches: _closest(batches, start, steps, step_s, threshold_km, fine_step_s, arrow), schema)
    # an object that is listed twice has its pairs more than once
    fine = fine.groupBy("a", "b").agg(F.min_by(F.struct("coarse_km", "tca", "min_km", "rel_speed_kms"), F.struct("min_km", "tca")).alias("m"))
    out = fine.select("a", "b", "m.*").filter(c("min_km") <= threshold_km)
    out = out.withColumn("co_moving", c("rel_speed_kms") < min_rel_kms)
    return out.withColumn("severity", F.when(~c("co_moving"), F.when(c("min_km") < threshold_km / 2, "high").otherwise("medium"))).withColumn("rule_id", F.when(~c("co_moving"), "ORB-002"))


def corridor_airports(track: DataFrame, width_nm: float = 50.0) -> DataFrame:
    """Airports under the ground tracks of objects, with the closest sample; the airport table has a fixed size."""
    from airlens import dims
    from airlens.functions.geo import wrapped_nm
    from airlens.operators.bandjoin import cover_cells, floor_cell

    a = dims.table(track.sparkSession, "airports").select("icao", c("lat").alias("a_lat"), c("lon").alias("a_lon"))
    dlat = F.lit(width_nm / 60.0)
    dlon = width_nm / (60.0 * F.greatest(F.cos(F.radians(F.abs("a_lat"))), F.lit(0.1)))
    a = cover_cells(a, c("a_lat") - dlat, c("a_lon") - dlon, c("a_lat") + dlat, c("a_lon") + dlon)
    t = track.withColumn("cell_y", floor_cell(c("lat"), 1.0)).withColumn("cell_x", floor_cell(c("lon"), 1.0))
    j = t.join(F.broadcast(a), ["cell_y", "cell_x"]).withColumn("nm", wrapped_nm(c("a_lat"), c("a_lon"), c("lat"), c("lon"))).filter(c("nm") <= width_nm)
    return j.groupBy("norad", "icao").agg(F.min_by(F.struct("nm", "ts", "height_km"), F.struct("nm", "ts")).alias("m")).select("norad", "icao", c("m.nm").alias("min_nm"), c("m.ts").alias("ts"), c("m.height_km").alias("height_km"))


def corridor_aircraft(track: DataFrame, states: DataFrame, start: float, step_s: float, width_nm: float = 50.0) -> DataFrame:
    """Aircraft under a track at the nearest time sample: equi-join on (sample index, cell), closest per aircraft.

    Cells are as high as the corridor is wide to one side, so a sample of the track is copied to some ten of them at any
    width. Samples whose cells hold no aircraft at their time go no further.
    """
    from airlens.functions.geo import wrapped_nm
    from airlens.operators.bandjoin import cover_cells, floor_cell

    s = states.filter("lat is not null and lon is not null and not on_ground").select("recording", "icao24", "ts", c("lat").alias("s_lat"), c("lon").alias("s_lon"), "baro_alt_ft")
    s = s.withColumn("t_idx", F.ceil((c("ts") - start) / step_s - 0.5).cast("int"))  # a tie goes to the earlier sample
    dlat, edge = F.lit(width_nm / 60.0), max(1.0, width_nm / 60.0)
    t = track.withColumn("_w", width_nm / (60.0 * F.greatest(F.cos(F.radians(F.least(F.abs("lat") + width_nm / 60.0, F.lit(84.0)))), F.lit(0.1))))
    t = cover_cells(t, c("lat") - dlat, c("lon") - c("_w"), c("lat") + dlat, c("lon") + c("_w"), edge).select("norad", "t_idx", "lat", "lon", "cell_y", "cell_x")
    s = s.withColumn("cell_y", floor_cell(c("s_lat"), edge)).withColumn("cell_x", floor_cell(c("s_lon"), edge))
    t = t.join(s.select("t_idx", "cell_y", "cell_x").distinct(), ["t_idx", "cell_y", "cell_x"], "left_semi")
    j = s.join(t, ["t_idx", "cell_y", "cell_x"]).withColumn("nm", wrapped_nm(c("s_lat"), c("s_lon"), c("lat"), c("lon"))).filter(c("nm") <= width_nm)
    return j.groupBy("norad", "recording", "icao24").agg(F.min_by(F.struct("nm", "baro_alt_ft", "ts"), F.struct("nm", "ts")).alias("m")).select("norad", "recording", "icao24", c("m.nm").alias("min_nm"), c("m.ts").alias("ts"))
