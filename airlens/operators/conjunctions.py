"""Conjunction messages: parse, collision probability, assessment, events."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

c = F.col
# fixed values
HBR_M = 20.0
PC_ALERT, PC_WATCH, MISS_TOLERANCE = 1e-4, 1e-7, 0.05
TCA_WINDOW_S = 600.0
NUMERIC = ["X", "Y", "Z", "X_DOT", "Y_DOT", "Z_DOT", "CR_R", "CT_R", "CT_T", "CN_R", "CN_T", "CN_N"]


def parse_kvn(messages: DataFrame) -> DataFrame:
    """Whole-text messages (file, text) -> header columns and the fields of both objects.

    Each message is small and is parsed where it lies; nothing is shuffled.
    """
    lines = F.filter(F.split("text", "\r?\n"), lambda x: ~F.trim(x).startswith("COMMENT") & x.rlike(r"^\s*[A-Z0-9_]+\s*="))
    pair = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^\s*([A-Z0-9_]+)\s*=", 1).alias("k"), F.trim(F.regexp_extract(x, r"=\s*(.*)$", 1)).alias("v")))
    m = messages.withColumn("_kv", pair)
    first = F.array_position(F.transform("_kv", lambda p: p["k"]), F.lit("OBJECT"))
    m = m.withColumn("_first", first)
    second = F.array_position(F.transform(F.slice("_kv", c("_first").cast("int") + 1, F.greatest(F.size("_kv") - c("_first").cast("int"), F.lit(0))), lambda p: p["k"]), F.lit("OBJECT"))
    m = m.withColumn("_n1", F.when(c("_first") > 0, F.coalesce(second, F.lit(0))).otherwise(0))

    size = F.size("_kv")
    head = F.when(c("_first") > 0, F.slice("_kv", F.lit(1), F.greatest(c("_first").cast("int") - 1, F.lit(0)))).otherwise(c("_kv"))
    one = F.when(c("_first") > 0, F.slice("_kv", c("_first").cast("int"), F.when(c("_n1") > 0, c("_n1").cast("int")).otherwise(size)))
    two = F.when(c("_n1") > 0, F.slice("_kv", (c("_first") + c("_n1")).cast("int"), size))
    parts = m.select("file", *[F.reverse(x).alias(n) for n, x in (("header", head), ("o1", one), ("o2", two))])
    parts = parts.select("file", *[c(f"{n}.{f}").alias(f"{n}_{f}") for n in ("header", "o1", "o2") for f in "kv"])
    # a repeated key keeps its last value, the first from the end
    text = lambda part, k: F.get(c(f"{part}_v"), (F.array_position(f"{part}_k", F.lit(k)) - 1).cast("int"))
    num = lambda part, k: F.split(text(part, k), " ")[0].try_cast("double")
    return parts.select(
        "file", text("header", "MESSAGE_ID").alias("message_id"), text("header", "ORIGINATOR").alias("originator"), text("header", "CREATION_DATE").alias("creation_date"), text("header", "TCA").alias("tca"),
        num("header", "MISS_DISTANCE").alias("stated_miss_m"), num("header", "COLLISION_PROBABILITY").alias("stated_pc"),
        text("o1", "OBJECT_DESIGNATOR").alias("object1"), text("o2", "OBJECT_DESIGNATOR").alias("object2"),
        *[num(o, k).alias(f"{o}_{k.lower()}") for o in ("o1", "o2") for k in NUMERIC])


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cols(df: DataFrame, name: str, values: list[Column]) -> tuple[DataFrame, list[Column]]:
    """Materialise a vector as columns, so later formulas refer to it instead of repeating it."""
    for i, v in enumerate(values):
        df = df.withColumn(f"_{name}{i}", v)
    return df, [c(f"_{name}{i}") for i in range(len(values))]


def encounter_plane(messages: DataFrame) -> DataFrame:
    """Miss vector and covariance in the plane across the relative velocity, or the reason there is none."""
    d = messages
    r = {o: [c(f"{o}_{a}") for a in ("x", "y", "z")] for o in ("o1", "o2")}
    v = {o: [c(f"{o}_{a}_dot") for a in ("x", "y", "z")] for o in ("o1", "o2")}
    cov = []
    bad = F.lit(None).cast("string")
    for o in ("o1", "o2"):
        rr, tr, tt, nr, nt, nn = (c(f"{o}_{k}") for k in ("cr_r", "ct_r", "ct_t", "cn_r", "cn_t", "cn_n"))
        det3 = rr * (tt * nn - nt * nt) - tr * (tr * nn - nt * nr) + nr * (tr * nt - tt * nr)
        definite = (rr > 0) & (tt > 0) & (nn > 0) & (rr * tt - tr * tr > 0) & (det3 > 0)
        missing = r[o][0].isNull() | r[o][1].isNull() | r[o][2].isNull() | v[o][0].isNull() | v[o][1].isNull() | v[o][2].isNull()
        nocov = rr.isNull() | tr.isNull() | tt.isNull() | nr.isNull() | nt.isNull() | nn.isNull()
        bad = F.coalesce(bad, F.when(missing, "no state vector").when(nocov, "no covariance").when(~definite, "covariance not positive definite"))
        norm = F.sqrt(_dot(r[o], r[o]))
        d, R = _cols(d, f"{o}r", [F.try_divide(x, norm) for x in r[o]])
        h = _cross(r[o], v[o])
        d, H = _cols(d, f"{o}h", h)
        d, N = _cols(d, f"{o}n", [F.try_divide(x, F.sqrt(_dot(H, H))) for x in H])
        d, T = _cols(d, f"{o}t", _cross(N, R))
        M = [[R[i], T[i], N[i]] for i in range(3)]
        C = [[rr, tr, nr], [tr, tt, nt], [nr, nt, nn]]
        d, flat = _cols(d, f"{o}c", [sum((M[i][k] * C[k][m] * M[j][m] for k in range(3) for m in range(3)), F.lit(0.0)) for i in range(3) for j in range(3)])
        cov.append(flat)
    d, S = _cols(d, "s", [a + b for a, b in zip(cov[0], cov[1], strict=True)])
    d, rel = _cols(d, "q", [(b - a) * 1000.0 for a, b in zip(r["o1"], r["o2"], strict=True)])
    d, rv = _cols(d, "w", [(b - a) * 1000.0 for a, b in zip(v["o1"], v["o2"], strict=True)])
    d = d.withColumn("miss_m", F.sqrt(_dot(rel, rel))).withColumn("rel_speed_ms", F.sqrt(_dot(rv, rv)))
    d, u = _cols(d, "u", [F.try_divide(x, c("rel_speed_ms")) for x in rv])
    d = d.withColumn("_al", _dot(rel, u))
    d, pl = _cols(d, "p", [rel[i] - c("_al") * u[i] for i in range(3)])
    d = d.withColumn("plane_miss_m", F.sqrt(_dot(pl, pl)))
    axis = [F.when(F.abs(u[0]) < 0.9, 1.0).otherwise(0.0), F.when(F.abs(u[0]) < 0.9, 0.0).otherwise(1.0), F.lit(0.0)]
    d, fb = _cols(d, "f", _cross(u, axis))
    d, e1 = _cols(d, "e", [F.when(c("plane_miss_m") < 1e-9, F.try_divide(fb[i], F.sqrt(_dot(fb, fb)))).otherwise(F.try_divide(pl[i], c("plane_miss_m"))) for i in range(3)])
    d, e2 = _cols(d, "g", _cross(u, e1))
    proj = lambda a, b: sum((a[i] * S[3 * i + j] * b[j] for i in range(3) for j in range(3)), F.lit(0.0))
    d = d.withColumn("s11", proj(e1, e1)).withColumn("s12", proj(e1, e2)).withColumn("s22", proj(e2, e2)).withColumn("mx", _dot(pl, e1)).withColumn("my", _dot(pl, e2))
    singular = c("s11") * c("s22") - c("s12") * c("s12") <= 0
    d = d.withColumn("error", F.coalesce(bad, F.when(c("rel_speed_ms") < 1e-6, "relative velocity is zero").when(singular, "projected covariance is singular")))
    return d.select(*messages.columns, "miss_m", "plane_miss_m", "rel_speed_ms", "s11", "s12", "s22", "mx", "my", "error")


#: messages whose grids (115 KB each) are held at once
GRID_ROWS = 64


@F.pandas_udf(T.DoubleType())
def _disc_integral(s11: pd.Series, s12: pd.Series, s22: pd.Series, mx: pd.Series, my: pd.Series, hbr: pd.Series) -> pd.Series:
    """Gaussian over a disc on an 80 x 180 polar grid, GRID_ROWS messages at a time."""
    th = (np.arange(180) + 0.5) * (2 * np.pi / 180)
    unit = (np.arange(80) + 0.5) / 80
    ux, uy = np.outer(unit, np.cos(th))[None], np.outer(unit, np.sin(th))[None]
    a, b, d, x0, y0, r = (x.to_numpy(float) for x in (s11, s12, s22, mx, my, hbr))
    det = a * d - b * b
    out = np.full(len(a), np.nan)
    sound = np.flatnonzero(det > 0)
    for i in np.split(sound, range(GRID_ROWS, len(sound), GRID_ROWS)):
        n = lambda v: v[i][:, None, None]  # noqa: B023, E731
        x, y = ux * n(r) - n(x0), uy * n(r) - n(y0)
        q = (n(d) * x * x - 2 * n(b) * x * y + n(a) * y * y) / n(det)
        w = unit[None, :, None] * n(r) * (n(r) / 80) * (2 * np.pi / 180)
        out[i] = np.minimum(1.0, (np.exp(-0.5 * q) * w).sum(axis=(1, 2)) / (2 * np.pi * np.sqrt(det[i])))
    return pd.Series(out)


def probability(messages: DataFrame, hbr_m: float = HBR_M) -> DataFrame:
    d = encounter_plane(messages)
    pc = _disc_integral("s11", "s12", "s22", "mx", "my", F.lit(hbr_m))
    return d.withColumn("_pc", pc).withColumn("pc", F.when(c("error").isNull() & ~F.isnan("_pc"), c("_pc"))).drop("_pc")


def findings(assessed: DataFrame) -> DataFrame:
    rel = F.abs(c("miss_m") - c("stated_miss_m")) / c("stated_miss_m")
    hits = F.array_compact(F.array(
        F.when(c("error").isNotNull(), F.struct(F.lit("ORB-005").alias("rule_id"), F.lit("medium").alias("severity"), c("error").alias("note"))),
        F.when(c("error").isNull() & (c("stated_miss_m") > 0) & (rel > MISS_TOLERANCE), F.struct(F.lit("ORB-005").alias("rule_id"), F.lit("medium").alias("severity"), F.lit("stated miss differs").alias("note"))),
        F.when(c("pc") >= PC_ALERT, F.struct(F.lit("ORB-004").alias("rule_id"), F.lit("high").alias("severity"), F.lit("above the manoeuvre threshold").alias("note")))
        .when(c("pc") >= PC_WATCH, F.struct(F.lit("ORB-004").alias("rule_id"), F.lit("medium").alias("severity"), F.lit("monitor").alias("note")))))
    return assessed.withColumn("_h", F.explode(hits)).select("message_id", "_h.*")


def events(ledger: DataFrame) -> DataFrame:
    """Ledger rows (pair, tca_ts, creation_date, received_at, message_id, pc, stated_pc) -> one row per event.

    Counts and maxima are plain aggregates; only the two newest probabilities of an event are ranked.
    """
    key = ["pair", "bucket"]
    led = ledger.withColumn("bucket", F.coalesce(F.floor(c("tca_ts") / TCA_WINDOW_S), F.lit(-1))).withColumn("p", F.coalesce("pc", "stated_pc"))
    order = F.struct(F.coalesce("creation_date", F.lit("")).alias("cd"), F.coalesce("received_at", F.lit("")).alias("ra"), c("message_id").alias("id"))
    led = led.withColumn("_o", order)
    agg = led.groupBy(*key).agg(F.count(F.lit(1)).alias("messages"), F.max("p").alias("max_pc"), F.max_by("message_id", "_o").alias("latest_message_id"))
    w = W.partitionBy(*key).orderBy(F.desc("_o"))
    two = led.filter("p is not null").withColumn("_r", F.row_number().over(w)).filter("_r <= 2").groupBy(*key).agg(
        F.max(F.when(c("_r") == 1, c("p"))).alias("latest_pc"), F.max(F.when(c("_r") == 2, c("p"))).alias("_before"))
    trend = F.when(c("latest_pc") > c("_before") * 1.5, "escalating").when(c("latest_pc") < c("_before") / 1.5, "de-escalating").otherwise("stable")
    return agg.join(two, key, "left").withColumn("trend", trend).drop("_before")
