"""Captions, hashes, slugs, log chains: row-local text work, plus the few windows it needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from airlens.operators.ordered import with_previous

c = F.col
# fixed values: milestone -> pattern on lower-case text
MILESTONES = [
    ("liftoff", r"\b(lift[- ]?off|launch(?:ed)?|we have ignition|and liftoff)\b"),
    ("max_q", r"\bmax[- ]?q\b"),
    ("meco", r"\b(meco|main engine cut[- ]?off)\b"),
    ("stage_separation", r"\b(stage sep(?:aration)?|booster sep(?:aration)?|separation confirmed)\b"),
    ("fairing_separation", r"\bfairing (?:sep|separation|deploy)"),
    ("seco", r"\b(seco|second[- ]engine cut[- ]?off)\b"),
    ("boostback", r"\bboost[- ]?back\b"),
    ("entry_burn", r"\bentry burn\b"),
    ("landing_burn", r"\blanding burn\b"),
    ("landing", r"\b(landing confirmed|has landed|touchdown|landed)\b"),
    ("deploy", r"\b(deploy(?:ment|ed)? confirmed|payload deploy|spacecraft separation)\b"),
    ("abort", r"\b(abort|anomaly|hold hold hold)\b"),
]
GENESIS = "0" * 64
# fixed values: kind -> file extensions
ASSET_KINDS = {
    "model": ["glb", "gltf", "stl", "obj", "fbx", "blend", "3ds", "lwo", "lws", "dae", "usdz", "ma", "mb", "max"],
    "image": ["png", "jpg", "jpeg", "webp", "tif", "tiff", "bmp", "exr", "hdr", "gif"],
    "archive": ["7z", "zip", "rar", "gz", "tgz", "tar"],
    "doc": ["pdf", "txt", "md", "json", "csv"],
}


def _clock(t: Column) -> Column:
    p = F.split(F.regexp_replace(t, ",", "."), ":")
    return p[0].try_cast("double") * 3600 + p[1].try_cast("double") * 60 + p[2].try_cast("double")


def captions(files: DataFrame) -> DataFrame:
    """Caption files (stream, text) -> one row per caption block with times, markup removed. Nothing is shuffled."""
    blocks = F.split(F.regexp_replace(F.trim("text"), "\r\n", "\n"), r"\n\s*\n")
    b = files.select("stream", F.posexplode(blocks).alias("block", "_b"))
    b = b.withColumn("_l", F.filter(F.split("_b", "\n"), lambda x: F.trim(x) != "")).filter(F.size("_l") >= 2)
    numbered = F.get("_l", 1).contains("-->")
    when = F.when(numbered, F.get("_l", 1)).otherwise(F.get("_l", 0))
    body = F.array_join(F.when(numbered, F.slice("_l", 3, F.greatest(F.size("_l") - 2, F.lit(0)))).otherwise(F.slice("_l", 2, F.size("_l") - 1)), " ")
    b = b.withColumn("_t", when).withColumn("caption", F.trim(F.regexp_replace(body, "<[^>]+>", "")))
    span = r"^\s*(\S+)\s*-->\s*(\S+)"
    b = b.withColumn("start_s", _clock(F.regexp_extract("_t", span, 1))).withColumn("end_s", _clock(F.regexp_extract("_t", span, 2)))
    return b.filter("start_s is not null and end_s is not null").select("stream", "block", "start_s", "end_s", "caption")


def milestones(caps: DataFrame) -> DataFrame:
    """First mention of every milestone per stream: a plain aggregate, combined before the shuffle."""
    low = F.lower("caption")
    hits = F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(k)) for k, p in MILESTONES]))
    return caps.select("stream", "block", "start_s", F.explode(hits).alias("kind")).groupBy("stream", "kind").agg(F.min_by("start_s", "block").alias("t_s"))


def milestone_gaps(events: DataFrame) -> DataFrame:
    """Seconds from liftoff to the marks a flight is compared by."""
    p = events.groupBy("stream").agg(*[F.min(F.when(c("kind") == k, c("t_s"))).alias(k) for k, _ in MILESTONES])
    gaps = [("liftoff", "max_q"), ("liftoff", "meco"), ("meco", "stage_separation"), ("liftoff", "seco"), ("liftoff", "landing")]
    return p.select("stream", *[(c(b) - c(a)).alias(f"{a}_to_{b}") for a, b in gaps])


def slug(text: Column, n: int = 60) -> Column:
    """Name for a file: at most n characters (0: all), which keeps paths short and is no part of a key."""
    whole = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return whole if not n else F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, n)


def split_for(sha256: Column, val_fraction: float = 0.2) -> Column:
    """Train or validation by the first four hex digits of the content hash."""
    return F.when(F.conv(F.substring(sha256, 1, 4), 16, 10).cast("double") / 65536.0 < val_fraction, "val").otherwise("train")


def git_blob_sha1(content: Column) -> Column:
    data = F.encode(content, "UTF-8")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8"), F.unhex(F.lit("00")), data))


def asset_kind(path: Column) -> Column:
    """Kind by the extension of the last path part; three digits are a part of a split archive."""
    ext = F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"\.([^.]*)$", 1))
    out = F.when(ext.rlike("^[0-9]{3}$"), "archive")
    for kind, exts in ASSET_KINDS.items():
        out = out.when(ext.isin(exts), kind)
    return out.otherwise("other")


def headline(body: Column, n: int = 160) -> Column:
    """First line that is neither empty nor a heading: at most n characters of it (0: all)."""
    lines = F.filter(F.split(body, "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("#"))
    first = F.trim(F.get(lines, 0))
    return first if not n else F.substring(first, 1, n)


def chain_errors(log: DataFrame) -> DataFrame:
    """Log lines (log, line, seq, prev, hash, body) -> the failing lines with a reason, first reason per line.

    Lines without a hash are from before chaining and are skipped. A log is cut into slabs of lines, so one long log
    is verified in parallel.
    """
    chained = log.filter("hash is not null")
    p = with_previous(chained, ["log"], F.floor(c("line") / 100000), ["line"], ["hash", "seq"], "p")
    link = c("prev") != F.coalesce("p.hash", F.lit(GENESIS))
    gap = c("seq") != F.coalesce("p.seq", F.lit(0)) + 1
    reason = F.when(link, "previous-hash link broken").when(gap, "sequence gap").when(F.sha2("body", 256) != c("hash"), "content does not match its hash")
    return p.select("log", "line", reason.alias("reason")).filter("reason is not null")


def verify_chain(log: DataFrame) -> DataFrame:
    """Per log: entries, chained and legacy lines, first bad line and why."""
    n = log.groupBy("log").agg(F.count(F.lit(1)).alias("entries"), F.count("hash").alias("chained_lines"))
    bad = chain_errors(log).groupBy("log").agg(F.min("line").alias("first_bad"), F.min_by("reason", "line").alias("reason"))
    return n.join(bad, "log", "left").select("log", "entries", (c("entries") - c("chained_lines")).alias("legacy"), c("first_bad").isNull().alias("ok"), "first_bad", "reason")


def classifier_report(pairs: DataFrame) -> DataFrame:
    """Precision and recall per class from (truth, pred) rows; counted once, then only the counts are combined."""
    n = pairs.groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"))
    both = n.select(F.inline(F.array(F.struct(c("truth").alias("label"), c("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(c("truth") == c("pred"), c("n")).otherwise(0).alias("ok")),
                                     F.struct(c("pred").alias("label"), F.lit(0).cast("long").alias("t"), c("n").alias("p"), F.lit(0).cast("long").alias("ok")))))
    s = both.groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("ok").alias("correct"))
    return s.select("label", "support", "predicted", "correct", F.round(F.try_divide("correct", "predicted"), 4).alias("precision"), F.round(F.try_divide("correct", "support"), 4).alias("recall"))


def confusion(pairs: DataFrame) -> DataFrame:
    """Rows (truth, pred) counted by pair, each with its share and the accuracy over all; nulls are not judged."""
    n = pairs.filter("truth is not null and pred is not null").groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("_all"), F.sum(F.when(c("truth") == c("pred"), c("n")).otherwise(0)).alias("_right")).withColumn("_k", F.lit(1))
    j = n.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k")  # one row
    return j.select(F.concat_ws("->", c("truth").cast("string"), c("pred").cast("string")).alias("pair"), "n", F.round(c("n") / c("_all"), 4).alias("share"), (c("truth") == c("pred")).alias("correct"), F.round(c("_right") / c("_all"), 4).alias("accuracy"))


def round_robin(items: DataFrame, group: str, item_id: str, n: int, seed: int = 0) -> DataFrame:
    """n items taken in turns from the groups, each group in the order of a seeded hash.

    No group can give more than n, so each keeps its n smallest hashes before the turns are merged.
    """
    h = F.sha2(F.concat(F.lit(f"{seed}:"), c(item_id).cast("string")), 256)
    w = W.partitionBy(group).orderBy("_h", item_id)
    r = items.withColumn("_h", h).withColumn("_turn", F.row_number().over(w)).filter(c("_turn") <= n)
    return r.orderBy("_turn", group).limit(n).drop("_h", "_turn")
