"""URL filters by hashed expressions.

A rule is a host, a path and a verdict; it fits a URL whose host is the rule's or a subdomain of it and whose path
starts with the rule's. A URL is expanded into host suffixes (cut at dots) with path prefixes, but only of those
(labels, length) sizes that some rule has, so no other expression could fit. Expressions meet rules on the first 32
bits of a SHA-256 digest; the full digest then confirms, and the longest fitting rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlens.llm.shared import ascii_lower, packed, unpacked

c = F.col
#: rules up to this count (about 200 bytes each) are sent to every executor, more are shuffled
BROADCAST_RULES = 100_000
#: parts that one URL's copies, or one expression, are dealt to in a shuffle
SALTS = 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty where the URL is null or has no `://`."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(after, "^[^/?#]*", ""), "^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\u0000"), path), 256)


def judged(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """All pages with `host`, `path`, `rule` (host and path of the deciding rule, else null) and `verdict`.

    rules: host, path, verdict. The longest fitting rule wins; between rules of equal length the longer host, then
    `block`. Rules with a null are ignored and repeated rules count once. A null URL has an empty host and path, and
    the default verdict unless a rule has an empty host. Repeated pages are judged alike; input columns with the added
    names are replaced; empty tables are fine.
    """
    names = pages.columns
    r = rules.filter("host is not null and path is not null and verdict is not null").select(ascii_lower(c("host")).alias("r_host"), c("path").alias("r_path"), c("verdict").alias("r_verdict"))
    r = r.groupBy("r_host", "r_path").agg(F.min(F.struct((c("r_verdict") != "block").alias("o"), "r_verdict"))["r_verdict"].alias("r_verdict"))
    sizes = r.select(F.size(F.split("r_host", r"\.")).alias("labels"), F.length("r_path").alias("length")).groupBy("labels", "length").count().collect()  # bounded by the lengths that URLs have
    r = r.withColumn("digest", _digest(c("r_host"), c("r_path"))).withColumn("short", F.substring("digest", 1, 8))
    host, path = host_and_path(c("row.`" + url + "`"))
    p = packed(pages).select("row", host.alias("host"), path.alias("path"), c("row.`" + url + "`").alias("url"))
    p = p.withColumn("salt", F.pmod(F.hash("row"), F.lit(SALTS)))
    # an expression of each size that the URL is long enough for
    labels = F.split("host", r"\.")
    wanted = F.array(*[F.struct(F.lit(s["labels"]).alias("k"), F.lit(s["length"]).alias("m")) for s in sizes]) if sizes else F.expr("cast(array() as array<struct<k:int,m:int>>)")
    fits = F.filter(wanted, lambda w: (F.size(labels) >= w["k"]) & (F.length("path") >= w["m"]))
    digests = F.transform(fits, lambda w: _digest(F.array_join(F.slice(labels, F.size(labels) - w["k"] + 1, w["k"]), "."), F.substring(c("path"), F.lit(1), w["m"])))
    e = p.select("url", "salt", F.explode(F.array_distinct(digests)).alias("digest")).withColumn("short", F.substring("digest", 1, 8))
    if r.count() <= BROADCAST_RULES:
        met = e.join(F.broadcast(r.withColumnRenamed("digest", "r_digest")), "short")
    else:
        spread = r.withColumnRenamed("digest", "r_digest").withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        met = e.join(spread, ["short", "salt"])
    met = met.filter(c("digest") == c("r_digest"))
    better = F.struct(F.length(F.concat("r_host", "r_path")).alias("l"), F.length("r_host").alias("h"), (c("r_verdict") == "block").alias("b"), F.concat("r_host", "r_path").alias("rule"), c("r_verdict").alias("v"))
    best = met.groupBy("url", "salt").agg(F.max(better).alias("best"))
    best = best.select(c("url").alias("b_url"), c("salt").alias("b_salt"), "best")
    out = p.join(best, c("url").eqNullSafe(c("b_url")) & (c("salt") == c("b_salt")), "left").select("row", "host", "path", c("best.rule").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))
    return out.select(*unpacked(out, names, "host", "path", "rule", "verdict"))
