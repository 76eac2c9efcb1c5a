"""Secrets in texts: strong patterns, and weak parts of a credential that count only near their other parts.

Built-in functions only. One scan takes from each text the lengths of the pieces between matches and of the matches;
running sums of them are the positions. The parts of a text (identifiers, secrets, endpoints) are intervals in its
scopes: the text around a part, the block between blank lines, and the whole text if it has one identifier only. For the
first, an interval join on (text, bin of `reach` code points) finds whether a complementary part lies within reach; per
bin and role only the smallest start and the largest end are kept, so a bin with many parts joins as one row. Blank
lines are placed like parts, and their number before a part is its block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from airlens.llm.shared import packed, stored, unpacked

c = F.col
# Strong kinds: (kind, role, pattern of a match, group that must have at least so many characters)
STRONG = [
    ("assign", "secret", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "id", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", "secret", r"[0-9a-f]+", 0, 32),
]
# Weak kinds: reported only when complementary parts are near
WEAK = [
    ("weak_id", "id", r"\b(?:ASIA|AIDA|AROA)[A-Z0-9]{12,}", 0, 16),
    ("weak_key", "secret", r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])", 0, 40),
    ("endpoint", "endpoint", r"\b(?:https?|s3|ftp|sftp|ssh|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~%:@/-]+", 0, 8),
]
#: what separates the blocks of a text
BLANK = r"\n[ \t\r]*\n"
# What a quick search must find before the pattern is matched piece by piece
QUICK = {"assign": STRONG[0][2][:-2] + "{8,})", "access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32}"}
ORDER = [k[0] for k in STRONG + WEAK]
#: roles of which one must be near, for each weak kind: all of the outer list, any of the inner
NEEDS = {"weak_id": [["secret"]], "weak_key": [["id"]], "endpoint": [["id"], ["secret"]]}


BREAK = "break"


def _none() -> Column:
    return F.expr("cast(array() as array<struct<gap:int,long:int,kept:boolean,kind:int>>)")


def _pieces(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (gap before the match, length of the match, kept, kind) in the order of the text; empty if none is kept."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    each = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), found.alias("f"), value.alias("v")),
        lambda z: F.struct(F.length(z["g"]).alias("gap"), F.length(z["f"]).alias("long"), (F.length(z["v"]) >= least).alias("kept"), F.lit((ORDER + [BREAK]).index(kind)).alias("kind")),
    )
    return F.when(text.rlike(QUICK.get(kind, pattern)), each).otherwise(_none())


def secret_spans(docs: DataFrame, text: str = "text", reach: int = 256) -> DataFrame:
    """All documents with `secrets`: array of (start, kind, end, weak), sorted by start and then by kind as in ORDER.

    Positions count code points, the end is exclusive. Strong spans are always listed: leftmost non-overlapping
    matches per kind without those that are too short. A weak span that overlaps no strong one is listed where parts
    of the roles in NEEDS lie in its scopes: within `reach` code points, in the same block between blank lines, or
    anywhere in a text with exactly one identifier. Null and empty texts have none; every row
    is judged on its own, so repeated rows and null ids are fine; an input column named secrets is replaced.
    """
    names = docs.columns
    t = c(f"row.`{text}`")
    scan = packed(docs).select(
        F.monotonically_increasing_id().alias("id"),
        F.struct(*[c(f"row.`{n}`").alias(n) for n in names if n != text]).alias("row") if len(names) > 1 else F.struct(F.lit(0).alias("_")).alias("row"),
        *[_pieces(t, k[0], *k[2:]).alias(k[0]) for k in STRONG + WEAK],
        # blocks only matter to texts with weak parts
        F.when(t.rlike("|".join(k[2] for k in WEAK)), _pieces(t, BREAK, BLANK, 0, 0)).otherwise(_none()).alias(BREAK),
    )
    # ids are drawn once: from here on they are read back. The texts are not kept.
    thin = stored(scan)
    each = thin.select("id", F.explode(F.array(*[c(k) for k in [*ORDER, BREAK]])).alias("a")).select("id", F.posexplode("a").alias("i", "m")).select("id", "i", "m.*")
    run = W.partitionBy("id", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    spans = each.withColumn("end", F.sum(c("gap") + c("long")).over(run).cast("int")).filter("kept").select("id", "kind", (c("end") - c("long")).alias("start"), "end")
    strong = len(STRONG)
    # a weak part inside or across a strong one is that strong one
    by_start = W.partitionBy("id").orderBy("start", "kind")
    base_end, base_start = F.when(c("kind") < strong, c("end")), F.when(c("kind") < strong, c("start"))
    spans = spans.withColumn("block", F.count(F.when(c("kind") == len(ORDER), 1)).over(by_start.rowsBetween(W.unboundedPreceding, -1))).filter(c("kind") < len(ORDER))
    clear = spans.withColumn("left", F.max(base_end).over(by_start.rowsBetween(W.unboundedPreceding, -1))).withColumn("right", F.min(base_start).over(by_start.rowsBetween(1, W.unboundedFollowing)))
    clear = clear.filter((c("kind") < strong) | ((F.coalesce("left", F.lit(-1)) <= c("start")) & F.coalesce(c("right") >= c("end"), F.lit(True))))
    role_of = F.element_at(F.array(*[F.lit(k[1]) for k in STRONG + WEAK]), c("kind") + 1)
    clear = clear.select("id", "kind", "start", "end", "block", role_of.alias("role"))
    # three roles at most in a set
    in_block = F.collect_set("role").over(W.partitionBy("id", "block"))
    in_text = F.when(F.count(F.when(c("role") == "id", 1)).over(W.partitionBy("id")) == 1, F.collect_set("role").over(W.partitionBy("id"))).otherwise(F.array().cast("array<string>"))
    clear = clear.withColumn("around", F.array_union(in_block, in_text))
    bins = clear.select("id", "role", "start", "end", F.explode(F.sequence(F.expr(f"start div {reach}"), F.expr(f"end div {reach}"))).alias("bin"))
    bins = bins.groupBy("id", "bin", "role").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    weak = clear.filter(c("kind") >= strong)
    looks = weak.withColumn("bin", F.explode(F.sequence(F.expr(f"greatest(start - {reach}, 0) div {reach}"), F.expr(f"(end + {reach}) div {reach}"))))
    # a bin is narrower than what is looked through, so its extremes tell whether any part lies within reach
    near = looks.select("id", "bin", "kind", "start", "end", "around").join(bins, ["id", "bin"]).filter((c("first") <= c("end") + reach) & (c("last") >= c("start") - reach))
    # a part itself is always within reach, so none is lost here
    roles = near.groupBy("id", "kind", "start", "end").agg(F.array_union(F.collect_set("role"), F.first("around")).alias("roles"))
    linked = None
    for k, needs in NEEDS.items():
        ok = c("kind") == ORDER.index(k)
        for some in needs:
            ok = ok & F.arrays_overlap("roles", F.array(*[F.lit(s) for s in some]))
        linked = ok if linked is None else linked | ok
    kept = clear.filter(c("kind") < strong).select("id", "kind", "start", "end").unionByName(roles.filter(linked).select("id", "kind", "start", "end"))
    lists = kept.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("l"))
    lists = lists.select("id", F.transform("l", lambda s: F.struct(s["start"].alias("start"), F.element_at(F.array(*[F.lit(k) for k in ORDER]), s["kind"] + 1).alias("kind"), s["end"].alias("end"), (s["kind"] >= strong).alias("weak"))).alias("secrets"))
    out = thin.select("id", "row").join(lists, "id", "left")
    none = F.expr("cast(array() as array<struct<start:int,kind:string,end:int,weak:boolean>>)")
    out = out.withColumn("secrets", F.coalesce("secrets", none))
    return out.select(*unpacked(out, [n for n in names if n != text], "secrets"))


def span_list(secrets: Column, base_only: bool = False) -> Column:
    """`kind:start:end` of the spans, comma-joined."""
    s = F.filter(secrets, lambda x: ~x["weak"]) if base_only else secrets
    return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
