"""Mixing to target weights by iterative proportional fitting.

Documents are counted into cells of all dimensions (one aggregation with partial sums). The cells' token weights are
raked to one margin after the other until no margin asks for a change; a document is then drawn with a probability in
proportion to its cell's weight, by the hash of its columns. A stated share of the tokens is kept: cells whose
probability would pass 1 are held at 1 and the others are raked again. A cell table of a counted, bounded size is raked
in one task; of a larger one the margins are aggregated and joined as tables, so neither cells nor margins have to be
few. Both ways take the same steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlens.llm.shared import stored, unpacked

c = F.col
#: cells up to this count (about 100 bytes each) are sent to every executor, more are joined by a shuffle
BROADCAST_CELLS = 50_000
#: cells up to this count (about 100 bytes each) are raked in one task, more sweep by sweep as tables
TOGETHER_CELLS = 50_000
SWEEPS = 50
#: sweeps in one task, where they cost next to nothing
TOGETHER_SWEEPS = 2000
#: a sweep that changes no weight by more than this share ends the raking
TOLERANCE = 1e-4


def _value(name: str) -> Column:
    """A dimension's value as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), c(name).cast("string")), F.lit(""))


def token_count(text: Column) -> Column:
    """Blanks and line ends of a text, plus one; none in null and empty texts."""
    n = F.octet_length(text)
    gaps = n - F.octet_length(F.replace(text, F.lit(" "), F.lit(""))) + n - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(n > 0, gaps + 1).otherwise(0).cast("long")


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Targets (value, share) for a dimension: its token shares to a power, so that large values weigh less."""
    sums = cells.groupBy(c(dimension).alias("value")).agg(F.sum("tokens").alias("t")).filter("t > 0").withColumn("p", F.pow(c("t").cast("double"), F.lit(power)))
    total = sums.agg(F.sum("p")).first()[0] or 1.0
    return sums.select("value", (c("p") / total).alias("share"))


def _goals(cells: DataFrame, dimensions: list[str], targets: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """For each dimension the values with tokens and a target: (value, its tokens t, its share of these targets)."""
    goal = {}
    for d in dimensions:
        present = cells.groupBy(c(d).alias("value")).agg(F.sum("tokens").alias("t")).filter("t > 0")
        t = targets[d].groupBy("value").agg(F.sum("share").alias("share")).filter("share > 0").join(present, "value")
        whole = t.agg(F.sum("share")).first()[0] or 1.0
        goal[d] = stored(t.select("value", "t", (c("share") / whole).alias("share")))
    return goal


def raked(cells: DataFrame, dimensions: list[str], targets: dict[str, DataFrame], sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """Cells (dimensions, tokens) with `weight`, by which the shares of weighted tokens fit the targets (value, share).

    Shares count in proportion among the values that have tokens. Cells with a value that no target names, or whose
    target is 0, weigh nothing; cells without tokens keep what their values ask for.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    w = cells.withColumn("weight", F.lit(1.0))
    goal = {d: g.select("value", (c("share") * float(total)).alias("asked")) for d, g in _goals(cells, dimensions, targets).items()}
    for _ in range(sweeps):
        w = w.withColumn("moved", F.lit(0.0))
        for d in dimensions:
            margin = w.groupBy(c(d).alias("value")).agg(F.sum(c("tokens") * c("weight")).alias("has"))
            factor = margin.join(goal[d], "value", "left").select(c("value").alias(d), F.when(c("has") > 0, F.coalesce("asked", F.lit(0.0)) / c("has")).otherwise(F.when(c("asked").isNull(), 0.0).otherwise(1.0)).alias("factor"))
            w = w.join(factor, d).withColumn("moved", F.greatest("moved", F.when(c("weight") * c("tokens") > 0, F.abs(c("factor") - 1)).otherwise(0.0))).withColumn("weight", c("weight") * c("factor")).drop("factor")
        w = stored(w.select(*dimensions, "tokens", "weight", "moved"))
        if (w.agg(F.max("moved")).first()[0] or 0.0) <= tolerance:
            break
    return w.drop("moved")


def _reachable(goal: DataFrame, budget: float) -> DataFrame:
    """A dimension's (value, asked tokens) that sum to the budget: in proportion to the shares, no value beyond its tokens."""
    k, full = budget, -1
    while True:
        held = c("share") * k >= c("t")
        n, tokens, left = goal.agg(F.count(F.when(held, 1)), F.sum(F.when(held, c("t"))), F.sum(F.when(~held, c("share")))).first()
        if n == full or not left:
            return goal.select("value", F.least(c("t").cast("double"), c("share") * k).alias("asked"))
        k, full = (budget - (tokens or 0)) / left, n


def margin_errors(w: DataFrame, dimensions: list[str], targets: dict[str, DataFrame], by: str) -> dict[str, float]:
    """For each dimension the largest distance between a value's share of the tokens times `by` and its target."""
    errors = {}
    for d, g in _goals(w.filter("weight > 0"), dimensions, targets).items():
        has = w.groupBy(c(d).alias("value")).agg(F.sum(c("tokens") * c(by)).alias("has"))
        whole = has.agg(F.sum("has")).first()[0] or 1.0
        errors[d] = has.join(g, "value", "full").agg(F.max(F.abs(F.coalesce("has", F.lit(0.0)) / whole - F.coalesce("share", F.lit(0.0))))).first()[0] or 0.0
    return errors


def budgeted(w: DataFrame, dimensions: list[str], targets: dict[str, DataFrame], keep: float, sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> tuple[DataFrame, dict[str, float]]:
    """The cells of raked() with `probability`, by which `keep` of all tokens are expected to stay; the margin errors left.

    The probability is one factor for all cells times the weight, if that fits. Else it is the smaller of 1 and a
    product of factors of the cell's values: what cells at 1 give is taken off their margins' targets and the others are
    raked to the rest. A value with fewer tokens than it is asked for is asked for all of them, and the other values of
    its dimension share what is missing. Cells that weigh nothing are never kept: if the others have fewer tokens than
    asked for, all of them stay.
    """
    total, able, whole, top = w.agg(F.sum("tokens"), F.sum(F.when(c("weight") > 0, c("tokens"))), F.sum(c("tokens") * c("weight")), F.max(F.when(c("tokens") > 0, c("weight")))).first()
    budget = min(keep * (total or 0), float(able or 0))
    if able and budget >= able:
        out = w.withColumn("probability", F.when(c("weight") > 0, 1.0).otherwise(0.0))
        return out, margin_errors(out, dimensions, targets, "probability")
    scale = budget / whole if whole else keep
    u = w.withColumn("odds", c("weight") * scale)
    if (top or 0.0) * scale > 1:
        goal = {d: stored(_reachable(g, budget)) for d, g in _goals(w.filter("weight > 0"), dimensions, targets).items()}
        for _ in range(sweeps):
            u = u.withColumn("was", F.least(F.lit(1.0), c("odds")))
            for d in dimensions:
                at1 = c("odds") >= 1
                margin = u.groupBy(c(d).alias("value")).agg(F.sum(F.when(at1, c("tokens")).otherwise(0)).alias("held"), F.sum(F.when(~at1, c("tokens") * c("odds")).otherwise(0.0)).alias("free"), F.sum(c("tokens") * c("odds")).alias("all"))
                # a Newton step for the factor; where cells at 1 alone give too much, one that brings the margin below its target
                step = F.when((c("free") > 0) & (c("asked") > c("held")), (c("asked") - c("held")) / c("free")).when((c("free") > 0) | (c("asked") < c("held")), c("asked") / c("all")).otherwise(1.0)
                factor = margin.join(goal[d], "value", "left").select(c("value").alias(d), F.when(c("asked").isNull(), 1.0).otherwise(step).alias("factor"))
                u = u.join(factor, d).withColumn("odds", c("odds") * c("factor")).drop("factor")
            u = stored(u)
            moved = u.agg(F.max(F.when(c("tokens") > 0, F.abs(F.least(F.lit(1.0), c("odds")) - c("was"))))).first()[0]
            u = u.drop("was")
            if (moved or 0.0) <= tolerance:
                break
    out = u.withColumn("probability", F.least(F.lit(1.0), c("odds"))).drop("odds")
    return out, margin_errors(out, dimensions, targets, "probability")


class _Cells:
    """The same for a bounded cell table in one task: values as numbers, sums by bincount."""

    def __init__(self, values: list[np.ndarray], tokens: np.ndarray, shares: list[dict[str, float]], powers: list[float | None]):
        self.tokens, self.total = tokens.astype(float), float(tokens.sum())
        self.codes, self.sizes, self.shares = [], [], []
        for v, given, power in zip(values, shares, powers):
            names, code = np.unique(v, return_inverse=True)
            self.codes.append(code)
            self.sizes.append(len(names))
            t = self.by_value(len(self.codes) - 1, self.tokens)
            self.shares.append(np.where(t > 0, t, 0.0) ** power * (t > 0) if power is not None else np.array([max(given.get(n, 0.0), 0.0) for n in names]))

    def by_value(self, d: int, amount: np.ndarray) -> np.ndarray:
        return np.bincount(self.codes[d], amount, self.sizes[d])

    def goals(self, some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each dimension the tokens of its values in some cells, and its shares among values with tokens."""
        for d, share in enumerate(self.shares):
            t = self.by_value(d, self.tokens * some)
            share = np.where(t > 0, share, 0.0)
            yield t, share / (share.sum() or 1.0)

    def raked(self, sweeps: int, tolerance: float) -> np.ndarray:
        weight = np.ones(len(self.tokens))
        asked = [share * self.total for _, share in self.goals(np.ones(len(self.tokens)))]
        for _ in range(sweeps):
            moved = 0.0
            for d, goal in enumerate(asked):
                has = self.by_value(d, self.tokens * weight)
                factor = np.where(has > 0, goal / np.where(has > 0, has, 1.0), goal > 0)[self.codes[d]]
                moved = max(moved, np.abs(factor - 1)[self.tokens * weight > 0].max(initial=0.0))
                weight = weight * factor
            if moved <= tolerance:
                break
        return weight

    def budgeted(self, weight: np.ndarray, keep: float, sweeps: int, tolerance: float) -> np.ndarray:
        some = weight > 0
        able, whole = self.tokens[some].sum(), float((self.tokens * weight).sum())
        budget = min(keep * self.total, able)
        if able and budget >= able:
            return some.astype(float)
        odds = weight * (budget / whole if whole else keep)
        if odds[self.tokens > 0].max(initial=0.0) > 1:
            asked = [self.reachable(t, share, budget) for t, share in self.goals(some)]
            for _ in range(sweeps):
                was = np.minimum(1.0, odds)
                for d, goal in enumerate(asked):
                    full = odds >= 1
                    held, free, given = (self.by_value(d, x) for x in (self.tokens * full, self.tokens * odds * ~full, self.tokens * odds))
                    with np.errstate(divide="ignore", invalid="ignore"):
                        step = np.where((free > 0) & (goal > held), (goal - held) / free, np.where((free > 0) | (goal < held), goal / given, 1.0))
                    odds = odds * np.where(goal > 0, step, 1.0)[self.codes[d]]
                if np.abs(np.minimum(1.0, odds) - was)[self.tokens > 0].max(initial=0.0) <= tolerance:
                    break
        return np.minimum(1.0, odds)

    @staticmethod
    def reachable(t: np.ndarray, share: np.ndarray, budget: float) -> np.ndarray:
        k, full = budget, -1
        while True:
            held = (share * k >= t) & (share > 0)
            left = share[~held].sum()
            if held.sum() == full or not left:
                return np.minimum(t, share * k)
            k, full = (budget - t[held].sum()) / left, held.sum()

    def errors(self, weight: np.ndarray, by: np.ndarray) -> list[float]:
        out = []
        for d, (_, share) in enumerate(self.goals(weight > 0)):
            has = self.by_value(d, self.tokens * by)
            out.append(float(np.abs(has / (has.sum() or 1.0) - share).max(initial=0.0)))
        return out


def _together(cells: DataFrame, dimensions: list[str], powers: dict[str, float], targets: dict[str, DataFrame], keep: float | None) -> DataFrame:
    """Cells with weight, probability and `errors`, one for each dimension, from one task."""
    target = None
    for d, t in targets.items():
        present = t.join(cells.select(c(d).alias("value")).distinct(), "value").groupBy("value").agg(F.sum("share").alias("share"))
        rows = present.select(F.lit(d).alias("dimension"), "value", c("share").cast("double").alias("share"))
        target = rows if target is None else target.unionByName(rows)
    both = cells if target is None else cells.unionByName(target, allowMissingColumns=True)
    power = [None if d in targets else powers[d] for d in dimensions]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = list(parts)
        if not found:
            return
        rows = pd.concat(found)
        shares: dict[str, dict[str, float]] = {d: {} for d in dimensions}
        if "share" in rows:
            for r in rows[rows["share"].notna()].itertuples():
                shares[r.dimension][r.value] = r.share
            rows = rows[rows["share"].isna()]
        if not len(rows):
            return
        w = _Cells([rows[d].to_numpy(str) for d in dimensions], rows["tokens"].to_numpy(float), [shares[d] for d in dimensions], power)
        weight = w.raked(TOGETHER_SWEEPS, TOLERANCE)
        top = weight[w.tokens > 0].max(initial=0.0)
        probability = np.minimum(1.0, weight / (top or 1.0)) if keep is None else w.budgeted(weight, keep, TOGETHER_SWEEPS, TOLERANCE)
        yield rows[dimensions].assign(weight=weight, probability=probability, errors=[w.errors(weight, probability)] * len(rows))

    return both.repartition(1).mapInPandas(run, ", ".join(f"{d} string" for d in dimensions) + ", weight double, probability double, errors array<double>")


def mixed(docs: DataFrame, dimensions: dict[str, Column], tokens: Column, powers: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None, seed: int = 0, keep: float | None = None, report: dict[str, float] | None = None, error: str | None = None) -> DataFrame:
    """All documents with `tokens`, `weight`, `probability` and `drawn`.

    dimensions: name -> value of a document. Targets (value, share) are given, or for dimensions in `powers` made from
    the documents. Values are written `=value`, null is the empty string. `keep` is the share of all tokens that is expected to stay, by
    budgeted(); the margin errors that it leaves are put into `report`, the largest of them into a column `error` if one
    is named. Without it the probability is the cell's weight
    over the largest weight of a cell with tokens: the expected margins are the targets, but the rarest cell decides how
    much stays. Rows are drawn by a hash of all their columns; equal rows share their fate; input columns with the added
    names are replaced; an empty table gives an empty result.
    """
    names = docs.columns
    dims = list(dimensions)
    own = {d: f"_d{i}" for i, d in enumerate(dims)}
    # the expressions see the input's columns, the rest only the packed row
    valued = docs.select(F.struct(*[c(f"`{n}`") for n in names]).alias("row"), tokens.alias("tokens"), *[dimensions[d].alias(own[d]) for d in dims])
    valued = valued.select("row", "tokens", *[_value(own[d]).alias(own[d]) for d in dims])
    cells = stored(valued.groupBy(*own.values()).agg(F.sum("tokens").alias("tokens")))
    given = {own[d]: t for d, t in (targets or {}).items() if d in own}
    n = cells.count()
    if n <= TOGETHER_CELLS:
        w = stored(_together(cells, list(own.values()), {own[d]: p for d, p in (powers or {}).items()}, given, keep))
        found = w.select("errors").first() if report is not None else None
        errors = dict(zip(own.values(), found[0] if found else [0.0] * len(own)))
        w = w.withColumn("worst", F.array_max("errors"))
    else:
        asked = {d: given[d] if d in given else tempered(cells, d, (powers or {})[k]) for k, d in own.items()}
        w = raked(cells, list(own.values()), asked)
        if keep is None:
            top = w.agg(F.max(F.when(c("tokens") > 0, c("weight")))).first()[0]
            w = w.withColumn("probability", F.least(F.lit(1.0), c("weight") / (top or 1.0)))
            errors = margin_errors(w, list(own.values()), asked, "probability") if report is not None or error else dict.fromkeys(own.values(), 0.0)
        else:
            w, errors = budgeted(w, list(own.values()), asked, keep)
        w = w.withColumn("worst", F.lit(max(errors.values(), default=0.0)))
    if report is not None:
        report.update({d: errors[own[d]] for d in dims})
    w = w.select(*own.values(), "weight", "probability", "worst")
    out = valued.join(F.broadcast(w) if n <= BROADCAST_CELLS else w, list(own.values()))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "row"), 11) / float(1 << 53)
    out = out.withColumn("drawn", draw < c("probability"))
    added = ["tokens", "weight", "probability", "drawn"]
    if error:
        out, added = out.withColumnRenamed("worst", error), [*added, error]
    return out.select(*unpacked(out, names, *added))
