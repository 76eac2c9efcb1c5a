"""Quality from compression: does a text shrink better with a dictionary of good texts or with one of bad texts?

Two Zstandard dictionaries are trained from bounded samples of labelled pieces. A text is compressed block by block
with either, and once without; the normalised difference of the sizes, next to how far the text shrinks on its own
(repetition helps both dictionaries alike), goes through a logistic calibration fitted on labelled texts that took no
part in the dictionaries. Scoring is one map over whole texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlens.llm.shared import computed

c = F.col
DICTIONARY_BYTES = 64 << 10
#: a long text would teach any compressor itself, so blocks are short
BLOCK_BYTES = 1024
LEVEL = 3
#: bytes added to every denominator: sizes of short texts say little
SHRINK = 100
#: Bounds of what is fitted: labelled documents of a class, half for its dictionary and half for the calibration; and
#: pieces of so many characters that go into a dictionary
DOCUMENTS_PER_CLASS = 4000
PIECES_PER_CLASS = 4000
PIECE_CHARS = 2000


@dataclass
class Model:
    good: bytes = b""
    bad: bytes = b""
    raw: tuple[bool, bool] = (True, True)
    weights: list[float] = field(default_factory=list)
    #: share of good labels; the score where there is nothing to tell the classes by
    prior: float = 0.5


def _dictionary(pieces: list[str]) -> tuple[bytes, bool]:
    """A trained dictionary, each line taken once so that a copied passage isn't taken for a trait; the pieces
    themselves where they are too few to train on."""
    seen: set[str] = set()
    lines = ["\n".join(x for x in p.split("\n") if not (x in seen or seen.add(x))) for p in pieces]
    samples = [x.encode("utf-8", "ignore") for x in lines if x]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes(), False
    except zstandard.ZstdError:
        return b"\n".join(samples)[:DICTIONARY_BYTES], True


def _measure(model: Model):
    def compressor(body: bytes | None = None, raw: bool = False) -> zstandard.ZstdCompressor:
        kind = zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_AUTO
        d = zstandard.ZstdCompressionDict(body, dict_type=kind) if body else None
        if d is not None:
            d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    good, bad, alone = compressor(model.good, model.raw[0]).compress, compressor(model.bad, model.raw[1]).compress, compressor().compress

    def measure(texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(texts), 3))
        for i, t in enumerate(texts):
            body = memoryview((t.as_py() or "").encode("utf-8", "ignore"))
            n = len(body)
            g = sum(len(good(body[k : k + BLOCK_BYTES])) for k in range(0, n, BLOCK_BYTES))
            b = sum(len(bad(body[k : k + BLOCK_BYTES])) for k in range(0, n, BLOCK_BYTES))
            out[i] = (b - g) / (b + g + SHRINK), len(alone(body)) / (n + SHRINK), math.log1p(n)
        return out

    return measure


def _inputs(m: np.ndarray) -> np.ndarray:
    d, r, n = m.T
    return np.stack([10 * d, 5 * r, 20 * d * r, 5 * r * r, n / 5, n * r, np.ones(len(m))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (w * (y - p)) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", text: str = "text") -> Model:
    """A model from labelled documents; label is 1 (good) or 0 (bad), rows with other labels or a null key are left out.

    What is read is bounded: the DOCUMENTS_PER_CLASS labels of each class with the smallest hash of their key. If a
    class has no document, every score is the share of good labels (0.5 without labels).
    """
    known = labels.select(c(key).alias("k"), c(label).cast("int").alias("y")).filter("k is not null and y in (0, 1)")
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    model = Model(prior=counts.get(1, 0) / sum(counts.values()) if counts else 0.5)
    if len(counts) < 2:
        return model
    drawn = [known.filter(c("y") == y).withColumn("h", F.xxhash64("k")).orderBy("h", "k").limit(DOCUMENTS_PER_CLASS) for y in (0, 1)]
    # at most 2 * DOCUMENTS_PER_CLASS rows of three numbers
    sample = docs.select(c(key).alias("k"), F.coalesce(c(text), F.lit("")).alias("t")).join(F.broadcast(drawn[0].unionByName(drawn[1])), "k")
    even = F.pmod("h", F.lit(2)) == 0
    pieces = sample.filter(even).select("y", F.explode(F.transform(F.sequence(F.lit(0), F.expr(f"(length(t) - 1) div {PIECE_CHARS}")), lambda i: F.substring(c("t"), i * PIECE_CHARS + 1, F.lit(PIECE_CHARS)))).alias("p")).filter("p <> ''")
    by_class = [[r.p for r in pieces.filter(c("y") == y).orderBy(F.xxhash64("p"), "p").limit(PIECES_PER_CLASS).collect()] for y in (0, 1)]
    (model.bad, bad_raw), (model.good, good_raw) = map(_dictionary, by_class)
    model.raw = (good_raw, bad_raw)
    rest = sample.filter(~even)
    rows = computed(rest, "t", ["y"], "d double, r double, n double", lambda: lambda a, f=_measure(model): [pa.array(x) for x in f(a).T]).collect()
    y = np.array([r.y for r in rows], float)
    if not model.good or not model.bad or len(set(y.tolist())) < 2:
        model.good = model.bad = b""
        return model
    # the classes count as much as they have labels
    w = np.where(y == 1, counts[1] / y.sum(), counts[0] / (1 - y).sum())
    model.weights = _logistic(_inputs(np.array([[r.d, r.r, r.n] for r in rows])), y, w / w.mean()).tolist()
    return model


def scored(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (default: all) with `score`: 0 to 1, higher for likelier good. Null counts as the empty text;
    every row has a score of its own; a column named score is replaced."""

    def setup():
        if not model.weights:
            return lambda a: [pa.array(np.full(len(a), model.prior))]
        measure, b = _measure(model), np.array(model.weights)
        return lambda a: [pa.array(1 / (1 + np.exp(-np.clip(_inputs(measure(a)) @ b, -500, 500))))]

    return computed(docs, text, docs.columns if keep is None else keep, "score double", setup)
