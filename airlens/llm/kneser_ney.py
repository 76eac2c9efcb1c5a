"""Interpolated modified Kneser-Ney language model (bigrams) counted in Spark, kept as sorted hash arrays.

Counting: a task collects the distinct bigrams of a block of tokens and sends them, as sorted 64-bit hashes with counts,
to the shard of their hash range; a shard merges what blocks send and writes one file of sorted hashes and counts to the
shared folder. A second pass looks the bigrams of each block up in those files, which workers map into memory, and
gathers word statistics: a block that holds k of the c occurrences of a bigram adds k/c of it to its context and its
word, so that every bigram counts once in the end; words are merged by hash range in the same way. Scoring is a map over
whole texts that maps both sets of files. Hashes are uniform, so no word or bigram makes a shard large, and no array
passes through the driver, only the list of files.

P(w | h) = max(c(hw) - D, 0) / c(h) + gamma(h) P1(w), with P1 from the numbers of contexts a word follows, discounted
likewise and interpolated with 1 / (V + 1). D depends on whether a count is 1, 2 or more. Every text begins in a context
of its own and ends with an end token, which counts as a token.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airlens.llm import words
from airlens.llm.graph import whole_groups
from airlens.llm.shared import shared_folder, small_batches

c = F.col
#: tokens of a block at least; a text is never divided
BLOCK_TOKENS = 1_500_000
#: bytes of text for each shard of bigrams, and shards at least
SHARD_BYTES = 12_000_000
LEAST_SHARDS = 16
#: hashes of the end of a text and of the context in front of it
END, START = np.uint64(0x3C6EF372FE94F82B), np.uint64(0xA54FF53A5F1D36F1)


# Files of sorted hashes -----------------------------------------------------------------------------------------------


def _filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def _write(folder: str, arrays: list[np.ndarray]) -> str:
    """One file of arrays of equal length, under a name of its own: only files of tasks that ended are ever named."""
    fs, base = _filesystem(folder)
    fs.create_dir(base, recursive=True)
    name = uuid.uuid4().hex
    with fs.open_output_stream(f"{base}/{name}") as out:
        for a in arrays:
            out.write(np.ascontiguousarray(a).data if len(a) else b"")
    return f"{folder}/{name}"


class Mapped:
    """A file of sorted hashes (uint64) and further arrays, mapped into memory; a file elsewhere than on a mounted
    folder is first spooled to a file without a name, which goes when the worker lets go of it."""

    def __init__(self, path: str, rows: int, kinds: list[type]):
        fs, at = _filesystem(path)
        source = at
        if fs.type_name != "local":
            source = tempfile.TemporaryFile()
            with fs.open_input_stream(at) as f:
                while part := f.read(8 << 20):
                    source.write(part)
            source.flush()
        self.arrays, offset = [], 0
        for kind in kinds:
            self.arrays.append(np.memmap(source, kind, "r", offset, (rows,)) if rows else np.zeros(0, kind))
            offset += rows * np.dtype(kind).itemsize

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of sorted keys, and which of them are there."""
        have = self.arrays[0]
        if not len(have):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        return at, have[at] == keys


@dataclass
class Files:
    """Shard s of n holds the hashes whose upper 32 bits times n, divided by 2**32, are s."""

    shards: int
    kinds: list[type]
    paths: dict[int, tuple[str, int]] = field(default_factory=dict)

    def look_up(self, keys: np.ndarray) -> list[np.ndarray]:
        """The further arrays' values of sorted keys, 0 where there are none."""
        out = [np.zeros(len(keys), k) for k in self.kinds[1:]]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(_shard(keys, self.shards))) + 1, [len(keys)]]) if len(keys) else [0]
        for lo, hi in zip(cut[:-1], cut[1:]):
            s = int(_shard(keys[lo : lo + 1], self.shards)[0])
            if s in self.paths:
                f = Mapped(*self.paths[s], self.kinds)
                at, there = f.find(keys[lo:hi])
                for o, a in zip(out, f.arrays[1:]):
                    o[lo:hi][there] = a[at[there]]
        return out


def _shard(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def _pack(a: np.ndarray) -> bytes:
    """Bytes of equal rank together: the upper bytes of close numbers are equal."""
    return zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T).tobytes(), 1) if len(a) else b""


def _unpack(b: bytes, kind: type) -> np.ndarray:
    if not b:
        return np.zeros(0, kind)
    raw = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


def _sent(keys: np.ndarray, values: list[np.ndarray], shards: int) -> Iterator[pa.RecordBatch]:
    """One row for each shard that some of the sorted keys belong to."""
    cut = np.concatenate([[0], np.flatnonzero(np.diff(_shard(keys, shards))) + 1, [len(keys)]]) if len(keys) else [0]
    bodies = [[_pack(np.diff(keys[lo:hi], prepend=np.uint64(0))), *[_pack(v[lo:hi]) for v in values]] for lo, hi in zip(cut[:-1], cut[1:])]
    if bodies:
        yield pa.RecordBatch.from_arrays([pa.array(_shard(keys[cut[:-1]], shards)), pa.array(bodies, pa.list_(pa.binary()))], ["shard", "body"])


def _merged(bodies: list[list[bytes]], kinds: list[type]) -> tuple[np.ndarray, list[np.ndarray]]:
    keys = np.concatenate([np.cumsum(_unpack(b[0], np.uint64), dtype=np.uint64) for b in bodies])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ np.uint64(1)))
    sums = [np.add.reduceat(np.concatenate([_unpack(b[k], kind) for b in bodies])[order], first) for k, kind in enumerate(kinds, 1)]
    return keys[first], sums


# Blocks of tokens -----------------------------------------------------------------------------------------------------


def _blocks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Rows with the token hashes of their texts, and the bounds of the texts in them; each text has its end token."""
    rows: list[pa.RecordBatch] = []
    parts: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    size = 0

    def block():
        n = np.concatenate(counts)
        bounds = np.concatenate([[0], np.cumsum(n + 1)])
        tokens = np.full(bounds[-1], END, np.uint64)
        keep = np.ones(len(tokens), bool)
        keep[bounds[1:] - 1] = False
        tokens[keep] = np.concatenate(parts)
        return rows, tokens, bounds

    for b in batches:
        for lo, hi, h, bounds in words.hashed(b.column(text), words.SPACED):
            rows.append(b.slice(lo, hi - lo))
            parts.append(h)
            counts.append(np.diff(bounds))
            size += len(h)
            if size >= BLOCK_TOKENS:
                yield block()
                rows, parts, counts, size = [], [], [], 0
    if rows:
        yield block()


def _contexts(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[bounds[:-1]] = START
    return before


def _bigrams(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return words.mix(h * np.uint64(0x9E3779B97F4A7C15) + w)


def _discounts(n: np.ndarray) -> list[float]:
    """For counts 1, 2 and above, from the numbers of entries with counts 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = [k - (k + 1) * y * b / a if a else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return [float(np.clip(d, 0.1, k)) for k, d in enumerate(raw, 1)]


def _classes(n: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(n[n > 0], 5).astype(np.int64), minlength=6)[1:5]


@dataclass
class Model:
    bigrams: Files
    words: Files
    tokens: int = 0
    vocabulary: int = 0
    contexts: int = 0
    discounts: list[float] = field(default_factory=lambda: [0.5, 1.0, 1.5])
    lower: list[float] = field(default_factory=lambda: [0.5, 1.0, 1.5])
    lower_gamma: float = 1.0


def _discount(n: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(n, 3).astype(np.int64)]


def _collected(df: DataFrame, shards: int, kinds: list[type], folder: str, finish, columns: str) -> list:
    """Merges what blocks have sent to each shard; finish(keys, sums) gives the arrays to write and the row to return."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches, 1, 1):
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                part = t.slice(lo, hi - lo)
                arrays, figures = finish(*_merged(part.column("body").to_pylist(), kinds))
                path = _write(folder, arrays)
                values = [part.column("shard")[0].as_py(), path, len(arrays[0]), *figures]
                yield pa.RecordBatch.from_arrays([pa.array([v]).cast(f) for v, f in zip(values, [pa.int32(), pa.string(), pa.int64(), *[pa.int64()] * len(figures)])], names)

    schema = T.StructType.fromDDL(f"shard int, path string, rows long, {columns}")
    names = schema.names
    dealt = df.repartition(max(1, shards), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(merge, schema).collect()  # a row of a few numbers for each shard


def fit(spark: SparkSession, docs: DataFrame, text: str = "text") -> Model:
    """A model of all whole texts. Tokens are maximal runs of anything but blanks and line ends, A-Z taken as a-z, and
    the end of each text; null counts as the empty text. Without texts every word has probability 1 / (V + 1) = 1."""
    small_batches(spark)
    texts = docs.select(c(f"`{text}`").alias("t"))
    size = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-size // SHARD_BYTES))
    folder = f"{shared_folder(spark).rstrip('/')}/ngrams-{uuid.uuid4().hex}"
    pairs, single = Files(shards, [np.uint64, np.uint32]), Files(shards, [np.uint64, np.uint64, np.uint64, np.float64])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, bounds in _blocks(batches, 0):
            g, n = np.unique(_bigrams(_contexts(tokens, bounds), tokens), return_counts=True)
            yield from _sent(g, [n.astype(np.uint32)], shards)

    def of_bigrams(keys: np.ndarray, sums: list[np.ndarray]):
        return [keys, sums[0].astype(np.uint32)], _classes(sums[0]).tolist()

    total = np.zeros(4, np.int64)
    for r in _collected(texts.mapInArrow(count, "shard int, body array<binary>"), shards, [np.uint32], folder, of_bigrams, "n1 long, n2 long, n3 long, n4 long"):
        pairs.paths[r.shard] = (r.path, r.rows)
        total += (r.n1, r.n2, r.n3, r.n4)
    d = _discounts(total)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, bounds in _blocks(batches, 0):
            before = _contexts(tokens, bounds)
            g, first, n = np.unique(_bigrams(before, tokens), return_index=True, return_counts=True)
            all_n = pairs.look_up(g)[0]
            share = n / all_n
            word, place, seen = np.unique(np.append(tokens, START), return_inverse=True, return_counts=True)
            seen = seen.astype(np.uint64)
            seen[place[-1]] = len(bounds) - 1
            h, w = np.searchsorted(word, before[first]), place[first]
            by_count = [np.bincount(h, share * (np.minimum(all_n, 3) == k), len(word)) for k in (1, 2, 3)]
            yield from _sent(word, [seen, *by_count, np.bincount(w, share, len(word))], shards)

    def of_words(keys: np.ndarray, sums: list[np.ndarray]):
        seen, n1, n2, n3, follows = sums[0], *[np.rint(s) for s in sums[1:]]
        real = keys != START
        gamma = np.where(keys == END, 0, (d[0] * n1 + d[1] * n2 + d[2] * n3) / seen)
        return [keys, seen.astype(np.uint64), follows.astype(np.uint64), gamma], [*_classes(follows[real]).tolist(), int(seen[real].sum()), int(real.sum()), int(follows.sum())]

    total = np.zeros(7, np.int64)
    kinds = [np.uint64, np.float64, np.float64, np.float64, np.float64]
    figures = ["n1", "n2", "n3", "n4", "tokens", "vocabulary", "contexts"]
    for r in _collected(texts.mapInArrow(gather, "shard int, body array<binary>"), shards, kinds, folder, of_words, ", ".join(f"{x} long" for x in figures)):
        single.paths[r.shard] = (r.path, r.rows)
        total += [r[x] for x in figures]
    lower = _discounts(total[:4])
    ones, twos, words_, contexts = (int(x) for x in (total[0], total[1], total[5], total[6]))
    left = lower[0] * ones + lower[1] * twos + lower[2] * (words_ - ones - twos)
    return Model(pairs, single, int(total[4]), words_, contexts, d, lower, left / contexts if contexts else 1.0)


def scored(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (default: all) with n_tokens, n_known (long), base_score and score (double).

    base_score: sum over tokens of log10((c + 0.1) / (N + 0.1 (V + 1))) with the counts c, N and V of what was fitted;
    score: log10 probability of the text in the model. Null counts as the empty text, which has one token; every row is
    scored on its own; columns with the added names are replaced; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    added = T.StructType.fromDDL("n_tokens long, n_known long, base_score double, score double")
    names = [k for k in (docs.columns if keep is None else keep) if k.lower() not in added.names]
    schema = T.StructType([docs.schema[k] for k in names] + list(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, tokens, bounds in _blocks(batches, len(names)):
            word, place = np.unique(np.append(tokens, START), return_inverse=True)
            seen, follows, gamma = model.words.look_up(word)
            real = place[:-1]
            before = np.empty(len(tokens), np.int64)
            before[1:] = real[:-1]
            before[bounds[:-1]] = place[-1]
            # as a context START counts texts; as a word it never occurs
            g, at = np.unique(_bigrams(word[before], tokens), return_inverse=True)
            n = model.bigrams.look_up(g)[0]
            n = n.astype(np.float64)
            higher = (n - _discount(n, model.discounts))[at]
            known = seen > 0
            context = np.where(known & (word != END), seen, 1).astype(np.float64)
            lower = 1 / (model.vocabulary + 1) * model.lower_gamma
            if model.contexts:
                lower = lower + (follows - _discount(follows, model.lower)) / model.contexts
            else:
                lower = np.full(len(word), lower)
            weight = np.where(known & (word != END), gamma, 1.0)
            p = np.maximum(higher, 0) / context[before] + weight[before] * lower[real]
            base = np.log10((np.where(word == START, 0, seen) + 0.1) / (model.tokens + 0.1 * (model.vocabulary + 1)))[real]
            start = bounds[:-1]
            results = [np.diff(bounds), np.add.reduceat(known[real].astype(np.int64), start), np.add.reduceat(base, start), np.add.reduceat(np.log10(p), start)]
            t = pa.Table.from_batches(rows).select(list(range(len(names))))
            for name, values in zip(added.names, results):
                t = t.append_column(name, pa.array(values))
            yield from t.rename_columns([*names, *added.names]).combine_chunks().to_batches()

    return docs.select(*[c(f"`{k}`") for k in names], c(f"`{text}`").alias("_text")).mapInArrow(run, schema)
