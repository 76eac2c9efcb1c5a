"""Token ids in files by a static range asymmetric numeral system.

All texts are encoded once; one table of frequencies, counted over all ids and scaled to a power of two, is shared by
all files. Documents are put into ascending order of their keys and written in blocks that can be decoded on their own:
the ids of a block are dealt to lanes in turn, every lane has a state, and the lanes write 32-bit words into one stream.
Every CHECKPOINT steps the states and the place in the stream are kept, so a reader begins at any of these places,
and decodes all stretches of a block side by side. Checksums cover the table, each block and its ids. An index table
names the blocks with the number of ids before them.

A file: 8 bytes `airrans1`, then blocks. A block (little-endian): 8 numbers of 64 bits (documents, ids, lanes, steps
between checkpoints, checkpoints, words, crc32 of the ids as 32-bit numbers, crc32 of the table), one byte a document
(1: it has a key), keys and lengths (64 bits a document), places of the checkpoints in the stream, their states (64
bits a lane), the words, crc32 of everything before it. The table: 8 bytes `airtable`, scale bits and symbols (64 bits),
the symbols and their frequencies (32 bits each), crc32.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens.llm.shared import kept_by_worker, small_batches, stored
from airlens.llm.words import hashed_runs, text_buffers

c = F.col
#: ids of a block at least (a document is never divided), lanes at most and ids of a lane at least, steps of a stretch
BLOCK_IDS = 1 << 20
LANES = 1024
LANE_IDS = 64
CHECKPOINT = 256
#: ids of a file, and of the smaller files that make several tasks of a small input
FILE_IDS = 64 << 20
LEAST_FILE_IDS = 4 << 20
#: words whose ids a worker remembers (about 50 bytes each), bytes of texts that are encoded at once
REMEMBERED = 1_800_000
BLOCK_BYTES = 2 << 20
#: bytes of ids in a batch that a reader returns
BATCH_BYTES = 4 << 20
LOW = np.uint64(1 << 32)


# Coding ---------------------------------------------------------------------------------------------------------------


@dataclass
class Table:
    """Symbols in ascending order and their frequencies, which sum to 2 ** bits."""

    bits: int
    symbols: np.ndarray
    freq: np.ndarray

    @staticmethod
    def of(symbols: np.ndarray, counts: np.ndarray) -> Table:
        """Frequencies in proportion to the counts, 1 at least; what rounding leaves goes to the most frequent symbol."""
        symbols, counts = np.asarray(symbols, np.uint32), np.asarray(counts)
        order = np.argsort(symbols)
        symbols, counts = symbols[order], counts[order].astype(object)
        bits = max(12, int(len(symbols)).bit_length() + 4)
        room, total = (1 << bits) - len(symbols), int(sum(counts)) or 1
        freq = np.array([1 + room * int(n) // total for n in counts], np.uint32)
        if len(freq):
            freq[int(np.argmax(freq))] += (1 << bits) - int(freq.sum(dtype=np.int64))
        return Table(bits, symbols, freq)

    def packed(self) -> bytes:
        body = b"airtable" + struct.pack("<2Q", self.bits, len(self.symbols)) + self.symbols.astype("<u4").tobytes() + self.freq.astype("<u4").tobytes()
        return body + struct.pack("<I", zlib.crc32(body))

    @staticmethod
    def unpacked(raw: bytes) -> Table:
        if raw[:8] != b"airtable" or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("the frequency table is damaged")
        bits, n = struct.unpack_from("<2Q", raw, 8)
        return Table(bits, np.frombuffer(raw, "<u4", n, 24), np.frombuffer(raw, "<u4", n, 24 + 4 * n))

    def before(self) -> np.ndarray:
        return (np.cumsum(self.freq, dtype=np.uint64) - self.freq).astype(np.uint64)


class Coder:
    """A table made ready for encoding and decoding."""

    def __init__(self, table: Table):
        self.bits, self.check = np.uint64(table.bits), zlib.crc32(table.packed()[:-4])
        self.symbols, self.freq, self.before = table.symbols, table.freq.astype(np.uint64), table.before()
        self.slots = np.repeat(np.arange(len(self.symbols), dtype=np.uint32), table.freq)
        self.place = np.zeros(int(self.symbols.max()) + 1 if len(self.symbols) else 1, np.uint32)
        self.place[self.symbols] = np.arange(len(self.symbols), dtype=np.uint32)

    def encode(self, ids: np.ndarray, lanes: int, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and states of the checkpoints, and the words."""
        at = self.place[ids]
        freq, before = self.freq[at], self.before[at]
        x, high = np.full(lanes, LOW), np.uint64(64) - self.bits
        steps = -(-len(ids) // lanes)
        written, sizes, states = [], np.zeros(steps + 1, np.uint64), []
        for t in range(steps - 1, -1, -1):
            f = freq[t * lanes : (t + 1) * lanes]
            y = x[: len(f)]
            full = (y >> high) >= f
            written.append(y[full].astype(np.uint32))
            sizes[t + 1] = len(written[-1])
            y = np.where(full, y >> np.uint64(32), y)
            q = y // f
            x[: len(f)] = (q << self.bits) + (y - q * f) + before[t * lanes : (t + 1) * lanes]
            if t % every == 0:
                states.append(x.copy())
        places = np.cumsum(sizes)[:steps:every]
        words = np.concatenate(written[::-1]) if written else np.zeros(0, np.uint32)
        return places, np.array(states[::-1], np.uint64).reshape(-1, lanes), words

    def decode(self, n: int, lanes: int, every: int, places: np.ndarray, states: np.ndarray, words: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids first to last (exclusive) of n, beginning at the checkpoint in front of them; all stretches at once."""
        last = n if last is None else min(last, n)
        if first >= last:
            return np.zeros(0, np.uint32)
        span = lanes * every
        a, b = first // span, -(-last // span)
        x, pos = states[a:b].astype(np.uint64), places[a:b].astype(np.int64)
        out = np.empty((b - a, every, lanes), np.uint32)
        left = n - np.arange(a, b)[:, None] * span - np.arange(lanes)  # ids from this lane's first one to the end
        low = (np.uint64(1) << self.bits) - np.uint64(1)
        for t in range(every):
            slot = x & low
            s = self.slots[slot]
            out[:, t] = s
            y = self.freq[s] * (x >> self.bits) + slot - self.before[s]
            more = y < LOW
            if left[-1, -1] <= t * lanes:  # the last step has fewer ids than lanes
                there = left > t * lanes
                y, more = np.where(there, y, x), more & there
            place = (pos[:, None] + np.cumsum(more, axis=1) - 1)[more]
            y[more] = (y[more] << np.uint64(32)) | words[place]
            pos += more.sum(axis=1)
            x = y
        if b * span >= n and (x[-1] != LOW).any():
            raise ValueError("a block does not end where it began")
        return self.symbols[out.reshape(-1)[first - a * span : last - a * span]]

    def block(self, keys: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
        lanes = max(1, min(LANES, len(ids) // LANE_IDS))
        places, states, words = self.encode(ids, lanes, CHECKPOINT)
        head = struct.pack("<8Q", len(keys), len(ids), lanes, CHECKPOINT, len(places), len(words), zlib.crc32(ids.astype("<u4")), self.check)
        some = np.array([k is not None for k in keys], np.uint8)
        body = head + b"".join(np.ascontiguousarray(a).tobytes() for a in (some, np.array([k or 0 for k in keys], "<i8"), np.array(lengths, "<u8"), places.astype("<u8"), states.astype("<u8"), words.astype("<u4")))
        return body + struct.pack("<I", zlib.crc32(body))

    def unblock(self, raw: bytes, first: int = 0, last: int | None = None) -> tuple[list[int | None], np.ndarray, np.ndarray]:
        """Keys, lengths and the ids first to last of a block; the checksum of the ids is tested if all are asked for."""
        if len(raw) < 68 or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("a block is damaged")
        docs, n, lanes, every, stretches, words, check, table = struct.unpack_from("<8Q", raw)
        if table != self.check:
            raise ValueError("a block was written with another table")
        at = 64
        out = []
        for kind, count in (("u1", docs), ("<i8", docs), ("<u8", docs), ("<u8", stretches), ("<u8", stretches * lanes), ("<u4", words)):
            out.append(np.frombuffer(raw, kind, count, at))
            at += out[-1].nbytes
        some, keys, lengths, places, states, stream = out
        ids = self.decode(n, lanes, every, places, states.reshape(-1, lanes), stream, first, last)
        if first == 0 and len(ids) == n and zlib.crc32(ids.astype("<u4")) != check:
            raise ValueError("the ids of a block are not those that were written")
        return [int(k) if s else None for k, s in zip(keys, some)], lengths.astype(np.int64), ids


# Tokens ---------------------------------------------------------------------------------------------------------------


#: how the tokenizer of words cuts lower-cased ASCII text
ASCII_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")
#: words of printable ASCII and Latin letters, whose lower-casing and cutting follow the same rule; and how bytes are
#: written for the tokenizer's model: printable Latin-1 as it is, the others as the characters from 256 on
LATIN = re.compile("[!-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")
LATIN_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]|[^a-z0-9\u00DF-\u00F6\u00F8-\u00FF]+")
LATIN_LOWER = {x: x + 32 for x in [*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]}
WRITTEN = {b: b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
WRITTEN |= {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in WRITTEN)}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = ~np.isin(np.arange(256), [32, *range(9, 14)])


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each of some stretches, one stretch after the other."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


class Known:
    """Words and their ids in flat arrays, in the order of the words' hashes."""

    def __init__(self, kind: type):
        self.hash = np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)  # bytes of a word
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)  # ids of a word
        self.bytes, self.ids = np.zeros(0, np.uint8), np.zeros(0, kind)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of sorted hashes, and which of them are there."""
        if not len(self.hash):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return at, self.hash[at] == h

    def add(self, h: np.ndarray, words: list[bytes], ids: list[bytes]) -> None:
        size, count = np.array([len(w) for w in words]), np.array([len(i) // self.ids.itemsize for i in ids])
        at, first = np.cumsum(size) - size + len(self.bytes), np.cumsum(count) - count + len(self.ids)
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(words), np.uint8)])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), self.ids.dtype)])
        order = np.argsort(np.concatenate([self.hash, h]), kind="stable")  # two sorted runs
        self.hash, self.at, self.size, self.first, self.count = (np.concatenate(x)[order] for x in ((self.hash, h), (self.at, at), (self.size, size), (self.first, first), (self.count, count)))


class Encoder:
    """Texts -> their ids, each followed by `end`. tokenizer: JSON as the tokenizers library reads it.

    by_words: only for tokenizers that lower-case, drop white space, never join across it and cut ASCII text as
    ASCII_PIECES says. Texts are then cut at ASCII white space, and each distinct word of a block is looked up once, by
    hash and then byte by byte; the ids of REMEMBERED words are kept. Marks of special tokens are told by their case, so
    nothing with `<|` is cut or lower-cased. Else whole texts are encoded.
    """

    def __init__(self, tokenizer: str, end: int, by_words: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.by_words = Tokenizer.from_str(tokenizer), end, by_words
        self.kind = np.uint16 if max(self.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else np.uint32
        self.known = Known(self.kind)
        self.pieces: dict[bytes, bytes] = {}

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """The ids of words from those of their pieces."""
        parts, whole = [], set()
        for w in words:
            if w.isascii() and b"<|" not in w:
                parts.append(ASCII_PIECES.findall(w.lower()))
            elif b"<|" not in w and LATIN.fullmatch(text := w.decode()):
                parts.append([x.encode() for x in LATIN_PIECES.findall(text.translate(LATIN_LOWER))])
            else:  # kept apart from pieces of the same bytes
                parts.append([b" " + w])
                whole.add(b" " + w)
        new = {x for p in parts for x in p if x not in self.pieces} - whole
        shown = [(x, t if (t := x.decode("latin-1")).isascii() and t.isprintable() else t.translate(WRITTEN)) for x in new]
        ids = {x: np.array([y.id for y in self.tokenizer.model.tokenize(t)], self.kind).tobytes() for x, t in shown}
        rest = [x for x in whole if x not in self.pieces]
        for x, e in zip(rest, self.tokenizer.encode_batch_fast([x[1:].decode() for x in rest], add_special_tokens=False)):
            ids[x] = np.array(e.ids, self.kind).tobytes()
        both = {x: self.pieces[x] for p in parts for x in p if x in self.pieces} | ids
        if len(self.pieces) < REMEMBERED // 8:
            self.pieces.update(ids)
        return [b"".join([both[x] for x in p]) if len(p) != 1 else both[p[0]] for p in parts]

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts whose bytes lie between the offsets, and the bounds of each text's ids."""
        n = len(offsets) - 1
        inside = _INSIDE[data]
        edge = np.zeros(len(data) + 1, bool)
        if len(data):
            edge[0], edge[-1] = inside[0], inside[-1]
            np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        at = np.flatnonzero(edge)
        cut = np.unique(offsets[1:-1])  # a border of texts inside a run ends one word and begins the next
        cut = cut[(cut > 0) & (cut < len(data))]
        cut = cut[inside[cut] & inside[cut - 1]]
        if len(cut):
            at = np.sort(np.concatenate([at, cut, cut]))
        start, stop = at[0::2], at[1::2]
        key = data
        if b"<|" not in data.tobytes():
            high = np.concatenate([[0], np.cumsum(data >= 128, dtype=np.int32)])
            odd = high[stop] != high[start]
            key = _LOWER[data]
            if odd.any():  # words with other than ASCII characters stay as they are
                keep = _spread(start[odd], (stop - start)[odd])
                key[keep] = data[keep]
        h, order, inverse = np.unique(hashed_runs(key, start, stop), return_index=True, return_inverse=True)
        begin, size = start[order], (stop - start)[order]
        place, there = self.known.find(h)
        new = np.flatnonzero(~there)
        if len(new):
            words = [key[a : a + k].tobytes() for a, k in zip(begin[new].tolist(), size[new].tolist())]
            if len(self.known.hash) + len(new) > REMEMBERED:
                self.known, new = Known(self.kind), np.arange(len(h))
                words = [key[a : a + k].tobytes() for a, k in zip(begin.tolist(), size.tolist())]
            self.known.add(h[new], words, self.ids_of(words))
            place, _ = self.known.find(h)
        k = self.known
        # equal hashes are no proof: every word is compared with the one its ids were made from
        at, size, first, count = (x[place][inverse] for x in (k.at, k.size, k.first, k.count))
        same = (size == stop - start).all() and (key[inside] == k.bytes[_spread(at, size)]).all()
        if not same:
            raise ValueError("two words have one hash: draw other numbers")
        ids = k.ids[_spread(first, count)]
        bounds = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(start, offsets, "left")]
        # the end id goes behind every text
        out = np.empty(len(ids) + n, self.kind)
        ends = bounds + np.arange(n + 1)
        out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(bounds))] = ids
        out[ends[1:] - 1] = self.end
        return out, ends

    def blocks(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, bounds) of blocks of about BLOCK_BYTES or one text."""
        if not self.by_words:
            for i, x in enumerate(column.to_pylist()):
                ids = self.tokenizer.encode(x or "", add_special_tokens=False).ids
                yield i, i + 1, np.array([*ids, self.end], self.kind), np.array([0, len(ids) + 1])
            return
        data, offsets = text_buffers(column)
        row = 0
        while row < len(column):
            end = min(max(int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, "right")) - 1, row + 1), len(column))
            lo, hi = int(offsets[row]), int(offsets[end])
            yield row, end, *self.block(data[lo:hi], offsets[row : end + 1] - lo)
            row = end

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [ids[a:b] for _, _, ids, bounds in self.blocks(pa.array(texts, pa.string())) for a, b in zip(bounds[:-1], bounds[1:])]


def tokens(docs: DataFrame, tokenizer: str, end: int, key: str = "doc_id", text: str = "text", by_words: bool = False) -> DataFrame:
    """(key, row, n, width, ids) of all rows: ids as bytes of `width` each. row tells rows of one key apart."""
    small_batches(docs.sparkSession)
    name = f"encoder_{zlib.crc32(tokenizer.encode())}_{end}_{by_words}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept_by_worker(name, lambda: Encoder(tokenizer, end, by_words))
        gc.disable()  # many small objects and no cycle among them
        for b in batches:
            for lo, hi, ids, bounds in encode.blocks(b.column(2)):
                raw = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((bounds * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])
                width = pa.array(np.full(hi - lo, ids.itemsize, np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(np.diff(bounds)), width, raw], ["key", "row", "n", "width", "ids"])
        gc.enable()

    rows = docs.select(c(f"`{key}`").cast("long").alias("key"), F.monotonically_increasing_id().alias("row"), c(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "key long, row long, n long, width int, ids binary")


def _counts(encoded: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            # all ids of a batch lie one after the other; their width is the vocabulary's
            raw, width = b.column(1), b.column(0)[0].as_py() if b.num_rows else 4
            ends = np.frombuffer(raw.buffers()[1], np.int32, raw.offset + len(raw) + 1)[raw.offset :] if len(raw) else [0, 0]
            found = np.bincount(np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint16 if width == 2 else np.uint32)) if ends[-1] > ends[0] else total[:0]
            size = max(len(found), len(total))
            total = np.pad(found, (0, size - len(found))) + np.pad(total, (0, size - len(total)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["id", "n"])

    return encoded.select("width", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


#: the index: a row for each block
INDEX = "file string, part long, block long, offset long, length long, documents long, ids long, start long"
_COLUMNS = [x.split()[0] for x in INDEX.split(", ")]

# Files ----------------------------------------------------------------------------------------------------------------


def _filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def _load(folder: str) -> Coder:
    fs, base = _filesystem(folder)
    with fs.open_input_stream(f"{base}/table") as f:
        return Coder(Table.unpacked(f.read()))


def write(docs: DataFrame, folder: str, tokenizer: str, end: int, key: str = "doc_id", text: str = "text", by_words: bool = False) -> None:
    """Writes the ids of all texts, each followed by `end`, into a new folder: `table`, `index` and the files.

    Documents are in ascending order of their integer key, null first; rows of one key are in any fixed order. A null
    text is an empty one. The table has at most one entry for each id of the vocabulary; the driver sees it and one row
    a file. Files of tasks that were lost are never named by the index.
    """
    encoded = stored(tokens(docs, tokenizer, end, key, text, by_words))
    counts = _counts(encoded).toPandas()
    table = Table.of(counts["id"].to_numpy(np.uint32), counts["n"].to_numpy())
    fs, base = _filesystem(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/table") as f:
        f.write(table.packed())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, (fs, base) = _load(folder), _filesystem(folder)
        name, part = f"ids-{uuid.uuid4().hex}", TaskContext.get().partitionId()
        out, held, rows = None, [], []
        at, start, waiting = 8, 0, 0

        def close() -> None:
            nonlocal at, start, waiting
            ids = np.concatenate([h[1] for h in held])
            raw = coder.block([h[0] for h in held], [len(h[1]) for h in held], ids)
            out.write(raw)
            rows.append((name, part, len(rows), at, len(raw), len(held), len(ids), start))
            at, start, waiting = at + len(raw), start + len(ids), 0
            held.clear()

        for b in batches:
            for k, width, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if out is None:
                    out = fs.open_output_stream(f"{base}/{name}")
                    out.write(b"airrans1")
                held.append((k, np.frombuffer(raw.as_py(), np.uint16 if width == 2 else np.uint32)))
                waiting += len(held[-1][1])
                if waiting >= BLOCK_IDS:
                    close()
        if held:
            close()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], _COLUMNS)

    total = int(counts["n"].sum())
    files = max(-(-total // FILE_IDS), min(int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // LEAST_FILE_IDS)), 1)
    ordered = encoded.repartitionByRange(files, "key", "row").sortWithinPartitions("key", "row")
    blocks = stored(ordered.select("key", "width", "ids").mapInArrow(run, INDEX))
    before, sums = 0, []
    for r in blocks.groupBy("part").agg(F.sum("ids").alias("ids")).orderBy("part").collect():  # a row for each file
        sums.append((r["part"], before))
        before += r["ids"]
    bases = docs.sparkSession.createDataFrame(sums, "part long, before long")
    blocks.join(F.broadcast(bases), "part").withColumn("start", c("start") + c("before")).select(*_COLUMNS).coalesce(1 + len(sums) // 1000).write.parquet(f"{folder}/index")


def read(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids) of every document from the files: start counts the ids of all documents before it,
    ids are 32-bit little-endian numbers. Blocks are dealt to tasks and decoded on their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, (fs, base) = _load(folder), _filesystem(folder)
        for b in batches:
            for file, offset, length, start in zip(*[b.column(k).to_pylist() for k in range(4)]):
                with fs.open_input_file(f"{base}/{file}") as f:
                    keys, lengths, ids = coder.unblock(f.read_at(length, offset))
                ends = np.concatenate([[0], np.cumsum(lengths)])
                raw = ids.astype("<u4").tobytes()
                lo = 0
                while lo < len(keys):
                    hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + BATCH_BYTES // 4, "right")) - 1)
                    body = [raw[4 * p : 4 * q] for p, q in zip(ends[lo:hi], ends[lo + 1 : hi + 1])]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[lo:hi], pa.int64()), pa.array(start + ends[lo:hi], pa.int64()), pa.array(lengths[lo:hi], pa.int64()), pa.array(body, pa.binary())], [key, "start", "n_tokens", "ids"])
                    lo = hi

    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), index.count() // 16)
    dealt = index.repartition(tasks, "file", "block").select("file", "offset", "length", "start")
    return dealt.mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids binary")


def sample(folder: str, file: str, offset: int, length: int, first: int, last: int) -> np.ndarray:
    """The ids first to last of one block, decoded from the checkpoint in front of them."""
    fs, base = _filesystem(folder)
    with fs.open_input_file(f"{base}/{file}") as f:
        return _load(folder).unblock(f.read_at(length, offset), first, last)[2]
