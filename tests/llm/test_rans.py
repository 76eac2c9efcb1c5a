"""Range-coded ids: a plain decoder, round trips, damage, and the ids of whole texts."""

import random
import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from airlens.llm import queries, rans

MASK = (1 << 64) - 1


def plain_decode(raw, table):
    """Lane after lane of a block, one id at a time, with Python's numbers."""
    docs, n, lanes, every, stretches, words, _, _ = struct.unpack_from("<8Q", raw)
    at = 64 + 17 * docs + 8 * stretches
    x = list(struct.unpack_from(f"<{lanes}Q", raw, at))
    stream = struct.unpack_from(f"<{words}I", raw, at + 8 * stretches * lanes)
    ends, total = [], 0
    for f in table.freq:
        total += int(f)
        ends.append(total)
    out, pos = [], 0
    for i in range(n):
        lane = i % lanes
        slot = x[lane] % (1 << table.bits)
        s = next(k for k, e in enumerate(ends) if slot < e)
        out.append(int(table.symbols[s]))
        f = int(table.freq[s])
        x[lane] = f * (x[lane] >> table.bits) + slot - (ends[s] - f)
        if x[lane] < 1 << 32:
            x[lane] = x[lane] << 32 | stream[pos]
            pos += 1
        assert x[lane] <= MASK
    assert pos == words and all(y == 1 << 32 for y in x)
    return out


@pytest.mark.parametrize("n, symbols", [(1, 1), (5000, 1), (777, 3), (4099, 300), (64, 64)])
def test_blocks(monkeypatch, n, symbols):
    monkeypatch.setattr(rans, "LANES", 16)
    monkeypatch.setattr(rans, "CHECKPOINT", 5)
    r = np.random.default_rng(n)
    ids = (r.zipf(1.3, n) % symbols * 7).astype(np.uint32)
    found, counts = np.unique(ids, return_counts=True)
    table = rans.Table.of(found[::-1], counts[::-1])
    assert table.freq.sum() == 1 << table.bits and table.freq.min() > 0
    again = rans.Table.unpacked(table.packed())
    coder = rans.Coder(again)
    raw = coder.block([3, None], [1, n - 1], ids)
    keys, lengths, got = coder.unblock(raw)
    assert keys == [3, None] and lengths.tolist() == [1, n - 1] and (got == ids).all()
    assert plain_decode(raw, table) == ids.tolist()
    for _ in range(20):
        a, b = sorted(r.integers(0, n + 1, 2))
        assert (coder.unblock(raw, a, b)[2] == ids[a:b]).all()
    for at in r.integers(0, len(raw), 20):
        with pytest.raises(ValueError):
            coder.unblock(raw[:at] + bytes([raw[at] ^ 4]) + raw[at + 1 :])
    with pytest.raises(ValueError):
        rans.Table.unpacked(table.packed()[:-1] + b"\0")
    with pytest.raises(ValueError, match="another table"):
        rans.Coder(rans.Table.of(np.arange(9), np.arange(9) + 1)).unblock(raw)


def test_size():
    """Close to the entropy."""
    r = np.random.default_rng(0)
    ids = np.minimum(r.zipf(1.2, 1 << 20), 40_000).astype(np.uint32)
    found, counts = np.unique(ids, return_counts=True)
    entropy = float((counts * -np.log2(counts / len(ids))).sum()) / 8
    assert len(rans.Coder(rans.Table.of(found, counts)).block([1], [len(ids)], ids)) < 1.06 * entropy


TEXTS = ["", None, " ", "Hello hello HELLO", "don't DON'T we'll\tx y z\x1ca\x85b\x0bc", "ΣΑΣ Σ İİ J̌ ǰ Á ́a", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b <|End", "12 345 a1b2 _x_ ...!?", "日本語 텍스트 각 각", "é" * 30, "x" * 5000, "a  b\n\n\nc\r\nd", "\U0001f600 naïve Straße ẞ ﬁ", "'S 's it'S"]


def whole(texts):
    t = Tokenizer.from_str(queries.tokenizer_json())
    return [e.ids + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_pieces_encode_as_whole_texts():
    r = random.Random(0)
    some = [x for x in TEXTS if x]
    texts = ["".join(r.choice(some)[:20] + r.choice(["", " ", "\n"]) for _ in range(8)) for _ in range(300)] + TEXTS
    for by_words in (True, False):
        encode = rans.Encoder(queries.tokenizer_json(), 1, by_words)
        for some in (texts[:100], texts):
            assert [x.tolist() for x in encode([x or "" for x in some])] == whole(some)


def test_files(spark, monkeypatch, tmp_path):
    for name, value in {"BLOCK_IDS": 500, "LANES": 8, "CHECKPOINT": 4, "LEAST_FILE_IDS": 3000, "BATCH_BYTES": 400, "REMEMBERED": 40, "BLOCK_BYTES": 700}.items():
        monkeypatch.setattr(rans, name, value)
    r = random.Random(4)
    rows = [(k, r.choice(TEXTS[3:]) * r.randint(1, 3)) for k in random.Random(1).sample(range(-200, 1000), 300)] + [(None, "a b"), (None, None), (5, ""), (5, "w " * 4000), (5, "x")]
    df = spark.createDataFrame([(k, t, "n") for k, t in rows], "doc_id long, text string, start string")
    folder = f"{tmp_path}/ids"
    rans.write(df, folder, queries.tokenizer_json(), 1, by_words=True)
    got = sorted(rans.read(spark, folder).collect(), key=lambda x: x.start)
    assert [x.doc_id is None for x in got[:3]] == [True, True, False] and [x.doc_id for x in got[2:]] == sorted(k for k, _ in rows if k is not None)
    start = 0
    for x in got:
        assert x.start == start and len(x.ids) == 4 * x.n_tokens
        start += x.n_tokens
    ids = dict(zip(rows, whole([t for _, t in rows])))
    assert sorted((x.doc_id is None, x.doc_id or 0, np.frombuffer(x.ids, "<u4").tolist()) for x in got) == sorted((k is None, k or 0, v) for (k, _), v in ids.items())
    index = spark.read.parquet(f"{folder}/index").collect()
    assert len({x.file for x in index}) > 2 and len(index) > 10
    flat = np.concatenate([np.frombuffer(x.ids, "<u4") for x in got])
    for x in r.sample(index, 6):
        a, b = sorted(r.choices(range(x.ids + 1), k=2))
        assert (rans.sample(folder, x.file, x.offset, x.length, a, b) == flat[x.start + a : x.start + b]).all()
    rans.write(df.limit(0), f"{tmp_path}/none", queries.tokenizer_json(), 1)
    assert rans.read(spark, f"{tmp_path}/none").collect() == []


def test_query(spark, sf):
    rows = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    want, start = [], 0
    for (k, _), ids in zip(rows, whole([t for _, t in rows])):
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(x) for x in queries.QUERIES["op13_rans_ids"](spark, sf).collect()) == want
