"""Spelling variants by a dictionary of trie-node pairs.

The prefixes of all words are the nodes of a trie, their suffixes those of a trie of the reversed words. Both are
numbered in one pass over the sorted words: a word shares as many nodes with the word before it as the two share first
letters, and the rest are new. Two words that differ by one replaced letter have the same pair (node in front of the
letter, node behind it); a word with a letter more has, around that letter, the pair that the shorter word has at a
position between two letters. So an equi-join of integers gives the exact neighbours, and no pair of words is ever
compared. All words that meet in a pair are equal but for one letter: such a group is no larger than the alphabet.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlens.llm.shared import small_batches, stored

c = F.col
#: maximal runs of these, in Latin-1 after lower-casing A-Z
RUN = re.compile(rb"[a-z\xc0-\xff]+")
#: distinct words that a task holds before it sends them on, runs of a text that are counted at once
HELD_WORDS = 300_000
HELD_RUNS = 200_000
#: words of a part of the sorted vocabulary
PART_WORDS = 100_000
#: parts have numbers above this many bits, nodes of a part below
PART_BITS = 40


def _altered(run: str, h: int) -> str:
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", noise: int | None = None) -> DataFrame:
    """(word, n): the runs of Latin letters in all texts, A-Z lower-cased, and how often each occurs.

    With `noise` a run loses a code point wherever that number divides h, the crc32 of `<key>:<run>`: the one at
    h % length. This plants misspellings that repeat exactly. Null texts have no words, a null key is written as nothing.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes | str] = Counter()

        def flushed() -> pa.RecordBatch:
            names = [w.decode("latin-1") if isinstance(w, bytes) else w for w in found]
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return out

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                # characters outside of Latin-1 part runs, as the question mark that stands for them does
                rest = (m.group() for m in RUN.finditer((t.as_py() or "").encode("latin-1", "replace").lower()))
                start = zlib.crc32(f"{'' if k is None else k}:".encode())
                while some := Counter(islice(rest, HELD_RUNS)):
                    for w, n in some.items() if noise else ():
                        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                        if h % noise == 0:
                            found[_altered(w.decode("latin-1"), h).encode("latin-1")] += n
                            some[w] = 0
                    found.update({w: n for w, n in some.items() if n})
                    if len(found) >= HELD_WORDS:
                        yield flushed()
        if found:
            yield flushed()

    return docs.select(c(f"`{key}`"), c(f"`{text}`")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _shared(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _numbered(words: DataFrame, parts: int) -> DataFrame:
    """(place, the columns of words, nodes): place numbers the words in code-point order, nodes are the numbers of a
    word's prefixes from the empty one (0) to itself.

    A part of the sorted words numbers its nodes from 1; its first word takes the first numbers, so those of its nodes
    that an earlier part has too are known by being small. One row of each part (its first and last word, the nodes of
    the last) is read by the driver, which carries the shared nodes from part to part.
    """
    names = words.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, stack, used, place = "", [], 0, part << PART_BITS
        for b in batches:
            nodes = []
            for w in b.column("word").to_pylist():
                same = _shared(last, w)
                new = len(w) - same
                stack = stack[:same] + list(range(used + 1, used + new + 1))
                used, last = used + new, w
                nodes.append(stack)
            n = b.num_rows
            first = [pa.array([part] * n, pa.int64()), pa.array(range(place, place + n), pa.int64())]
            yield pa.RecordBatch.from_arrays([*first, *b.columns, pa.array(nodes, pa.list_(pa.int64()))], ["part", "place", *names, "own"])
            place += n

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema)
    own = stored(words.repartitionByRange(parts, "word").sortWithinPartitions("word").mapInArrow(run, f"part long, place long, {kinds}, own array<long>"))
    ends = own.groupBy("part").agg(F.min("word").alias("first"), F.max(F.struct("word", "own")).alias("last")).orderBy("part").collect()
    carried, last, stack = [], "", []
    for r in ends:
        carry = stack[: _shared(last, r["first"])]
        carried.append((r["part"], carry))
        last, stack = r["last"]["word"], [carry[x - 1] if x <= len(carry) else (r["part"] << PART_BITS) + x for x in r["last"]["own"]]
    carries = own.sparkSession.createDataFrame(carried, "part long, carry array<long>")
    whole = F.transform("own", lambda x: F.when(x <= F.size("carry"), F.get("carry", (x - 1).cast("int"))).otherwise(F.shiftleft("part", PART_BITS) + x))
    # a row for each part of PART_WORDS words: no more than nodes that two neighbouring words share
    return own.join(F.broadcast(carries), "part").select("place", *names, F.concat(F.array(F.lit(0).cast("long")), whole).alias("nodes"))


def node_pairs(words: DataFrame) -> DataFrame:
    """(front, back, place, n, whole, lead) of numbered words: whole rows stand between two letters of a word, the
    others around one. Lead marks the first of equal letters in a row: only there does leaving it out count."""
    length = F.size("front") - 1
    around = F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.struct(F.get("front", i).alias("front"), F.get("back", length - i - 1).alias("back"), F.lit(False).alias("whole"), F.get("leads", i).alias("lead")))
    between = F.transform(F.sequence(F.lit(0), length), lambda i: F.struct(F.get("front", i).alias("front"), F.get("back", length - i).alias("back"), F.lit(True).alias("whole"), F.lit(False).alias("lead")))
    return words.select("place", "n", F.explode(F.concat(around, between)).alias("p")).select("p.*", "place", "n")


def _leads(words: DataFrame) -> DataFrame:
    """With `leads`: for each letter of a word, whether the letter in front of it is another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leads = [[i == 0 or w[i - 1] != x for i, x in enumerate(w)] for w in b.column(b.schema.get_field_index("word")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leads, pa.list_(pa.bool_()))], [*b.schema.names, "leads"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema)
    return words.mapInArrow(run, f"{kinds}, leads array<boolean>")


def _near(pairs: DataFrame) -> DataFrame:
    """(place, n_near, best): for words with near words, how many, and the one of largest n, ties by code points."""
    members = F.sort_array(F.collect_list(F.struct((-c("n")).alias("rank"), c("place"), c("whole"), c("lead"))))
    groups = pairs.groupBy("front", "back").agg(members.alias("m")).filter(F.size("m") > 1)

    def linked(x, y):
        one_letter = ~x["whole"] & ~y["whole"] & (x["place"] != y["place"])
        return one_letter | (x["whole"] & y["lead"]) | (y["whole"] & x["lead"])

    met = F.transform("m", lambda x: F.struct(x["place"].alias("place"), F.filter("m", lambda y: linked(x, y)).alias("near")))
    met = groups.select(F.explode(met).alias("g")).select("g.place", F.size("g.near").alias("k"), F.get("g.near", F.lit(0)).alias("best")).filter("k > 0")
    return met.groupBy("place").agg(F.sum("k").alias("n_near"), F.min(F.struct("best.rank", "best.place")).alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(place, root) of (place, form): the last form that is reached, by doubling the way; n at least doubles with each
    step, so there are few rounds."""
    r = stored(forms.select("place", c("form").alias("root")))
    while True:
        ahead = r.select(c("place").alias("root"), c("root").alias("ahead"))
        r = stored(r.join(ahead, "root", "left").select("place", F.coalesce("ahead", "root").alias("root"), c("ahead").isNotNull().alias("moved")))
        if r.filter("moved").isEmpty():
            return r.select("place", "root")
        r = r.select("place", "root")


def variants(words: DataFrame, dominance: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table (word, n) of distinct words.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. A word's form is its near
    word of largest n (ties: first in code-point order) if that n is at least `dominance` (2 or more) times its own, else
    null; the root is where following forms ends. Null and empty words are left out, an empty table gives an empty result.
    """
    if dominance < 2:
        raise ValueError("forms of equal or close counts could lead in a circle")
    words = stored(words.filter("word <> ''").select("word", c("n").cast("long").alias("n")))
    parts = max(8, -(-words.count() // PART_WORDS))
    front = stored(_numbered(words, parts).withColumnRenamed("nodes", "front"))
    back = _numbered(front.select(F.reverse("word").alias("word"), c("place").alias("id")), parts).select(c("id").alias("place"), c("nodes").alias("back"))
    known = front.select("place", "word", "n")
    near = stored(_near(node_pairs(_leads(front).join(back, "place"))))
    best = near.select("place", "n_near", c("best.place").alias("form"), (-c("best.rank")).alias("form_n")).join(known.select("place", "n"), "place")
    formed = best.filter(c("form_n") >= dominance * c("n")).select("place", "form", "form_n")
    named = known.select(c("place").alias("at"), c("word").alias("name"))
    out = known.join(near.select("place", "n_near"), "place", "left").join(formed, "place", "left").join(_roots(formed), "place", "left")
    out = out.join(named.select(c("at").alias("form"), c("name").alias("form_word")), "form", "left").join(named.select(c("at").alias("root"), c("name").alias("root_word")), "root", "left")
    return out.select("word", c("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
