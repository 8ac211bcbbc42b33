"""Benchmark decontamination with suffix arrays of the training text.

The documents of a task are taken in shards of a bounded number of words.  A
shard's words become one sequence of numbers, cut between documents; its
suffix array, over the places where a match can begin, is searched for every
suffix of every benchmark item by bisection.
The range of equal suffixes gives all places of a match, and comparing onward
from there gives its full length.  No rows are moved: each shard answers for
its own documents.

The benchmark reaches the tasks in blocks of a bounded number of words
(``BLOCK_WORDS``), each its own broadcast and searched in turn, so memory does
not depend on the benchmark's size; it grows only in passes over the shards.

A match is a run of ``window`` words of an item found in a document, or a
whole item that is shorter than that.

Cases: a NULL or word-less document has no words and no hits; an item without
words is skipped, one with a NULL id counts like others but has no name; equal items are reported each under its own id;
repeated rows give equal rows; empty tables give empty or hit-free results.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ship, tables

WINDOW = 10
BLOCK_WORDS = 2_000_000  # benchmark words in one broadcast
SHARD_WORDS = 400_000  # document words in one suffix array
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of lower-cased UTF-8


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: ASCII letters lowered, digits and everything beyond ASCII."""
    return _WORD.findall(text.encode("utf-8").lower()) if text else []


class Block:
    """Some benchmark items: a word numbering and the suffixes to search."""

    def __init__(self, items: Sequence[tuple[int, list[bytes]]], window: int):
        self.ids = [item for item, _ in items]
        self.numbers: dict[bytes, int] = {}
        number = self.numbers.setdefault
        flat, starts, need, owner = [], [], [], []
        for k, (_, words) in enumerate(items):
            reach = min(window, len(words))
            for i in range(len(words) - reach + 1 if words else 0):
                starts.append(len(flat) + i)
                need.append(reach)
                owner.append(k)
            flat += [number(w, len(self.numbers) + 1) for w in words]
            flat.append(0)
        self.flat = np.array(flat + [0] * window, dtype=np.int64)
        self.starts, self.need, self.owner = (np.array(x, dtype=np.int64) for x in (starts, need, owner))


def suffix_order(seq: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in the order of the suffixes of ``seq`` beginning there, by their first ``depth`` numbers.

    ``seq`` ends in at least ``depth`` zeros.
    """
    return starts[np.lexsort([seq[starts + i] for i in range(depth - 1, -1, -1)])]


def openings(seq: np.ndarray, block: Block) -> np.ndarray:
    """The places of ``seq`` where a run of the block can begin: the suffixes worth sorting.

    All pairs of neighbours within a run are pairs of some item, so a place
    needs as many such pairs in a row as the shortest run has.
    """
    base = len(block.numbers) + 1
    pairs = np.unique(block.flat[:-1] * base + block.flat[1:])
    mine = seq[:-1] * base + seq[1:]
    good = (pairs[np.minimum(np.searchsorted(pairs, mine), len(pairs) - 1)] == mine) & (seq[:-1] > 0) & (seq[1:] > 0)
    least = int(block.need.min())
    if least == 1:
        return np.flatnonzero(good | np.isin(seq[:-1], block.flat[block.starts[block.need == 1]]))
    ends = np.concatenate([np.flatnonzero(~good), [len(good)]])  # good from a place to the next end
    places = np.flatnonzero(good)
    return places[ends[np.searchsorted(ends, places)] - places >= least - 1]


def bisect(seq: np.ndarray, order: np.ndarray, block: Block, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one place in ``order`` of the suffixes that begin with each of the block's runs."""
    runs = np.stack([block.flat[np.minimum(block.starts + i, len(block.flat) - 1)] for i in range(window)], axis=1)
    runs[np.arange(window)[None, :] >= block.need[:, None]] = -1  # beyond the needed words everything is equal
    sides = []
    for right in (False, True):
        low, high = np.zeros(len(runs), dtype=np.int64), np.full(len(runs), len(order), dtype=np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) // 2
            at = order[mid]
            sign = np.zeros(len(open_), dtype=np.int64)
            for i in range(window):
                want = runs[open_, i]
                sign = np.where((sign == 0) & (want >= 0), np.sign(seq[at + i] - want), sign)
            up = sign <= 0 if right else sign < 0
            low[open_[up]] = mid[up] + 1
            high[open_[~up]] = mid[~up]
        sides.append(low)
    return sides[0], sides[1]


def search(shard: Sequence[list[bytes]], block: Block, window: int) -> Iterator[tuple[int, int, int, int]]:
    """(document number, word position, length, item number) of every occurrence of a run of the block."""
    if not len(block.starts):
        return
    parts, offsets, at = [], [], 0
    for words in shard:
        parts.append(np.array(list(map(block.numbers.get, words, repeat(0))) + [0], dtype=np.int64))
        offsets.append(at)
        at += len(words) + 1
    seq = np.concatenate([*parts, np.zeros(window, dtype=np.int64)])
    starts = openings(seq, block)
    if not len(starts):
        return
    order = suffix_order(seq, starts, window)
    low, high = bisect(seq, order, block, window)
    begins = np.array(offsets)
    for run in np.flatnonzero(high > low):
        places = order[low[run]:high[run]]
        documents = np.searchsorted(begins, places, side="right") - 1
        for place, document in zip(places.tolist(), documents.tolist()):
            yield document, place - offsets[document], int(block.need[run]), int(block.owner[run])


def longest(found: Sequence[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(item, position, length) runs of one document joined to longest verbatim matches.

    Runs of one item that begin one word after another are one longer match.
    """
    out: list[list[int]] = []
    for item, start, length in sorted(found):
        if out and out[-1][0] == item and start <= out[-1][1] + out[-1][2] - length + 1:
            out[-1][2] = max(out[-1][2], start + length - out[-1][1])
        else:
            out.append([item, start, length])
    return [tuple(x) for x in out]


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list:
    """Broadcasts of the benchmark in blocks of about ``block_words`` words (eager: one count, one read a block).

    The items are dealt to blocks by a hash of their id and text; a block is the
    largest thing the driver holds.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").alias("item_id"), F.col("text").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    count = max(1, -(-size // (block_words * 6)))
    blocks = []
    for k in range(count):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text", F.lit(31)), F.lit(count)) == k) if count > 1 else items
        block = Block([(item, words_of(text)) for item, text in mine.distinct().collect()], window)
        blocks.append(spark.sparkContext.broadcast(pickle.dumps(block)))
    return blocks


def finder(spark: SparkSession, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS,
           shard_words: int = SHARD_WORDS):
    """Column function: text to its words, hits and matches with the benchmark."""
    ship(spark)
    blocks = benchmark_blocks(benchmark, window, block_words)

    def answer(shard: list[list[bytes]], parts: list[Block]) -> list[dict]:
        hits = [np.zeros(len(words), dtype=bool) for words in shard]
        found: list[dict[int, list]] = [{} for _ in shard]
        for block in parts:
            for document, start, length, owner in search(shard, block, window):
                hits[document][start:start + length] = True
                found[document].setdefault(block.ids[owner], []).append((start, length))
        out = []
        for words, hit, matched in zip(shard, hits, found):
            n_items = len(matched)
            nameless = [(None, start, length) for _, start, length in longest([(0, *place) for place in matched.pop(None, [])])]
            runs = nameless + longest([(item, start, length) for item, places in matched.items() for start, length in places])
            names = sorted(str(item) for item in matched)
            out.append({"n_words": len(words), "n_hit": int(hit.sum()), "n_items": n_items,
                        "items_sha256": hashlib.sha256(",".join(names).encode()).hexdigest(),
                        "matches": [{"item_id": i, "start": s, "length": n} for i, s, n in runs]})
        return out

    @F.pandas_udf("n_words long, n_hit long, n_items long, items_sha256 string, "
                  "matches array<struct<item_id: bigint, start: bigint, length: bigint>>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parts = [pickle.loads(b.value) for b in blocks]
        for batch in texts:
            out, shard, size = [], [], 0
            for text in batch:
                words = words_of(text)
                shard.append(words)
                size += len(words)
                if size >= shard_words:
                    out += answer(shard, parts)
                    shard, size = [], 0
            out += answer(shard, parts)
            yield pd.DataFrame(out, columns=["n_words", "n_hit", "n_items", "items_sha256", "matches"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, **sizes: int) -> DataFrame:
    """Per document: counts, the items found and every longest match (item_id, start word, length in words)."""
    found = finder(docs.sparkSession, benchmark, **sizes)
    made = docs.select("doc_id", found(F.col("text")).alias("made"))
    return made.select("doc_id", "made.*").withColumn("contaminated", F.col("n_hit") > 0)


def clean_documents(docs: DataFrame, benchmark: DataFrame, **sizes: int) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no run of a benchmark item."""
    found = finder(docs.sparkSession, benchmark, **sizes)
    return docs.filter(found(F.col("text"))["n_hit"] == 0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = tables(spark, sf_dir, "documents", "benchmark")
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
