"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered along a global order.  A Feistel network over the smallest
power of two that holds all numbers, walked until it falls among them again,
permutes the numbers by a seed.  Place p of the shuffle is slot p // shards of
shard p % shards, so shard sizes differ by one row at most, slots have no gaps,
and both directions can be computed for a single row or place without the
others (``Feistel.forward``, ``Feistel.backward``, ``row_at``).

Law ``rows``: sizes and groups of equal texts do not matter, and a further
shard would deal all rows anew, so ``grown_shard`` is NULL.

Cases: a NULL text counts as empty (size 1, CRC 0); a NULL id sorts first and
is dealt as any other; rows that repeat are dealt each for itself, and those
with the same id, size and text hash may change places without a difference; an
empty table gives an empty result; very long texts are only measured; further
columns, whatever their names, are not looked at by the query and are carried
along by ``shuffled``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ship, tables
from tidemark.llm.numbering import numbered

SHARDS, SEED = 16, 20240607
ROUNDS = 8  # even, so that both halves end up with their own width
LOW = 0xFFFFFFFF
STEP = 0x9E3779B9
# The multipliers of the 32-bit finalizer of MurmurHash3.
FIRST, SECOND = 0x85EBCA6B, 0xC2B2AE35


def mixed(x: np.ndarray) -> np.ndarray:
    """32-bit finalizer: a bijection in which every bit depends on all."""
    x = x ^ (x >> np.uint64(16))
    x = (x * np.uint64(FIRST)) & np.uint64(LOW)
    x = x ^ (x >> np.uint64(13))
    x = (x * np.uint64(SECOND)) & np.uint64(LOW)
    return x ^ (x >> np.uint64(16))


class Feistel:
    """A seeded permutation of 0 to ``size`` - 1 and its inverse, on arrays."""

    def __init__(self, size: int, seed: int = SEED):
        self.size = size
        bits = max(2, (size - 1).bit_length())
        self.left, self.right = bits // 2, bits - bits // 2
        self.keys = [int(mixed(np.array([(seed + STEP * (k + 1)) & LOW], dtype=np.uint64))[0]) for k in range(ROUNDS)]

    def _once(self, x: np.ndarray) -> np.ndarray:
        a, b = self.left, self.right
        left, right = x >> np.uint64(b), x & np.uint64((1 << b) - 1)
        for key in self.keys:
            left, right = right, left ^ (mixed(right ^ np.uint64(key)) & np.uint64((1 << a) - 1))
            a, b = b, a
        return (left << np.uint64(b)) | right

    def _back_once(self, x: np.ndarray) -> np.ndarray:
        a, b = self.left, self.right
        left, right = x >> np.uint64(b), x & np.uint64((1 << b) - 1)
        for key in reversed(self.keys):
            a, b = b, a
            left, right = right ^ (mixed(left ^ np.uint64(key)) & np.uint64((1 << a) - 1)), left
        return (left << np.uint64(b)) | right

    def _walk(self, step, x: np.ndarray) -> np.ndarray:
        """Steps until back among the numbers; the domain is less than twice as large, so two on average at most."""
        x = step(np.asarray(x, dtype=np.uint64))
        while (out := x >= self.size).any():
            x[out] = step(x[out])
        return x.astype(np.int64)

    def forward(self, rows: np.ndarray) -> np.ndarray:
        return self._walk(self._once, rows)

    def backward(self, places: np.ndarray) -> np.ndarray:
        return self._walk(self._back_once, places)


def row_at(shard: int, slot: int, size: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The global row number that a slot of a shard holds."""
    place = slot * shards + shard
    if not (0 <= shard < shards and 0 <= place < size):
        raise IndexError(f"no slot {slot} in shard {shard}")
    return int(Feistel(size, seed).backward(np.array([place]))[0])


def _dealt(rows: DataFrame, size: int, shards: int, seed: int) -> DataFrame:
    """Adds ``shard`` and ``slot`` to numbered rows (column ``__row``)."""
    ship(rows.sparkSession)

    def places(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Feistel(size, seed)
        for batch in batches:
            yield pd.Series(own.forward(batch.to_numpy(dtype=np.int64)))

    place = F.pandas_udf(places, "long")(F.col("__row"))
    kept = [c for c in rows.columns if c not in ("__row", "shard", "slot")]
    return rows.select(*kept, place.alias("__place")).select(
        *kept, (F.col("__place") % shards).cast("int").alias("shard"), F.floor(F.col("__place") / shards).cast("long").alias("slot"))


def text_bytes(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def shuffled(df: DataFrame, order: Sequence[Column], keep: Sequence[str | Column] | None = None, shards: int = SHARDS,
             seed: int = SEED) -> DataFrame:
    """``keep`` (all columns) of every row with its ``shard`` and ``slot`` (eager: the numbered rows are stored).

    The result depends on the rows, the order, the number of shards and the
    seed alone.  Columns of the input named shard or slot give way.
    """
    rows, size = numbered(df, order, list(df.columns if keep is None else keep), "__row")
    return _dealt(rows, size, shards, seed)


def document_order(df: DataFrame) -> list[Column]:
    """By id, then by what a text holds: documents equal in all of it can change places."""
    content = text_bytes()
    return [F.col("doc_id").asc_nulls_first(), F.length(content), F.xxhash64(content), F.crc32(content)]


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Whole documents as one folder a shard, each in the sequence of its slots (eager).

    Files of a shard are ranges of slots, so a shard may be larger than a task.
    """
    dealt = shuffled(docs, document_order(docs), None, shards, seed)
    (dealt.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.mode("overwrite").partitionBy("shard").parquet(path))


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document; no text is exchanged."""
    content = text_bytes()
    narrow = docs.select("doc_id", (F.length(content) + 1).cast("long").alias("size"), F.crc32(content).alias("text_crc32"),
                         F.xxhash64(content).alias("content"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("content"), F.col("text_crc32")]
    dealt = shuffled(narrow, order, ["doc_id", "size", "text_crc32"], shards, seed)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, = tables(spark, sf_dir, "documents")
    return assign(docs)
