"""Sharding: the permutation, its inverse, and the documents dealt by it."""

import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import sharding
from tidemark.llm.numbering import numbered
from pyspark.sql import functions as F


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 7, 16, 17, 100, 1000, 4097])
def test_permutation_and_inverse(size):
    own = sharding.Feistel(size, 5)
    places = own.forward(np.arange(size))
    assert sorted(places) == list(range(size))
    assert (own.backward(places) == np.arange(size)).all()


def test_large_domains_and_seeds():
    own = sharding.Feistel(10**13, 5)
    rows = np.random.default_rng(1).integers(0, 10**13, 5000)
    assert (own.backward(own.forward(rows)) == rows).all()
    a, b = (sharding.Feistel(1000, s).forward(np.arange(1000)) for s in (1, 2))
    assert (a != b).sum() > 900
    # Neighbours are torn apart: every residue follows every other about equally often.
    pairs = Counter(zip(*(np.stack([a[:-1], a[1:]]) % 4)))
    assert len(pairs) == 16 and max(pairs.values()) < 110


def test_row_at_finds_every_row():
    size, shards = 37, 5
    places = sharding.Feistel(size, 9).forward(np.arange(size))
    for row, place in enumerate(places):
        assert sharding.row_at(int(place) % shards, int(place) // shards, size, shards, 9) == row
    with pytest.raises(IndexError):
        sharding.row_at(4, 7, size, shards, 9)


def brute(rows, shards, seed):
    def key(r):
        data = (r[1] or "").encode()
        return (r[0] is not None, r[0] or 0, len(data))

    out = []
    places = sharding.Feistel(len(rows), seed).forward(np.arange(len(rows)))
    for (i, text), place in zip(sorted(rows, key=key), places):
        data = (text or "").encode()
        out.append((i, len(data) + 1, zlib.crc32(data), "rows", int(place) % shards, int(place) // shards, None))
    return sorted(out, key=repr)


def test_documents_equal_brute_force(spark, docs_of):
    rows = [(i, "x" * (i % 9)) for i in range(300)] + [(None, "née"), (None, None), (5, None), (7, "same"), (7, "same"), (8, "long " * 50000)]
    got = sharding.assign(docs_of(rows, clashing=True), 7, 3)
    columns = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert got.columns == columns
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 7, 3)
    again = sharding.assign(docs_of(rows[::-1]).repartition(5), 7, 3)
    assert sorted(map(tuple, again.collect()), key=repr) == brute(rows, 7, 3)
    for sizes in ([r["n"] for r in got.groupBy("shard").agg(F.count("*").alias("n")).collect()],):
        assert max(sizes) - min(sizes) <= 1
    assert sharding.assign(docs_of([])).count() == 0


def test_one_key_does_not_make_one_range(spark):
    df = spark.range(40000).select(F.when(F.col("id") % 3 == 0, F.lit(None).cast("long")).otherwise(F.col("id")).alias("k"), F.lit("t").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows, size = numbered(df, [F.col("k").asc_nulls_first()], ["k", "v"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert size == 40000
    assert sorted(r["row"] for r in rows.collect()) == list(range(40000))
    nulls = rows.filter("k IS NULL").agg(F.max("row").alias("m"), F.count("*").alias("n")).first()
    assert nulls["m"] == nulls["n"] - 1


def test_written_shards_keep_slots_and_columns(spark, docs_of, tmp_path):
    docs = docs_of([(i, f"text {i}") for i in range(50)], clashing=True).withColumn("slot", F.lit("theirs"))
    sharding.write_shards(docs, str(tmp_path / "out"), 4, 1)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(docs.columns) | {"shard"} == set(back.columns)
    want = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.assign(docs, 4, 1).collect()}
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in back.collect()} == want
    one = spark.read.parquet(str(tmp_path / "out" / "shard=2")).collect()
    assert [r["slot"] for r in one] == list(range(len(one)))
