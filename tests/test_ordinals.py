"""Order helpers against brute force, with one group holding most rows."""

import random

from pyspark.sql import functions as F

from tidemark.functions import ordinals
from tidemark.functions.digests import set_digest, typed_line


def skewed(spark, n=4000):
    rng = random.Random(7)
    data = []
    for i in range(n):
        group = "hot" if rng.random() < 0.6 else rng.choice("abc")
        value = 0 if rng.random() < 0.3 else rng.choice([rng.randint(-9, 9), rng.randint(-10**12, 10**12)])
        data.append((i, group, value))
    return data, spark.createDataFrame(data, "id bigint, g string, v bigint").repartition(5)


def test_percentiles_match_brute_force(spark, monkeypatch):
    data, df = skewed(spark)
    by_group = {}
    for _, g, v in data:
        by_group.setdefault(g, []).append(v)
    for bits in (2, 22):  # many blocks and few
        monkeypatch.setattr(ordinals, "BLOCK_BITS", bits)
        made = ordinals.midrank_percentiles(df, ["g"], {"p": "v", "q": -F.col("v")}).collect()
        assert len(made) == len(data)
        for r in made:
            values = by_group[r.g]
            less, equal = sum(x < r.v for x in values), values.count(r.v)
            assert r.p == (less + equal / 2) / len(values)
            assert abs(r.q - (1 - r.p)) < 1e-12


def test_positions_match_a_sort(spark):
    data, df = skewed(spark)
    made = ordinals.position_in_group(df, ["g"], [F.desc("v"), F.asc("id")], "pos").collect()
    wanted = {}
    for g in {g for _, g, _ in data}:
        for n, row in enumerate(sorted((r for r in data if r[1] == g), key=lambda r: (-r[2], r[0])), start=1):
            wanted[row[0]] = n
    assert {r.id: r.pos for r in made} == wanted


def test_running_weights(spark):
    data, df = skewed(spark)
    weights = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    for levels in (2, 3):
        for r in ordinals.running_weights(weights, ["g"], "v", "n", levels).collect():
            values = [v for _, g, v in data if g == r.g]
            assert (r.before, r.total) == (sum(x < r.v for x in values), len(values))


def test_salted_join_is_a_left_join(spark):
    _, df = skewed(spark)
    small = spark.createDataFrame([("hot", 1), ("a", 2)], "g string, w int")
    made = ordinals.salted_left_join(df, small, ["g"], ["id"], 4)
    assert sorted(made.select("id", "w").collect()) == sorted(df.join(small, "g", "left").select("id", "w").collect())


def test_set_digest_ignores_order_and_counts_copies(spark):
    _, df = skewed(spark)
    line = typed_line(["id", "v"])
    one = set_digest(df, ["g"], line).collect()
    two = set_digest(df.orderBy(F.desc("id")).repartition(3), ["g"], line).collect()
    more = set_digest(df.union(df.limit(1)), ["g"], line).collect()
    assert sorted(one) == sorted(two) and sorted(one) != sorted(more)


def test_percentiles_come_back_by_key_in_one_join(spark):
    rows = [(i, i % 3, None if i % 7 == 0 else i % 5, i * i % 11) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, g int, a bigint, b bigint")
    measures = {"pa": "a", "pb": "b"}
    want = sorted(map(tuple, ordinals.midrank_percentiles(df, ["g"], measures).collect()))
    made = ordinals.midrank_percentiles(df, ["g"], measures, key=["id"])
    assert made.columns == ["id", "g", "a", "b", "pa", "pb"]
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(want, key=repr)
