"""Order statistics that do not need a whole group inside one task.

A plain ``Window.partitionBy(group).orderBy(value)`` sorts a group in a single
task; one hot group then decides the run time of the job.  The helpers here
cut a group along the *value* axis instead, so every window partition has a
bounded size whatever the group sizes are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stored

# A block spans 2**BLOCK_BITS consecutive ordinals, which bounds the distinct
# ordinals (rows, after pre-aggregation) one window partition can hold.
BLOCK_BITS = 22


def running_weights(weights: DataFrame, group: Sequence[str], ordinal: str, weight: str,
                    levels: int = 2) -> DataFrame:
    """Add ``before`` (sum of weights at smaller ordinals) and ``total``.

    ``weights`` must be unique on (group, ordinal) with a BIGINT ordinal.  The
    ordinal axis is cut into fixed blocks: one window inside each block, one
    over the block totals.  All shuffles carry pre-aggregated rows only.

    Two levels keep every window partition below 2**BLOCK_BITS rows while a
    group's ordinals span less than 2**(2 * BLOCK_BITS), some 10**13; three
    levels do so for any BIGINT.
    """
    group = list(group)
    blocked = weights.withColumn("_block", F.shiftright(F.col(ordinal), BLOCK_BITS)).repartition(*group, "_block")
    inside = Window.partitionBy(*group, "_block").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    sums = blocked.groupBy(*group, "_block").agg(F.sum(weight).alias("_weight"))
    if levels > 2:
        sums = sums.withColumnRenamed("_block", "_b")
        totals = running_weights(sums, group, "_b", "_weight", levels - 1).select(
            *group, F.col("_b").alias("_block"), F.col("before").alias("_earlier"), "total")
    else:
        blocks = Window.partitionBy(*group)
        earlier = blocks.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        totals = sums.select(*group, "_block", F.coalesce(F.sum("_weight").over(earlier), F.lit(0)).alias("_earlier"),
                             F.sum("_weight").over(blocks).alias("total"))
    return (blocked.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
            .join(totals, group + ["_block"])
            .withColumn("before", F.col("_inside") + F.col("_earlier"))
            .drop("_block", "_inside", "_earlier"))


def midrank_percentiles(df: DataFrame, group: Sequence[str], measures: dict[str, str | Column],
                        population: DataFrame | None = None, key: Sequence[str] | None = None) -> DataFrame:
    """Mid-rank percentile ``(less + equal / 2) / n`` of BIGINT measures.

    ``measures`` maps an output column to the column or expression ranked
    inside ``group``.  Rows are first reduced to value counts with a map-side
    combine, so equal values cost one row however often they occur; the result
    comes back by an equi-join on (group, value) in which AQE broadcasts the
    counts when they are small and splits hot values when they are not.

    ``population`` is what to count when that is cheaper to read than ``df``
    (the same rows before joins and windows); it defaults to ``df``.

    With ``key``, columns unique in ``df``, only narrow rows (key, measure, value)
    meet the counts, all measures in one join, and one row a key comes back to
    ``df``: its full width is exchanged once instead of once a measure.
    """
    group = list(group)
    names = list(measures)
    columns = [(F.col(m) if isinstance(m, str) else m).cast("bigint") for m in measures.values()]
    stacked = (df if population is None else population).select(
        *group, F.inline(F.array(*[F.struct(F.lit(i).alias("_measure"), c.alias("_value"))
                                   for i, c in enumerate(columns)])))
    counts = (stacked.filter(F.col("_value").isNotNull())
              .groupBy(*group, "_measure", "_value").agg(F.count(F.lit(1)).alias("_n")))
    ranked = running_weights(counts, group + ["_measure"], "_value", "_n").select(
        *group, "_measure", "_value",
        ((F.col("before").cast("double") + F.col("_n").cast("double") / 2) / F.col("total")).alias("_p"))
    if key is not None:
        stacked_keys = list(dict.fromkeys([*key, *group]))
        narrow = (df if population is None else population).select(
            *stacked_keys, F.inline(F.array(*[F.struct(F.lit(i).alias("_measure"), c.alias("_value"))
                                              for i, c in enumerate(columns)])))
        placed = narrow.filter(F.col("_value").isNotNull()).join(ranked, group + ["_measure", "_value"])
        back = placed.groupBy(*key).agg(*[F.max(F.when(F.col("_measure") == i, F.col("_p"))).alias(n) for i, n in enumerate(names)])
        return df.join(back, list(key), "left").select(*df.columns, *names)
    # One column per measure, so that all joins below share the same upstream exchanges.
    wide = ranked.groupBy(*group, "_value").agg(
        *[F.max(F.when(F.col("_measure") == i, F.col("_p"))).alias(n) for i, n in enumerate(names)])
    result = df.select(*df.columns, *[c.alias(f"_v_{n}") for n, c in zip(names, columns)])
    for name in names:
        part = wide.select(*group, F.col("_value").alias(f"_v_{name}"), name)
        result = result.join(part, group + [f"_v_{name}"], "left")
    return result.select(*df.columns, *names)


def position_in_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """Strict 1..n position inside ``group`` along ``order`` (must be total).

    Rows are range-partitioned on (group, order), so a large group spreads over
    many tasks.  Only the group that straddles a partition start needs a carry,
    hence the carry table has at most one row per partition and is safe to
    broadcast.  The range-partitioned rows are stored first: range bounds come
    from a sample, and rows and carries must agree on them after a retry.
    """
    group = list(group)
    keys = [F.col(c).asc() for c in group]
    ranged = stored(
        df.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id()))
    local = ranged.withColumn(
        "_local", F.row_number().over(Window.partitionBy("_slice", *group).orderBy(*order)).cast("bigint"))
    sizes = ranged.groupBy("_slice", *group).agg(F.count(F.lit(1)).alias("_rows"))
    carries = (sizes
               .withColumn("_carry", F.sum("_rows").over(
                   Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)))
               .filter(F.col("_carry").isNotNull())
               .select("_slice", *group, "_carry"))
    return (local.join(F.broadcast(carries), ["_slice"] + group, "left")
            .withColumn(out, F.col("_local") + F.coalesce(F.col("_carry"), F.lit(0)))
            .drop("_slice", "_local", "_carry"))


def trailing_midrank(values: Column, n: int) -> Column:
    """Mid-rank of the last element of ``values`` among its last ``n``; NULL if fewer."""
    recent = F.slice(values, -n, n)
    today = F.element_at(values, -1)
    below = F.size(F.filter(recent, lambda x: x < today))
    equal = F.size(F.filter(recent, lambda x: x == today))
    return F.when(F.size(values) >= n, (below.cast("double") + equal.cast("double") / 2) / F.lit(n))


def salted_left_join(left: DataFrame, right: DataFrame, on: Sequence[str], spread: Sequence[str],
                     salts: int = 16) -> DataFrame:
    """Left join of a large skewed side to a small side unique on ``on``.

    Each left row goes to one of ``salts`` copies of its key, chosen from its
    own ``spread`` columns, so a hot key is shared by ``salts`` tasks.
    """
    on = list(on)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, on + ["_salt"], "left").drop("_salt")
