"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stored


def _between(edges: DataFrame) -> DataFrame:
    """Distinct edges between different nodes, the larger first."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mapped(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges between the roots of their ends; an end without a root stands for itself."""
    first = roots.select(F.col("node").alias("a"), F.col("label").alias("root_a"))
    second = roots.select(F.col("node").alias("b"), F.col("label").alias("root_b"))
    return edges.join(first, "a", "left").join(second, "b", "left").select(
        F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): the smallest node of its component.

    ``labels`` holds components known before, which the edges may join further.
    Each round points every node at its smallest neighbour, follows the pointers
    to their roots, and goes on with the edges between different roots, which
    are soon few.  Rounds are stored in the shared folder; nothing but "is one
    left" comes to the driver.  Minima are combined before they are shuffled,
    and a node with very many edges is split by the skew join.
    """
    left = stored(_between(edges if labels is None else _mapped(edges, labels)))
    spark = edges.sparkSession
    labels = spark.createDataFrame([], "node long, label long") if labels is None else labels
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        roots = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select(
            "node", F.least("node", "least").alias("label")))
        while True:
            ahead = roots.select(F.col("node").alias("at"), F.col("label").alias("next"))
            after = stored(roots.join(ahead, roots["label"] == ahead["at"]).select("node", F.col("label").alias("before"), F.col("next").alias("label")))
            roots = after.select("node", "label")
            if after.filter("label <> before").isEmpty():
                break
        onward = roots.select(F.col("node").alias("at"), F.col("label").alias("next"))
        old = labels.join(onward, labels["label"] == onward["at"], "left").select("node", F.coalesce("next", "label").alias("label"))
        labels = stored(old.union(roots.join(labels.select("node"), "node", "left_anti")))
        left = stored(_between(_mapped(left, roots)))
    return labels
