"""Membership on storage: changes by date, and snapshots so that a read folds few of them.

    <root>/changes/effective_date=...            events, as scans find them
    <root>/snapshots/snapshot_date=...           members as of a date

A read takes the last snapshot up to its date and the changes since.  Both are
found by folder name, so a read costs one snapshot and the changes of at most
one interval, however long the history is.  A snapshot is made from the one
before it the same way.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.membership import members_from_snapshot
from tidemark.schemas import RELATION
from tidemark.session import stored
from tidemark.sources.folders import Folder
from tidemark.sources.tables import replace_partitions

EVENTS = "effective_date date, change_type string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RELATION) + ", run_id string"
MEMBERS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RELATION) + ", effective_date date"


class Memberships:
    """Board membership over time under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, Folder(spark, root)

    def _days(self, table: str, column: str) -> list[str]:
        """Dates of a table's folders: a name a date."""
        return [n.split("=", 1)[1] for n in self.folder.names(table) if n.startswith(f"{column}=")]

    def save_baseline(self, baseline: DataFrame) -> None:
        """Full listings become snapshots of their dates (eager)."""
        self._save_snapshot(baseline.withColumns({"effective_date": F.col("baseline_date"), "snapshot_date": F.col("baseline_date")}).drop("baseline_date"))

    def save_changes(self, changes: DataFrame) -> None:
        """Replace the events of their dates (eager).  Snapshots from such a date on are to be taken again."""
        rows = changes.withColumn("_day", F.col("effective_date")).withColumnsRenamed({"effective_date": "_own", "_day": "effective_date"}).drop("_own")
        replace_partitions(rows, f"{self.folder.path}/changes", ["effective_date"], ["board_code", "stock_code"])

    def _save_snapshot(self, members: DataFrame) -> None:
        replace_partitions(members, f"{self.folder.path}/snapshots", ["snapshot_date"], ["board_code", "stock_code"])

    def read(self, as_of: str, board_type: str | None = None) -> DataFrame:
        """Edges in force on a date, with the columns of ``members_as_of``; none before the first snapshot."""
        known = [d for d in self._days("snapshots", "snapshot_date") if d <= as_of]
        if not known:
            return self.spark.createDataFrame([], MEMBERS)
        start = max(known)
        later = [d for d in self._days("changes", "effective_date") if start < d <= as_of]
        base = self.spark.read.schema(MEMBERS).parquet(f"{self.folder.path}/snapshots/snapshot_date={start}")
        deltas = self.spark.createDataFrame([], EVENTS)
        if later:
            deltas = (self.spark.read.schema(EVENTS).option("basePath", f"{self.folder.path}/changes")
                      .parquet(*[f"{self.folder.path}/changes/effective_date={d}" for d in later]))
        return members_from_snapshot(base, deltas, as_of, board_type)

    def snapshot(self, as_of: str) -> None:
        """Store the members as of a date as a snapshot (eager)."""
        # Stored first: an older snapshot of the same date would be read and replaced at once.
        self._save_snapshot(stored(self.read(as_of)).withColumn("snapshot_date", F.lit(dt.date.fromisoformat(as_of))))
