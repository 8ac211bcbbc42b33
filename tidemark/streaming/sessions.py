"""Streams with keyed state and timers: what a session lacks once it is over, and the newest board of each key.

State is a few values a key, kept by Spark's state store and restored with the
stream, so a lost executor costs a micro-batch.  Processors are built inside
functions and use nothing of this package, so tasks need no copy of it.  Streams
with keyed state need the RocksDB state store, which ``with_keyed_state`` names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from tidemark.functions.grid import CLOSE, MINUTES, grid_array, on_minute_grid
from tidemark.functions.scalars import clock_minute

LATENESS = "10 minutes"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_keyed_state(spark: SparkSession) -> SparkSession:
    """The session, set to a state store that can hold keyed state (for streams started from now on)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


def session_gaps(boards: DataFrame, keys: Sequence[str] = ("rank_type",), date: str = "trade_date", at: str = "snapshot_at",
                 lateness: str = LATENESS) -> DataFrame:
    """One row per key and date once its session is over: minutes, points and close seen, and the minutes missing.

    The state of a session is a map of 240 bits.  A timer at the close fires
    when the watermark has passed it, emits the row and frees the state.  Rows
    later than that are dropped by the watermark; rows off the grid do not count.
    """
    grid = grid_array(1)
    minute = clock_minute(F.col(at))
    # 15:00 in the session's zone, as the instant the timer waits for.
    close = F.unix_millis(F.col(date).cast("timestamp") + F.make_dt_interval(mins=F.lit(CLOSE)))
    rows = boards.withWatermark(at, lateness).filter(on_minute_grid(minute)).select(
        *keys, F.col(date).cast("string").alias("session_day"), at, (F.array_position(grid, minute) - 1).cast("int").alias("session_bit"), close.alias("closes_at"))
    # Columns must not begin with an underscore here: tasks would see them renamed.
    names, size = [*keys, "trade_date"], MINUTES

    class Gaps(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.seen = handle.getValueState("seen", "bits binary")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            known = self.seen.exists()
            bits = int.from_bytes(self.seen.get()[0], "little") if known else 0
            ends = None
            for batch in rows:
                for bit in batch["session_bit"]:
                    bits |= 1 << int(bit)
                ends = int(batch["closes_at"].iloc[0])
            self.seen.update((bits.to_bytes(size // 8, "little"),))
            if not known and ends is not None:
                self.handle.registerTimer(ends)
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            bits = int.from_bytes(self.seen.get()[0], "little")
            self.seen.clear()
            missing = [i for i in range(size) if not bits >> i & 1]
            points = sum(bits >> i & 1 for i in range(4, size, 5))
            yield pd.DataFrame({**{n: [k] for n, k in zip(names, key)}, "minutes_seen": [size - len(missing)], "points_seen": [points],
                                "close_seen": [bits >> (size - 1) & 1], "missing": [missing]})

        def close(self):
            pass

    kinds = dict(boards.dtypes)
    out = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", trade_date string, minutes_seen int, points_seen int, close_seen int, missing array<int>"
    made = rows.groupBy(*keys, "session_day").transformWithStateInPandas(Gaps(), StructType.fromDDL(out), "Append", "EventTime")
    clock = F.transform("missing", lambda i: F.get(grid, i))
    return made.select(*keys, F.col("trade_date").cast("date").alias("trade_date"), "minutes_seen", "points_seen", "close_seen",
                       clock.alias("missing_minutes"))


def latest_boards(boards: DataFrame, keys: Sequence[str] = ("rank_type", "code"), value: str = "dark_money", at: str = "snapshot_at",
                  closing: str = "is_close") -> DataFrame:
    """The newest row of each key whenever it changes: a minute row if the key has any, else its newest close.

    ``boards`` has minute rows and daily closes, told apart by ``closing``; state
    is one minute row and one close a key.
    """
    rows = boards.select(*keys, F.unix_micros(F.col(at)).alias("seen_at"), F.col(value).cast("bigint").alias("amount"), F.col(closing).alias("closing"))
    names = list(keys)

    class Latest(StatefulProcessor):
        def init(self, handle):
            self.held = [handle.getValueState(name, "at bigint, value bigint") for name in ("minute", "daily")]

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            held = [tuple(state.get()) if state.exists() else None for state in self.held]
            before = held[0] or held[1]
            new = list(held)
            for batch in rows:
                for at_, value_, closing_ in zip(batch["seen_at"].tolist(), batch["amount"].tolist(), batch["closing"].tolist()):
                    k = 1 if closing_ else 0
                    if new[k] is None or (at_, value_) > new[k]:
                        new[k] = (at_, value_)
            for state, old, now in zip(self.held, held, new):
                if now != old:
                    state.update(now)
            shown = new[0] or new[1]
            if shown != before or (new[0] is None) != (held[0] is None):
                yield pd.DataFrame({**{n: [k] for n, k in zip(names, key)}, "seen_at": [shown[0]], "amount": [shown[1]], "from_close": [new[0] is None]})

        def close(self):
            pass

    kinds = dict(boards.dtypes)
    out = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", seen_at bigint, amount bigint, from_close boolean"
    made = rows.groupBy(*keys).transformWithStateInPandas(Latest(), StructType.fromDDL(out), "Update", "None")
    return made.select(*keys, F.timestamp_micros("seen_at").alias(at), F.col("amount").alias(value), "from_close")
