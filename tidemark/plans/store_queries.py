"""Writers and streams over the driver's tables: what was written is read back.

Every run writes to its own folder under the shared checkpoint folder.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.operators import archive as ar
from tidemark.plans import standin as st
from tidemark.plans.ingest_queries import _export_tables
from tidemark.plans.registry import instant, query, text
from tidemark.session import checkpoint_dir, stored
from tidemark.sources import exports as ex
from tidemark.sources import minutes as mn
from tidemark.sources import tables as tb
from tidemark.sources.memberships import Memberships
from tidemark.streaming import boards as sb
from tidemark.streaming import sessions as ss


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"


def _minute_rows(spark, sf):
    """The last event of every minute as that minute's row of its concept."""
    e = st.events(spark, sf).withColumn("snapshot_at", F.date_trunc("minute", "ts").cast("timestamp_ntz"))
    last = e.groupBy("trade_date", "snapshot_at", "event_type").agg(
        F.max_by("cents", "event_id").alias("dark_money"), F.max("event_id").alias("fetched_at"),
        F.min_by("cents", "event_id").alias("first_money"), F.min("event_id").alias("first_id"))
    return last.select("trade_date", "snapshot_at", F.lit("concept").alias("rank_type"),
                       F.concat(F.lit("BK"), "event_type").alias("code"), "dark_money", "fetched_at", "first_money", "first_id")


@query("save_minute_board", "ev", """
SELECT CAST(date_trunc('minute',ts) AS VARCHAR) AS snapshot_at, 'BK'||event_type AS code, arg_max(cents,event_id) AS dark_money FROM ev GROUP BY date_trunc('minute',ts), event_type""")
def save_minute_board(spark, sf):
    """The newer fetch of each minute is stored first; the older one then must not replace it."""
    path, rows = _folder(spark), _minute_rows(spark, sf)
    older = rows.withColumns({"dark_money": F.col("first_money"), "fetched_at": F.col("first_id")})
    for name, batch in (("new", rows), ("old", older)):
        mn.append_minute_board(batch.drop("first_money", "first_id"), path, name)
    return mn.read_minute_board(spark, path).select(instant("snapshot_at"), "code", "dark_money")


@query("fold_minute_board", "ev", """
SELECT CAST(date_trunc('minute',ts) AS VARCHAR) AS snapshot_at, 'BK'||event_type AS code, arg_max(cents,event_id) AS dark_money FROM ev GROUP BY date_trunc('minute',ts), event_type""")
def fold_minute_board(spark, sf):
    """Even and odd minutes in batches, one batch replayed, closed hours folded between and after: nothing is lost."""
    path, rows = _folder(spark), stored(_minute_rows(spark, sf))
    older = rows.withColumns({"dark_money": F.col("first_money"), "fetched_at": F.col("first_id")})
    closed = dt.datetime(2024, 1, 16)
    for k in range(2):
        part = F.minute("snapshot_at") % 2 == k
        mn.append_minute_board(rows.filter(part).drop("first_money", "first_id"), path, f"b{k}")
        mn.append_minute_board(older.filter(part).drop("first_money", "first_id"), path, f"b{k}-older")
        if k == 0:
            mn.fold_minute_board(spark, path, closed)
            mn.append_minute_board(rows.filter(part).drop("first_money", "first_id"), path, f"b{k}")
    mn.fold_minute_board(spark, path, closed)
    return mn.read_minute_board(spark, path).select(instant("snapshot_at"), "code", "dark_money")


@query("save_daily_close", "daily", """
SELECT CAST(d AS VARCHAR) AS trade_date, rank_type, market, code, turnover FROM daily WHERE rank_type<>'stock' OR quote_available""")
def save_daily_close(spark, sf):
    path = _folder(spark)
    tb.save_daily_close(st.daily_close(spark, sf), path)
    return spark.read.parquet(path).select(text("trade_date"), "rank_type", "market", "code", "turnover")


def _archive(spark, sf):
    """All days archived in one go: boards, then stocks, then bars; returns the folder."""
    root = _folder(spark)
    closes = stored(st.daily_close(spark, sf).withColumn("fetched_at", F.col("snapshot_at")))
    none = closes.limit(0).select("rank_type", "code", F.lit("").alias("reason"))
    points = stored(st.money_points(spark, sf).withColumn("rank", F.lit(1).cast("bigint")))
    stock = F.col("rank_type") == "stock"
    tb.save_board_archive(ar.ArchiveDay(closes.filter(~stock), points.filter(~stock), none), root)
    tb.save_stock_archive(ar.ArchiveDay(closes.filter(stock), points.filter(stock), none), root)
    bars = st.stock_bars(spark, sf).withColumn("fetched_at", F.col("trade_date").cast("timestamp_ntz"))
    tb.save_stock_bars(stored(bars), root, "v1", "run")
    return root


@query("archive_tables", "daily points", """
SELECT CAST(d.d AS VARCHAR) AS trade_date, d.ic AS industry_close_rows, d.cc AS concept_close_rows, d.sq AS stock_close_rows, coalesce(p.im,0) AS industry_money_rows, coalesce(p.cm,0) AS concept_money_rows, coalesce(q.sm,0) AS stock_money_rows FROM
(SELECT d, count(*) FILTER (rank_type='industry') AS ic, count(*) FILTER (rank_type='concept') AS cc, count(*) FILTER (rank_type='stock' AND quote_available) AS sq FROM daily GROUP BY d) d
LEFT JOIN (SELECT d, count(*) FILTER (rank_type='industry') AS im, count(*) FILTER (rank_type='concept') AS cm FROM points GROUP BY d) p USING (d)
LEFT JOIN (SELECT d, count(*) AS sm FROM points SEMI JOIN (SELECT d, code FROM daily WHERE rank_type='stock' AND quote_available) e USING (d, code) WHERE rank_type='stock' GROUP BY d) q USING (d)""")
def archive_tables(spark, sf):
    root = _archive(spark, sf)
    return spark.read.parquet(f"{root}/manifest").select(
        text("trade_date"), "industry_close_rows", "concept_close_rows", "stock_close_rows", "industry_money_rows",
        "concept_money_rows", "stock_money_rows")


@query("export_files", "daily rets", """
SELECT 'daily_close' AS name, count(*) AS rows FROM daily WHERE d BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'
UNION ALL SELECT 'future_label_history', count(*) FROM rets WHERE signal_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'
UNION ALL SELECT 'revisions', 21""")
def export_files(spark, sf):
    """Row counts the export manifest reports."""
    made = ex.export_datasets(_export_tables(spark, sf), "2024-01-05", "2024-01-25", _folder(spark),
                              names=["revisions", "daily_close", "future_label_history"])
    per_name = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"datasets.{n}.rows").alias("rows"))
                         for n in ("revisions", "daily_close", "future_label_history")])
    return made.select(F.inline(per_name))


# -- streams -----------------------------------------------------------------

def _event_stream(spark, sf):
    """The events file as a stream, shaped like minute boards."""
    schema = st.table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    # A watermark needs an instant, not a zoneless time.
    return raw.select("event_id", F.to_date("ts").alias("trade_date"), F.col("ts").cast("timestamp").alias("ts"), F.lit("concept").alias("rank_type"),
                      F.concat(F.lit("BK"), "event_type").alias("code"), "value", st.cents(F.col("value")).alias("cents"))


def _run_to_files(stream, folder, name):
    """Run an append-mode stream over what is there now; the file sink is the result."""
    done = (stream.writeStream.format("parquet").outputMode("append")
            .option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-state")
            .trigger(availableNow=True).start())
    done.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/{name}")


@query("stream_minute_boards", "ev", """
SELECT CAST(date_trunc('minute',ts) AS VARCHAR) AS snapshot_at, 'BK'||event_type AS code, arg_max(cents,event_id) AS dark_money FROM ev GROUP BY date_trunc('minute',ts), event_type""")
def stream_minute_boards(spark, sf):
    folder = _folder(spark)
    boards = _event_stream(spark, sf).select(
        "trade_date", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("snapshot_at"), "rank_type", "code",
        F.col("cents").alias("dark_money"), F.col("event_id").alias("fetched_at"))
    sb.upsert_minute_boards(boards, f"{folder}/board", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return mn.read_minute_board(spark, f"{folder}/board").select(instant("snapshot_at"), "code", "dark_money")


@query("stream_five_minute_bars", "ev", """
SELECT 'BK'||event_type AS code, CAST(time_bucket(INTERVAL 5 MINUTE, ts) AS VARCHAR) AS bucket_start, arg_min(value,event_id) AS open_price, max(value) AS high_price, min(value) AS low_price, arg_max(value,event_id) AS close_price, CAST(sum(cents) AS BIGINT) AS volume
FROM ev GROUP BY event_type, time_bucket(INTERVAL 5 MINUTE, ts) HAVING time_bucket(INTERVAL 5 MINUTE, ts)+INTERVAL 5 MINUTE<=(SELECT max(ts)-INTERVAL 10 MINUTE FROM ev)""")
def stream_five_minute_bars(spark, sf):
    """Bars whose window the watermark has closed, as an append-mode stream writes them."""
    bars = sb.stream_bars(_event_stream(spark, sf), ["code"], "value", "cents", ["event_id"])
    made = _run_to_files(bars, _folder(spark), "bars")
    return made.select("code", instant("bucket_start"), "open_price", "high_price", "low_price", "close_price", "volume")


@query("stream_five_minute_samples", "ev", """
SELECT 'BK'||event_type AS code, CAST(time_bucket(INTERVAL 5 MINUTE, ts - INTERVAL 1 MINUTE) + INTERVAL 1 MINUTE AS VARCHAR) AS bucket_start, arg_max(cents,ts) AS cents
FROM ev GROUP BY 1, 2, event_type, time_bucket(INTERVAL 5 MINUTE, ts - INTERVAL 1 MINUTE) HAVING time_bucket(INTERVAL 5 MINUTE, ts - INTERVAL 1 MINUTE)+INTERVAL 6 MINUTE<=(SELECT max(ts)-INTERVAL 10 MINUTE FROM ev)""")
def stream_five_minute_samples(spark, sf):
    samples = sb.five_minute_samples(_event_stream(spark, sf), ["code"], ["cents"], "ts")
    return _run_to_files(samples, _folder(spark), "samples").select("code", instant("bucket_start"), "cents")


@query("stream_session_gaps", "ev", """, m AS (SELECT DISTINCT 'BK'||event_type AS code, d, hour(ts)*60+minute(ts) AS mi FROM ev), g AS (SELECT * FROM m WHERE mi BETWEEN 571 AND 690 OR mi BETWEEN 781 AND 900)
SELECT code, CAST(d AS VARCHAR) AS trade_date, count(*)::INTEGER AS minutes_seen, (240-count(*))::INTEGER AS missing, count(*) FILTER (mi%5=0)::INTEGER AS points_seen, count(*) FILTER (mi=900)::INTEGER AS close_seen
FROM g WHERE d+INTERVAL 15 HOUR<=(SELECT max(ts)-INTERVAL 10 MINUTE FROM ev) GROUP BY code, d""")
def stream_session_gaps(spark, sf):
    """Sessions that the watermark has passed, as their timers report them."""
    boards = _event_stream(ss.with_keyed_state(spark), sf)
    made = _run_to_files(ss.session_gaps(boards, ["code"], at="ts"), _folder(spark), "gaps")
    return made.select("code", text("trade_date"), "minutes_seen", F.size("missing_minutes").alias("missing"), "points_seen", "close_seen")


@query("stream_latest_boards", "ev", """
SELECT 'BK'||event_type AS code, coalesce(arg_max(cents, row(ts, cents)) FILTER (NOT shut), arg_max(cents, row(ts, cents))) AS dark_money, bool_and(shut) AS from_close
FROM (SELECT *, event_type='error' OR event_id%50=0 AS shut FROM ev) GROUP BY event_type""")
def stream_latest_boards(spark, sf):
    """The newest minute row of every board, or its newest close where it has none."""
    folder = _folder(spark)
    boards = _event_stream(ss.with_keyed_state(spark), sf).withColumn("is_close", (F.col("code") == "BKerror") | (F.col("event_id") % 50 == 0))
    latest = ss.latest_boards(boards, ["code"], "cents", "ts")

    def keep(batch, batch_id):
        tb.replace_partitions(batch.withColumn("batch", F.lit(batch_id)), f"{folder}/latest", ["batch"])

    latest.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/latest").groupBy("code").agg(
        F.max_by("cents", "batch").alias("dark_money"), F.max_by("from_close", "batch").alias("from_close"))


@query("stream_late_rows", "ev", """, n AS (SELECT d, count(*) AS n FROM (SELECT DISTINCT d, date_trunc('minute',ts) AS m, event_type FROM ev) GROUP BY d)
SELECT CAST(d AS VARCHAR) AS trade_date, CASE WHEN day(d)%3=0 THEN 0 ELSE n END AS in_time, CASE WHEN day(d)%3=0 THEN n ELSE 0 END AS late, n AS after_fold FROM n""")
def stream_late_rows(spark, sf):
    """Rows of sealed dates go to the side table, and into the log by the nightly fold."""
    folder = _folder(spark)
    st.sealed_dates(spark, sf).select("trade_date").filter(F.day("trade_date") % 3 == 0).write.parquet(f"{folder}/sealed")
    boards = _event_stream(spark, sf).select(
        "trade_date", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("snapshot_at"), "rank_type", "code",
        F.col("cents").alias("dark_money"), F.col("event_id").alias("fetched_at"))
    sb.upsert_with_late_table(boards, f"{folder}/board", f"{folder}/late", f"{folder}/sealed", f"{folder}/state").trigger(
        availableNow=True).start().awaitTermination()

    def counted(rows, out):
        return rows.groupBy("trade_date").agg(F.count(F.lit(1)).alias(out))

    before = stored(counted(mn.read_minute_board(spark, f"{folder}/board"), "in_time"))
    aside = stored(counted(mn.newest(spark.read.parquet(f"{folder}/late").drop("batch")), "late"))
    sb.fold_late_rows(spark, f"{folder}/late", f"{folder}/board")
    after = counted(mn.read_minute_board(spark, f"{folder}/board"), "after_fold")
    return after.join(before, "trade_date", "left").join(aside, "trade_date", "left").fillna(0).select(text("trade_date"), "in_time", "late", "after_fold")


@query("members_from_snapshots", "scans", """
SELECT DISTINCT CAST(d AS VARCHAR) AS as_of, stock_code, board_code FROM scans WHERE d IN (DATE '2024-01-06', DATE '2024-01-14', DATE '2024-01-26')""")
def members_from_snapshots(spark, sf):
    """Members on three dates, each from the last weekly snapshot and the changes since."""
    baseline, changes = (x.withColumn("detected_at", F.col("detected_at").cast("timestamp")) for x in st.membership_tables(spark, sf))
    store = Memberships(spark, _folder(spark))
    store.save_baseline(baseline)
    store.save_changes(changes)
    for day in ("2024-01-08", "2024-01-15", "2024-01-22"):
        store.snapshot(day)
    made = [store.read(d).select(F.lit(d).alias("as_of"), "stock_code", "board_code") for d in ("2024-01-06", "2024-01-14", "2024-01-26")]
    return made[0].unionByName(made[1]).unionByName(made[2])
