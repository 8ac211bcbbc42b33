import datetime as dt

from pyspark.sql import functions as F

from builders import at, day, records
from tidemark import schemas
from tidemark.sources.minutes import read_minute_board
from tidemark.streaming import boards as sb
from tidemark.streaming import sessions as ss

DATE = "2026-08-14"


def boards(spark, minutes, fetched=0, date=DATE):
    data = []
    for m, dark in minutes:
        stamp = at(date, m // 60, m % 60)
        data.append(dict(trade_date=date, snapshot_at=stamp, rank_type="industry", code="A", dark_money=dark,
                         fetched_at=stamp + dt.timedelta(seconds=fetched)))
    return records(spark, data)


def feed(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_upsert_stream_survives_a_replay(spark, root):
    source = f"{root}/in"
    feed(boards(spark, [(571, 1), (572, 2)]), source)
    feed(boards(spark, [(571, 5)], fetched=9), source)
    for run in ("one", "two"):  # the second run replays everything into the same table
        stream = sb.read_stream(spark, source, schemas.RANK_RECORD, 1)
        drain(sb.upsert_minute_boards(stream, f"{root}/out", f"{root}/cp-{run}").start())
        got = sorted((r.snapshot_at.minute, r.dark_money) for r in read_minute_board(spark, f"{root}/out").collect())
        assert got == [(31, 5), (32, 2)]


def test_late_rows_go_aside(spark, root):
    feed(boards(spark, [(571, 1)]), f"{root}/in")
    feed(boards(spark, [(571, 2)], date="2026-08-17"), f"{root}/in")
    spark.createDataFrame([(day(DATE),)], "trade_date date").write.parquet(f"{root}/sealed")
    stream = sb.read_stream(spark, f"{root}/in", schemas.RANK_RECORD)
    drain(sb.upsert_with_late_table(stream, f"{root}/out", f"{root}/late", f"{root}/sealed", f"{root}/cp").start())
    assert [r.dark_money for r in spark.read.parquet(f"{root}/out").collect()] == [2]
    assert [r.dark_money for r in spark.read.parquet(f"{root}/late").collect()] == [1]
    assert sb.fold_late_rows(spark, f"{root}/late", f"{root}/out") == [DATE]
    assert sorted(r.dark_money for r in read_minute_board(spark, f"{root}/out").collect()) == [1, 2]
    assert sb.fold_late_rows(spark, f"{root}/late", f"{root}/out") == []


def stream_to_memory(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_samples_and_bars_in_append_mode(spark, root):
    feed(boards(spark, [(571, 1), (573, 3), (575, 5), (576, 6)]), f"{root}/in")
    feed(boards(spark, [(600, 30)]), f"{root}/in")
    stream = sb.read_stream(spark, f"{root}/in", schemas.RANK_RECORD, 1)
    got = stream_to_memory(sb.five_minute_samples(stream, ["code"], ["dark_money"]), "samples", "append")
    assert [(r.bucket_start.minute, r.dark_money) for r in got.orderBy("bucket_start").collect()] == [(31, 5), (36, 6)]
    stream = sb.read_stream(spark, f"{root}/in", schemas.RANK_RECORD, 1).withColumn("price", F.col("dark_money").cast("double"))
    bars = sb.stream_bars(stream, ["code"], "price", "dark_money", ["snapshot_at"], at="snapshot_at")
    got = stream_to_memory(bars, "bars", "append").orderBy("bucket_start").collect()
    assert [(b.open_price, b.close_price, b.volume) for b in got] == [(1.0, 3.0, 4), (5.0, 6.0, 11)]


def test_latest_and_counts(spark, root):
    feed(boards(spark, [(571, 1), (575, 5)]), f"{root}/in")
    feed(boards(spark, [(900, 9)]), f"{root}/in")
    stream = sb.read_stream(spark, f"{root}/in", schemas.RANK_RECORD)
    latest = stream_to_memory(sb.latest_board(stream), "latest", "complete").collect()
    assert [(r.code, r.dark_money) for r in latest] == [("A", 9)]
    counts = stream_to_memory(sb.session_counts(sb.read_stream(spark, f"{root}/in", schemas.RANK_RECORD)), "counts", "complete").first()
    assert (counts.minutes_seen, counts.points_seen, counts.close_seen, counts.minutes_expected) == (3, 2, 1, 240)


def test_session_gaps_are_told_when_the_session_is_over(spark, root):
    ss.with_keyed_state(spark)
    minutes = [m for m in [*range(571, 691), *range(781, 901)] if m not in (575, 700, 790)]
    feed(boards(spark, [(m, m) for m in minutes[:100]]), f"{root}/in")
    feed(boards(spark, [(m, m) for m in [*minutes[90:], 905, 690, 691]]), f"{root}/in")  # repeats and rows off the grid
    feed(boards(spark, [(571, 1), (600, 2)], date="2026-08-17"), f"{root}/in")  # moves the watermark past the close
    stream = sb.read_stream(spark, f"{root}/in", schemas.RANK_RECORD, 1)
    made = ss.session_gaps(stream, ["rank_type"])
    q = made.writeStream.format("memory").queryName("gaps").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r.trade_date, r.minutes_seen, r.points_seen, r.close_seen, r.missing_minutes) for r in spark.table("gaps").collect()]
    assert got == [(day(DATE), 238, 46, 1, [575, 790])]


def test_latest_board_falls_back_to_the_close(spark, root):
    ss.with_keyed_state(spark)

    def rows(values, close):
        return boards(spark, values).withColumn("is_close", F.lit(close))

    schema = rows([(571, 1)], False).schema
    feed(rows([(900, 5)], True), f"{root}/in")
    feed(rows([(571, 7)], False), f"{root}/in")
    feed(rows([(572, 8), (573, 9)], False), f"{root}/in")
    feed(rows([(571, 6)], False), f"{root}/in")  # late: nothing changes
    latest = ss.latest_boards(sb.read_stream(spark, f"{root}/in", schema, 1))
    q = latest.writeStream.format("memory").queryName("newest").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.dark_money, r.from_close) for r in spark.table("newest").collect()] == [(5, True), (7, False), (9, False)]
