"""Raw ranked-list pages to rank records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordinals import running_weights
from tidemark.functions.scalars import (double_or_zero, iso_date, leading_long, long_or_zero, six_digit_clock,
                                        text_or_empty)

# Numbered fields of the ranked-list answer.
RANK_FIELDS = {
    "text": {"4": "code", "16": "name"},
    "long": {"3": "market", "6": "dark_money", "7": "regular_money", "8": "main_money_inflow",
             "13": "latest_price_raw"},
    "double": {"11": "dark_activity", "12": "dark_inflow_ratio", "14": "change_pct"},
}
BOARD_FIELDS = {"long": {"9": "up_count", "10": "down_count"}, "text": {"15": "leader_name", "20": "leader_code"}}
QUOTE_CLOCK = "5"
SOURCE_VERSION, SOURCE_SORT_FLAG = 101, 6

_PAGE = "errid int, errmsg string, `1` string, `2` string, data array<map<string,string>>"


def rank_page_rows(pages: DataFrame, keys: Sequence[str] = ("trade_date", "rank_type")) -> DataFrame:
    """One row per list entry: keys, page, ``pos`` on the page, running ``rank`` and the field map.

    The rank counts entries in response order over all pages.  Pages report
    their sizes, the running total of sizes is taken over pages (not rows), and
    each page's rows are numbered by their own position.
    """
    keys = list(keys)
    parsed = pages.select(*keys, F.col("page").cast("bigint").alias("page"),
                          F.from_json(F.col("body").cast("string"), _PAGE).alias("_p"))
    listed = parsed.select(*keys, "page", iso_date(F.col("_p").getField("1")).alias("answer_date"),
                           F.col("_p").getField("2").try_cast("bigint").alias("answer_total"),
                           F.coalesce("_p.data", F.array().cast("array<map<string,string>>")).alias("_data"))
    sizes = listed.groupBy(*keys, "page").agg(F.sum(F.size("_data")).cast("bigint").alias("_size"))
    starts = running_weights(sizes, keys, "page", "_size").select(*keys, "page", F.col("before").alias("_start"))
    rows = listed.select(*keys, "page", "answer_date", "answer_total", F.posexplode("_data").alias("pos", "fields"))
    return (rows.join(starts, keys + ["page"])
            .withColumn("rank", F.col("_start") + F.col("pos") + 1).drop("_start"))


def parse_rank_pages(pages: DataFrame, keys: Sequence[str] = ("trade_date", "rank_type")) -> DataFrame:
    """Typed rank records of all pages; missing or unreadable numbers are 0."""
    rows = rank_page_rows(pages, keys)

    def at(number: str) -> Column:
        return F.element_at("fields", number)

    reader = {"text": text_or_empty, "long": long_or_zero, "double": double_or_zero}
    columns = [reader[kind](at(number)).alias(name) for kind, fields in RANK_FIELDS.items()
               for number, name in fields.items()]
    board = F.col("rank_type") != "stock"
    zero = {"text": F.lit(""), "long": F.lit(0).cast("bigint")}
    columns += [F.when(board, reader[kind](at(number))).otherwise(zero[kind]).alias(name)
                for kind, fields in BOARD_FIELDS.items() for number, name in fields.items()]
    return rows.select(*keys, "page", "pos", "rank", "answer_date", "answer_total", *columns,
                       six_digit_clock(long_or_zero(at(QUOTE_CLOCK))).alias("quote_time"),
                       F.lit(True).alias("money_available"), F.lit(SOURCE_VERSION).alias("source_version"),
                       F.lit(SOURCE_SORT_FLAG).alias("source_sort_flag"), F.lit(True).alias("source_descending"))


def check_snapshot_complete(records: DataFrame, keys: Sequence[str] = ("trade_date", "rank_type"),
                            pages: DataFrame | None = None) -> DataFrame:
    """(keys, reason, expected, found) of snapshots to reject.

    Date and expected total come from the first page's answer.  With ``pages``,
    snapshots whose pages hold no entry at all are rejected, too.
    """
    keys = list(keys)
    per_code = records.groupBy(*keys, "code").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by(F.struct("answer_date", "answer_total"), F.struct("page", "pos"))
        .alias("_head"), F.min(F.struct("page", "pos")).alias("_at"))
    per_key = per_code.groupBy(*keys).agg(
        F.sum("_n").alias("found"), F.max("_n").alias("_copies"), F.max(F.col("code") == "").alias("_nameless"),
        F.min_by("_head", "_at").alias("_head"))
    if pages is not None:
        asked = pages.select(*[F.col(k).alias(f"_asked_{k}") for k in keys]).distinct()
        same = [per_key[k].eqNullSafe(asked[f"_asked_{k}"]) for k in keys]
        per_key = asked.join(per_key, same, "left").select(
            *[F.col(f"_asked_{k}").alias(k) for k in keys], F.coalesce("found", F.lit(0)).alias("found"), "_copies", "_nameless", "_head")
    expected = F.coalesce(F.col("_head.answer_total"), F.lit(0))
    reason = (F.when(F.col("_nameless"), "missing_code").when(F.col("_copies") > 1, "duplicate_code")
              .when(F.col("_head.answer_date").isNull(), "no_data")
              .when((expected > 0) & (F.col("found") != expected), "incomplete"))
    return (per_key.select(*keys, reason.alias("reason"), expected.alias("expected"), "found")
            .filter(F.col("reason").isNotNull()))


def raw_page_kind(at: Column) -> Column:
    """Kind a raw page is filed under: the 15:00 page belongs to the daily close."""
    return F.when((F.hour(at) == 15) & (F.minute(at) == 0), "daily_close").otherwise("research_5m")


def raw_page_table(pages: DataFrame) -> DataFrame:
    """Raw pages with their kind, latest copy per (kind, at, type, page), ready to be stored."""
    keys = ["snapshot_kind", "snapshot_at", "rank_type", "page"]
    filed = pages.withColumn("snapshot_kind", raw_page_kind(F.col("snapshot_at")))
    rest = [c for c in filed.columns if c not in keys]
    return (filed.groupBy(*keys).agg(F.max_by(F.struct(*rest), "fetched_at").alias("_r")).select(*keys, "_r.*"))


# -- minute-bar text ---------------------------------------------------------

def parse_minute_bars(lines: DataFrame, text: str = "line") -> DataFrame:
    """Twelve-field comma text rows to typed minutes; the input's other columns are kept.

    Whole numbers are cut at the decimal point; unreadable numbers are 0.
    ``valid`` is false for rows with too few fields or an unreadable time.
    """
    parts = F.split(F.col(text), ",")
    def field(i: int) -> Column:
        return F.get(parts, F.lit(i))

    at = F.try_to_timestamp(field(0), F.lit("yyyy-MM-dd HH:mm"))
    kept = [c for c in lines.columns if c not in (text, "trade_date")]
    return lines.select(
        *kept, at.cast("date").alias("trade_date"), (F.hour(at) * 60 + F.minute(at)).cast("int").alias("minute"),
        *[double_or_zero(field(i)).alias(n) for i, n in
          ((1, "open_price"), (2, "close_price"), (3, "high_price"), (4, "low_price"))],
        leading_long(field(10)).alias("cumulative_volume"), leading_long(field(11)).alias("cumulative_turnover"),
        ((F.size(parts) >= 12) & at.isNotNull()).alias("valid"))
