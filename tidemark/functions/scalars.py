"""Scalar column expressions: lenient parsing, fixed point, clocks, predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code prefixes of main-board listings per market, and the name
# prefixes that mark a stock under special treatment.
MAIN_BOARD_PREFIXES = {1: ("600", "601", "603", "605"), 0: ("000", "001", "002", "003")}
SPECIAL_TREATMENT = ("ST", "*ST", "S*ST", "SST")

PRICE_TOLERANCE = 1e-4
CLOSE_TOLERANCE = 0.0101


# -- lenient reads of text fields (missing or unreadable -> 0 / '') ----------

def text_or_empty(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def long_or_zero(value: Column) -> Column:
    """Whole number; a fractional number is cut towards zero; else 0."""
    return F.coalesce(value.try_cast("bigint"), value.try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def double_or_zero(value: Column) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def leading_long(value: Column) -> Column:
    """The part before the decimal point as BIGINT, 0 if it is not a number."""
    return F.coalesce(F.element_at(F.split(value, "\\."), 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def numeric_prefix(value: Column) -> Column:
    """Leading digits as BIGINT; text that does not start with a digit is 0."""
    return F.coalesce(F.regexp_extract(value, "^([0-9]+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def positive_double(value: Column) -> Column:
    """A number above zero, else NULL ("no usable quote")."""
    number = value.try_cast("double")
    return F.when(number > 0, number)


# -- fixed point -------------------------------------------------------------

def scale_e4(value: Column) -> Column:
    """Price to whole 1/10000, half away from zero."""
    return F.round(value * F.lit(1e4)).cast("bigint")


def scale_ppm(value: Column) -> Column:
    return F.round(value * F.lit(1e6)).cast("bigint")


def unscale_e4(value: Column) -> Column:
    return value.cast("double") / F.lit(1e4)


def unscale_ppm(value: Column) -> Column:
    return value.cast("double") / F.lit(1e6)


def same_price(left: Column, right: Column) -> Column:
    return F.abs(left - right) <= F.lit(PRICE_TOLERANCE)


def sign_of(value: Column) -> Column:
    return F.signum(value).cast("int")


def bit(value: Column) -> Column:
    """Boolean as 1/0."""
    return value.cast("int")


# -- dates and clocks --------------------------------------------------------

def iso_date(value: Column) -> Column:
    """``yyyyMMdd`` text to DATE; other text is read as an ISO date."""
    return F.when(F.length(value) == 8, F.try_to_date(value, "yyyyMMdd")).otherwise(value.try_cast("date"))


def six_digit_clock(value: Column) -> Column:
    return F.when(F.length(value.cast("string")) > 6, value.cast("string")).otherwise(
        F.lpad(value.cast("string"), 6, "0"))


def epoch_to_instant(value: Column) -> Column:
    """Epoch seconds, or milliseconds from 1e12 on, as TIMESTAMP; else NULL."""
    number = value.try_cast("bigint")
    return F.when(number >= F.lit(1_000_000_000_000), F.timestamp_millis(number)).when(
        number > 0, F.timestamp_seconds(number))


def epoch_to_text(value: Column) -> Column:
    """Epoch text as a UTC RFC 3339 instant; text that is no epoch is kept."""
    number = value.try_cast("bigint")
    seconds = F.when(number >= F.lit(1_000_000_000_000), F.floor(number / 1000)).otherwise(number).cast("bigint")
    utc = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    within = F.pmod(seconds, F.lit(86400))
    clock = F.concat_ws(
        ":",
        F.lpad(F.floor(within / 3600).cast("string"), 2, "0"),
        F.lpad(F.floor(F.pmod(within, F.lit(3600)) / 60).cast("string"), 2, "0"),
        F.lpad(F.pmod(within, F.lit(60)).cast("string"), 2, "0"))
    return F.when(number > 0, F.concat(utc.cast("string"), F.lit("T"), clock, F.lit("Z"))).otherwise(value)


def quote_date(value: Column) -> Column:
    """Session-zone date of an RFC 3339 or ``yyyy-MM-dd HH:mm:ss`` text, else NULL."""
    stamped = F.when(value.rlike("^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?(Z|[+-]\\d{2}:\\d{2})$"),
                     value.try_cast("timestamp"))
    local = F.when(value.rlike("^\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}$"), value.try_cast("timestamp"))
    return F.coalesce(stamped, local).cast("date")


def clock_minute(at: Column) -> Column:
    """Minutes since midnight."""
    return (F.hour(at) * 60 + F.minute(at)).cast("int")


def clock_text(minute: Column) -> Column:
    """Minutes since midnight as ``HH:MM``."""
    return F.concat_ws(":", F.lpad(F.floor(minute / 60).cast("string"), 2, "0"),
                       F.lpad(F.pmod(minute, F.lit(60)).cast("string"), 2, "0"))


# -- predicates --------------------------------------------------------------

def is_stock_code(code: Column) -> Column:
    return code.rlike("^[0-9]{6}$")


def is_main_board(market: Column, code: Column) -> Column:
    head = F.substring(code, 1, 3)
    per_market = F.lit(False)
    for number, prefixes in MAIN_BOARD_PREFIXES.items():
        per_market = per_market | ((market == number) & head.isin(*prefixes))
    return (F.length(code) == 6) & per_market


def is_special_treatment(name: Column) -> Column:
    clean = F.upper(F.trim(name))
    hit = F.lit(False)
    for prefix in SPECIAL_TREATMENT:
        hit = hit | clean.startswith(prefix)
    return hit


# Folding is ASCII only, so accented or full-width letters stay distinct.
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_fold(value: Column) -> Column:
    return F.translate(value, _UPPER, _UPPER.lower())


def contains_text(needle: str, *columns: Column) -> Column:
    """Literal, ASCII-case-insensitive substring match in any of the columns."""
    wanted = ascii_fold(F.lit(needle))
    hit = F.lit(False)
    for column in columns:
        hit = hit | F.contains(ascii_fold(column), wanted)
    return hit


def repaired_money_bit(available: Column, *amounts: Column) -> Column:
    """Money seen anywhere means the availability bit should have been set."""
    seen = available
    for amount in amounts:
        seen = seen | (amount != 0)
    return seen


def ratio_or_zero(top: Column, bottom: Column) -> Column:
    return F.when(bottom != 0, top.cast("double") / bottom).otherwise(F.lit(0.0))


def decode_text(body: Column) -> Column:
    """Bytes as UTF-8, or as GBK when they are not valid UTF-8.

    GBK needs ``spark.sql.legacy.javaCharsets`` (set by ``build_session``).
    """
    return F.when(F.is_valid_utf8(body.cast("string")), body.cast("string")).otherwise(F.decode(body, "GBK"))
