"""Quote, catalog and constituent pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordinals import position_in_group
from tidemark.functions.scalars import (double_or_zero, epoch_to_text, long_or_zero, positive_double, text_or_empty)

# Field names of the quote answer.
CODE, MARKET, NAME, LAST, STAMP = "f12", "f13", "f14", "f2", "f124"
PRICES = {"open_price": "f17", "high_price": "f15", "low_price": "f16", "previous_close": "f18", "change_value": "f4"}
PERCENTS = {"change_pct": "f3", "turnover_rate": "f8", "amplitude": "f7"}
COUNTS = {"volume": "f5", "turnover": "f6"}

_ENTRIES = "array<map<string,string>>"
_NUMBERED = "map<string,map<string,string>>"


def rows_from_object_or_array(value: Column) -> Column:
    """Entries of a JSON array, or of an object keyed by number in numeric key order; '' or null is empty."""
    text = F.trim(value)
    numbered = F.from_json(text, _NUMBERED)
    keys = F.array_sort(F.transform(F.map_keys(numbered), lambda k: F.struct(
        k.try_cast("bigint").alias("n"), k.alias("k"))))
    return F.when(F.substring(text, 1, 1) == "[", F.from_json(text, _ENTRIES)).when(
        F.substring(text, 1, 1) == "{", F.transform(keys, lambda x: F.element_at(numbered, x["k"]))).otherwise(
        F.array().cast(_ENTRIES))


def quote_entries(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per entry of the answer pages: keys, page, pos, total, the field map ``q``."""
    answer = F.from_json(F.col("body").cast("string"), "rc int, message string, data struct<total:bigint,diff:string>")
    parsed = pages.select(*keys, F.col("page").cast("bigint").alias("page"), answer.alias("_a"))
    return parsed.select(*keys, "page", F.col("_a.data.total").alias("total"),
                         F.posexplode_outer(rows_from_object_or_array(F.col("_a.data.diff"))).alias("pos", "q"))


def typed_quote(q: str = "q") -> list[Column]:
    def at(name: str) -> Column:
        return F.element_at(q, name)

    last = positive_double(at(LAST))
    return ([text_or_empty(at(CODE)).alias("code"), long_or_zero(at(MARKET)).alias("market"),
             text_or_empty(at(NAME)).alias("name"), F.coalesce(last, F.lit(0.0)).alias("latest_price")]
            + [double_or_zero(at(f)).alias(n) for n, f in PRICES.items()]
            + [(double_or_zero(at(f)) / 100).alias(n) for n, f in PERCENTS.items()]
            + [long_or_zero(at(f)).alias(n) for n, f in COUNTS.items()]
            + [epoch_to_text(text_or_empty(at(STAMP))).alias("quote_time"), last.isNotNull().alias("available")])


def _per_code(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Copies and first announced total of each code of a listing; entries that are none have a NULL code."""
    has = F.col("q").isNotNull()
    # A page's entries announce one total, so the first of each stands for it; a number as order keeps the aggregate hashed.
    place = F.coalesce(F.col("page"), F.lit(-(1 << 63))).cast("decimal(20,0)") * 2 + F.when(F.col("pos").isNull(), 0).otherwise(1)
    first = F.when(F.coalesce("pos", F.lit(0)) == 0, place)
    return entries.withColumn("_code", F.when(has, text_or_empty(F.element_at("q", CODE)))).groupBy(*keys, "_code").agg(
        F.count_if(has).alias("_n"), F.min_by("total", first).alias("_total"), F.min(first).alias("_first"))


def _judged(per_code: DataFrame, keys: Sequence[str], exact: bool) -> DataFrame:
    """(keys, reason, expected, found, codes) of every listing; a sound one has no reason."""
    joined = per_code.groupBy(*keys).agg(
        F.min_by("_total", "_first").alias("expected"), F.sum("_n").alias("found"), F.max("_n").alias("_copies"),
        F.max(F.col("_code") == "").alias("_nameless"), F.count("_code").alias("codes")).fillna(0, ["expected"])
    duplicate = (F.col("_copies") > 1) if exact else F.lit(False)
    short = (F.col("found") != F.col("expected")) if exact else (F.col("found") < F.col("expected"))
    reason = (F.when(F.col("_nameless"), "empty_code").when(duplicate, "duplicate_code")
              .when(F.col("found") == 0, "no_data").when(F.col("expected") <= 0, "invalid_total")
              .when(short, "incomplete"))
    return joined.select(*keys, reason.alias("reason"), "expected", "found", "codes")


def listing_errors(entries: DataFrame, keys: Sequence[str], exact: bool = True) -> DataFrame:
    """(keys, reason, expected, found) of listings that are unusable.

    ``exact`` listings must hold as many distinct codes as the first page
    announced; otherwise at least that many source rows, repeats allowed.
    """
    keys = list(keys)
    return _judged(_per_code(entries, keys), keys, exact).filter(F.col("reason").isNotNull()).drop("codes")


def _accepted(entries: DataFrame, errors: DataFrame, keys: Sequence[str]) -> DataFrame:
    # A row a listing: small beside the entries, and few enough keys that a shuffle would meet in a few tasks.
    return entries.filter(F.col("q").isNotNull()).join(F.broadcast(errors.select(*keys)), list(keys), "left_anti")


def parse_board_quotes(pages: DataFrame, keys: Sequence[str] = ("rank_type",)) -> tuple[DataFrame, DataFrame]:
    """Board quotes of sound listings, and the listings rejected."""
    entries = quote_entries(pages, keys)
    errors = listing_errors(entries, keys)
    return _accepted(entries, errors, keys).select(*keys, *typed_quote()), errors


def parse_stock_quotes(requested: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per requested stock (stock_code, stock_market, stock_name).

    The last answer for a code counts; a stock without one is unavailable, and
    a missing market or name is taken from the request.
    """
    entries = quote_entries(pages, []).filter(F.col("q").isNotNull())
    typed = entries.select("page", "pos", *typed_quote()).filter(F.col("code") != "")
    names = [c for c in typed.columns if c not in ("page", "pos", "code")]
    last = typed.groupBy("code").agg(F.max_by(F.struct(*names), F.struct("page", "pos")).alias("_q"))
    joined = requested.select(F.col("stock_code").alias("code"), "stock_market", "stock_name").join(last, "code", "left")
    zero = {"bigint": F.lit(0).cast("bigint"), "double": F.lit(0.0), "string": F.lit(""), "boolean": F.lit(False)}
    kinds = dict(typed.dtypes)
    filled = joined.select("code", "stock_market", "stock_name",
                           *[F.coalesce(F.col(f"_q.{n}"), zero[kinds[n]]).alias(n) for n in names])
    return filled.withColumns({
        "market": F.when(F.col("market") == 0, F.col("stock_market")).otherwise(F.col("market")),
        "name": F.when(F.col("name") == "", F.col("stock_name")).otherwise(F.col("name")),
    }).drop("stock_market", "stock_name")


def parse_board_catalog(pages: DataFrame, keys: Sequence[str] = ("board_type",)) -> tuple[DataFrame, DataFrame]:
    """Boards of sound catalogs with ``source_rank`` = position by code, and the catalogs rejected."""
    entries = quote_entries(pages, keys)
    errors = listing_errors(entries, keys)
    boards = _accepted(entries, errors, keys).select(
        *keys, text_or_empty(F.element_at("q", CODE)).alias("board_code"),
        text_or_empty(F.element_at("q", NAME)).alias("board_name"))
    return position_in_group(boards, keys, [F.asc("board_code")], "source_rank"), errors


def _constituent_errors(per_code: DataFrame, boards: DataFrame) -> DataFrame:
    """Unusable listings, and sound ones of boards that the catalog lacks with their number of codes."""
    known = boards.select("board_code", F.lit(True).alias("_known")).distinct()
    judged = _judged(per_code, ["board_code"], exact=False).join(known, "board_code", "left")
    sound = F.col("reason").isNull()
    return judged.filter(~sound | F.col("_known").isNull()).select(
        "board_code", F.coalesce("reason", F.lit("unknown_board")).alias("reason"), F.when(sound, 0).otherwise(F.col("expected")).alias("expected"),
        F.when(sound, F.col("codes")).otherwise(F.col("found")).alias("found"))


def constituent_errors(pages: DataFrame, boards: DataFrame) -> DataFrame:
    """The boards that ``parse_board_constituents`` rejects, without the rows of the others (one pass over the pages)."""
    return _constituent_errors(_per_code(quote_entries(pages, ["board_code"]), ["board_code"]), boards)


def parse_board_constituents(pages: DataFrame, boards: DataFrame, source: str, scope: str,
                             detected_at: Column) -> tuple[DataFrame, DataFrame]:
    """Membership rows of sound constituent listings, and the boards rejected.

    ``pages`` carry ``board_code``; repeats of a stock keep the first entry.
    Sound listings of boards that are not in the catalog are rejected as ``unknown_board``.
    """
    entries = quote_entries(pages, ["board_code"])
    per_code = _per_code(entries, ["board_code"])
    coded = _accepted(entries, _judged(per_code, ["board_code"], exact=False).filter(F.col("reason").isNotNull()), ["board_code"])
    place = F.struct("page", "pos")
    # Field by field, so that what the caller does not read is not sorted either.
    first = coded.groupBy("board_code", text_or_empty(F.element_at("q", CODE)).alias("stock_code")).agg(
        F.min_by(long_or_zero(F.element_at("q", MARKET)), place).alias("stock_market"),
        F.min_by(text_or_empty(F.element_at("q", NAME)), place).alias("stock_name"), F.min_by(F.to_json("q"), place).alias("raw_data"))
    rows = first.join(boards.select("board_code", "board_name", "board_type", F.col("source_rank").alias("source_order")),
                      "board_code")
    return rows.select(
        "stock_code", "stock_market", "stock_name", "board_code", "board_name", "board_type",
        F.col("source_order").cast("int").alias("source_order"), F.lit(source).alias("relation_source"),
        F.lit(scope).alias("relation_scope"), detected_at.alias("detected_at"), "raw_data"), _constituent_errors(per_code, boards)


def read_calendar(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(date, kind) entries of calendar files, and the bad entries as (value, reason).

    ``files`` has the layout ``schemas.CALENDAR_FILE``.
    """
    both = files.select(F.explode(F.array(
        F.struct(F.lit("holiday").alias("kind"), F.col("holidays").alias("v")),
        F.struct(F.lit("workday").alias("kind"), F.col("workdays").alias("v")))).alias("_e"))
    entries = both.select("_e.kind", F.explode("_e.v").alias("value")).distinct()
    day = F.when(F.col("value").rlike("^\\d{4}-\\d{2}-\\d{2}$"), F.col("value").try_cast("date"))
    dated = entries.withColumn("date", day)
    clash = (dated.filter(F.col("date").isNotNull()).groupBy("value").agg(F.count_distinct("kind").alias("n"))
             .filter(F.col("n") > 1).select("value", F.lit("holiday_and_workday").alias("reason")))
    bad = dated.filter(F.col("date").isNull()).select("value", F.lit("invalid_date").alias("reason"))
    return dated.filter(F.col("date").isNotNull()).select("date", "kind"), bad.unionByName(clash)
