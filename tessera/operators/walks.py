"""Samples for backtests by session, trailing candidate pools, lesson calendars and checks of packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def forward_sample(bars: DataFrame, sessions: DataFrame, benchmark: str, back: int = 5, ahead: int = 21) -> DataFrame:
    """(ticker, session_idx, trailing, excess): the return of the last `back` sessions and that from the next session's open to
    the close `ahead` sessions on, less the benchmark's over the same sessions.

    Bars are (ticker, date, open, close), sessions (date, session_idx). A row is left out if the ticker or the benchmark has no
    bar in exactly one of those sessions, or a price to divide by that is not positive.
    """
    by_index = W.partitionBy("ticker").orderBy("session_idx")
    at = lambda column, n: F.max(column).over(by_index.rangeBetween(n, n))
    indexed = bars.join(sessions, "date").select("ticker", F.col("session_idx").cast("long").alias("session_idx"), "open", "close")
    legs = indexed.withColumns({"before": at("close", -back), "entry": at("open", 1), "exit": at("close", ahead)})
    moved = legs.select(
        "ticker", "session_idx", F.when(F.col("before") > 0, F.col("close") / F.col("before") - 1).alias("trailing"),
        F.when(F.col("entry") > 0, F.col("exit") / F.col("entry") - 1).alias("forward"),
    )
    matched = moved.where((F.col("ticker") == benchmark) & F.col("forward").isNotNull()).select("session_idx", F.col("forward").alias("matched"))
    own = moved.where((F.col("ticker") != benchmark) & F.col("trailing").isNotNull() & F.col("forward").isNotNull())
    return own.join(matched, "session_idx").select("ticker", "session_idx", "trailing", (F.col("forward") - F.col("matched")).alias("excess"))


def trailing_pool(items: DataFrame, key: str, day: str, order: str, days: int) -> DataFrame:
    """(day, key, first): for each day with items, the keys of that day and the days - 1 before it, each with the order of its
    first item. Items are folded to one row a key and day before they are dealt to their days; null keys or days count for none.
    """
    daily = items.where(F.col(key).isNotNull() & F.col(day).isNotNull()).groupBy(F.col(key), F.col(day).alias("day")).agg(F.min(order).alias("order"))
    dealt = daily.select(key, F.struct("day", "order").alias("item"), F.explode(F.sequence("day", F.date_add("day", days - 1))).alias("on"))
    pools = dealt.groupBy("on", key).agg(F.min("item")["order"].alias("first"))
    return pools.join(daily.select(F.col("day").alias("on")).distinct(), "on", "left_semi").withColumnRenamed("on", "day")


def first_monday(start: Column) -> Column:
    """The Monday on or after a date."""
    return F.next_day(F.date_sub(start, 1), "Mon")


def lesson_of(date: Column, start: Column, packs: int, offset_weeks: int = 0) -> dict[str, Column]:
    """week (from 0), pack (week modulo packs) and lesson (1 to 7) of a date; null before the first Monday of the start, which
    offset_weeks moves on."""
    days = F.datediff(date, F.date_add(first_monday(start), 7 * offset_weeks))
    days = F.when(days >= 0, days)
    week = F.floor(days / 7).cast("int")
    return {"week": week, "pack": week % packs, "lesson": (days % 7 + 1).cast("int")}


def pack_checks(rows: DataFrame, pack: str, number: str, filled: Column) -> DataFrame:
    """pack, parts, numbered (the numbers are 1 to parts, each once), filled (so is each part) and valid (both) for each pack."""
    out = rows.groupBy(pack).agg(
        F.count("*").alias("parts"), F.countDistinct(number).alias("numbers"), F.min(number).alias("least"), F.max(number).alias("most"),
        F.bool_and(F.coalesce(filled, F.lit(False))).alias("filled"),
    )
    numbered = F.coalesce((F.col("numbers") == F.col("parts")) & (F.col("least") == 1) & (F.col("most") == F.col("parts")), F.lit(False))
    return out.select(pack, "parts", numbered.alias("numbered"), "filled", (numbered & F.col("filled")).alias("valid"))
