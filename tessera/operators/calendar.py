"""Session arithmetic, calendar lookups and sums over consecutive periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def session_at_or_after(dates: DataFrame, calendar: DataFrame, date: str) -> DataFrame:
    """dates with the index of the first session on or after each, or -1; calendar (date, session_idx) is one row a day."""
    marks = calendar.select(F.col("date").alias("_d"), F.col("session_idx").alias("_i"))
    days = dates.select(F.col(date).alias("_d")).distinct().unionByName(marks, allowMissingColumns=True)
    # a calendar holds one row a day whatever the data, so this window stays small
    found = days.withColumn("session_idx", F.first("_i", ignorenulls=True).over(W.orderBy("_d", F.col("_i").isNull().cast("int").desc()).rowsBetween(0, W.unboundedFollowing)))
    index = found.where("_i is null").select("_d", F.coalesce("session_idx", F.lit(-1)).alias("session_idx"))
    return dates.join(F.broadcast(index), dates[date] == index["_d"]).drop("_d")


def trailing_sum(rows: DataFrame, key: str, period: str, value: str, n: int = 4) -> DataFrame:
    """Sum over n consecutive whole-numbered periods; null, never a part, where one is missing."""
    frame = W.partitionBy(key).orderBy(period).rangeBetween(1 - n, 0)
    return rows.withColumn("trailing", F.when(F.count(value).over(frame) == n, F.sum(value).over(frame)))


def from_year_to_date(rows: DataFrame, key: str, year: str, quarter: str, total: str) -> DataFrame:
    """Single quarters out of year-to-date totals: each less the quarter before of the same year; null where that is missing."""
    w = W.partitionBy(key, year).orderBy(quarter)
    before = F.when(F.lag(quarter).over(w) == F.col(quarter) - 1, F.lag(total).over(w))
    return rows.withColumn("single", F.when(F.col(quarter) == 1, F.col(total)).otherwise(F.col(total) - before))


def growth(now: Column, before: Column) -> Column:
    return F.when(before > 0, now / before - 1)


def next_by_median_gap(rows: DataFrame, key: str, date: str, most_gaps: int = 8, least_spread: int = 3, lone_spread: int = 14) -> DataFrame:
    """The next date of each key: the last plus the median of its latest gaps, and a spread of half their range."""
    w = W.partitionBy(key).orderBy(date)
    gaps = rows.withColumn("gap", F.datediff(date, F.lag(date).over(w))).withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(F.desc(date))))
    kept = F.when((F.col("rn") <= most_gaps) & (F.col("gap") > 0), F.col("gap"))
    out = gaps.groupBy(key).agg(F.max(date).alias("last"), F.percentile(kept, F.lit(0.5)).alias("m"), F.count(kept).alias("n_gaps"), (F.max(kept) - F.min(kept)).alias("r"))
    spread = F.when(F.col("n_gaps") >= 2, F.greatest(F.lit(least_spread), F.floor(F.col("r") / 2 + 0.5).cast("int"))).otherwise(lone_spread)
    return out.where("n_gaps > 0").select(key, "last", F.expr("date_add(last, cast(floor(m + 0.5) as int))").alias("expected"), spread.cast("int").alias("spread"), "n_gaps")


def of_the_day(day: Column, n: int | Column) -> Column:
    """An index from 0 to n - 1 that moves on by one a day; null if n is 0."""
    return F.pmod(F.datediff(day, F.lit("1970-01-01").cast("date")), F.nullif(n if isinstance(n, Column) else F.lit(n), F.lit(0)))


def numbered(rows: DataFrame, key: str, name: str, width: int = 1024) -> DataFrame:
    """rows with their number from 0 in the order of a whole-numbered key: counts of the key ranges before, and the place within."""
    ranged = rows.withColumn("_range", F.floor(F.col(key) / width))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_c"))
    before = sizes.select("_range", F.coalesce(F.sum("_c").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("_range").orderBy(key)) - 1
    return ranged.join(before, "_range").withColumn(name, F.col("_before") + place).drop("_range", "_before")


def changes(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change): rows that came, went or differ between two snapshots."""
    o, n = before.alias("o"), after.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    change = F.when(F.col(f"o.{key}").isNull(), "came").when(F.col(f"n.{key}").isNull(), "went").when(differs, "changed")
    return both.select(F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key), change.alias("change")).where("change is not null")
