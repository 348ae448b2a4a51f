"""Point-in-time operators: what was known when, nearest and preceding rows, adjustment by later events.

Every join here has an equality key; time conditions only filter within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def known_at(facts: DataFrame, keys: list[str], as_of: Column, accepted: str, superseded: str, accession: str) -> DataFrame:
    """The best-known fact of each key at as_of: first not superseded, then accepted last, then the greatest accession."""
    best = W.partitionBy(*keys).orderBy(F.asc(superseded), F.desc(accepted), F.desc(accession))
    return facts.where(F.col(accepted) <= as_of).withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn")


def as_of_backward(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, value: str, tie: str) -> DataFrame:
    """left with the last value of right at or before left_ts: one sort by (key, time) over both sides, no range join."""
    marks = right.select(F.col(key).alias("_k"), F.col(right_ts).alias("_t"), F.struct(F.col(right_ts).alias("ts"), F.col(value).alias("value")).alias("_v"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"))
    rows = left.select(F.col(key).alias("_k"), F.col(left_ts).alias("_t"), F.struct(*left.columns).alias("_row"), F.lit(1).alias("_side"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    seen = F.last("_v", ignorenulls=True).over(W.partitionBy("_k").orderBy("_t", "_side", "_tie").rowsBetween(W.unboundedPreceding, 0))
    out = both.withColumn("_seen", seen).where("_side = 1")
    return out.select("_row.*", F.col("_seen.ts").alias("as_of_ts"), F.col("_seen.value").alias("as_of_value"))


def nearest_within(rows: DataFrame, key: str, date: str, target: Column, tolerance_days: int) -> DataFrame:
    """For each row the date of the same key that is nearest to `target`, within the tolerance; the earliest wins ties."""
    dates = rows.select(F.col(key).alias("_k"), F.col(date).alias("near")).distinct()
    # an equality on a coarse bucket keeps the self-join linear in long histories
    width = tolerance_days + 1
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / width)
    left = rows.withColumn("_target", target).withColumn("_b", F.explode(F.array(*[bucket(F.col("_target")) + i for i in (-1, 0, 1)])))
    gap = F.abs(F.datediff("near", "_target"))
    found = left.join(dates.withColumn("_b2", bucket(F.col("near"))), (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_b2")) & (gap <= tolerance_days))
    best = found.groupBy(key, date).agg(F.min(F.struct(gap.alias("gap"), F.col("near"))).alias("x"))
    return rows.join(best, [key, date], "left").withColumns({"near": F.col("x.near"), "gap": F.col("x.gap")}).drop("x")


def band_previous(rows: DataFrame, key: str, date: str, low: int, high: int) -> DataFrame:
    """The latest date of the same key that lies low to high days before: an off-grid date between does not matter.

    A range frame finds it in one sorted pass.
    """
    day = F.datediff(F.col(date), F.lit("1970-01-01"))
    frame = W.partitionBy(key).orderBy("_day").rangeBetween(-high, -low)
    return rows.withColumn("_day", day).withColumn("previous", F.max(date).over(frame)).drop("_day")


def adjust_by_later(rows: DataFrame, events: DataFrame, key: str, row_date: str, event_date: str, ratio: str) -> DataFrame:
    """rows with the product of the ratios of all events of the key on or after the row's date (1 without any).

    One running product over each key's dates, the last first; rows of one date are one mark.
    """
    marks = rows.select(F.col(key).alias("_k"), F.col(row_date).alias("_d")).distinct().withColumn("_r", F.lit(None).cast("double"))
    days = events.groupBy(F.col(key).alias("_k"), F.col(event_date).alias("_d")).agg(F.product(ratio).alias("_r"))
    later = W.partitionBy("_k").orderBy(F.desc("_day")).rangeBetween(W.unboundedPreceding, 0)
    both = marks.withColumn("_mark", F.lit(True)).unionByName(days.withColumn("_mark", F.lit(False))).withColumn("_day", F.datediff("_d", F.lit("1970-01-01")))
    factors = both.withColumn("factor", F.coalesce(F.product("_r").over(later), F.lit(1.0))).where("_mark").select("_k", "_d", "factor")
    return rows.join(factors, rows[key].eqNullSafe(factors["_k"]) & rows[row_date].eqNullSafe(factors["_d"]), "left").drop("_k", "_d").fillna(1.0, ["factor"])


def overlay(base: DataFrame, patch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """patch, one row a key, and the rows of base whose key it lacks."""
    first = W.partitionBy(*keys).orderBy(*order)
    once = patch.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    return once.unionByName(base.join(once.select(*keys), keys, "left_anti"))
