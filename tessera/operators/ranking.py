"""Cross-sectional ranking: winsorised z-scores in cohorts, percentiles, deciles, ordered screens and position measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cohort_z(rows: DataFrame, signals: list[str], cohort: str, everyone: str = "*", p: float = 0.02, least: int = 5) -> DataFrame:
    """rows with a column z_<signal> each: (value - mean) / sample deviation after clipping to the p and 1 - p quantiles, within
    the cohort, or within all rows where the cohort is `everyone`. Groups of fewer than `least` values are not clipped; z is 0
    where the deviation is 0 or unknown. Statistics are two aggregations joined back, so no task holds a cohort's rows."""

    def of_cohorts(table: DataFrame, exprs: list[Column]) -> DataFrame:
        each = table.where(F.col(cohort) != everyone).groupBy(F.col(cohort).alias("_c")).agg(*exprs)
        return each.unionByName(table.agg(*exprs).withColumn("_c", F.lit(everyone)).select(each.columns))

    quantiles = [F.percentile(s, F.lit(q)).alias(f"_{n}_{s}") for s in signals for n, q in (("lo", p), ("hi", 1 - p))]
    bounds = of_cohorts(rows, quantiles + [F.count(s).alias(f"_n_{s}") for s in signals])

    def clipped(table: DataFrame) -> DataFrame:
        cut = lambda s: F.when((F.col(f"_n_{s}") < least) | F.col(s).isNull(), F.col(s)).otherwise(F.least(f"_hi_{s}", F.greatest(f"_lo_{s}", s)))
        return table.withColumns({f"_w_{s}": cut(s) for s in signals})

    # all rows are clipped to the bounds of all rows for the statistics of everyone
    own = clipped(rows.join(bounds, rows[cohort] == bounds["_c"]).drop("_c"))
    whole = clipped(rows.crossJoin(F.broadcast(bounds.where(F.col("_c") == everyone).drop("_c"))))  # one row
    moments = [e for s in signals for e in (F.avg(f"_w_{s}").alias(f"_m_{s}"), F.stddev_samp(f"_w_{s}").alias(f"_d_{s}"))]
    each = own.where(F.col(cohort) != everyone).groupBy(F.col(cohort).alias("_c")).agg(*moments)
    stats = each.unionByName(whole.agg(*moments).withColumn("_c", F.lit(everyone)).select(each.columns))
    out = own.join(stats, own[cohort] == stats["_c"])
    z = lambda s: F.when(F.col(f"_w_{s}").isNull(), None).when(F.col(f"_d_{s}") > 0, (F.col(f"_w_{s}") - F.col(f"_m_{s}")) / F.col(f"_d_{s}")).otherwise(0.0)
    return out.select(*rows.columns, *[z(s).alias(f"z_{s}") for s in signals])


def share_at_most(rows: DataFrame, value: str, column: str, width: float = 0.001) -> DataFrame:
    """rows with the share of rows whose value is at most as high. Ranks come from counts of buckets of that width and from the
    order within a bucket, so no task sorts all rows; the buckets must be few, as for scores."""
    placed = rows.withColumn("_b", F.floor(F.col(value) / width))
    sizes = placed.groupBy("_b").agg(F.count("*").alias("_c"))
    before = sizes.select("_b", (F.sum("_c").over(W.orderBy("_b")) - F.col("_c")).alias("_before"), F.sum("_c").over(W.partitionBy()).alias("_total"))
    within = F.count("*").over(W.partitionBy("_b").orderBy(value).rangeBetween(W.unboundedPreceding, 0))
    return placed.join(before, "_b").withColumn(column, (F.col("_before") + within) / F.col("_total")).select(*rows.columns, column)


def composite(rows: DataFrame, key: str, group: str, signals: dict[str, int], least_peers: int = 8, least_signals: int = 3) -> DataFrame:
    """Mean of the directed z-scores that a row has (at least `least_signals`), within its group or, if that is too small, all rows.

    rank_score is the share of rows with a composite at most as high, in percent. A null group counts as too small.
    """
    sizes = rows.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_size"))
    cohort = F.when(F.col("_size") >= least_peers, F.col(group).cast("string")).otherwise("*")
    out = rows.join(sizes, rows[group] == sizes["_g"], "left").withColumn("cohort", F.coalesce(cohort, F.lit("*"))).drop("_g", "_size")
    out = cohort_z(out, list(signals), "cohort")
    zs = F.filter(F.array(*[d * F.col(f"z_{s}") for s, d in signals.items()]), lambda z: z.isNotNull())
    mean = F.aggregate(zs, F.lit(0.0), lambda a, z: a + z) / F.size(zs)
    out = out.withColumn("composite", F.when(F.size(zs) >= least_signals, mean)).select(*rows.columns, "cohort", "composite")
    known = share_at_most(out.where("composite is not null").select(key, F.round("composite", 9).alias("_order")), "_order", "_share")
    return out.join(known.select(key, F.floor(100 * F.col("_share") + 0.5).cast("int").alias("rank_score")), key, "left")


def volatility_cap(rows: DataFrame, column: str, percentile: float = 0.85, least: int = 5) -> DataFrame:
    """Rows at or under the percentile of the column; rows without it go; no cut for fewer than `least` values."""
    cut = rows.agg(F.percentile(column, F.lit(percentile)).alias("_cut"), F.count(column).alias("_n"))
    return rows.crossJoin(F.broadcast(cut)).where((F.col("_n") < least) | (F.col(column) <= F.col("_cut"))).drop("_cut", "_n")


def widened_percentile(rows: DataFrame, value: str, narrow: str, wide: str, least: int = 8) -> DataFrame:
    """Share of peers with a value at most as high: in the narrow group if it has `least` rows, else in the wide one."""
    n, w = W.partitionBy(narrow), W.partitionBy(wide)
    small = F.count("*").over(n) < least
    return rows.withColumns({"widened": small, "share": F.when(small, F.cume_dist().over(w.orderBy(value))).otherwise(F.cume_dist().over(n.orderBy(value)))})


def upper_median(column: str) -> Column:
    """sorted[n >> 1]: the upper one of two middle values, not their mean."""
    return F.expr(f"percentile_disc(0.5) within group (order by `{column}` desc)")


def deciles(rows: DataFrame, value: str, tie: str, n: int = 10) -> DataFrame:
    """Decile by rank of floor(count / n) rows each; what is left over all goes to the last. Rows are ranked by range-sorted
    parts: ranks come from the counts of the parts before, not from one task."""
    ordered = rows.withColumn("_bucket", F.floor(F.col(value)))
    sizes = ordered.groupBy("_bucket").agg(F.count("*").alias("_c"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    total = sizes.agg(F.sum("_c").alias("_total"))
    ranked = ordered.join(before.select("_bucket", "_before"), "_bucket").withColumn("_rn", F.col("_before") + F.row_number().over(W.partitionBy("_bucket").orderBy(value, tie)))
    size = F.floor(F.col("_total") / n)
    out = ranked.crossJoin(F.broadcast(total)).withColumn("decile", F.least(F.lit(n), F.floor((F.col("_rn") - 1) / size) + 1).cast("int"))
    return out.select(*rows.columns, "decile")


def first_failure(tests: list[tuple[str, Column]]) -> Column:
    """The name of the first test that a row fails (its condition does not hold or is unknown), or null."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in tests])


def census(rows: DataFrame, reason: str) -> DataFrame:
    return rows.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count("*").alias("n"))


def slot_portfolio(positions: DataFrame, entry_idx: str, net: str, slots: int = 21) -> DataFrame:
    """Growth of each slot (entry index modulo slots); a slot without positions stays at 1.

    log_growth is the sum of logarithms, which holds where the product leaves the range of a double; null if a position loses all.
    """
    grown = positions.groupBy((F.col(entry_idx) % slots).cast("int").alias("slot")).agg(
        F.product(1 + F.col(net)).alias("growth"), F.when(F.min(net) > -1, F.sum(F.log1p(net))).alias("_log"), F.count("*").alias("positions"))
    every = positions.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    out = every.join(grown, "slot", "left").withColumn("log_growth", F.when(F.col("positions").isNull(), 0.0).otherwise(F.col("_log")))
    return out.fillna({"growth": 1.0, "positions": 0}).drop("_log")


def blocks(positions: DataFrame, entry_idx: str, net: str, excess: str, sessions: int = 21) -> DataFrame:
    """Mean net and excess by non-overlapping blocks of entry sessions, counted from the first entry."""
    first = positions.agg(F.min(entry_idx).alias("_first"))
    return positions.crossJoin(F.broadcast(first)).groupBy(F.floor((F.col(entry_idx) - F.col("_first")) / sessions).cast("long").alias("block")).agg(
        F.count("*").alias("n"), F.avg(net).alias("mean_net"), F.avg(excess).alias("mean_excess"))


def position_return(entry_open: str, exit_close: str, cost: float) -> Column:
    """Net of a cost on both ways."""
    return F.when(F.col(entry_open) > 0, F.col(exit_close) * (1 - cost) / (F.col(entry_open) * (1 + cost)) - 1)


def mean_of_rounded(value: Column, digits: int = 6) -> Column:
    """The mean of values of so many digits, to as many (ties away from 0), in any order of the rows: sums of whole units are exact up to 2**53."""
    unit = float(10**digits)
    return F.round(F.avg(F.round(value * unit))) / unit


def recap(rows: DataFrame, by: str, net: str, status: str) -> DataFrame:
    """Complete positions only: count, wins (> 0), losses (<= 0), mean, win rate; null where there are none."""
    done = F.col(status) == "complete"
    n = F.count_if(done)
    return rows.groupBy(by).agg(
        n.alias("complete"), F.count_if(done & (F.col(net) > 0)).alias("wins"), F.count_if(done & (F.col(net) <= 0)).alias("losses"),
        F.avg(F.when(done, F.col(net))).alias("mean_net"), F.when(n > 0, F.count_if(done & (F.col(net) > 0)) / n).alias("win_rate"),
        F.count_if(~done).alias("open"))
