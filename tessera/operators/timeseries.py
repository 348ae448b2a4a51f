"""Session time series over daily bars (ticker, date, open, high, low, close, volume).

Every frame counts sessions (rows of a ticker), not days, and is null until it is full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TRADING_DAYS = 252


def by_session(key: str = "ticker", date: str = "date"):
    return W.partitionBy(key).orderBy(date)


def daily_bars(ticks: DataFrame, key: str, ts: str, price: str, size: Column, tie: str) -> DataFrame:
    """Open, high, low, close and volume by key and day; ties of time are broken by `tie`."""
    day = F.to_date(F.col(ts))
    at = F.struct(F.col(ts), F.col(tie))
    return ticks.groupBy(F.col(key).alias("ticker"), day.alias("date")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(size).alias("volume"),
    )


def calendar(bars: DataFrame) -> DataFrame:
    """The trading calendar: each distinct date with its session index from 0.

    Dates are few whatever the data (one a day), so they are numbered in one partition after the distinct.
    """
    return bars.select("date").distinct().withColumn("session_idx", F.row_number().over(W.orderBy("date")) - 1)


def full_frame(value: Column, n: int, key: str = "ticker", date: str = "date") -> Column:
    """value, or null while fewer than n sessions are there."""
    return F.when(F.row_number().over(by_session(key, date)) >= n, value)


def sma(n: int, column: str = "close") -> Column:
    return full_frame(F.avg(column).over(by_session().rowsBetween(1 - n, 0)), n)


def median_dollar_volume(n: int = 60) -> Column:
    value = F.percentile(F.col("close") * F.col("volume"), F.lit(0.5)).over(by_session().rowsBetween(1 - n, 0))
    return full_frame(value, n)


def with_log_returns(bars: DataFrame) -> DataFrame:
    before = F.lag("close").over(by_session())
    return bars.withColumn("log_return", F.when((F.col("close") > 0) & (before > 0), F.log(F.col("close") / before)))


def realised_vol(n: int = 60) -> Column:
    """Sample deviation of the last n log returns; null if one of them is missing. Needs with_log_returns()."""
    frame = by_session().rowsBetween(1 - n, 0)
    return F.when(F.count("log_return").over(frame) == n, F.stddev_samp("log_return").over(frame))


def trailing_return(n: int) -> Column:
    before = F.lag("close", n).over(by_session())
    return F.when(before > 0, F.col("close") / before - 1)


def momentum_12_1(skip: int = 21, span: int = 252, paid: str | None = None) -> Column:
    """The close `skip` sessions ago against that of `span` sessions ago; with `paid`, the running sum of dividends, those between count."""
    late, early = F.lag("close", skip).over(by_session()), F.lag("close", span).over(by_session())
    if paid is not None:
        late = late + F.lag(paid, skip).over(by_session()) - F.lag(paid, span).over(by_session())
    return F.when(early > 0, late / early - 1)


def with_paid(bars: DataFrame, dividends: DataFrame, column: str = "paid") -> DataFrame:
    """Bars with the running sum of the ticker's dividends up to each date; dividends (ticker, ex_date, amount). One sort a ticker."""
    days = dividends.groupBy("ticker", F.col("ex_date").alias("date")).agg(F.sum("amount").alias("_amount")).withColumn("_bar", F.lit(False))
    both = bars.withColumn("_bar", F.lit(True)).unionByName(days, allowMissingColumns=True)
    frame = W.partitionBy("ticker").orderBy("date", "_bar").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(column, F.coalesce(F.sum("_amount").over(frame), F.lit(0.0))).where("_bar").select(*bars.columns, column)


def dividends_within(bars: DataFrame, dividends: DataFrame, n: int) -> DataFrame:
    """Bars with the sum of dividends in the half-open window (date n sessions ago, date]: a difference of running sums."""
    before = F.lag("_paid", n).over(by_session())
    # equal sums differ by exactly nothing, so that no dividend reads 0
    return with_paid(bars, dividends, "_paid").withColumn("paid", F.coalesce(F.col("_paid") - before, F.lit(0.0))).drop("_paid")


def extension(short: int = 50, vol: int = 60) -> Column:
    """How many daily deviations the close is above its average. Needs with_log_returns()."""
    average, deviation = sma(short), realised_vol(vol)
    return F.when((average > 0) & (deviation > 0), (F.col("close") / average - 1) / deviation)


def above_trend(n: int = 200) -> Column:
    """Whether the close is above its average; null without the sessions for one."""
    return F.col("close") > sma(n)


def prior_volume_ratio(n: int = 20) -> Column:
    """Volume over the average of the n sessions before, today left out."""
    before = F.avg("volume").over(by_session().rowsBetween(-n, -1))
    return full_frame(F.when(before > 0, F.col("volume") / before), n + 1)


def share_of_high(n: int = 60) -> Column:
    return F.col("close") / F.max("close").over(by_session().rowsBetween(1 - n, 0))


def drawdown(value: str, key: str = "ticker", date: str = "date") -> Column:
    peak = F.max(value).over(by_session(key, date).rowsBetween(W.unboundedPreceding, 0))
    return F.least(F.lit(0.0), F.col(value) / peak - 1)


def equity(column: str, key: str = "ticker", date: str = "date") -> Column:
    """Compounded growth of 1 + column, which must be above -1."""
    return F.exp(F.sum(F.log1p(column)).over(by_session(key, date).rowsBetween(W.unboundedPreceding, 0)))


def t_statistic(values: DataFrame, value: str, key: str) -> DataFrame:
    s = F.stddev_samp(value)
    return values.groupBy(key).agg(F.count(value).alias("n"), F.when((F.count(value) >= 2) & (s > 0), F.avg(value) / (s / F.sqrt(F.count(value)))).alias("t"))


def newey_west(values: DataFrame, value: str, key: str, order: str, lags: int = 21) -> DataFrame:
    """t statistic of the mean with Bartlett weights over autocovariances up to `lags`; null for fewer than three values."""
    rows = values.where(F.col(value).isNotNull())
    mean = F.avg(value).over(W.partitionBy(key))
    rows = rows.select(key, (F.col(value) - mean).alias("u"), mean.alias("mean"), F.row_number().over(W.partitionBy(key).orderBy(order)).alias("rn"))
    own = W.partitionBy(key).orderBy("rn")
    lagged = rows.select(key, "u", "mean", *[(F.col("u") * F.lag("u", j).over(own)).alias(f"p{j}") for j in range(lags + 1)])
    sums = lagged.groupBy(key).agg(F.count("*").alias("n"), F.first("mean").alias("mean"), *[F.coalesce(F.sum(f"p{j}"), F.lit(0.0)).alias(f"s{j}") for j in range(lags + 1)])
    spread = F.col("s0") / F.col("n")
    for j in range(1, lags + 1):
        spread = spread + 2 * (1 - j / (lags + 1)) * F.col(f"s{j}") / F.col("n")
    return sums.select(key, "n", "mean", F.when((F.col("n") >= 3) & (F.col("s0") > 0) & (spread > 0), F.col("mean") / F.sqrt(spread / F.col("n"))).alias("t"))
