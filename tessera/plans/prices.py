"""Time-series queries. Bars are the orders of a priority by day: price is o_totalprice, volume the number of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import timeseries as ts


def bars(spark, sf_dir: str) -> DataFrame:
    return ts.daily_bars(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderpriority", "o_orderdate", "o_totalprice", F.lit(1), "o_orderkey")


def daily_bars(spark, sf_dir):
    return bars(spark, sf_dir)


def trading_calendar(spark, sf_dir):
    return ts.calendar(bars(spark, sf_dir))


def sma_20(spark, sf_dir):
    return bars(spark, sf_dir).select("ticker", "date", F.round(ts.sma(20), 6).alias("sma_20"), F.round(ts.sma(200), 6).alias("sma_200"))


def median_dollar_volume_60(spark, sf_dir):
    return bars(spark, sf_dir).select("ticker", "date", F.round(ts.median_dollar_volume(60), 3).alias("median_dollar_volume"))


def realised_vol_60(spark, sf_dir):
    return ts.with_log_returns(bars(spark, sf_dir)).select("ticker", "date", F.round(ts.realised_vol(60), 6).alias("daily_vol"), F.round(ts.realised_vol(60) * F.sqrt(F.lit(ts.TRADING_DAYS)), 5).alias("annual_vol"))


def momentum_12_1(spark, sf_dir):
    b = bars(spark, sf_dir)
    return b.select("ticker", "date", F.round(ts.momentum_12_1(), 6).alias("momentum"), *[F.round(ts.trailing_return(n), 6).alias(f"r{n}") for n in (5, 20)])


def trailing_return_with_dividends(spark, sf_dir):
    """Every signup event is a dividend of its value, dealt to the tickers by user."""
    b = bars(spark, sf_dir)
    out = ts.dividends_within(b, _dividends(spark, sf_dir), 20)
    before = F.lag("close", 20).over(ts.by_session())
    return out.select("ticker", "date", (F.round("paid", 2) + 0.0).alias("paid"), F.round(F.when(before > 0, (F.col("close") + F.col("paid")) / before - 1), 6).alias("total_return"))


def _dividends(spark, sf_dir):
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'signup'").select(
        F.element_at(F.array(*map(F.lit, names)), (F.col("user_id") % 5 + 1).cast("int")).alias("ticker"), F.to_date("ts").alias("ex_date"), F.col("value").alias("amount"))


def momentum_with_dividends(spark, sf_dir):
    """Ten-to-two-session momentum with the dividends paid between; events fall into few weeks, so the spans are short."""
    b = ts.with_paid(bars(spark, sf_dir), _dividends(spark, sf_dir))
    return b.select("ticker", F.col("date").cast("string").alias("date"), F.round(ts.momentum_12_1(2, 10, "paid"), 6).alias("momentum"))


def extension_and_trend(spark, sf_dir):
    b = ts.with_log_returns(bars(spark, sf_dir))
    return b.select("ticker", F.col("date").cast("string").alias("date"), F.round(ts.extension(), 4).alias("extension"), ts.above_trend().alias("above_trend"))


def volume_and_high(spark, sf_dir):
    return bars(spark, sf_dir).select("ticker", "date", F.round(ts.prior_volume_ratio(20), 6).alias("vol_ratio"), F.round(ts.share_of_high(60), 6).alias("of_high"))


def drawdown(spark, sf_dir):
    b = bars(spark, sf_dir).select("ticker", "date", "close", F.round(ts.drawdown("close"), 6).alias("drawdown"))
    return b.groupBy("ticker").agg(F.min("drawdown").alias("max_drawdown"), F.count("*").alias("sessions"), F.count_if(F.col("drawdown") == 0).alias("at_peak"))


def equity_curve(spark, sf_dir):
    """Monthly changes of order totals, capped at one half each way, compounded."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    m = o.groupBy(F.col("o_orderpriority").alias("ticker"), F.trunc(F.to_date("o_orderdate"), "month").alias("date")).agg(F.sum("o_totalprice").alias("total"))
    change = F.col("total") / F.lag("total").over(ts.by_session()) - 1
    m = m.withColumn("net", F.coalesce(F.least(F.lit(0.5), F.greatest(F.lit(-0.5), change)), F.lit(0.0)))
    return m.select("ticker", "date", F.round(ts.equity("net"), 4).alias("equity"))


def newey_west(spark, sf_dir):
    out = ts.newey_west(ts.with_log_returns(bars(spark, sf_dir)), "log_return", "ticker", "date")
    return out.select("ticker", "n", F.round("mean", 6).alias("mean"), F.round("t", 3).alias("t"))


def t_statistic(spark, sf_dir):
    out = ts.t_statistic(ts.with_log_returns(bars(spark, sf_dir)), "log_return", "ticker")
    return out.select("ticker", "n", F.round("t", 4).alias("t"))


QUERIES = {f.__name__: f for f in (daily_bars, trading_calendar, sma_20, median_dollar_volume_60, realised_vol_60, momentum_12_1, trailing_return_with_dividends, volume_and_high, momentum_with_dividends, extension_and_trend, drawdown, equity_curve, newey_west, t_statistic)}

_BARS = """bars AS (
  SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS date,
         arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
         arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close, count(*) AS volume
  FROM orders GROUP BY ALL)"""
_S = "PARTITION BY ticker ORDER BY date"
_RETURNS = f"""r AS (
  SELECT *, CASE WHEN close > 0 AND lag(close) OVER ({_S}) > 0 THEN ln(close / lag(close) OVER ({_S})) END AS x FROM bars)"""

ORACLE_SQL = {
    "daily_bars": f"WITH {_BARS} SELECT * FROM bars",
    "trading_calendar": f"WITH {_BARS} SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS session_idx FROM (SELECT DISTINCT date FROM bars)",
    "sma_20": f"""WITH {_BARS}, s AS (
  SELECT ticker, date,
    CASE WHEN row_number() OVER ({_S}) >= 20 THEN round(avg(close) OVER ({_S} ROWS 19 PRECEDING), 6) END AS sma_20,
    CASE WHEN row_number() OVER ({_S}) >= 200 THEN round(avg(close) OVER ({_S} ROWS 199 PRECEDING), 6) END AS sma_200 FROM bars)
SELECT * FROM s""",
    "median_dollar_volume_60": f"""WITH {_BARS} SELECT ticker, date,
  CASE WHEN row_number() OVER ({_S}) >= 60 THEN round(quantile_cont(close * volume, 0.5) OVER ({_S} ROWS 59 PRECEDING), 3) END AS median_dollar_volume FROM bars""",
    "realised_vol_60": f"""WITH {_BARS}, {_RETURNS}, v AS (
  SELECT ticker, date, CASE WHEN count(x) OVER ({_S} ROWS 59 PRECEDING) = 60 THEN stddev_samp(x) OVER ({_S} ROWS 59 PRECEDING) END AS v FROM r)
SELECT ticker, date, round(v, 6) AS daily_vol, round(v * sqrt(252), 5) AS annual_vol FROM v""",
    "momentum_12_1": f"""WITH {_BARS} SELECT ticker, date,
  CASE WHEN lag(close, 252) OVER ({_S}) > 0 THEN round(lag(close, 21) OVER ({_S}) / lag(close, 252) OVER ({_S}) - 1, 6) END AS momentum,
  CASE WHEN lag(close, 5) OVER ({_S}) > 0 THEN round(close / lag(close, 5) OVER ({_S}) - 1, 6) END AS r5,
  CASE WHEN lag(close, 20) OVER ({_S}) > 0 THEN round(close / lag(close, 20) OVER ({_S}) - 1, 6) END AS r20 FROM bars""",
    "trailing_return_with_dividends": f"""WITH {_BARS}, s AS (
  SELECT ticker, date, close, lag(date, 20) OVER ({_S}) AS after, lag(close, 20) OVER ({_S}) AS before FROM bars),
p AS (SELECT ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][user_id % 5 + 1] AS ticker, CAST(ts AS DATE) AS ex, value FROM events WHERE event_type = 'signup'),
d AS (SELECT s.ticker, s.date, sum(value) AS paid FROM s JOIN p ON s.ticker = p.ticker AND ex > after AND ex <= date GROUP BY ALL)
SELECT s.ticker, s.date, round(coalesce(paid, 0), 2) AS paid, CASE WHEN before > 0 THEN round((close + coalesce(paid, 0)) / before - 1, 6) END AS total_return
FROM s LEFT JOIN d ON s.ticker = d.ticker AND s.date = d.date""",
    "momentum_with_dividends": f"""WITH {_BARS}, s AS (
  SELECT ticker, date, lag(close, 2) OVER ({_S}) AS late, lag(date, 2) OVER ({_S}) AS until, lag(close, 10) OVER ({_S}) AS early, lag(date, 10) OVER ({_S}) AS since FROM bars),
p AS (SELECT ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][user_id % 5 + 1] AS ticker, CAST(ts AS DATE) AS ex, value FROM events WHERE event_type = 'signup'),
d AS (SELECT s.ticker, s.date, sum(value) AS paid FROM s JOIN p ON s.ticker = p.ticker AND ex > since AND ex <= until GROUP BY ALL)
SELECT s.ticker, CAST(s.date AS VARCHAR) AS date, CASE WHEN early > 0 THEN round((late + coalesce(paid, 0)) / early - 1, 6) END AS momentum FROM s LEFT JOIN d ON s.ticker = d.ticker AND s.date = d.date""",
    "extension_and_trend": f"""WITH {_BARS}, {_RETURNS}, v AS (
  SELECT ticker, date, close, CASE WHEN row_number() OVER ({_S}) >= 50 THEN avg(close) OVER ({_S} ROWS 49 PRECEDING) END AS a, CASE WHEN row_number() OVER ({_S}) >= 200 THEN avg(close) OVER ({_S} ROWS 199 PRECEDING) END AS t,
    CASE WHEN count(x) OVER ({_S} ROWS 59 PRECEDING) = 60 THEN stddev_samp(x) OVER ({_S} ROWS 59 PRECEDING) END AS v FROM r)
SELECT ticker, CAST(date AS VARCHAR) AS date, CASE WHEN a > 0 AND v > 0 THEN round((close / a - 1) / v, 4) END AS extension, close > t AS above_trend FROM v""",
    "volume_and_high": f"""WITH {_BARS} SELECT ticker, date,
  CASE WHEN row_number() OVER ({_S}) >= 21 THEN round(volume / avg(volume) OVER ({_S} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 6) END AS vol_ratio,
  round(close / max(close) OVER ({_S} ROWS 59 PRECEDING), 6) AS of_high FROM bars""",
    "drawdown": f"""WITH {_BARS}, d AS (SELECT ticker, round(least(0, close / max(close) OVER ({_S} ROWS UNBOUNDED PRECEDING) - 1), 6) AS d FROM bars)
SELECT ticker, min(d) AS max_drawdown, count(*) AS sessions, count(*) FILTER (WHERE d = 0) AS at_peak FROM d GROUP BY ticker""",
    "equity_curve": f"""WITH m AS (SELECT o_orderpriority AS ticker, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, sum(o_totalprice) AS total FROM orders GROUP BY ALL),
n AS (SELECT ticker, date, coalesce(least(0.5, greatest(-0.5, total / lag(total) OVER ({_S}) - 1)), 0) AS net FROM m)
SELECT ticker, date, round(exp(sum(ln(1 + net)) OVER ({_S} ROWS UNBOUNDED PRECEDING)), 4) AS equity FROM n""",
    "newey_west": f"""WITH {_BARS}, {_RETURNS}, u AS (
  SELECT ticker, x - avg(x) OVER (PARTITION BY ticker) AS u, avg(x) OVER (PARTITION BY ticker) AS m, row_number() OVER ({_S}) AS rn FROM r WHERE x IS NOT NULL),
g AS (SELECT a.ticker, j.j AS j, sum(a.u * b.u) AS s FROM u a, range(0, 22) j(j), u b WHERE a.ticker = b.ticker AND b.rn = a.rn - j.j GROUP BY ALL),
n AS (SELECT ticker, count(*) AS n, any_value(m) AS mean FROM u GROUP BY ticker),
v AS (SELECT g.ticker, sum(CASE WHEN j = 0 THEN s / n ELSE 2 * (1 - j / 22.0) * s / n END) AS v FROM g JOIN n USING (ticker) GROUP BY g.ticker)
SELECT ticker, n, round(mean, 6) AS mean, CASE WHEN v > 0 THEN round(mean / sqrt(v / n), 3) END AS t FROM n JOIN v USING (ticker)""",
    "t_statistic": f"""WITH {_BARS}, {_RETURNS} SELECT ticker, count(x) AS n, round(avg(x) / (stddev_samp(x) / sqrt(count(x))), 4) AS t FROM r GROUP BY ticker""",
}
