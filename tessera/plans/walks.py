"""Backtest samples, candidate pools, lesson weeks and pack checks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeseries as ts
from ..operators import walks
from .prices import _BARS, bars


def forward_sample(spark, sf_dir):
    """The priorities' bars against those of the most urgent one."""
    b = bars(spark, sf_dir)
    out = walks.forward_sample(b, ts.calendar(b), "1-URGENT")
    return out.select("ticker", "session_idx", F.round("trailing", 6).alias("r5"), F.round("excess", 6).alias("excess"))


def candidate_pool(spark, sf_dir):
    """Users with events on a day or the two before, with the first of these events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.to_date("ts").alias("on"))
    return walks.trailing_pool(e, "user_id", "on", "event_id", 3).select(F.col("day").cast("string").alias("day"), "user_id", F.col("first").alias("first_event"))


def lesson_weeks(spark, sf_dir):
    """The lesson of each order date: the regions are the packs, and lessons begin on the first Monday of 1992."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    dates = read("orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    of = dates.withColumns(walks.lesson_of(F.col("date"), F.lit("1992-01-01").cast("date"), 5))
    packs = read("region").select(F.col("r_regionkey").cast("int").alias("pack"), F.col("r_name").alias("name"))
    return of.join(packs, "pack", "left").select(F.col("date").cast("string").alias("date"), "week", "pack", "lesson", "name")


def pack_checks(spark, sf_dir):
    """Orders as packs of lines: numbered from 1, each with a quantity and a discount of at most 8 %."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return walks.pack_checks(rows, "l_orderkey", "l_linenumber", (F.col("l_quantity") >= 1) & (F.col("l_discount") <= 0.08))


QUERIES = {f.__name__: f for f in (forward_sample, candidate_pool, lesson_weeks, pack_checks)}
ORACLE_SQL = {
    "forward_sample": f"""WITH {_BARS}, cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS session_idx FROM (SELECT DISTINCT date FROM bars)),
s AS (SELECT ticker, open, close, session_idx FROM bars JOIN cal USING (date)),
m AS (SELECT a.ticker, a.session_idx, CASE WHEN b.close > 0 THEN a.close / b.close - 1 END AS r, CASE WHEN e.open > 0 THEN x.close / e.open - 1 END AS f
  FROM s a LEFT JOIN s b ON a.ticker = b.ticker AND b.session_idx = a.session_idx - 5 LEFT JOIN s e ON a.ticker = e.ticker AND e.session_idx = a.session_idx + 1
  LEFT JOIN s x ON a.ticker = x.ticker AND x.session_idx = a.session_idx + 21)
SELECT m.ticker, m.session_idx, round(m.r, 6) AS r5, round(m.f - k.f, 6) AS excess FROM m JOIN m k ON k.session_idx = m.session_idx AND k.ticker = '1-URGENT'
WHERE m.ticker <> '1-URGENT' AND m.r IS NOT NULL AND m.f IS NOT NULL AND k.f IS NOT NULL""",
    "candidate_pool": """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id FROM events), d AS (SELECT DISTINCT day FROM e),
p AS (SELECT d.day, user_id, event_id, row_number() OVER (PARTITION BY d.day, user_id ORDER BY e.day, event_id) AS place FROM d JOIN e ON e.day BETWEEN d.day - 2 AND d.day)
SELECT CAST(day AS VARCHAR) AS day, user_id, event_id AS first_event FROM p WHERE place = 1""",
    "lesson_weeks": """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders),
n AS (SELECT date, date_diff('day', CAST(date_trunc('week', DATE '1992-01-01' + 6) AS DATE), date) AS days FROM d),
w AS (SELECT date, CASE WHEN days >= 0 THEN days END AS days FROM n),
p AS (SELECT date, CAST(days // 7 AS INTEGER) AS week, CAST(days // 7 % 5 AS INTEGER) AS pack, CAST(days % 7 + 1 AS INTEGER) AS lesson FROM w)
SELECT CAST(date AS VARCHAR) AS date, week, pack, lesson, r_name AS name FROM p LEFT JOIN region ON pack = r_regionkey""",
    "pack_checks": """WITH p AS (SELECT l_orderkey, count(*) AS parts, count(DISTINCT l_linenumber) = count(*) AND min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AS numbered,
  bool_and(l_quantity >= 1 AND l_discount <= 0.08) AS filled FROM lineitem GROUP BY 1)
SELECT *, numbered AND filled AS valid FROM p""",
}
