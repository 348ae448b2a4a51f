"""Queries over periods: sessions, trailing sums, year-to-date differences, estimates and snapshots."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import calendar as cal
from ..operators import timeseries as ts
from .prices import bars


def _read(spark, sf_dir, t):
    return spark.read.parquet(f"{sf_dir}/{t}.parquet")


def _quarters(spark, sf_dir):
    """Order totals in cents by customer and quarter, numbered through."""
    o = _read(spark, sf_dir, "orders")
    return o.groupBy("o_custkey", F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).agg(
        F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents")).withColumn("period", F.col("year") * 4 + F.col("quarter"))


def entry_sessions(spark, sf_dir):
    """The session at or after each month's first day among the shipments' months, and the one 20 sessions on."""
    c = ts.calendar(bars(spark, sf_dir))
    months = _read(spark, sf_dir, "lineitem").select(F.trunc(F.to_date("l_shipdate"), "month").alias("month")).distinct()
    out = cal.session_at_or_after(months, c, "month")
    return out.select(F.col("month").cast("string").alias("month"), "session_idx", F.when(F.col("session_idx") >= 0, F.col("session_idx") + 20).alias("exit_idx"))


def trailing_four_quarters(spark, sf_dir):
    out = cal.trailing_sum(_quarters(spark, sf_dir), "o_custkey", "period", "cents")
    prior = F.lag("trailing").over(W.partitionBy("o_custkey").orderBy("period"))
    return out.select("o_custkey", "period", F.col("trailing").alias("ttm"), F.round(cal.growth(F.col("trailing"), prior), 6).alias("growth"))


def quarters_from_year_to_date(spark, sf_dir):
    q = _quarters(spark, sf_dir)
    ytd = q.withColumn("ytd", F.sum("cents").over(W.partitionBy("o_custkey", "year").orderBy("quarter").rowsBetween(W.unboundedPreceding, 0)))
    return cal.from_year_to_date(ytd, "o_custkey", "year", "quarter", "ytd").select("o_custkey", "period", "single")


def next_order_estimate(spark, sf_dir):
    days = _read(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day")).distinct()
    out = cal.next_by_median_gap(days, "o_custkey", "day")
    return out.withColumns({c: F.col(c).cast("string") for c in ("last", "expected")})


def part_of_the_day(spark, sf_dir):
    """For each day of events the part whose turn it is among all parts in order of their keys."""
    parts = _read(spark, sf_dir, "part").select("p_partkey", "p_name")
    days = _read(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct().crossJoin(F.broadcast(parts.agg(F.count("*").alias("n"))))
    turns = days.select("day", cal.of_the_day(F.col("day"), F.col("n")).alias("turn"))
    return cal.numbered(parts, "p_partkey", "turn").join(F.broadcast(turns), "turn").select("p_partkey", F.col("day").cast("string").alias("day"), "p_name")


def snapshot_changes(spark, sf_dir):
    """Users' last event kinds at two times, each from all events before it: who came, went or changed."""
    e = _read(spark, sf_dir, "events")
    last = lambda cut: e.where(F.col("ts") < F.lit(cut).cast("timestamp_ntz")).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"), F.count("*").alias("n"))
    return cal.changes(last("2024-01-04"), last("2024-01-05"), "user_id", ["kind"])


def step_dates(spark, sf_dir):
    """Each user's days with an error event, with the days before and after them on which there was one."""
    days = _read(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", F.to_date("ts").alias("day")).distinct()
    w = W.partitionBy("user_id").orderBy("day")
    return days.select("user_id", F.col("day").cast("string").alias("day"), F.lag("day").over(w).cast("string").alias("before"), F.lead("day").over(w).cast("string").alias("after"))


def claimed_keys(spark, sf_dir):
    """Line items by (part, ship day), joined to suppliers only where the key is claimed once and by one supplier."""
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.to_date("l_shipdate").alias("day"), "l_suppkey")
    keys = li.groupBy("l_partkey", "day").agg(F.count("*").alias("n"), F.min("l_suppkey").alias("owner"), F.max("l_suppkey").alias("other")).where("n > 1 and owner = other")
    return li.join(keys.select("l_partkey", "day", "owner"), ["l_partkey", "day"]).select("l_orderkey", "l_linenumber", "owner")


def sector_groups(spark, sf_dir):
    """Ordered ranges over part sizes and prices, with counts."""
    from ..functions.text import first_rule

    p, size = _read(spark, sf_dir, "part"), F.col("p_size")
    group = first_rule([("tiny", size.between(1, 5)), ("dear", F.col("p_retailprice") > 1500), ("small", size.between(6, 15)), ("middle", size.between(16, 35))], "large")
    return p.groupBy(group.alias("sector")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part"))


QUERIES = {
    f.__name__: f
    for f in (entry_sessions, trailing_four_quarters, quarters_from_year_to_date, next_order_estimate, part_of_the_day, snapshot_changes, step_dates, claimed_keys, sector_groups)
}
_Q = """q AS (SELECT o_custkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, year(o_orderdate) * 4 + quarter(o_orderdate) AS period,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY ALL)"""
ORACLE_SQL = {
    "entry_sessions": """WITH c AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)),
m AS (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS m FROM lineitem), f AS (SELECT m, min(i) AS i FROM m LEFT JOIN c ON d >= m GROUP BY m)
SELECT CAST(m AS VARCHAR) AS month, CAST(coalesce(i, -1) AS INTEGER) AS session_idx, CAST(i + 20 AS INTEGER) AS exit_idx FROM f""",
    "trailing_four_quarters": f"""WITH {_Q}, t AS (SELECT a.o_custkey, a.period, CASE WHEN count(b.period) = 4 THEN CAST(sum(b.cents) AS BIGINT) END AS ttm
  FROM q a JOIN q b ON a.o_custkey = b.o_custkey AND a.period - b.period BETWEEN 0 AND 3 GROUP BY ALL)
SELECT o_custkey, period, ttm, CASE WHEN lag(ttm) OVER w > 0 THEN round(ttm / lag(ttm) OVER w - 1, 6) END AS growth FROM t WINDOW w AS (PARTITION BY o_custkey ORDER BY period)""",
    "quarters_from_year_to_date": f"""WITH {_Q} SELECT a.o_custkey, a.period, CASE WHEN a.q = 1 OR b.q IS NOT NULL THEN a.cents END AS single
FROM q a LEFT JOIN q b ON a.o_custkey = b.o_custkey AND a.y = b.y AND b.q = a.q - 1""",
    "next_order_estimate": """WITH d AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders),
g AS (SELECT *, day - lag(day) OVER (PARTITION BY o_custkey ORDER BY day) AS gap, row_number() OVER (PARTITION BY o_custkey ORDER BY day DESC) AS rn FROM d),
s AS (SELECT o_custkey, max(day) AS last, median(gap) FILTER (WHERE rn <= 8) AS m, count(gap) FILTER (WHERE rn <= 8) AS n, max(gap) FILTER (WHERE rn <= 8) - min(gap) FILTER (WHERE rn <= 8) AS r FROM g GROUP BY 1)
SELECT o_custkey, CAST(last AS VARCHAR) AS last, CAST(last + CAST(floor(m + 0.5) AS INTEGER) AS VARCHAR) AS expected,
  CAST(CASE WHEN n >= 2 THEN greatest(3, floor(r / 2 + 0.5)) ELSE 14 END AS INTEGER) AS spread, n AS n_gaps FROM s WHERE n > 0""",
    "part_of_the_day": """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events), p AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part)
SELECT CAST(d AS VARCHAR) AS day, p_partkey, p_name FROM d JOIN p ON i = datediff('day', DATE '1970-01-01', d) % n""",
    "snapshot_changes": """WITH o AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS k FROM events WHERE ts < '2024-01-04' GROUP BY 1),
n AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS k FROM events WHERE ts < '2024-01-05' GROUP BY 1),
c AS (SELECT coalesce(o.user_id, n.user_id) AS user_id, CASE WHEN o.user_id IS NULL THEN 'came' WHEN n.user_id IS NULL THEN 'went' WHEN o.k <> n.k THEN 'changed' END AS change FROM o FULL JOIN n ON o.user_id = n.user_id)
SELECT * FROM c WHERE change IS NOT NULL""",
    "step_dates": """WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'error')
SELECT user_id, CAST(d AS VARCHAR) AS day, CAST(lag(d) OVER w AS VARCHAR) AS before, CAST(lead(d) OVER w AS VARCHAR) AS after FROM d WINDOW w AS (PARTITION BY user_id ORDER BY d)""",
    "claimed_keys": """SELECT l_orderkey, l_linenumber, owner FROM (
  SELECT l_orderkey, l_linenumber, count(*) OVER k AS n, min(l_suppkey) OVER k AS owner, max(l_suppkey) OVER k AS other FROM lineitem WINDOW k AS (PARTITION BY l_partkey, CAST(l_shipdate AS DATE))) x
WHERE n > 1 AND owner = other""",
    "sector_groups": """SELECT CASE WHEN p_size BETWEEN 1 AND 5 THEN 'tiny' WHEN p_retailprice > 1500 THEN 'dear' WHEN p_size BETWEEN 6 AND 15 THEN 'small' WHEN p_size BETWEEN 16 AND 35 THEN 'middle' ELSE 'large' END AS sector,
  count(*) AS n, min(p_partkey) AS first_part FROM part GROUP BY 1""",
}
