"""Cross-sectional queries over line items, orders and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking, timeseries
from .prices import bars


def _read(spark, sf_dir, t):
    return spark.read.parquet(f"{sf_dir}/{t}.parquet")


def _supplier_figures(spark, sf_dir):
    li = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.round(F.avg("l_quantity"), 4).alias("quantity"),
        F.round(F.avg("l_discount"), 6).alias("discount"), F.round(F.stddev_samp("l_extendedprice"), 2).alias("spread"))
    s = _read(spark, sf_dir, "supplier").join(_read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select("s_suppkey", "s_nationkey", "n_regionkey", "s_acctbal").join(li, "s_suppkey")


def winsor_zscore_composite(spark, sf_dir):
    out = ranking.composite(_supplier_figures(spark, sf_dir), "s_suppkey", "n_regionkey", {"revenue": 1, "quantity": 1, "discount": -1, "spread": -1})
    return out.select("s_suppkey", "cohort", F.round("composite", 5).alias("composite"), "rank_score")


def volatility_cap(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.round(F.stddev_samp("l_extendedprice"), 2).alias("sd"))
    return ranking.volatility_cap(rows, "sd")


def peer_percentile_widen(spark, sf_dir):
    out = ranking.widened_percentile(_supplier_figures(spark, sf_dir), "revenue", "s_nationkey", "n_regionkey")
    return out.select("s_suppkey", "widened", F.round("share", 6).alias("share"))


def upper_median(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(ranking.upper_median("l_extendedprice").alias("upper_median"))


def decile_excess(spark, sf_dir):
    li = _read(spark, sf_dir, "lineitem").select("l_extendedprice", "l_discount", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("tie"))
    out = ranking.deciles(li, "l_extendedprice", "tie")
    return out.groupBy("decile").agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 3).alias("mean_discount"), F.min("l_extendedprice").alias("from_price"))


def _positions(spark, sf_dir):
    """A position for each order: entered and left at prices from its keys."""
    return _read(spark, sf_dir, "orders").select(
        "o_orderkey", F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01")).alias("entry_idx"), F.col("o_orderpriority").alias("kind"),
        F.round((F.col("o_totalprice") % 1000) / 20000 - 0.02, 7).alias("net"), F.round((F.col("o_custkey") % 100) / 10000 - 0.004, 6).alias("bench"),
        F.when(F.col("o_orderstatus") == "O", "open").otherwise("complete").alias("status"))


def slot_portfolio(spark, sf_dir):
    out = ranking.slot_portfolio(_positions(spark, sf_dir), "entry_idx", "net")
    # nine digits after the point of the logarithm are nine significant digits of the growth, at any size
    growth = F.coalesce(F.exp(F.round("log_growth", 9)), F.col("growth"))
    return out.select("slot", growth.alias("growth"), F.round("log_growth", 6).alias("log_growth"), "positions")


def block_statistics(spark, sf_dir):
    p = _positions(spark, sf_dir).withColumn("excess", F.col("net") - F.col("bench"))
    out = ranking.blocks(p, "entry_idx", "net", "excess")
    return out.select("block", "n", (F.round("mean_net", 4) + 0.0).alias("mean_net"), (F.round("mean_excess", 4) + 0.0).alias("mean_excess"))


def position_recap(spark, sf_dir):
    out = ranking.recap(_positions(spark, sf_dir), "kind", "net", "status")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_net", "win_rate")})


def position_returns(spark, sf_dir):
    """A position opened at each bar and closed 20 sessions on, ten basis points each way; and the share of a ticker that wins."""
    b = bars(spark, sf_dir)
    w = timeseries.by_session()
    p = b.select("ticker", "date", F.lead("open", 1).over(w).alias("entry"), F.lead("close", 21).over(w).alias("exit"))
    out = p.withColumn("net", ranking.position_return("entry", "exit", 0.001))
    return out.select("ticker", "date", F.round("net", 6).alias("net"), F.when(F.col("entry").isNull(), "not-entered").when(F.col("exit").isNull(), "open").otherwise("complete").alias("status"))


def screen_first_failure_census(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    test = ranking.first_failure([
        ("price", F.col("o_totalprice") >= 1000), ("balance", F.col("c_acctbal") > 0), ("segment", ~F.col("c_mktsegment").isin("MACHINERY")),
        ("status", F.col("o_orderstatus") != "P"), ("priority", F.col("o_orderpriority") < "4"),
    ])
    return ranking.census(o.withColumn("test", F.coalesce(test, F.lit("passed"))), "test")


QUERIES = {f.__name__: f for f in (winsor_zscore_composite, volatility_cap, peer_percentile_widen, upper_median, decile_excess, slot_portfolio, block_statistics, position_recap, position_returns, screen_first_failure_census)}

_FIGURES = """f AS (
  SELECT s_suppkey, s_nationkey, n_regionkey, revenue, quantity, discount, spread FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN (
    SELECT l_suppkey, round(sum(l_extendedprice), 2) AS revenue, round(avg(l_quantity), 4) AS quantity, round(avg(l_discount), 6) AS discount,
           round(stddev_samp(l_extendedprice), 2) AS spread FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey)"""
_POSITIONS = """p AS (
  SELECT o_orderkey, datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS entry_idx, o_orderpriority AS kind,
         round((o_totalprice % 1000) / 20000 - 0.02, 7) AS net, round((o_custkey % 100) / 10000 - 0.004, 6) AS bench,
         CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'complete' END AS status FROM orders)"""


def _z(column: str, over: str) -> tuple[str, str]:
    clip = f"CASE WHEN count({column}) OVER ({over}) < 5 THEN {column} ELSE least(quantile_cont({column}, 0.98) OVER ({over}), greatest(quantile_cont({column}, 0.02) OVER ({over}), {column})) END"
    return clip, f"CASE WHEN stddev_samp(w_{column}) OVER ({over}) > 0 THEN (w_{column} - avg(w_{column}) OVER ({over})) / stddev_samp(w_{column}) OVER ({over}) ELSE 0 END"


_SIGNALS = ("revenue", "quantity", "discount", "spread")
ORACLE_SQL = {
    "winsor_zscore_composite": f"""WITH {_FIGURES},
c AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY n_regionkey) >= 8 THEN CAST(n_regionkey AS VARCHAR) ELSE '*' END AS cohort FROM f),
gw AS (SELECT s_suppkey, cohort, {', '.join(_z(s, 'PARTITION BY cohort')[0] + f' AS w_{s}' for s in _SIGNALS)} FROM c),
gz AS (SELECT s_suppkey, cohort, {', '.join(_z(s, 'PARTITION BY cohort')[1] + f' AS z_{s}' for s in _SIGNALS)} FROM gw),
aw AS (SELECT s_suppkey, {', '.join(_z(s, '')[0] + f' AS w_{s}' for s in _SIGNALS)} FROM c),
az AS (SELECT s_suppkey, {', '.join(_z(s, '')[1] + f' AS z_{s}' for s in _SIGNALS)} FROM aw),
z AS (SELECT s_suppkey, cohort, {', '.join(f"CASE WHEN cohort = '*' THEN az.z_{s} ELSE gz.z_{s} END AS {s}" for s in _SIGNALS)} FROM gz JOIN az USING (s_suppkey)),
m AS (SELECT s_suppkey, cohort, (revenue + quantity - discount - spread) / 4 AS m FROM z)
SELECT s_suppkey, cohort, round(m, 5) AS composite, CAST(floor(100 * cume_dist() OVER (ORDER BY round(m, 9)) + 0.5) AS INTEGER) AS rank_score FROM m""",
    "volatility_cap": """WITH r AS (SELECT l_partkey, round(stddev_samp(l_extendedprice), 2) AS sd FROM lineitem GROUP BY 1),
c AS (SELECT quantile_cont(sd, 0.85) AS cut, count(sd) AS n FROM r) SELECT l_partkey, sd FROM r, c WHERE n < 5 OR sd <= cut""",
    "peer_percentile_widen": f"""WITH {_FIGURES}
SELECT s_suppkey, count(*) OVER (PARTITION BY s_nationkey) < 8 AS widened,
  round(CASE WHEN count(*) OVER (PARTITION BY s_nationkey) < 8 THEN cume_dist() OVER (PARTITION BY n_regionkey ORDER BY revenue)
             ELSE cume_dist() OVER (PARTITION BY s_nationkey ORDER BY revenue) END, 6) AS share FROM f""",
    "upper_median": "SELECT l_suppkey, list_sort(list(l_extendedprice))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS upper_median FROM lineitem GROUP BY 1",
    "decile_excess": """WITH r AS (SELECT *, row_number() OVER (ORDER BY l_extendedprice, l_orderkey * 8 + l_linenumber) AS rn, count(*) OVER () AS n FROM lineitem),
d AS (SELECT *, CAST(least(10, floor((rn - 1) / floor(n / 10)) + 1) AS INTEGER) AS decile FROM r)
SELECT decile, count(*) AS n, round(avg(l_discount), 3) AS mean_discount, min(l_extendedprice) AS from_price FROM d GROUP BY 1""",
    "slot_portfolio": f"""WITH {_POSITIONS}, g AS (SELECT entry_idx % 21 AS slot, sum(ln(1 + net)) AS l, count(*) AS positions FROM p GROUP BY 1)
SELECT CAST(s.s AS INTEGER) AS slot, exp(round(coalesce(l, 0), 9)) AS growth, round(coalesce(l, 0), 6) AS log_growth, coalesce(positions, 0) AS positions FROM range(21) s(s) LEFT JOIN g ON g.slot = s.s""",
    "block_statistics": f"""WITH {_POSITIONS} SELECT CAST(floor((entry_idx - (SELECT min(entry_idx) FROM p)) / 21) AS BIGINT) AS block, count(*) AS n,
  round(avg(net), 4) + 0.0 AS mean_net, round(avg(net - bench), 4) + 0.0 AS mean_excess FROM p GROUP BY 1""",
    "position_recap": f"""WITH {_POSITIONS} SELECT kind, count(*) FILTER (WHERE status = 'complete') AS complete, count(*) FILTER (WHERE status = 'complete' AND net > 0) AS wins,
  count(*) FILTER (WHERE status = 'complete' AND net <= 0) AS losses, round(avg(net) FILTER (WHERE status = 'complete'), 6) AS mean_net,
  round(count(*) FILTER (WHERE status = 'complete' AND net > 0) / nullif(count(*) FILTER (WHERE status = 'complete'), 0), 6) AS win_rate,
  count(*) FILTER (WHERE status <> 'complete') AS open FROM p GROUP BY 1""",
    "position_returns": """WITH bars AS (
  SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS date, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open,
         arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close FROM orders GROUP BY ALL),
p AS (SELECT ticker, date, lead(open, 1) OVER w AS entry, lead(close, 21) OVER w AS exit FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date))
SELECT ticker, date, CASE WHEN entry > 0 THEN round(exit * (1 - 0.001) / (entry * (1 + 0.001)) - 1, 6) END AS net,
  CASE WHEN entry IS NULL THEN 'not-entered' WHEN exit IS NULL THEN 'open' ELSE 'complete' END AS status FROM p""",
    "screen_first_failure_census": """WITH t AS (SELECT CASE WHEN NOT o_totalprice >= 1000 THEN 'price' WHEN NOT c_acctbal > 0 THEN 'balance' WHEN c_mktsegment = 'MACHINERY' THEN 'segment'
  WHEN o_orderstatus = 'P' THEN 'status' WHEN NOT o_orderpriority < '4' THEN 'priority' ELSE 'passed' END AS test FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT test, count(*) AS n FROM t GROUP BY 1""",
}
