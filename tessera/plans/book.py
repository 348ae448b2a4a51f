"""The walk of strategies over decision sessions. Suppliers are the stocks, months of shipments the sessions, the price of a piece the price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import book, ranking
from ..operators import timeseries as ts
from .tables import stored

HOLD = 6
SIGNALS = (
    book.Signal("growth"), book.Signal("margin", -1, ("operating", "energy", "utilities")), book.Signal("yield", 1, ("finance",)),
    book.Signal("momentum"), book.Signal("relative"), book.Signal("peer_percentile"), book.Signal("return1", -1),
)
PRICE_SIGNALS = tuple(s for s in SIGNALS if s.name in ("momentum", "relative", "return1"))
STRATEGIES = (
    book.Strategy("composite", book.by_composite(SIGNALS, "yield", most_extension=1), hold=HOLD, most_open=5, most_per_division=1),
    book.Strategy("price only", book.by_composite(PRICE_SIGNALS, "yield", most_extension=1), after="no_test", hold=HOLD, most_open=None, most_per_division=1),
    book.Strategy("rules v1", book.by_weighted_z({"return1": (1.0, None), "return3": (0.5, None), "volume_ratio": (0.5, 2.0)}), before="fails_v1", after="no_test", hold=11, most_open=None, most_per_division=None),
)


def _read(spark, sf_dir, t):
    return spark.read.parquet(f"{sf_dir}/{t}.parquet")


def monthly_bars(spark, sf_dir) -> DataFrame:
    """Open, close and volume of each supplier and month with shipments, its revenue, and its mean discount and tax."""
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return _read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("ticker"), F.to_date(F.trunc("l_shipdate", "month")).alias("date")).agg(
        F.min_by(price, at).alias("open"), F.max_by(price, at).alias("close"), F.sum("l_quantity").alias("volume"),
        F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.round(F.avg("l_tax"), 6).alias("tax"))


def candidates(spark, sf_dir, bars: DataFrame | None = None) -> DataFrame:
    """One row a session and supplier with a bar in it: tests, signals and groups. bars: the monthly ones, where they are written already."""
    bars = ts.with_log_returns(monthly_bars(spark, sf_dir) if bars is None else bars)
    w = ts.by_session()
    revenue = ts.full_frame(F.sum("revenue").over(w.rowsBetween(-2, 0)), 3)
    out = bars.select(
        "ticker", "date", "open", "close", F.row_number().over(w).alias("bars"), ts.median_dollar_volume(6).alias("liquidity"), ts.sma(6).alias("sma"),
        ts.realised_vol(6).alias("volatility"), ts.extension(6, 6).alias("extension"), *[ts.trailing_return(n).alias(f"return{n}") for n in (1, 3)], ts.momentum_12_1(1, 12).alias("momentum"),
        ts.prior_volume_ratio(6).alias("volume_ratio"), revenue.alias("revenue"), F.col("discount").alias("margin"), F.col("tax").alias("yield"),
    )
    before = F.lag("revenue", 3).over(w)
    out = out.withColumn("growth", F.when(before > 0, F.col("revenue") / before - 1)).join(ts.calendar(bars), "date").withColumn("session", F.col("session_idx").cast("long"))
    of = _read(spark, sf_dir, "supplier").join(_read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    sector = F.when(F.col("n_regionkey") == 0, "finance").when(F.col("n_regionkey") == 1, "utilities").when(F.col("n_regionkey") == 2, "energy").otherwise("operating")
    out = out.join(of.select(F.col("s_suppkey").cast("string").alias("ticker"), F.col("n_name").alias("division"), F.col("n_name").alias("major"), sector.alias("grp")), "ticker")
    middle = out.groupBy("session", F.col("grp").alias("_g")).agg(ranking.upper_median("return3").alias("_middle"))
    out = out.join(middle, (out["session"] == middle["session"]) & (out["grp"] == middle["_g"])).drop(middle["session"], "_g").withColumn("relative", F.col("return3") - F.col("_middle")).drop("_middle")

    signals = ["volatility", "extension", "return1", "return3", "momentum", "volume_ratio", "growth", "relative"]
    out = out.withColumns({c: F.round(c, 6) for c in signals})
    enough: Column = F.col("bars") >= 13
    rising = F.col("close") > F.col("sma")
    return out.select(
        "session", F.col("date").cast("string").alias("date"), "ticker", "division", "major", "grp", "open", "close", *signals, "margin", "yield",
        ranking.first_failure([("history", enough), ("liquidity", F.col("liquidity") >= 100_000), ("trend", F.col("close") >= 0.97 * F.col("sma"))]).alias("fails_before"),
        ranking.first_failure([("fundamentals", F.col("growth").isNotNull()), ("leverage", F.col("margin") <= 0.058)]).alias("fails_after"),
        ranking.first_failure([("history", F.col("bars") >= 7), ("average", rising), ("return", F.col("return1") > 0)]).alias("fails_v1"),
        F.lit(None).cast("string").alias("no_test"),
    ).where("session >= 12")


def _walked(spark, sf_dir) -> tuple[dict[str, DataFrame], DataFrame]:
    """The walk and the monthly bars, which are summed and written once."""
    bars = stored(monthly_bars(spark, sf_dir), "monthly-bars")
    return book.walk(candidates(spark, sf_dir, bars), STRATEGIES, stored), bars


def strategy_walk(spark, sf_dir):
    """The choice of each strategy and session: three strategies share one walk, each with its own book."""
    out = None
    for name, scored in _walked(spark, sf_dir)[0].items():
        d = book.decisions(scored).select(F.lit(name).alias("strategy"), "session", "scanned", "eligible", "ticker", "division", F.round("score", 6).alias("score"), "rank_score", F.concat_ws(",", "runners_up").alias("runners_up"), "binding")
        out = d if out is None else out.unionByName(d)
    return out


def strategy_results(spark, sf_dir):
    """What the choices earned, from the next session's open to the close of the last one held: sessions, positions, mean, win rate, gains,
    losses, and the growth of a portfolio of equal slots. A random choice among the composite's candidates stands beside them."""
    rows, bars = _walked(spark, sf_dir)
    choices = None
    for name, scored in rows.items():
        c = scored.where("place = 1").select(F.lit(name).alias("strategy"), "session", "ticker")
        choices = c if choices is None else choices.unionByName(c)
    choices = choices.unionByName(book.seeded_choices(rows["composite"], 12).select(F.lit("random").alias("strategy"), "session", "ticker"))
    bars = bars.join(ts.calendar(bars), "date").select("ticker", F.col("session_idx").cast("long").alias("at"), "open", "close")
    entry, exit_ = (bars.select("ticker", (F.col("at") - n).alias("session"), c) for n, c in ((1, "open"), (HOLD, "close")))
    positions = choices.join(entry, ["ticker", "session"]).join(exit_, ["ticker", "session"]).withColumn("net", F.round(ranking.position_return("open", "close", 0.001), 6)).where("net is not null")
    slots = positions.groupBy("strategy", ((F.col("session") + 1) % HOLD).alias("slot")).agg(F.product(1 + F.col("net")).alias("growth"), F.count("*").alias("n"))
    folio = slots.groupBy("strategy").agg((F.sum("growth") + HOLD - F.count("*")).alias("growth"))
    gain, loss = F.when(F.col("net") > 0, F.col("net")), F.when(F.col("net") <= 0, F.col("net"))
    mean = ranking.mean_of_rounded
    out = positions.groupBy("strategy").agg(F.count("*").alias("positions"), mean(F.col("net")).alias("mean_net"), (F.count(gain) / F.count("*")).alias("win_rate"), mean(gain).alias("gain"), mean(loss).alias("loss"), F.count_distinct("ticker").alias("names"))
    return out.join(folio, "strategy").select("strategy", "positions", *[F.round(c, 6).alias(c) for c in ("mean_net", "win_rate", "gain", "loss")], "names", F.round(F.col("growth") / HOLD - 1, 6).alias("portfolio"))


def book_positions(spark, sf_dir):
    """Urgent orders are a log of choices, published at an hour of their day; those still held on the first order day of 1998."""
    o = _read(spark, sf_dir, "orders")
    days = o.select(F.to_date("o_orderdate").alias("date")).where("weekday(date) < 5 and day(date) <> 4")
    log = o.where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.expr("timestampadd(MINUTE, cast(o_orderkey * 37 % 1440 as int), o_orderdate)").alias("published_at"))
    return book.open_book(log.where("o_orderdate < '1998-02-01'"), ts.calendar(days), "1998-01-05").select("o_orderkey", "held")


QUERIES = {q.__name__: q for q in (strategy_walk, strategy_results, book_positions)}

_BARS = """
b AS (SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
    arg_min(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS open, arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS close,
    sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS revenue, round(avg(l_discount), 6) AS margin, round(avg(l_tax), 6) AS yield
  FROM lineitem GROUP BY 1, 2),
cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS session FROM (SELECT DISTINCT date FROM b))"""

_ROWS = f"""{_BARS},
x AS (SELECT *, CASE WHEN close > 0 AND lag(close) OVER s > 0 THEN ln(close / lag(close) OVER s) END AS lr, row_number() OVER s AS bars FROM b WINDOW s AS (PARTITION BY ticker ORDER BY date)),
y AS (SELECT *, CASE WHEN bars >= 6 THEN quantile_cont(close * volume, 0.5) OVER f END AS liquidity, CASE WHEN bars >= 6 THEN avg(close) OVER f END AS sma,
    CASE WHEN count(lr) OVER f = 6 THEN stddev_samp(lr) OVER f END AS vol, close / lag(close) OVER s - 1 AS r1, close / lag(close, 3) OVER s - 1 AS r3, lag(close) OVER s / lag(close, 12) OVER s - 1 AS mom,
    CASE WHEN bars >= 7 THEN volume / avg(volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) END AS vr,
    CASE WHEN bars >= 3 THEN sum(revenue) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS rev
  FROM x WINDOW s AS (PARTITION BY ticker ORDER BY date), f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
z AS (SELECT y.*, CASE WHEN vol > 0 THEN (close / sma - 1) / vol END AS ext, CASE WHEN lag(rev, 3) OVER (PARTITION BY ticker ORDER BY date) > 0 THEN rev / lag(rev, 3) OVER (PARTITION BY ticker ORDER BY date) - 1 END AS g,
    session, n_name AS division, CASE n_regionkey WHEN 0 THEN 'finance' WHEN 1 THEN 'utilities' WHEN 2 THEN 'energy' ELSE 'operating' END AS grp
  FROM y JOIN cal USING (date) JOIN supplier ON ticker = CAST(s_suppkey AS VARCHAR) JOIN nation ON s_nationkey = n_nationkey),
mid AS (SELECT session, grp, list_sort(list(r3))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS middle FROM z WHERE r3 IS NOT NULL GROUP BY 1, 2),
base AS (SELECT CAST(session AS BIGINT) AS session, ticker, division, grp, open, close, round(vol, 6) AS volatility, round(ext, 6) AS extension, round(r1, 6) AS return1, round(r3, 6) AS return3, round(mom, 6) AS momentum,
    round(vr, 6) AS volume_ratio, round(g, 6) AS growth, round(r3 - middle, 6) AS relative, margin, yield,
    CASE WHEN bars < 13 THEN 'history' WHEN NOT coalesce(liquidity >= 100000, false) THEN 'liquidity' WHEN NOT coalesce(close >= 0.97 * sma, false) THEN 'trend' END AS fails_before,
    CASE WHEN g IS NULL THEN 'fundamentals' WHEN margin > 0.058 THEN 'leverage' END AS fails_after,
    CASE WHEN bars < 7 THEN 'history' WHEN NOT coalesce(close > sma, false) THEN 'average' WHEN NOT coalesce(round(r1, 6) > 0, false) THEN 'return' END AS fails_v1
  FROM z LEFT JOIN mid USING (session, grp) WHERE session >= 12),
r AS (
  SELECT 'composite' AS strategy, 6 AS hold, 5 AS most_open, 1 AS most, fails_before AS before, fails_after AS after, base.* FROM base
  UNION ALL SELECT 'price only', 6, 1000000, 1, fails_before, NULL, base.* FROM base
  UNION ALL SELECT 'rules v1', 11, 1000000, 1000000, fails_v1, NULL, base.* FROM base)"""


def _steps() -> str:
    """One step of the walk for all strategies: the statistics of a session under the book that earlier steps left."""
    price = {s.name for s in PRICE_SIGNALS}
    names = [s.name for s in SIGNALS]

    def used(s: book.Signal) -> str:
        groups = "true" if s.groups is None else f"grp IN ({', '.join(repr(g) for g in s.groups)})"
        return f"({groups})" if s.name in price else f"({groups} AND strategy = 'composite')"

    clip = lambda s, f: f"CASE WHEN n_{f}_{s} < 5 THEN v_{s} ELSE least(hi_{f}_{s}, greatest(lo_{f}_{s}, v_{s})) END"
    over = {"g": "(PARTITION BY strategy, grp)", "a": "(PARTITION BY strategy)"}
    bounds = ", ".join(f"count(v_{s}) OVER {o} AS n_{f}_{s}, quantile_cont(v_{s}, 0.02) OVER {o} AS lo_{f}_{s}, quantile_cont(v_{s}, 0.98) OVER {o} AS hi_{f}_{s}" for s in names for f, o in over.items())
    clipped = ", ".join(f"CASE WHEN v_{s} IS NOT NULL THEN {clip(s, f)} END AS c_{f}_{s}" for s in names for f in over)
    moments = ", ".join(f"avg(c_{f}_{s}) OVER {o} AS m_{f}_{s}, stddev_samp(c_{f}_{s}) OVER {o} AS d_{f}_{s}" for s in names for f, o in over.items())
    z = lambda s, f: f"CASE WHEN n_{f}_{s.name} < 3 OR v_{s.name} IS NULL OR NOT {used(s)} THEN NULL WHEN d_{f}_{s.name} > 0 THEN {s.direction} * (c_{f}_{s.name} - m_{f}_{s.name}) / d_{f}_{s.name} ELSE 0 END"
    zs = ", ".join(f"CASE WHEN small THEN {z(s, 'a')} ELSE {z(s, 'g')} END" for s in SIGNALS)
    v1 = " + ".join(f"{w} * {q}" for w, q in [(f"{w}", f"least({most}, ({n} - avg(p_{n}) OVER (PARTITION BY strategy)) / coalesce(nullif(stddev_pop(p_{n}) OVER (PARTITION BY strategy), 0), 1))") for n, w, most in (("return1", 1.0, 1e9), ("return3", 0.5, 1e9), ("volume_ratio", 0.5, 2.0))])
    return f"""
  SELECT strategy, any_value(session) AS session, count(*) AS scanned, count(*) FILTER (WHERE test IS NULL) AS eligible,
    arg_min(struct_pack(ticker := ticker, division := division, score := score, rank_score := rank_score), (late, -score, ticker)) FILTER (WHERE test IS NULL AND score IS NOT NULL) AS best,
    list(ticker ORDER BY late, -score, ticker) FILTER (WHERE test IS NULL AND score IS NOT NULL) AS ranked,
    list(test) FILTER (WHERE test IS NOT NULL) AS tests, list(ticker ORDER BY ticker) FILTER (WHERE test IS NULL) AS pool, any_value(book) AS book
  FROM (SELECT *, CASE WHEN score IS NOT NULL THEN CAST(floor(100.0 * count(score) OVER (PARTITION BY strategy ORDER BY score NULLS FIRST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / count(score) OVER (PARTITION BY strategy) + 0.5) AS INTEGER) END AS rank_score
  FROM (SELECT *, CASE WHEN test IS NULL THEN round(CASE WHEN strategy = 'rules v1' THEN {v1} ELSE list_avg(list_filter([{zs}], lambda q: q IS NOT NULL)) END, 9) END AS score,
      strategy <> 'rules v1' AND coalesce(extension > 1, false) AS late
  FROM (SELECT *, {moments}
  FROM (SELECT *, {clipped}
  FROM (SELECT *, {bounds}
  FROM (SELECT *, {', '.join(f'CASE WHEN test IS NULL THEN {s} END AS v_{s}' for s in names)}, {', '.join(f'CASE WHEN test IS NULL THEN {s} END AS p_{s}' for s in ('return1', 'return3', 'volume_ratio'))},
      count(*) FILTER (WHERE test IS NULL) OVER (PARTITION BY strategy, grp) < 8 AS small
  FROM (SELECT * EXCLUDE (test), CASE WHEN test IS NULL AND strategy <> 'rules v1' AND known >= 5 AND coalesce(volatility > cut, true) THEN 'volatility' ELSE test END AS test
  FROM (SELECT *, count(volatility) FILTER (WHERE test IS NULL) OVER (PARTITION BY strategy) AS known, quantile_cont(volatility, 0.85) FILTER (WHERE test IS NULL) OVER (PARTITION BY strategy) AS cut,
      CASE WHEN test IS NULL AND yield IS NOT NULL THEN CASE WHEN count(yield) FILTER (WHERE test IS NULL) OVER (PARTITION BY strategy, division) < 8
        THEN count(yield) FILTER (WHERE test IS NULL) OVER (PARTITION BY strategy, grp ORDER BY yield RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / count(yield) FILTER (WHERE test IS NULL) OVER (PARTITION BY strategy, grp)
        ELSE count(yield) FILTER (WHERE test IS NULL) OVER (PARTITION BY strategy, division ORDER BY yield RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / count(yield) FILTER (WHERE test IS NULL) OVER (PARTITION BY strategy, division) END END AS peer_percentile
  FROM (SELECT *, CASE WHEN len(book) >= most_open THEN 'book-full' WHEN before IS NOT NULL THEN before WHEN list_contains(list_transform(book, lambda q: q.ticker), ticker) THEN 'already-held'
        WHEN len(list_filter(book, lambda q: q.division = division)) >= most THEN 'division-cap' ELSE after END AS test
  FROM (SELECT r.*, list_filter(w.book, lambda q: r.session - q.since < r.hold) AS book FROM state w JOIN r ON r.strategy = w.strategy AND r.session = w.session + 1)))))))))) GROUP BY strategy"""


_WALK = f"""WITH RECURSIVE {_ROWS},
state AS (
  SELECT DISTINCT strategy, CAST(11 AS BIGINT) AS session, CAST(0 AS BIGINT) AS scanned, CAST(0 AS BIGINT) AS eligible,
    CAST(NULL AS STRUCT(ticker VARCHAR, division VARCHAR, score DOUBLE, rank_score INTEGER)) AS best, CAST([] AS VARCHAR[]) AS ranked, CAST([] AS VARCHAR[]) AS tests, CAST([] AS VARCHAR[]) AS pool,
    CAST([] AS STRUCT(since BIGINT, ticker VARCHAR, division VARCHAR)[]) AS book FROM r
  UNION ALL
  SELECT strategy, session, scanned, eligible, best, ranked, tests, pool, CASE WHEN best IS NULL THEN book ELSE list_append(book, struct_pack(since := session, ticker := best.ticker, division := best.division)) END AS book
  FROM ({_steps()}) AS step
), walked AS (SELECT * FROM state WHERE session >= 12)"""

ORACLE_SQL = {
    "strategy_walk": f"""{_WALK}
SELECT strategy, session, scanned, eligible, best.ticker AS ticker, best.division AS division, round(best.score, 6) AS score, best.rank_score AS rank_score, coalesce(array_to_string(ranked[2:4], ','), '') AS runners_up,
  CASE WHEN best IS NULL THEN (SELECT t FROM (SELECT unnest(tests) AS t) GROUP BY t ORDER BY count(*) DESC, t LIMIT 1) END AS binding
FROM walked""",
    "strategy_results": f"""{_WALK},
choices AS (SELECT strategy, session, best.ticker AS ticker FROM walked WHERE best IS NOT NULL
  UNION ALL SELECT 'random', session, pool[CAST(abs(((session - 11) * 1103515245 + 12345) % 2147483648) % len(pool) AS BIGINT) + 1] FROM walked WHERE strategy = 'composite' AND len(pool) > 0),
p AS (SELECT strategy, c.session, c.ticker, round(e.close * 0.999 / (o.open * 1.001) - 1, 6) AS net FROM choices c
  JOIN (SELECT ticker, session, open FROM b JOIN cal USING (date)) o ON o.ticker = c.ticker AND o.session = c.session + 1
  JOIN (SELECT ticker, session, close FROM b JOIN cal USING (date)) e ON e.ticker = c.ticker AND e.session = c.session + 6 WHERE o.open > 0),
f AS (SELECT strategy, (sum(growth) + 6 - count(*)) / 6 - 1 AS portfolio FROM (SELECT strategy, (session + 1) % 6 AS slot, product(1 + net) AS growth FROM p GROUP BY 1, 2) GROUP BY 1)
SELECT strategy, count(*) AS positions, round(avg(net), 6) AS mean_net, round(count(*) FILTER (WHERE net > 0) / count(*), 6) AS win_rate, round(avg(net) FILTER (WHERE net > 0), 6) AS gain,
  round(avg(net) FILTER (WHERE net <= 0), 6) AS loss, count(DISTINCT ticker) AS names, round(any_value(portfolio), 6) AS portfolio FROM p JOIN f USING (strategy) GROUP BY strategy""",
    "book_positions": """WITH cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) WHERE isodow(date) < 6 AND day(date) <> 4),
log AS (SELECT o_orderkey, o_orderdate + to_minutes(CAST(o_orderkey * 37 % 1440 AS INTEGER)) AS published FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate < TIMESTAMP '1998-02-01'),
e AS (SELECT o_orderkey, (SELECT min(i) FROM cal WHERE date >= CAST(published AS DATE) + CASE WHEN strftime(published, '%H:%M') < '09:30' THEN 0 ELSE 1 END) AS entry FROM log)
SELECT o_orderkey, CAST(greatest(0, coalesce((SELECT max(i) FROM cal WHERE date <= DATE '1998-01-05') - entry + 1, 0)) AS INTEGER) AS held FROM e
WHERE coalesce((SELECT max(i) FROM cal WHERE date <= DATE '1998-01-05') - entry + 1, 0) < 21""",
}
