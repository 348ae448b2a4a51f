"""Company figures on many decision dates. Suppliers are companies, their shipments facts of the quarter before, accepted some weeks on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fundamentals, screen
from ..operators import timeseries as ts
from .book import monthly_bars


def _facts(spark, sf_dir) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n, flag, s, k = F.col("l_linenumber"), F.col("l_returnflag"), F.col("l_suppkey"), F.col("l_orderkey")
    tag = (
        F.when(n <= 2, F.when(s % 3 > 0, "Revenues").otherwise("SalesRevenueNet")).when(n == 3, F.when(s % 2 > 0, "NetIncomeLoss").otherwise("ProfitLoss"))
        .when(n == 4, "NetCashProvidedByUsedInOperatingActivities").when(n == 5, F.when(flag == "A", "Assets").when(flag == "N", "StockholdersEquity").otherwise("CommonStockSharesOutstanding"))
        .when(n == 6, F.when(flag == "R", "OperatingIncomeLoss").otherwise("GrossProfit"))
        .when(flag == "A", "PaymentsToAcquirePropertyPlantAndEquipment").when(flag == "R", "CashAndCashEquivalentsAtCarryingValue").when(s % 2 > 0, "LongTermDebt").otherwise("LongTermDebtNoncurrent")
    )
    instant = (n == 5) | ((n == 7) & (flag != "A"))
    qtrs = F.when(instant, 0).when(k % 10 == 0, 2).when(k % 10 == 1, 3).when(k % 10 == 2, 4).otherwise(1)
    value = F.when(n == 3, F.col("l_extendedprice") - 20_000).when(n >= 6, F.floor(F.col("l_extendedprice") / 4)).otherwise(F.col("l_extendedprice"))
    return li.select(
        s.cast("string").alias("cik"), tag.alias("tag"), qtrs.alias("qtrs"), F.when(tag == "CommonStockSharesOutstanding", "shares").otherwise("USD").alias("uom"),
        F.date_sub(F.trunc("l_shipdate", "quarter"), 1).alias("ddate"), (F.round(value, 2) * F.greatest(F.lit(1), qtrs)).alias("value"),
        F.expr("timestampadd(HOUR, cast(l_orderkey % 60 * 24 + l_partkey % 24 as int), l_shipdate)").cast("timestamp_ntz").alias("accepted"),
        F.format_string("a%09d", k).alias("adsh"), (k % 7 == 0).alias("prevrpt"),
    )


def _bars(spark, sf_dir) -> DataFrame:
    """cik, date (the month after a bar's) and close of each supplier's bars."""
    return monthly_bars(spark, sf_dir).select(F.col("ticker").alias("cik"), F.add_months("date", 1).alias("date"), "close")


def _dates(spark, sf_dir, bars: DataFrame) -> DataFrame:
    """The middle of each month for each supplier, with what its bars (cik, date and more) say of the month before, null without one."""
    more = [c for c in bars.columns if c not in ("cik", "date")]
    # the calendar of every company; a company's bars stay in one row that the months look into
    shipped = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.add_months(F.trunc("l_shipdate", "month"), 1).alias("date"))
    months = shipped.where("date is not null").distinct().agg(F.array_sort(F.collect_list("date")).alias("months"))
    held = bars.where("cik is not null and date is not null").groupBy("cik").agg(F.map_from_entries(F.collect_list(F.struct("date", F.struct(*more)))).alias("of"))
    each = held.crossJoin(F.broadcast(months)).select("cik", "of", F.explode("months").alias("date")).withColumn("bar", F.try_element_at("of", "date"))
    return each.select("cik", F.date_add("date", 14).alias("day"), *[f"bar.{c}" for c in more], (F.col("cik").cast("int") * 97 % 10_000).cast("string").alias("sic"))


FIGURES = [
    "revenue_growth", "growth_acceleration", "revenue_ttm", "revenue_ttm_prior", "gross_margin", "gross_margin_trend", "operating_margin_trend", "net_income_ttm", "operating_cash_flow_ttm", "capex_ttm",
    "assets", "equity", "shares", "total_debt", "cash", "market_cap", "cash_conversion", "gross_profitability", "return_on_equity", "leverage", "fcf_yield", "earnings_yield",
]


def company_figures(spark, sf_dir):
    """The figures of every company in the middle of every month, as its filings were known then."""
    out = fundamentals.company_figures(_facts(spark, sf_dir), _dates(spark, sf_dir, _bars(spark, sf_dir)))
    tags = F.concat_ws(",", *[F.col(f"tags.{t}") for t in ("revenue", "net_income", "gross_profit", "operating_cash_flow", "capex", "assets", "equity", "shares", "cash", "debt")])
    return out.select("cik", F.col("day").cast("string").alias("day"), "reason", "grp", F.col("period_end").cast("string").alias("period_end"), F.col("year_ago").cast("string").alias("year_ago"), *[F.round(c, 1 if c == "market_cap" else 4).alias(c) for c in FIGURES], "derived_quarters", tags.alias("tags"), F.concat_ws(",", "dropped").alias("dropped"))


def fact_versions(spark, sf_dir):
    """When each fact was the best statement of its figure."""
    v = fundamentals.versions(_facts(spark, sf_dir))
    return v.select("cik", "tag", "qtrs", F.col("ddate").cast("string").alias("ddate"), "adsh", F.round("value", 2).alias("value"), F.date_format("known_from", "yyyy-MM-dd HH:mm").alias("known_from"), F.date_format("known_until", "yyyy-MM-dd HH:mm").alias("known_until"))


def candidate_screen(spark, sf_dir):
    """Companies, their bars, facts and last filing on every decision date: the first of the screen's tests that a company fails, by date."""
    bars = ts.with_log_returns(monthly_bars(spark, sf_dir))
    w = ts.by_session()
    prices = bars.select(
        F.col("ticker").alias("cik"), F.add_months("date", 1).alias("date"), "close", F.row_number().over(w).alias("sessions"), ts.median_dollar_volume(6).alias("liquidity"), ts.sma(6).alias("sma200")
    )
    keep = ["close", "sessions", "liquidity", "sma200"]
    rows = fundamentals.company_figures(_facts(spark, sf_dir), _dates(spark, sf_dir, prices), keep=keep, filed=True)
    rows = rows.withColumn("month", F.trunc("day", "month")).withColumnRenamed("filed", "period")
    # a shipment of the largest size in the days before stands for an announcement
    large = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity >= 50").groupBy(F.col("l_suppkey").cast("string").alias("cik")).agg(F.collect_set(F.trunc("l_shipdate", "month")).alias("months"))
    rows = rows.join(large, "cik", "left").withColumn("announced", F.array_contains("months", F.col("month")))
    limits = screen.Limits(min_close=905, min_liquidity=100_000, min_sessions=13, max_financials_age=120)
    tested = rows.withColumn("test", screen.first_failure(screen.tests_before_book(limits) + screen.tests_after_book(limits)))
    return tested.groupBy(F.col("day").cast("string").alias("day"), F.coalesce("test", F.lit("eligible")).alias("test")).agg(F.count("*").alias("n"))


QUERIES = {q.__name__: q for q in (company_figures, fact_versions, candidate_screen)}

_FACTS = """f0 AS (SELECT CAST(l_suppkey AS VARCHAR) AS cik, CASE WHEN l_linenumber <= 2 THEN CASE WHEN l_suppkey % 3 > 0 THEN 'Revenues' ELSE 'SalesRevenueNet' END
    WHEN l_linenumber = 3 THEN CASE WHEN l_suppkey % 2 > 0 THEN 'NetIncomeLoss' ELSE 'ProfitLoss' END WHEN l_linenumber = 4 THEN 'NetCashProvidedByUsedInOperatingActivities'
    WHEN l_linenumber = 5 THEN CASE l_returnflag WHEN 'A' THEN 'Assets' WHEN 'N' THEN 'StockholdersEquity' ELSE 'CommonStockSharesOutstanding' END
    WHEN l_linenumber = 6 THEN CASE WHEN l_returnflag = 'R' THEN 'OperatingIncomeLoss' ELSE 'GrossProfit' END
    WHEN l_returnflag = 'A' THEN 'PaymentsToAcquirePropertyPlantAndEquipment' WHEN l_returnflag = 'R' THEN 'CashAndCashEquivalentsAtCarryingValue' WHEN l_suppkey % 2 > 0 THEN 'LongTermDebt' ELSE 'LongTermDebtNoncurrent' END AS tag,
    CASE WHEN l_linenumber = 5 OR l_linenumber = 7 AND l_returnflag <> 'A' THEN 0 WHEN l_orderkey % 10 = 0 THEN 2 WHEN l_orderkey % 10 = 1 THEN 3 WHEN l_orderkey % 10 = 2 THEN 4 ELSE 1 END AS qtrs,
    CAST(date_trunc('quarter', l_shipdate) AS DATE) - 1 AS ddate, round(CASE WHEN l_linenumber = 3 THEN l_extendedprice - 20000 WHEN l_linenumber >= 6 THEN floor(l_extendedprice / 4) ELSE l_extendedprice END, 2) AS amount,
    l_shipdate + to_hours(CAST(l_orderkey % 60 * 24 + l_partkey % 24 AS INTEGER)) AS accepted, 'a' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') AS adsh, l_orderkey % 7 = 0 AS prevrpt FROM lineitem),
f AS (SELECT * EXCLUDE (amount), amount * greatest(1, qtrs) AS value FROM f0)"""
_FLOWS = {"net_income": ["NetIncomeLoss", "ProfitLoss"], "gross_profit": ["GrossProfit"], "operating_income": ["OperatingIncomeLoss"], "operating_cash_flow": ["NetCashProvidedByUsedInOperatingActivities"], "capex": ["PaymentsToAcquirePropertyPlantAndEquipment"]}


def sector_sql(sic: str) -> str:
    n = f"CAST({sic} AS INTEGER)"
    return f"CASE WHEN {n} BETWEEN 6000 AND 6999 THEN 'finance' WHEN {n} BETWEEN 4900 AND 4999 THEN 'utilities' WHEN {n} BETWEEN 1200 AND 1399 OR {n} BETWEEN 2900 AND 2999 THEN 'energy' ELSE 'operating' END"


def _figures_sql() -> str:
    """The same rules walked date by date: what was known on each date, quarters, chains by joins of a quarter with the one before."""
    steps = range(1, 9)
    chain = "\n".join(f"  LEFT JOIN p p{i} ON p{i}.cik = p0.cik AND p{i}.day = p0.day AND p{i}.tag = p0.tag AND p{i}.ddate = p{i - 1}.pd" for i in steps)
    columns = ", ".join(f"p{i}.ddate AS d{i}, p{i}.value AS v{i}, p{i}.derived AS x{i}" for i in range(9))
    flows = ",\n".join(
        f"""{f} AS (SELECT cik, day, arg_min(tag, rank) AS tag, arg_min(ttm, rank) AS ttm, arg_min(ARRAY[prior], rank)[1] AS prior FROM (
    SELECT r.cik, r.day, c.tag, CASE c.tag {' '.join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(ts_))} END AS rank, c.ttm, a.ttm AS prior FROM rev r JOIN chains c ON c.cik = r.cik AND c.day = r.day AND c.d0 = r.d0 AND c.ttm IS NOT NULL
      LEFT JOIN chains a ON a.cik = r.cik AND a.day = r.day AND a.tag = c.tag AND a.d0 = r.ago WHERE c.tag IN ({', '.join(f"'{t}'" for t in ts_)})) GROUP BY cik, day)"""
        for f, ts_ in _FLOWS.items()
    )
    joins = "\n".join(f"LEFT JOIN {f} ON {f}.cik = d.cik AND {f}.day = d.day" for f in _FLOWS)
    now = lambda t: f"(SELECT value FROM i WHERE i.cik = d.cik AND i.day = d.day AND i.tag = '{t}')"
    return f"""{_FACTS},
bar AS (SELECT CAST(l_suppkey AS VARCHAR) AS cik, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS close FROM lineitem GROUP BY 1, 2),
d AS (SELECT m.cik, CAST(m.month + INTERVAL 1 MONTH AS DATE) + 14 AS day, close, CAST(CAST(m.cik AS INTEGER) * 97 % 10000 AS VARCHAR) AS sic FROM (SELECT * FROM (SELECT DISTINCT month FROM bar), (SELECT DISTINCT cik FROM bar)) m LEFT JOIN bar ON bar.cik = m.cik AND bar.month = m.month),
k AS (SELECT * FROM (SELECT d.day, f.*, row_number() OVER (PARTITION BY d.cik, d.day, tag, qtrs, ddate ORDER BY prevrpt, accepted DESC, adsh DESC, value) AS rn FROM d JOIN f ON f.cik = d.cik AND f.accepted < d.day + 1 AND f.ddate > d.day - 1200) WHERE rn = 1),
s AS (SELECT k.cik, k.day, k.tag, k.ddate, k.qtrs, CASE WHEN k.qtrs = 1 THEN any_value(k.value) ELSE any_value(k.value) - arg_max(b.value, b.ddate) END AS single FROM k
  LEFT JOIN k b ON k.qtrs > 1 AND b.cik = k.cik AND b.day = k.day AND b.tag = k.tag AND b.qtrs = k.qtrs - 1 AND k.ddate - b.ddate BETWEEN 80 AND 102 WHERE k.qtrs > 0 GROUP BY k.cik, k.day, k.tag, k.ddate, k.qtrs),
q AS (SELECT cik, day, tag, ddate, arg_min(single, qtrs) AS value, min(qtrs) > 1 AS derived FROM s WHERE single IS NOT NULL GROUP BY cik, day, tag, ddate),
p AS (SELECT q.cik, q.day, q.tag, q.ddate, any_value(q.value) AS value, any_value(q.derived) AS derived, max(b.ddate) AS pd FROM q LEFT JOIN q b ON b.cik = q.cik AND b.day = q.day AND b.tag = q.tag AND q.ddate - b.ddate BETWEEN 80 AND 102 GROUP BY q.cik, q.day, q.tag, q.ddate),
chains AS (SELECT *, CASE WHEN d0 - d3 BETWEEN 240 AND 306 THEN v0 + v1 + v2 + v3 END AS ttm, CASE WHEN d0 - d4 BETWEEN 350 AND 380 THEN d4 END AS ago, CASE WHEN d1 - d5 BETWEEN 350 AND 380 THEN d5 END AS prev_ago FROM (
  SELECT p0.cik, p0.day, p0.tag, {columns} FROM p p0
{chain})),
latest AS (SELECT cik, day, tag, max(d0) AS d0 FROM chains GROUP BY cik, day, tag),
rev AS (SELECT c.* FROM chains c JOIN latest l USING (cik, day, tag, d0) WHERE tag IN ('Revenues', 'SalesRevenueNet') AND day - d0 <= 200 AND d7 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cik, day ORDER BY tag) = 1),
i AS (SELECT cik, day, tag, arg_max(value, ddate) AS value FROM k WHERE qtrs = 0 GROUP BY cik, day, tag HAVING day - max(ddate) <= 200),
{flows},
base AS (SELECT d.cik, d.day, d.close, {sector_sql('d.sic')} AS grp, r.cik IS NOT NULL AS has, r.tag AS rtag, r.d0, r.ago, r.ttm AS revenue_ttm, CASE WHEN r.ago IS NOT NULL AND r.d4 - r.d7 BETWEEN 240 AND 306 THEN r.v4 + r.v5 + r.v6 + r.v7 END AS revenue_ttm_prior,
    CASE WHEN r.ago IS NOT NULL AND r.v4 > 0 THEN r.v0 / r.v4 - 1 END AS yoy, CASE WHEN r.prev_ago IS NOT NULL AND r.v5 > 0 THEN r.v1 / r.v5 - 1 END AS yoy_prior, r.x0 OR r.x1 OR r.x2 OR r.x3 AS derived_quarters,
    {', '.join(f'{f}.ttm AS {f}_ttm, {f}.prior AS {f}_prior, {f}.tag AS {f}_tag' for f in _FLOWS)},
    {now('Assets')} AS assets, {now('StockholdersEquity')} AS equity, {now('CommonStockSharesOutstanding')} AS shares, {now('CashAndCashEquivalentsAtCarryingValue')} AS cash, {now('LongTermDebt')} AS ltd, {now('LongTermDebtNoncurrent')} AS ltn
  FROM d LEFT JOIN rev r ON r.cik = d.cik AND r.day = d.day
{joins}),
g AS (SELECT *, CASE WHEN revenue_ttm_prior > 0 THEN revenue_ttm / revenue_ttm_prior - 1 END AS revenue_growth, coalesce(ltd, ltn) AS total_debt, CASE WHEN close > 0 THEN shares * close END AS market_cap FROM base),
h AS (SELECT *, yoy - yoy_prior AS growth_acceleration, CASE WHEN revenue_ttm > 0 THEN gross_profit_ttm / revenue_ttm END AS gross_margin, CASE WHEN revenue_ttm_prior > 0 THEN gross_profit_prior / revenue_ttm_prior END AS gmp,
    CASE WHEN revenue_ttm > 0 THEN operating_income_ttm / revenue_ttm END AS om, CASE WHEN revenue_ttm_prior > 0 THEN operating_income_prior / revenue_ttm_prior END AS omp,
    CASE WHEN net_income_ttm > 0 AND operating_cash_flow_ttm IS NOT NULL THEN least(3, greatest(-3, operating_cash_flow_ttm / net_income_ttm)) END AS cash_conversion, CASE WHEN assets > 0 THEN gross_profit_ttm / assets END AS gross_profitability,
    CASE WHEN equity > 0 THEN net_income_ttm / equity END AS return_on_equity, CASE WHEN operating_cash_flow_ttm > 0 THEN total_debt / operating_cash_flow_ttm END AS leverage,
    CASE WHEN market_cap > 0 THEN (operating_cash_flow_ttm - capex_ttm) / market_cap END AS fcf_yield, CASE WHEN market_cap <> 0 THEN net_income_ttm / market_cap END AS earnings_yield,
    CASE WHEN NOT has THEN 'no revenue series with eight consecutive quarters on file' WHEN ago IS NULL THEN 'no comparable quarter a year before' WHEN revenue_ttm IS NULL OR revenue_ttm_prior IS NULL THEN 'trailing-year revenue cannot be assembled from single quarters'
      WHEN revenue_growth IS NULL THEN 'the year-ago revenue base is not positive' WHEN yoy IS NULL OR yoy_prior IS NULL THEN 'two comparable quarterly year-on-year rates are not available' END AS reason FROM g),
figures AS (SELECT *, gross_margin - gmp AS gross_margin_trend, om - omp AS operating_margin_trend FROM h)"""


_NULLS = [("market_cap", "coalesce(market_cap, 0) = 0"), *[(c, f"{c} IS NULL") for c in ("gross_margin_trend", "operating_margin_trend", "cash_conversion", "fcf_yield", "earnings_yield")],
          ("gross_profitability", "gross_profitability IS NULL AND grp = 'operating'"), ("return_on_equity", "return_on_equity IS NULL AND grp = 'finance'")]
_TAG_LIST = ["rtag", "net_income_tag", "gross_profit_tag", "operating_cash_flow_tag", "capex_tag", "CASE WHEN assets IS NOT NULL THEN 'Assets' END", "CASE WHEN equity IS NOT NULL THEN 'StockholdersEquity' END", "CASE WHEN shares IS NOT NULL THEN 'CommonStockSharesOutstanding' END",
             "CASE WHEN cash IS NOT NULL THEN 'CashAndCashEquivalentsAtCarryingValue' END", "CASE WHEN ltd IS NOT NULL THEN 'LongTermDebt' WHEN ltn IS NOT NULL THEN 'LongTermDebtNoncurrent' END"]
ORACLE_SQL = {
    "company_figures": f"""WITH {_figures_sql()}
SELECT cik, CAST(day AS VARCHAR) AS day, reason, grp, CASE WHEN reason IS NULL THEN CAST(d0 AS VARCHAR) END AS period_end, CASE WHEN reason IS NULL THEN CAST(ago AS VARCHAR) END AS year_ago,
  {', '.join(f'CASE WHEN reason IS NULL THEN round({c}, {1 if c == "market_cap" else 4}) END AS {c}' for c in FIGURES)}, CASE WHEN reason IS NULL THEN derived_quarters END AS derived_quarters,
  CASE WHEN reason IS NULL THEN concat_ws(',', {', '.join(_TAG_LIST)}) ELSE '' END AS tags, CASE WHEN reason IS NULL THEN concat_ws(',', {', '.join(f"CASE WHEN {w} THEN '{c}' END" for c, w in _NULLS)}) ELSE '' END AS dropped
FROM figures""",
    "fact_versions": f"""WITH {_FACTS},
r AS (SELECT *, max((NOT prevrpt, accepted, adsh)) OVER (PARTITION BY cik, tag, qtrs, ddate ORDER BY accepted RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM f),
v AS (SELECT cik, tag, qtrs, ddate, adsh, accepted, min(value) AS value FROM r WHERE (NOT prevrpt, accepted, adsh) = best GROUP BY ALL)
SELECT cik, tag, qtrs, CAST(ddate AS VARCHAR) AS ddate, adsh, round(value, 2) AS value, strftime(accepted, '%Y-%m-%d %H:%M') AS known_from, strftime(lead(accepted) OVER (PARTITION BY cik, tag, qtrs, ddate ORDER BY accepted), '%Y-%m-%d %H:%M') AS known_until FROM v""",
    "candidate_screen": f"""WITH {_figures_sql()},
x AS (SELECT cik, month, l.close, row_number() OVER s AS sessions, quantile_cont(close * volume, 0.5) OVER f AS liquidity, avg(close) OVER f AS sma FROM (
    SELECT CAST(l_suppkey AS VARCHAR) AS cik, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, arg_max(l_extendedprice / l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2) l
  WINDOW s AS (PARTITION BY cik ORDER BY month), f AS (PARTITION BY cik ORDER BY month ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
fil AS (SELECT cik, adsh, max(ddate) AS period, max(accepted) AS accepted FROM f GROUP BY 1, 2),
lf AS (SELECT d.cik, d.day, arg_max(period, (accepted, adsh)) AS period FROM d JOIN fil ON fil.cik = d.cik AND fil.accepted < d.day + 1 GROUP BY 1, 2),
large AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS cik, CAST(date_trunc('month', l_shipdate) AS DATE) AS month FROM lineitem WHERE l_quantity >= 50),
t AS (SELECT h.day, CASE WHEN sessions IS NULL THEN 'priced-at-T' WHEN NOT coalesce(h.close >= 905, false) THEN 'price' WHEN sessions < 13 THEN 'history' WHEN NOT coalesce(liquidity >= 100000, false) THEN 'liquidity'
    WHEN NOT coalesce(h.close >= sma, false) THEN 'trend' WHEN lf.cik IS NULL THEN 'financials-on-file' WHEN NOT coalesce(h.day - period BETWEEN 0 AND 120, false) THEN 'financials-recent' WHEN large.cik IS NOT NULL THEN 'just-announced'
    WHEN reason IS NOT NULL THEN 'fundamentals' WHEN grp <> 'finance' AND NOT coalesce(operating_cash_flow_ttm > 0, false) THEN 'cash-flow' WHEN grp <> 'finance' AND leverage > 6 THEN 'leverage' ELSE 'eligible' END AS test
  FROM figures h LEFT JOIN x ON x.cik = h.cik AND x.month + INTERVAL 1 MONTH = date_trunc('month', h.day) LEFT JOIN lf ON lf.cik = h.cik AND lf.day = h.day LEFT JOIN large ON large.cik = h.cik AND large.month = date_trunc('month', h.day))
SELECT CAST(day AS VARCHAR) AS day, test, count(*) AS n FROM t GROUP BY 1, 2""",
}
