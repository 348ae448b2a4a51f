"""Figures as they were known: versions, quarters out of totals, chains of quarters, preferences and the screen."""

import datetime

from pyspark.sql import functions as F

from tessera.operators import fundamentals as fu
from tessera.operators import screen

D = datetime.date
FACT = "cik string, tag string, qtrs int, uom string, ddate date, value double, accepted timestamp_ntz, adsh string, prevrpt boolean"
ENDS = [D(2022, 3, 31), D(2022, 6, 30), D(2022, 9, 30), D(2022, 12, 31), D(2023, 3, 31), D(2023, 6, 30), D(2023, 9, 30), D(2023, 12, 31), D(2024, 3, 31)]


def at(d, h=12):
    return datetime.datetime(d.year, d.month, d.day, h)


def fact(tag, ddate, value, qtrs=1, lag=30, adsh=None, prevrpt=False, uom="USD", cik="1"):
    return (cik, tag, qtrs, uom, ddate, float(value), at(ddate + datetime.timedelta(lag)), adsh or f"{ddate}", prevrpt)


def figures(spark, rows, days, close=10.0, sic="3000"):
    dates = spark.createDataFrame([("1", d, close, sic) for d in days], "cik string, day date, close double, sic string")
    out = fu.company_figures(spark.createDataFrame(rows, FACT).repartition(3), dates)
    return {r.day: r for r in out.collect()}


def test_versions(spark):
    e = ENDS[0]
    rows = [fact("T", e, 1, adsh="a", lag=10), fact("T", e, 2, adsh="b", lag=20, prevrpt=True), fact("T", e, 3, adsh="c", lag=30), fact("T", e, 4, adsh="d", lag=30), fact("T", e, 5, adsh="b", lag=40, prevrpt=True)]
    got = fu.versions(spark.createDataFrame(rows, FACT)).orderBy("known_from").collect()
    # a superseded filing never replaces a whole one; of one second's two the greater accession counts
    assert [(r.value, r.known_from.date(), r.known_until and r.known_until.date()) for r in got] == [(1, e + datetime.timedelta(10), e + datetime.timedelta(30)), (4, e + datetime.timedelta(30), None)]


def test_revenue_and_the_state_of_knowledge(spark):
    revenue = [fact("Revenues", e, 100 + 10 * i) for i, e in enumerate(ENDS)]
    late = fact("Revenues", ENDS[7], 1000, lag=75, adsh="z")
    day = lambda e, n: e + datetime.timedelta(n)
    got = figures(spark, [*revenue, late], [day(ENDS[6], 40), day(ENDS[7], 30), day(ENDS[7], 74), day(ENDS[7], 75), day(ENDS[8], 29), day(ENDS[8], 231)])
    assert got[day(ENDS[6], 40)].reason == "no revenue series with eight consecutive quarters on file"
    r = got[day(ENDS[7], 30)]  # accepted at noon of that day
    assert (r.ok, r.period_end, r.year_ago, r.revenue_ttm, r.revenue_ttm_prior, r.tags.revenue) == (True, ENDS[7], ENDS[3], 620, 460, "Revenues")
    assert abs(r.growth_acceleration - ((170 / 130 - 1) - (160 / 120 - 1))) < 1e-12 and not r.derived_quarters
    assert got[day(ENDS[7], 74)].revenue_ttm == 620 and got[day(ENDS[7], 75)].revenue_ttm == 1450
    assert got[day(ENDS[8], 29)].period_end == ENDS[7]
    assert got[day(ENDS[8], 231)].reason is not None  # stale


def test_the_fourth_quarter_out_of_the_year(spark):
    revenue = [fact("Revenues", e, 100) for i, e in enumerate(ENDS[:8]) if i % 4 != 3]
    nine = [fact("Revenues", ENDS[i], 300, qtrs=3) for i in (2, 6)]
    year = [fact("Revenues", ENDS[i], 450 + i, qtrs=4) for i in (3, 7)]
    day = ENDS[7] + datetime.timedelta(40)
    r = figures(spark, [*revenue, *nine, *year], [day])[day]
    assert (r.revenue_ttm, r.revenue_ttm_prior, r.derived_quarters) == (457, 453, True)
    r = figures(spark, [*revenue, *nine, *year, fact("Revenues", ENDS[7], 99)], [day])[day]
    assert r.revenue_ttm == 399  # what is reported wins
    assert figures(spark, [*revenue, *year], [day])[day].reason.startswith("no revenue series")


def test_holes_preferences_and_flows(spark):
    day = ENDS[7] + datetime.timedelta(40)
    old = [fact("Revenues", e, 1) for e in ENDS[:7] if e != ENDS[4]]
    new = [fact("SalesRevenueNet", e, 100) for e in ENDS[:8]]
    income = [fact("ProfitLoss", e, 10) for e in ENDS[:8]] + [fact("NetIncomeLoss", e, 5) for e in ENDS[5:8]]
    cash = [fact("NetCashProvidedByUsedInOperatingActivities", e, 20) for e in ENDS[4:8]]
    debt = [fact("LongTermDebtNoncurrent", ENDS[7], 70, qtrs=0), fact("LongTermDebtCurrent", ENDS[7], 7, qtrs=0), fact("CommercialPaper", ENDS[6], 3, qtrs=0), fact("CommercialPaper", ENDS[0], 9999, qtrs=0)]
    shares = [fact("WeightedAverageNumberOfDilutedSharesOutstanding", ENDS[7], 8, uom="shares"), fact("CommonStockSharesOutstanding", ENDS[0], 99, qtrs=0, uom="shares"), fact("CommonStockSharesOutstanding", ENDS[7], 99, qtrs=0)]
    r = figures(spark, old + new + income + cash + debt + shares, [day])[day]
    assert (r.tags.revenue, r.tags.net_income, r.net_income_ttm, r.operating_cash_flow_ttm) == ("SalesRevenueNet", "ProfitLoss", 40, 80)
    assert (r.total_debt, r.tags.debt, r.leverage, r.shares, r.market_cap, r.earnings_yield, r.cash_conversion) == (80, "LongTermDebtNoncurrent + LongTermDebtCurrent + CommercialPaper", 1.0, 8, 80, 0.5, 2.0)
    assert r.dropped == ["gross_margin_trend", "operating_margin_trend", "fcf_yield", "gross_profitability"]
    total = figures(spark, new + debt + [fact("LongTermDebt", ENDS[7], 77, qtrs=0)], [day], sic="6020")[day]
    assert (total.total_debt, total.grp, "return_on_equity" in total.dropped, "gross_profitability" in total.dropped) == (80, "finance", True, False)


def test_a_base_that_is_not_positive(spark):
    day = ENDS[7] + datetime.timedelta(40)
    rows = [fact("Revenues", e, -1 if i < 4 else 100) for i, e in enumerate(ENDS[:8])]
    assert figures(spark, rows, [day])[day].reason == "the year-ago revenue base is not positive"


def test_odd_rows_and_empty_tables(spark):
    day = ENDS[7]
    assert figures(spark, [], [day])[day].reason.startswith("no revenue") and figures(spark, [fact("Revenues", ENDS[0], 1)], []) == {}
    rows = [("1", "Revenues", 1, "USD", None, 1.0, at(day), "a", False), ("1", "Revenues", 1, "USD", day, 1.0, None, "a", None), (None, None, None, None, None, None, None, None, None)]
    assert not figures(spark, rows, [day])[day].ok


def test_latest_filing(spark):
    d = D(2024, 1, 31)
    filings = spark.createDataFrame([("1", "a", D(2023, 9, 30), at(D(2023, 11, 1))), ("1", "c", D(2023, 12, 31), at(d, 23)), ("1", "b", None, at(d, 23))], "cik string, adsh string, period date, accepted timestamp_ntz")
    dates = spark.createDataFrame([("1", d), ("1", D(2024, 1, 30)), ("1", D(2023, 10, 31)), ("2", d)], "cik string, day date")
    got = {(r.cik, r.day): r.adsh for r in fu.latest_filing(filings, dates).collect()}
    assert got == {("1", d): "c", ("1", D(2024, 1, 30)): "a"}


def test_screen_order(spark):
    good = dict(day=D(2024, 1, 31), sessions=300, close=10.0, liquidity=3e7, sma200=9.0, period=D(2023, 12, 31), announced=None, ok=True, grp="operating", operating_cash_flow_ttm=5.0, leverage=2.0)
    bad = [
        dict(sessions=None), dict(close=4.99), dict(sessions=252), dict(liquidity=None), dict(sma200=None), dict(period=None), dict(period=D(2023, 7, 1)), dict(period=D(2024, 2, 1)), dict(announced=True), dict(ok=False),
        dict(operating_cash_flow_ttm=None), dict(operating_cash_flow_ttm=0.0), dict(leverage=6.1), dict(grp="finance", operating_cash_flow_ttm=None, leverage=9.0), dict(leverage=None), dict(close=1.0, ok=False), {},
    ]
    schema = "n int, day date, sessions int, close double, liquidity double, sma200 double, period date, announced boolean, ok boolean, grp string, operating_cash_flow_ttm double, leverage double"
    df = spark.createDataFrame([(i, *(good | b).values()) for i, b in enumerate(bad)], schema)
    limits = screen.Limits()
    got = [r[0] for r in df.orderBy("n").select(screen.first_failure(screen.tests_before_book(limits) + screen.tests_after_book(limits))).collect()]
    assert got == ["priced-at-T", "price", "history", "liquidity", "trend", "financials-on-file", "financials-recent", "financials-recent", "just-announced", "fundamentals", "cash-flow", "cash-flow", "leverage", None, None, "price", None]


def test_a_company_is_one_row_however_many_dates_ask(spark):
    """Facts are not copied for every state: what is known at one is looked up in the company's row."""
    at = lambda day: datetime.datetime.fromisoformat(day)
    facts = [("c", "Revenues", 1, "USD", datetime.date(2020, 3, 31), 10.0, at("2020-05-01"), None), ("c", "Revenues", 2, "USD", datetime.date(2020, 6, 30), 25.0, at("2020-08-01"), at("2020-09-01")),
             ("c", "Revenues", 2, "USD", datetime.date(2020, 6, 30), 27.0, at("2020-09-01"), None), ("c", "Assets", 0, "USD", datetime.date(2020, 6, 30), 5.0, at("2020-08-01"), None)]
    v = spark.createDataFrame(facts, "cik string, tag string, qtrs int, uom string, ddate date, value double, known_from timestamp_ntz, known_until timestamp_ntz")
    held = fu.histories(v, {"revenue": ("Revenues", "USD"), "assets": ("Assets", "USD")})
    assert held.count() == 1
    states = spark.createDataFrame([(at(d),) for d in ("2020-04-01", "2020-05-01", "2020-08-01", "2020-09-01")], "state timestamp_ntz")
    rows = held.crossJoin(states).select("state", *[fu.known_at(F.col(c), F.col("state")).alias(c) for c in ("revenue", "assets")])
    got = rows.select("state", fu.single_quarters(F.col("revenue")).alias("q"), fu.latest_instant(F.col("assets")).alias("i")).orderBy("state").collect()
    assert [r.q and [(x.value, x.derived) for x in r.q] for r in got] == [None, [(10.0, False)], [(10.0, False), (15.0, True)], [(10.0, False), (17.0, True)]]
    assert [r.i and r.i.value for r in got] == [None, None, 5.0, 5.0]


def test_what_is_looked_up_equals_what_one_state_says(spark):
    """Random facts, with values and acceptances missing, ends off the quarter and far ahead: the look-up against the expressions on one state's row."""
    import random

    rng, rows = random.Random(3), []
    for cik in "abcde":
        for y, (m, d) in ((y, x) for y in range(2019, 2024) for x in ((3, 31), (6, 30), (9, 30), (12, 31))):
            for tag in ("Revenues", "Revenues", "Assets", "ProfitLoss"):
                for q in [0] if tag == "Assets" else rng.sample([1, 1, 1, 2, 3, 4, 5], 3):
                    end = D(y, m, d) + datetime.timedelta(rng.choice([0] * 30 + [-7, 45, 500]))
                    accepted = at(D(y, m, d) + datetime.timedelta(rng.randint(0, 90)), rng.choice([0, 12]))
                    rows.append((cik, tag, q, "USD", end, rng.choice([None, *map(float, range(1, 30))]), rng.choice([None, *[accepted] * 50]), rng.choice("xyz"), rng.choice([True, False, False, None])))
    facts = spark.createDataFrame(rows, FACT)
    dates = spark.createDataFrame([(c, D(2019, 1, 1) + datetime.timedelta(37 * i), 10.0, "3000") for c in "abcdef" for i in range(55)], "cik string, day date, close double, sic string")
    v = fu.versions(facts)
    x = dates.join(fu.states(v, dates), ["cik", "day"]).join(fu.histories(v, {"r": ("Revenues", "USD"), "i": ("ProfitLoss", "USD"), "a": ("Assets", "USD")}), "cik", "left")
    x = x.withColumns({c: fu.known_at(F.col(c), F.col("state")) for c in "ria"})
    x = x.withColumns({"r": fu.single_quarters(F.col("r")), "i": fu.single_quarters(F.col("i")), "a": fu.latest_instant(F.col("a")), "t": F.datediff("day", F.lit("1970-01-01").cast("date"))})
    x = x.withColumn("c", fu.chain(F.col("r"), F.get("r", F.size("r") - 1)["d"])).withColumn("end", F.get("c", F.lit(0))["d"])
    income, sheet = fu.trailing_year(fu.chain(F.col("i"), F.col("end"), 4)), F.when(F.col("t") - F.col("a.d") <= fu.STALE_DAYS, F.col("a.value"))
    want = x.where((F.size("c") >= 8) & (F.col("t") - F.col("end") <= fu.STALE_DAYS)).select("cik", "day", fu.trailing_year(F.col("c")).alias("ttm"), fu.trailing_year(F.col("c"), 4).alias("prior"), income.alias("income"), sheet.alias("assets"))
    want = {(r.cik, r.day): tuple(r)[2:] for r in want.collect()}
    got = fu.company_figures(facts, dates).collect()
    assert len(got) == dates.count() and {(r.cik, r.day) for r in got if not r.reason or "consecutive" not in r.reason} == want.keys()
    ok = [r for r in got if r.ok]
    assert len(ok) > 20 and sum(r.net_income_ttm is not None for r in ok) > 5
    assert all((r.revenue_ttm, r.revenue_ttm_prior, r.net_income_ttm, r.assets) == want[r.cik, r.day] for r in ok)


def scans_of_facts(query, spark):
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    return sum("FileScan" in line and "l_partkey" in line for line in plan.split("\n"))


def test_facts_are_dealt_once(spark):
    """One scan and one shuffle of the facts serve the versions, the states and what is known at each date."""
    from tessera.plans import fundamentals as plans

    assert scans_of_facts(plans.company_figures, spark) == 1


def test_the_last_filing_comes_with_the_figures(spark):
    """The screen's filings ride on the facts' one shuffle; they are those of latest_filing, of tags and units without a figure, too."""
    from tessera.plans import fundamentals as plans

    assert scans_of_facts(plans.candidate_screen, spark) == 1
    d, none = D(2024, 1, 31), None
    rows = [
        fact("Revenues", D(2023, 9, 30), 1, adsh="a"), fact("Other", D(2023, 12, 31), 1, adsh="c", lag=31), fact("Assets", D(2023, 10, 31), 1, qtrs=0, adsh="b", lag=92, uom="EUR"), fact("Revenues", D(2022, 1, 1), 5, adsh="c"),
        ("1", "Revenues", 1, "USD", none, 1.0, at(D(2024, 2, 2)), "d", False), ("1", "Revenues", 1, "USD", D(2024, 1, 1), 1.0, none, "e", False), (none, "Revenues", 1, "USD", d, 1.0, at(d), "f", False),
    ]
    facts = spark.createDataFrame(rows, FACT)
    dates = spark.createDataFrame([(c, x, 7.0, "3000") for c in "12" for x in (D(2023, 10, 29), D(2023, 10, 30), D(2024, 1, 30), d, D(2024, 2, 2))], "cik string, day date, close double, sic string")
    filings = facts.groupBy("cik", "adsh").agg(F.max("ddate").alias("period"), F.max("accepted").alias("accepted"))
    want = {(r.cik, r.day): r.period for r in fu.latest_filing(filings, dates).collect()}
    got = fu.company_figures(facts, dates, keep=["close"], filed=True).collect()
    assert {(r.cik, r.day): (r.filed, r.close) for r in got} == {(c, x): (want.get((c, x)), 7.0) for c in "12" for x in {r.day for r in got}}
    assert want["1", d] == D(2023, 12, 31) and want["1", D(2023, 10, 30)] == D(2023, 9, 30) and len(want) == 4 and want["1", D(2024, 2, 2)] is none
