"""The walk against a sequential version, and the rules of the book by hand cases."""

import datetime
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tessera.operators import book
from tessera.plans.tables import stored

SIGNALS = (book.Signal("a"), book.Signal("b", -1, ("operating",)), book.Signal("peer_percentile"))
SCHEMA = "session long, ticker string, division string, major string, grp string, volatility double, extension double, a double, b double, yield double, fails_before string, fails_after string"


def quantile(values, p):
    s = sorted(values)
    at = (len(s) - 1) * p
    lo = int(at)
    return s[lo] if lo == at else s[lo] + (s[lo + 1] - s[lo]) * (at - lo)


def z_scores(values):
    if len(values) >= 5:
        lo, hi = quantile(values, 0.02), quantile(values, 0.98)
        values = [min(hi, max(lo, v)) for v in values]
    sd = statistics.stdev(values) if len(values) > 1 else 0
    return [(v - statistics.fmean(values)) / sd if sd > 0 else 0.0 for v in values]


def day(rows, held, strategy):
    """Tests, statistics and order of one session's rows under a book; (test by ticker, ranked rows)."""
    test = {}
    for r in rows:
        counts = sum(d == r["division"] for _, d in held)
        test[r["ticker"]] = ("book-full" if len(held) >= strategy.most_open else None) or r["fails_before"] or ("already-held" if r["ticker"] in {t for t, _ in held} else None) \
            or ("division-cap" if r["division"] is not None and counts >= strategy.most_per_division else None) or r["fails_after"]
    peers = [r for r in rows if test[r["ticker"]] is None and r["yield"] is not None]
    for r in rows:
        r["peer_percentile"] = None
        if r in peers:
            own = [x["yield"] for x in peers if x["major"] == r["major"]]
            own = own if len(own) >= 8 else [x["yield"] for x in peers if x["grp"] == r["grp"]]
            r["peer_percentile"] = sum(v <= r["yield"] for v in own) / len(own)
    vols = [r["volatility"] for r in rows if test[r["ticker"]] is None and r["volatility"] is not None]
    if len(vols) >= 5:
        cut = quantile(vols, 0.85)
        for r in rows:
            if test[r["ticker"]] is None and (r["volatility"] is None or r["volatility"] > cut):
                test[r["ticker"]] = "volatility"
    good = [r for r in rows if test[r["ticker"]] is None]
    zs = {r["ticker"]: [] for r in good}
    for g in {r["grp"] for r in good}:
        members = [r for r in good if r["grp"] == g]
        cohort = members if len(members) >= 8 else good
        for s in book.signals_for(g, SIGNALS):
            there = [r for r in cohort if r[s.name] is not None]
            if len(there) < 3:
                continue
            for r, z in zip(there, z_scores([r[s.name] for r in there]), strict=True):
                if r in members:
                    zs[r["ticker"]].append(z * s.direction)
    scored = [(r["extension"] is not None and r["extension"] > 3, -round(statistics.fmean(zs[r["ticker"]]), 9), r["ticker"], r["division"]) for r in good if zs[r["ticker"]]]
    return test, sorted(scored)


def sequential(rows, strategy):
    open_, out = [], {}
    for at in sorted({r["session"] for r in rows}):
        held = [(t, d) for e, t, d in open_ if at - e < strategy.hold]
        test, ranked = day([r for r in rows if r["session"] == at], held, strategy)
        out[at] = (test, [r[2] for r in ranked[:4]])
        if ranked:
            open_.append((at, ranked[0][2], ranked[0][3]))
    return out


def sample(seed, sessions=18, tickers=34):
    rng = random.Random(seed)
    maybe = lambda v, p=0.05: None if rng.random() < p else v
    quality = {i: rng.gauss(0, 1) for i in range(tickers)}  # the same stocks lead for long, so that books matter
    rows = []
    for at in range(100, 100 + sessions):
        for i in range(tickers):
            if rng.random() < 0.95 and at != 107:
                rows.append(dict(zip(SCHEMA.replace(",", "").split()[::2], (
                    at, f"t{i:02}", [None, "d1", "d2", "d3", "d4"][i % 5], f"m{i % 3}", ["operating", "finance", None][min(2, i % 11 // 4)], maybe(rng.random()), maybe(rng.random() * 3.2),
                    maybe(quality[i] + rng.gauss(0, 0.3)), maybe(rng.gauss(0, 1)), maybe(rng.random()), "price" if rng.random() < 0.1 else None, "leverage" if rng.random() < 0.1 else None), strict=True)))
    rows += [dict(rows[0], session=107, ticker=f"x{i}", fails_before="price" if i else "history") for i in range(3)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_walk_equals_a_sequential_one(spark, seed):
    rows = sample(seed)
    strategies = [book.Strategy("one", book.by_composite(SIGNALS, "yield"), hold=7, most_open=6, most_per_division=2), book.Strategy("two", book.by_composite(SIGNALS, "yield"), hold=3, most_open=9, most_per_division=1)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(3)
    out = book.walk(df, strategies, stored)
    for s in strategies:
        got = out[s.name].collect()
        want = sequential([dict(r) for r in rows], s)
        for at, (test, ranked) in want.items():
            mine = [r for r in got if r.session == at]
            assert {r.ticker: r.test for r in mine} == test
            assert [r.ticker for r in sorted((r for r in mine if r.place), key=lambda r: r.place)] == ranked
    said = {r.session: r for r in book.decisions(out["one"]).collect()}
    assert (said[107].ticker, said[107].binding, said[107].scanned, said[107].reason) == (None, "price", 3, "no candidate passed the eligibility tests")
    full = [r for r in said.values() if r.binding == "book-full"]
    assert full and all(r.eligible == 0 for r in full)
    assert all(r.rank_score <= 100 and len(r.runners_up) <= 3 for r in said.values() if r.ticker)


def test_signals_by_group():
    assert [s.name for s in book.signals_for("operating", SIGNALS)] == ["a", "b", "peer_percentile"]
    assert [s.name for s in book.signals_for("finance", SIGNALS)] == ["a", "peer_percentile"]


def test_a_thin_field_is_not_scored(spark):
    """Two candidates cannot be compared: eligible, but without a score."""
    rows = [dict(r, fails_before=None, fails_after=None, volatility=0.1, extension=0.0) for r in sample(3, sessions=1)[:2]]
    out = book.walk(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA), [book.Strategy("s", book.by_composite(SIGNALS, "yield"))], stored)["s"]
    said = book.decisions(out).collect()
    assert [(r.ticker, r.eligible, r.binding, r.reason) for r in said] == [(None, 2, None, "no eligible candidate had enough comparable signals to be scored")]


def test_empty_table(spark):
    out = book.walk(spark.createDataFrame([], SCHEMA), [book.Strategy("s", book.by_composite(SIGNALS, "yield"))], stored)["s"]
    assert out.collect() == [] and book.decisions(out).collect() == []


def test_open_book(spark):
    """Monday 1 to Friday 5 trade, Wednesday does not; bought at the open after publication, out after three sessions."""
    dates = [datetime.date(2024, 1, d) for d in (1, 2, 4, 5)]
    calendar = spark.createDataFrame([(d, i) for i, d in enumerate(dates)], "date date, session_idx int")
    at = lambda d, h, m=0: datetime.datetime(2024, 1, d, h, m)
    log = [("a", at(1, 9, 29)), ("b", at(1, 9, 30)), ("c", at(3, 8)), ("d", at(3, 20)), ("e", at(5, 8)), ("f", at(5, 16)), ("g", at(9, 8)), ("h", None)]
    log = spark.createDataFrame(log, "ticker string, published_at timestamp_ntz")
    got = lambda day: {r.ticker: r.held for r in book.open_book(log, calendar, day, horizon=3).collect()}
    assert got("2024-01-05") == {"c": 2, "d": 2, "e": 1, "f": 0, "g": 0}
    assert got("2024-01-04") == {"b": 2, "c": 1, "d": 1, "e": 0, "f": 0, "g": 0}
    assert got("2024-01-03") == {"a": 2, "b": 1, "c": 0, "d": 0, "e": 0, "f": 0, "g": 0}


def test_windows_of_a_session_share_one_shuffle(spark):
    """Statistics of all signals and cohorts stay where the rows of a session are."""
    df = spark.range(50).select(*[F.col("id").cast(kind).alias(name) for name, kind in (x.split() for x in SCHEMA.split(", "))], F.when(F.col("id") < 5, "x").alias("test")).repartition("session")
    plan = book.by_composite(SIGNALS, "yield")(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
