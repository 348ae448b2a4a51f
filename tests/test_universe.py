"""Readers in the layouts of their sources, with the rows that are easily got wrong."""

import datetime
import json

import pytest

from tessera.functions import company as co
from tessera.operators import fixtures
from tessera.sources import files
from tessera.streaming import upserts

HEAD = "Nasdaq Traded|Symbol|Security Name|Listing Exchange|Market Category|ETF|Round Lot Size|Test Issue|Financial Status|CQS Symbol|NASDAQ Symbol|NextShares"


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "line string").repartition(2)


def test_universe_by_header(spark):
    text = lines(
        spark, HEAD, "Y|A|Agilent Technologies, Inc. Common Stock|N| |N|100|N||A|A|N", "Y|AACB|Some Corp - Class A Ordinary Shares|Q|G|N|100|N|D||AACB|N\r",
        "Y|T1|Test 1 Common Stock|N| |N|100|Y||T1", "Y|SHORT|row", "", "File Creation Time: 1126202521:33|||||||||||")
    rows = {r.symbol: r for r in files.traded_universe(text, "line").collect()}
    assert set(rows) == {"A", "AACB"}
    assert (rows["A"].name, rows["A"].exchange, rows["A"].financial_status, rows["AACB"].financial_status, rows["AACB"].next_shares) == ("Agilent Technologies, Inc. Common Stock", "N", "", "D", "N")
    assert [r.created_at for r in files.universe_created(text, "line").collect()] == ["1126202521:33|||||||||||"]
    other = lines(spark, "ETF|Test Issue|Listing Exchange|Security Name|SYMBOL", "N|N|Q|X Common Stock|X1", "N|N|Q|no symbol")
    assert [(r.symbol, r.name, r.next_shares) for r in files.traded_universe(other, "line").orderBy("symbol").collect()] == [("", "no symbol", ""), ("X1", "X Common Stock", "")]


def test_universe_without_header(spark):
    with pytest.raises(ValueError, match="security name"):
        files.traded_universe(lines(spark, "Y|A|Agilent|N"), "line")
    assert files.traded_universe(lines(spark), "line").collect() == []


@pytest.mark.parametrize("name, reason", [
    ("Rights Capital Inc. - Common Stock", None),
    ("Unit Corporation Common Stock", None),
    ("Notes & Co. Ordinary Shares", None),
    ("Acme Corp. – Units, each consisting of one share of Class A common stock and one-half of one warrant", "derivative or non-equity instrument"),
    ("Acme Corp. Common Stock Rights", "derivative or non-equity instrument"),
    ("Acme 5% Subordinated Debenture with common shares", None),
    ("Acme - 5% Subordinated Debenture with common shares", "derivative or non-equity instrument"),
    ("Acme Depositary Receipt", "not described as common or ordinary shares"),
])
def test_descriptor_only(spark, name, reason):
    row = spark.createDataFrame([("A", name, "N", "", "N", "N", "N")], "symbol string, name string, exchange string, financial_status string, test_issue string, etf string, next_shares string")
    assert row.select(co.ineligible_reason()).first()[0] == reason


def test_reasons_and_issuers(spark):
    base = dict(symbol="A", name="A Common Stock", exchange="N", financial_status="N", test_issue="N", etf="N", next_shares="N")
    bad = [{}, dict(symbol=" "), dict(symbol="A.B"), dict(test_issue="Y"), dict(etf="Y"), dict(next_shares="Y"), dict(exchange="P"), dict(exchange=""), dict(financial_status="Q"), dict(name=None)]
    df = spark.createDataFrame([(i, *(base | b).values()) for i, b in enumerate(bad)], "n int, " + ", ".join(f"{k} string" for k in base))
    got = [r[0] for r in df.orderBy("n").select(co.ineligible_reason()).collect()]
    assert got == [None, "no symbol", "symbol carries a class or status suffix", "test issue", "exchange-traded fund", "NextShares fund", "exchange P not accepted", "exchange (none) not accepted", "financial status Q", "not described as common or ordinary shares"]
    names = spark.createDataFrame([("Apple Inc. - Common Stock",), ("Alphabet Inc. Class A Common Stock",), ("Common Stock",), (" Plain ",)], "name string")
    assert [r[0] for r in names.coalesce(1).select(co.issuer_name("name")).collect()] == ["Apple Inc.", "Alphabet Inc.", "Common Stock", "Plain"]


def test_company_facts(spark):
    rows = [dict(start="2024-01-01", end="2024-03-31", val=1, accn="a", form="10-Q", filed="2024-05-01", fy=2024, fp="Q1"), dict(start="2024-03-31", end="2024-03-31", val=2, accn="b", form="10-Q", filed="2024-05-01"),
            dict(start="2024-04-01", end="2024-03-31", val=3, accn="c", form="10-Q", filed="2024-05-01"), dict(end="2024-03-31", val=4, accn="d", form="10-Q", filed="2024-05-01"),
            dict(start="2022-01-01", end="2024-03-31", val=5, accn="e", form="10-K", filed="2024-05-01"), dict(start="2024-01-01", end="2024-03-31", accn="f", form="10-Q", filed="2024-05-01")]
    doc = json.dumps({"cik": 1, "facts": {"us-gaap": {"T": {"units": {"USD": rows}}}}})
    got = files.company_facts(spark.createDataFrame([("1", doc)], "cik string, json string"), "json", "cik").orderBy("adsh").collect()
    assert [(r.adsh, r.qtrs, r.fy, r.fp, r.version, r.prevrpt) for r in got] == [("a", 1, "2024", "Q1", "companyfacts", False), ("d", 0, None, None, "companyfacts", False)]
    assert got[0].filed == datetime.date(2024, 5, 1) and got[0].accepted == datetime.datetime(2024, 5, 1, 23, 59, 59)


def test_facts_of_data_sets(spark):
    sub = spark.createDataFrame([("a", "12", "10-K", "20231231", "2024-02-01 10:00:00.0", "0", "20240201", "2023", "FY")], "adsh string, cik string, form string, period string, accepted string, prevrpt string, filed string, fy string, fp string")
    num = [("a", "T", "v1", "20231231", "4", "USD", "", "", x) for x in ("1.5", "Infinity", "-Infinity", "NaN", "", "x")] + [("a", "T", "v1", d, "4", "USD", "", "", "2") for d in ("", "20231331", "2023")]
    num += [("a", "T", "v1", "20231231", q, "USD", "", "", "3") for q in ("1.5", "", "x")] + [("a", "T", "v1", "20231231", "4", "USD", "Region=EU", "", "4"), ("a", "T", "v1", "20231231", "4", "USD", "", "Sub", "5"), ("b", "T", "v1", "20231231", "4", "USD", "", "", "6"), ("a", "U", "v1", "20231231", "4", "USD", "", "", "7")]
    num = spark.createDataFrame(num, "adsh string, tag string, version string, ddate string, qtrs string, uom string, segments string, coreg string, value string")
    (r,) = files.facts(num, files.submissions(sub, ["10-K"]), ["T"]).collect()
    assert (r.value, r.version, r.qtrs, r.fy, r.fp, r.filed, r.prevrpt) == (1.5, "v1", 4, "2023", "FY", datetime.date(2024, 2, 1), False)


def test_the_clock_is_the_latest_reading(spark):
    rows = [("g", "s1", "18:00", "scheduled", 1), ("g", "s2", "17:00", "scheduled", 2), ("g", "s1", None, "final", 3)]
    df = spark.createDataFrame([(*r, None) for r in rows], "game string, source string, time string, status string, at int, score int")
    (r,) = fixtures.merged_games(df, ["game"], "source", "time", "status", ["score"], "at").collect()
    assert (r.time, r.status, r.sources, r.score) == ("17:00", "final", 2, None)


def test_archive_after_its_log_was_deleted(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "new"), ("a", 2, "done"), ("b", 1, "new")], "k string, at int, status string")
    archive, ranks = str(tmp_path / "archive"), {"new": 0, "done": 1}
    assert upserts.read_archive(spark, archive, "k", "at") is None
    upserts.folded(rows, "k", "at", ranks, "status").write.parquet(f"{archive}/log/archive_version=0")
    before = sorted(map(tuple, upserts.read_archive(spark, archive, "k", "at").collect()))
    upserts.compact(spark, archive, "k")
    import shutil

    shutil.rmtree(f"{archive}/log")
    assert sorted(map(tuple, upserts.read_archive(spark, archive, "k", "at").collect())) == before
    upserts.compact(spark, archive, "k")  # nothing new
    upserts.folded(spark.createDataFrame([("b", 5, "done")], rows.schema), "k", "at", ranks, "status").write.parquet(f"{archive}/log/archive_version=1")
    assert {r["k"]: r["status"] for r in upserts.read_archive(spark, archive, "k", "at").collect()} == {"a": "done", "b": "done"}
    (tmp_path / "archive/base/archive_version=0/broken.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        upserts.read_archive(spark, archive, "k", "at").collect()
