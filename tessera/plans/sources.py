"""Queries that write the driver's tables in the source formats and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files
from .tables import scratch

TAGS = ["A", "R"]


def _read(spark, sf_dir, t):
    return spark.read.parquet(f"{sf_dir}/{t}.parquet")


def _bars(spark, sf_dir):
    e = _read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("ticker"), F.to_date("ts").alias("date")).agg(
        F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"), F.count("*").cast("double").alias("volume"))
    return e


def _rounded(df):
    return df.select("ticker", F.col("date").cast("string").alias("date"), *[F.round(c, 2).alias(c) for c in ("open", "high", "low", "close")], "volume")


def bars_round_trip(spark, sf_dir):
    """Bars written as one gzip CSV folder a session, twice (the second time nothing is new), and read back."""
    root = f"{scratch(spark)}/bars"
    for _ in range(2):
        files.write_bars(_bars(spark, sf_dir), root)
    return _rounded(files.read_bars(spark, root))


def grouped_bars_json(spark, sf_dir):
    """Bars of one JSON document a session; the low of half the tickers is missing and becomes the close."""
    low = F.when(F.length("ticker") % 2 == 0, F.col("low"))
    one = F.struct(F.format_string(" %s ", F.col("ticker")).alias("T"), F.col("open").alias("o"), F.col("high").alias("h"), low.alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"))
    docs = _bars(spark, sf_dir).groupBy("date").agg(F.to_json(F.struct(F.collect_list(one).alias("results"))).alias("json"))
    return _rounded(files.grouped_bars(docs, "json", "date"))


def dividends_json(spark, sf_dir):
    e = _read(spark, sf_dir, "events").where("event_type = 'signup'")
    one = F.struct(F.format_string("u%d", F.col("user_id")).alias("ticker"), F.when(F.col("event_id") % 4 > 0, F.date_format("ts", "yyyy-MM-dd")).otherwise("n/a").alias("ex_dividend_date"), F.col("value").alias("cash_amount"), F.col("event_id").alias("id"))
    docs = e.select(F.to_json(F.struct(F.array(one).alias("results"))).alias("json"))
    return files.dividends(docs, "json").groupBy("ticker").agg(F.count("*").alias("n"), F.max("ex_date").cast("string").alias("last"), F.round(F.sum("amount"), 2).alias("total"))


def splits_json(spark, sf_dir):
    e = _read(spark, sf_dir, "lineitem")
    one = F.struct(F.format_string("p%d", F.col("l_partkey")).alias("ticker"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("execution_date"), F.col("l_linenumber").cast("double").alias("split_from"), (F.col("l_quantity") - 5).alias("split_to"))
    docs = e.select(F.to_json(F.struct(F.array(one).alias("results"))).alias("json"))
    return files.splits(docs, "json").groupBy("ticker").agg(F.count("*").alias("n"), F.max("day").cast("string").alias("last"), F.round(F.max("ratio"), 6).alias("largest"))


def facts_from_tsv(spark, sf_dir):
    """Orders as filings and line items as facts, as tab-separated files; whole facts of two tags with their filing."""
    base, o, li = scratch(spark), _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "lineitem")
    form = F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "10-Q").otherwise("8-K")
    sub = o.select(F.col("o_orderkey").alias("ADSH"), F.col("o_custkey").alias("CIK"), form.alias("Form"), F.date_format("o_orderdate", "yyyyMMdd").alias("period"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss.0").alias("accepted"), F.when(F.col("o_orderkey") % 7 == 0, "1").otherwise("0").alias("prevrpt"))
    segment = F.when(F.col("l_linestatus") == "F", "Region=EU").otherwise("")
    num = li.select(F.col("l_orderkey").alias("adsh"), F.col("l_returnflag").alias("tag"), F.date_format("l_shipdate", "yyyyMMdd").alias("ddate"), F.col("l_linenumber").alias("qtrs"), F.lit("USD").alias("uom"), segment.alias("segments"), F.lit("").alias("coreg"), F.col("l_extendedprice").alias("value"))
    for name, df in (("sub", sub), ("num", num)):
        df.write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(f"{base}/{name}")
    filings = files.submissions(files.read_tsv(spark, f"{base}/sub"), ["10-K", "10-Q"])
    out = files.facts(files.read_tsv(spark, f"{base}/num"), filings, TAGS)
    return out.select("adsh", "cik", "tag", F.col("ddate").cast("string").alias("ddate"), "qtrs", F.round("value", 2).alias("value"), "form", F.col("period").cast("string").alias("period"), F.date_format("accepted", "yyyy-MM-dd HH:mm:ss").alias("accepted"), "prevrpt")


def _company_docs(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    start = F.when(F.col("o_orderkey") % 3 > 0, F.date_format(F.date_sub("o_orderdate", F.lit(90)), "yyyy-MM-dd"))
    row = F.struct(start.alias("start"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("end"), F.col("o_totalprice").alias("val"), F.format_string("a%d", F.col("o_orderkey")).alias("accn"), F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "10-Q").otherwise("8-K").alias("form"), F.date_format(F.date_add("o_orderdate", 30), "yyyy-MM-dd").alias("filed"))
    # one document an order, as a company's document holds only its own rows
    units = F.create_map(F.lit("USD"), F.array(row))
    return o.select(F.col("o_custkey").alias("cik"), F.to_json(F.struct(F.create_map(F.lit("gaap"), F.create_map(F.col("o_orderpriority"), F.struct(units.alias("units")))).alias("facts"))).alias("json"))


def company_facts_json(spark, sf_dir):
    out = files.company_facts(_company_docs(spark, sf_dir), "json", "cik")
    return out.select("cik", "adsh", "tag", F.col("ddate").cast("string").alias("ddate"), "qtrs", F.round("value", 2).alias("value"), F.date_format("accepted", "yyyy-MM-dd HH:mm:ss").alias("accepted"))


def filings_of_facts(spark, sf_dir):
    out = files.filings_of_facts(files.company_facts(_company_docs(spark, sf_dir), "json", "cik"))
    return out.select("adsh", "form", F.col("period").cast("string").alias("period"))


def daily_index_lines(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    form = F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "10-Q").otherwise("8-K")
    line = F.concat(F.rpad(form, 12, " "), F.rpad("c_name", 40, " "), F.rpad(F.col("c_custkey").cast("string"), 12, " "), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("  "), F.format_string("data/%d.txt", F.col("o_orderkey")))
    head = spark.range(1).select(F.lit("Form Type   Company Name   CIK   Date Filed  File Name").alias("line"))
    out = files.daily_index(o.select(line.alias("line")).union(head), "line", ["10-K", "8-K"])
    return out.select("form", "company", "cik", F.col("filed").cast("string").alias("filed"), "path")


def parallel_filings(spark, sf_dir):
    """Each customer's orders as parallel arrays in one document."""
    o = _read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.struct(F.format_string("a%d", F.col("o_orderkey")).alias("a"), F.col("o_orderstatus").alias("f"), F.when(F.col("o_orderkey") % 5 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("").alias("d"), F.format_string("Item %d.02, %d.02 and 9.01", F.col("o_orderkey") % 3, F.col("o_orderkey") % 2).alias("i")).alias("x"))
    g = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list("x")).alias("x"))
    recent = F.struct(*[F.col(f"x.{c}").alias(n) for c, n in (("a", "accessionNumber"), ("f", "form"), ("d", "filingDate"), ("i", "items"))])
    docs = g.select(F.col("o_custkey").alias("cik"), F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("json"))
    return files.parallel_filings(docs, "json", "cik").select("cik", "accession", "form", F.col("filed").cast("string").alias("filed"), F.concat_ws(",", "items").alias("items"))


def ticker_ciks(spark, sf_dir):
    """Suppliers named like tickers in one map each; a ticker's first entry counts; then parts looked up by either of two spellings."""
    s = _read(spark, sf_dir, "supplier")
    docs = s.groupBy((F.col("s_suppkey") % 16).alias("file")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("s_suppkey").cast("string"), F.struct(F.format_string("t%d", F.col("s_suppkey") % 40).alias("ticker"), F.col("s_suppkey").alias("cik_str")))))).alias("json"))
    ciks = files.ticker_map(docs, "json")
    p = _read(spark, sf_dir, "part").select("p_partkey", F.format_string("T%d", F.col("p_partkey") % 90).alias("one"), F.format_string("T%d", F.col("p_size")).alias("two"))
    one, two = (ciks.select(F.col("ticker").alias(c), F.col("cik").alias(f"cik_{c}")) for c in ("one", "two"))
    return p.join(F.broadcast(one), "one", "left").join(F.broadcast(two), "two", "left").select("p_partkey", F.coalesce("cik_one", "cik_two").alias("cik"))


def feed_items(spark, sf_dir):
    """Pages as one-item feeds, of either dialect."""
    p = _read(spark, sf_dir, "pages").select("page_id", F.replace("url", F.lit("&"), F.lit("&amp;")).alias("u"))
    rss = F.concat(F.lit("<rss><channel><item><title>Page "), "page_id", F.lit("</title><link>"), "u", F.lit("</link><pubDate>2024-01-01</pubDate><description>d</description></item></channel></rss>"))
    atom = F.concat(F.lit("<feed><entry><title>Page "), "page_id", F.lit("</title><link rel='self' href='x'/><link href='"), "u", F.lit("'/><updated>2024-01-02</updated></entry></feed>"))
    docs = p.select("page_id", F.when(F.col("page_id") % 2 == 0, rss).otherwise(atom).alias("xml"))
    return files.feed_items(docs, "xml", "page_id").select("page_id", "title", "url", "published")


QUERIES = {f.__name__: f for f in (bars_round_trip, grouped_bars_json, dividends_json, splits_json, facts_from_tsv, company_facts_json, filings_of_facts, daily_index_lines, parallel_filings, ticker_ciks, feed_items)}
_BARS = """b AS (SELECT event_type AS ticker, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2)"""
_FORM = "CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-Q' ELSE '8-K' END"
ORACLE_SQL = {
    "bars_round_trip": f"WITH {_BARS} SELECT ticker, date, round(open, 2) AS open, round(CASE WHEN high <> 0 THEN high ELSE close END, 2) AS high, round(CASE WHEN low <> 0 THEN low ELSE close END, 2) AS low, round(close, 2) AS close, volume FROM b WHERE open > 0 AND close > 0",
    "grouped_bars_json": f"WITH {_BARS} SELECT upper(ticker) AS ticker, date, round(open, 2) AS open, round(high, 2) AS high, round(CASE WHEN length(ticker) % 2 = 0 AND low <> 0 THEN low ELSE close END, 2) AS low, round(close, 2) AS close, volume FROM b WHERE open > 0 AND close > 0",
    "dividends_json": "SELECT 'U' || user_id AS ticker, count(*) AS n, CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS last, round(sum(value), 2) AS total FROM events WHERE event_type = 'signup' AND event_id % 4 > 0 AND value > 0 GROUP BY 1",
    "splits_json": "SELECT 'P' || l_partkey AS ticker, count(*) AS n, CAST(max(CAST(l_shipdate AS DATE)) AS VARCHAR) AS last, round(max((l_quantity - 5) / l_linenumber), 6) AS largest FROM lineitem WHERE l_quantity > 5 AND l_linenumber > 0 GROUP BY 1",
    "facts_from_tsv": f"""SELECT CAST(l_orderkey AS VARCHAR) AS adsh, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, l_returnflag AS tag, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS ddate, l_linenumber AS qtrs, round(l_extendedprice, 2) AS value,
  {_FORM} AS form, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS period, strftime(date_trunc('second', o_orderdate) + INTERVAL 4 HOUR, '%Y-%m-%d %H:%M:%S') AS accepted, o_orderkey % 7 = 0 AS prevrpt
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus IN ('F', 'O') AND l_linestatus <> 'F' AND l_returnflag IN ('A', 'R')""",
    "company_facts_json": """SELECT o_custkey AS cik, 'a' || o_orderkey AS adsh, o_orderpriority AS tag, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS ddate, CAST(CASE WHEN o_orderkey % 3 > 0 THEN 1 ELSE 0 END AS INTEGER) AS qtrs,
  round(o_totalprice, 2) AS value, strftime(CAST(o_orderdate AS DATE) + 30, '%Y-%m-%d') || ' 23:59:59' AS accepted FROM orders""",
    "filings_of_facts": f"SELECT 'a' || o_orderkey AS adsh, {_FORM} AS form, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS period FROM orders WHERE {_FORM} <> '8-K'",
    "daily_index_lines": f"SELECT {_FORM} AS form, c_name AS company, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS filed, 'data/' || o_orderkey || '.txt' AS path FROM orders JOIN customer ON o_custkey = c_custkey WHERE {_FORM} IN ('10-K', '8-K')",
    "parallel_filings": """SELECT o_custkey AS cik, 'a' || o_orderkey AS accession, o_orderstatus AS form, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS filed,
  CASE WHEN o_orderkey % 3 = o_orderkey % 2 THEN (o_orderkey % 3) || '.02,9.01' ELSE (o_orderkey % 3) || '.02,' || (o_orderkey % 2) || '.02,9.01' END AS items FROM orders WHERE o_orderkey % 5 > 0""",
    "ticker_ciks": """WITH m AS (SELECT 'T' || (s_suppkey % 40) AS t, lpad(CAST(min(s_suppkey) AS VARCHAR), 10, '0') AS cik FROM supplier GROUP BY 1)
SELECT p_partkey, coalesce(a.cik, b.cik) AS cik FROM part LEFT JOIN m a ON a.t = 'T' || (p_partkey % 90) LEFT JOIN m b ON b.t = 'T' || p_size""",
    "feed_items": "SELECT page_id, 'Page ' || page_id AS title, url, CASE WHEN page_id % 2 = 0 THEN '2024-01-01' ELSE '2024-01-02' END AS published FROM pages",
}
