"""Readers and writers of the text formats that filings, prices and universes come in; all parse with built-in functions.

Readers take a path or a column of whole documents and return rows; a malformed row is dropped, never guessed at.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BARS = "ticker string, open double, high double, low double, close double, volume double"
DAY = r"^\d{4}-\d{2}-\d{2}$"


def write_bars(bars: DataFrame, root: str) -> None:
    """One immutable gzip CSV folder a session (year=/date=); prices with four decimals, whole volumes; sessions on file stay."""
    spark, prices = bars.sparkSession, ("open", "high", "low", "close")
    there = session_dates(spark, root)
    fresh = bars if there is None else bars.join(F.broadcast(there), "date", "left_anti")
    rows = fresh.select("ticker", *[F.format_string("%.4f", F.col(c).cast("double")).alias(c) for c in prices], F.floor(F.col("volume") + 0.5).cast("long").alias("volume"), F.year("date").alias("year"), "date")
    rows.repartition("date").write.partitionBy("year", "date").mode("append").option("compression", "gzip").csv(root)


def session_dates(spark: SparkSession, root: str) -> DataFrame | None:
    """The sessions on file (one row a folder), None where there is no folder."""
    try:
        return spark.read.schema(f"{BARS}, year int, date date").csv(root).select("date").distinct()
    except AnalysisException:
        return None


def read_bars(spark: SparkSession, root: str) -> DataFrame:
    """ticker, date, open, high, low, close, volume of all sessions; '#' begins a comment. Rows need positive open and close; a
    missing high or low is the close."""
    rows = spark.read.schema(f"{BARS}, year int, date date").option("comment", "#").csv(root)
    return checked_bars(rows.drop("year"))


def checked_bars(rows: DataFrame) -> DataFrame:
    price = lambda c: F.coalesce(F.when(F.col(c) != 0, F.col(c)), F.col("close")).alias(c)
    good = rows.where("open > 0 and close > 0")
    return good.select("ticker", "date", "open", price("high"), price("low"), "close", F.coalesce("volume", F.lit(0.0)).alias("volume"))


def grouped_bars(docs: DataFrame, json: str, date: str) -> DataFrame:
    """Bars of JSON documents {results: [{T, o, h, l, c, v}]}, one document a session."""
    shape = "results array<struct<T: string, o: double, h: double, l: double, c: double, v: double>>"
    rows = docs.select(F.col(date).alias("date"), F.explode(F.from_json(json, shape)["results"]).alias("x"))
    named = rows.select(F.upper(F.trim("x.T")).alias("ticker"), "date", F.col("x.o").alias("open"), F.col("x.h").alias("high"), F.col("x.l").alias("low"), F.col("x.c").alias("close"), F.col("x.v").alias("volume"))
    return checked_bars(named.where("ticker <> ''"))


def dividends(docs: DataFrame, json: str) -> DataFrame:
    """ticker, ex_date, amount of {results: [{ticker, ex_dividend_date, cash_amount}]}; dates must be dates, amounts positive."""
    x = docs.select(F.explode(F.from_json(json, "results array<struct<ticker: string, ex_dividend_date: string, cash_amount: double>>")["results"]).alias("x")).select("x.*")
    return x.where(F.col("ex_dividend_date").rlike(DAY) & (F.col("cash_amount") > 0)).select(F.upper(F.trim("ticker")).alias("ticker"), F.to_date("ex_dividend_date").alias("ex_date"), F.col("cash_amount").alias("amount"))


def splits(docs: DataFrame, json: str) -> DataFrame:
    """ticker, day, ratio of {results: [{ticker, execution_date, split_from, split_to}]}; both sides must be positive."""
    x = docs.select(F.explode(F.from_json(json, "results array<struct<ticker: string, execution_date: string, split_from: double, split_to: double>>")["results"]).alias("x")).select("x.*")
    good = x.where(F.col("execution_date").rlike(DAY) & (F.col("split_from") > 0) & (F.col("split_to") > 0))
    return good.select(F.upper(F.trim("ticker")).alias("ticker"), F.to_date("execution_date").alias("day"), (F.col("split_to") / F.col("split_from")).alias("ratio"))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table of strings with a header whose case does not matter; empty fields may read null."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").option("nullValue", "\0").csv(path)
    return rows.toDF(*[c.strip().lower() for c in rows.columns])


def ymd(column: str) -> Column:
    return F.when(F.col(column).rlike(r"^\d{8}$"), F.try_to_timestamp(F.col(column), F.lit("yyyyMMdd")).cast("date"))


def accepted_instant(column: str) -> Column:
    """An acceptance time four hours on, all year; a bare date is its last second."""
    bare = F.col(column).rlike(DAY)
    return F.when(bare, F.try_to_timestamp(F.concat(F.col(column), F.lit(" 23:59:59")))).otherwise(F.try_to_timestamp(F.substring(column, 1, 19)) + F.expr("interval 4 hours")).cast("timestamp_ntz")


def submissions(table: DataFrame, forms: list[str], ciks: DataFrame | None = None) -> DataFrame:
    """Filings of the wanted forms with a numeric cik and a readable acceptance; ciks (cik) restricts them. Tables without filed, fy or fp give null."""
    has = lambda c: F.col(c) if c in table.columns else F.lit(None).cast("string").alias(c)
    filed = (ymd("filed") if "filed" in table.columns else F.lit(None).cast("date")).alias("filed")
    rows = table.where(F.col("form").isin(forms) & F.col("cik").rlike(r"^\d+$")).select(
        "adsh", F.lpad("cik", 10, "0").alias("cik"), "form", ymd("period").alias("period"), accepted_instant("accepted").alias("accepted"), (F.col("prevrpt") == "1").alias("prevrpt"), filed, has("fy"), has("fp")
    ).where("accepted is not null")
    return rows if ciks is None else rows.join(ciks, "cik", "left_semi")


def facts(table: DataFrame, filings: DataFrame, tags: list[str]) -> DataFrame:
    """Consolidated facts (no segment, no co-registrant) of the wanted tags with a date, finite values and whole quarters, with their
    version and the columns of their filing; filing columns are those of submissions()."""
    value, qtrs = F.expr("try_cast(value as double)"), F.expr("try_cast(qtrs as int)")
    version = F.trim("version") if "version" in table.columns else F.lit("")
    good = table.where((F.trim(F.coalesce("segments", F.lit(""))) == "") & (F.trim(F.coalesce("coreg", F.lit(""))) == "") & F.col("tag").isin(tags) & F.col("qtrs").rlike(r"^\d+$") & (F.abs(value) < float("inf")) & ymd("ddate").isNotNull())
    return good.select("adsh", "tag", version.alias("version"), ymd("ddate").alias("ddate"), qtrs.alias("qtrs"), F.trim("uom").alias("uom"), value.alias("value")).join(filings, "adsh")


def company_facts(docs: DataFrame, json: str, cik: str) -> DataFrame:
    """Facts of {facts: {taxonomy: {tag: {units: {unit: [{start, end, val, accn, form, filed, fy, fp}]}}}}}; quarters come from the span of
    days: none for a date, and no fact where the end does not lie behind the start or the span is of no whole quarters."""
    shape = "facts map<string, map<string, struct<units: map<string, array<struct<start: string, end: string, val: double, accn: string, form: string, filed: string, fy: string, fp: string>>>>>>"
    x = docs.select(cik, F.explode(F.from_json(json, shape)["facts"]).alias("taxonomy", "tags")).select(cik, F.explode("tags").alias("tag", "u"))
    x = x.select(cik, "tag", F.explode("u.units").alias("uom", "rows")).select(cik, "tag", "uom", F.explode("rows").alias("r")).select(cik, "tag", "uom", "r.*")
    day = lambda c: F.try_to_date(c, "yyyy-MM-dd")
    days = F.datediff(day("end"), day("start"))
    # fixed values: the most days of one to four quarters
    qtrs = F.when(F.coalesce("start", F.lit("")) == "", 0).when(days <= 0, None).when(days <= 115, 1).when(days <= 205, 2).when(days <= 295, 3).when(days <= 400, 4)
    return x.where((F.abs("val") < float("inf")) & F.col("end").rlike(DAY) & F.col("filed").rlike(DAY)).select(
        cik, F.col("accn").alias("adsh"), "tag", F.lit("companyfacts").alias("version"), day("end").alias("ddate"), qtrs.alias("qtrs"), "uom", F.col("val").alias("value"), "form", accepted_instant("filed").alias("accepted"),
        day("filed").alias("filed"), "fy", "fp", F.lit(False).alias("prevrpt"),
    ).where("qtrs is not null")


def filings_of_facts(rows: DataFrame) -> DataFrame:
    """One annual or quarterly filing for each adsh that facts name; its period is their last day."""
    return rows.where("form in ('10-K', '10-Q')").groupBy("adsh").agg(F.min("form").alias("form"), F.max("ddate").alias("period"), F.max("accepted").alias("accepted"))


def daily_index(lines: DataFrame, line: str, forms: list[str]) -> DataFrame:
    """form, company, cik, filed, path of index lines whose fields stand two spaces or more apart."""
    part = lambda i: F.regexp_extract(line, r"^(\S.*?)\s{2,}(.+?)\s{2,}(\d+)\s{2,}(\d{4}-?\d{2}-?\d{2})\s{2,}(\S+)\s*$", i)
    rows = lines.select(part(1).alias("form"), part(2).alias("company"), F.lpad(part(3), 10, "0").alias("cik"), F.regexp_replace(part(4), "-", "").alias("filed"), part(5).alias("path"))
    return rows.where(F.col("form").isin(forms)).withColumn("filed", ymd("filed"))


def parallel_filings(docs: DataFrame, json: str, cik: str) -> DataFrame:
    """Filings of {filings: {recent: {accessionNumber: [], form: [], filingDate: [], items: []}}}: parallel arrays to rows."""
    names = ("accessionNumber", "form", "filingDate", "items")
    shape = "filings struct<recent: struct<" + ", ".join(f"{n}: array<string>" for n in names) + ">>"
    x = docs.select(cik, F.from_json(json, shape)["filings"]["recent"].alias("r")).select(cik, F.explode(F.arrays_zip(*[F.col(f"r.{n}").alias(n) for n in names])).alias("x")).select(cik, "x.*")
    return x.where(F.col("filingDate").rlike(DAY)).select(cik, F.col("accessionNumber").alias("accession"), "form", F.to_date("filingDate").alias("filed"), items("items").alias("items"))


def items(column: str) -> Column:
    """The distinct item numbers of a filing's list."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(r"(\d+\.\d+)"), 1))


#: The columns of a traded universe by their names in its header; the last two may be missing.
UNIVERSE = {
    "symbol": "symbol", "name": "security name", "exchange": "listing exchange", "etf": "etf", "test_issue": "test issue", "financial_status": "financial status", "next_shares": "nextshares",
}
_OPTIONAL = ("financial_status", "next_shares")


def traded_universe(lines: DataFrame, line: str) -> DataFrame:
    """The columns of UNIVERSE of pipe-separated lines with a header, found by the header's names in any case and order.

    The header is read first (one row); the trailer, empty lines and lines that lack more than one field are left out, fields that lack read empty.
    Lines without a header that has the columns are an error; no lines give no rows.
    """
    f = F.transform(F.split(F.regexp_replace(line, "\\r$", ""), r"\|"), lambda x: F.trim(x))  # trim takes a second argument, which would be the place
    needed = [F.lit(v) for k, v in UNIVERSE.items() if k not in _OPTIONAL]
    is_head = F.size(F.array_except(F.array(*needed), F.transform(f, F.lower))) == 0
    head = lines.where(is_head).select(F.transform(f, F.lower).alias("f")).limit(1).collect()
    if not head and not lines.where(F.length(line) > 0).isEmpty():
        raise ValueError(f"no header with the columns {', '.join(v for k, v in UNIVERSE.items() if k not in _OPTIONAL)}")
    names = head[0]["f"] if head else list(UNIVERSE.values())
    rows = lines.where((F.length(line) > 0) & ~is_head & ~F.col(line).startswith("File Creation Time:") & (F.size(f) >= len(names) - 1))
    at = {k: names.index(v) if v in names else None for k, v in UNIVERSE.items()}
    return rows.select(*[(F.lit("") if i is None else F.coalesce(F.get(f, F.lit(i)), F.lit(""))).alias(k) for k, i in at.items()])


def universe_created(lines: DataFrame, line: str) -> DataFrame:
    """created_at, the text behind the trailer's "File Creation Time:"; no row without a trailer."""
    return lines.where(F.col(line).startswith("File Creation Time:")).select(F.trim(F.substring(line, 20, 1000)).alias("created_at"))


def ticker_map(docs: DataFrame, json: str) -> DataFrame:
    """ticker, cik (ten digits) of {"0": {ticker, cik_str}, ...}; the first entry of a ticker counts."""
    x = docs.select(F.explode(F.from_json(json, "map<string, struct<ticker: string, cik_str: long>>")).alias("at", "x"))
    first = x.groupBy(F.upper("x.ticker").alias("ticker")).agg(F.min_by("x.cik_str", F.col("at").cast("long")).alias("cik"))
    return first.where("ticker is not null and cik is not null").select("ticker", F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"))


def feed_items(docs: DataFrame, xml: str, key: str) -> DataFrame:
    """key, title, url, published, excerpt of RSS and Atom documents; other documents have no items."""
    rss = F.from_xml(F.col(xml), F.schema_of_xml(F.lit("<rss><channel><item><title>a</title><link>a</link><pubDate>a</pubDate><description>a</description></item><item><title>b</title></item></channel></rss>")))
    atom = F.from_xml(F.col(xml), F.lit("entry array<struct<title: string, link: array<struct<_href: string, _rel: string>>, updated: string, summary: string>>"))
    link = F.filter("x.link", lambda a: F.coalesce(a["_rel"], F.lit("alternate")) == "alternate")[0]["_href"]
    one = docs.where(F.col(xml).contains("<rss")).select(key, F.explode(rss["channel"]["item"]).alias("x")).select(key, F.trim("x.title").alias("title"), F.trim("x.link").alias("url"), F.col("x.pubDate").alias("published"), F.col("x.description").alias("excerpt"))
    two = docs.where(F.col(xml).contains("<feed")).select(key, F.explode(atom["entry"]).alias("x")).select(key, F.trim("x.title").alias("title"), link.alias("url"), F.col("x.updated").alias("published"), F.col("x.summary").alias("excerpt"))
    return one.unionByName(two)
