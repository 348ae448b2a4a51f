"""Queries on companies, filings, positions and editions over stand-in tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import company as co
from ..operators import fixtures, selection
from ..sources import files
from .tables import scratch

NOW = "2024-01-31 00:00:00"


def _read(spark, sf_dir, t):
    return spark.read.parquet(f"{sf_dir}/{t}.parquet")


def sic_groups(spark, sf_dir):
    """Parts by industry code (their keys, over the whole range of codes, some of them invalid)."""
    sic = F.when(F.col("p_partkey") % 17 == 0, "n/a").otherwise((F.col("p_partkey") * 7 % 10000).cast("string"))
    p = _read(spark, sf_dir, "part").withColumn("sic", sic)
    return p.groupBy(co.sector_group("sic").alias("sector"), co.division("sic").alias("division")).agg(F.count("*").alias("n"), F.count_distinct(co.major_group("sic")).alias("majors"))


def _universe(spark, sf_dir):
    """Parts as a traded universe in its own layout; makers' names hold words that are instruments elsewhere."""
    p = _read(spark, sf_dir, "part")
    flag = lambda n, r: F.when(F.col("p_partkey") % n == r, "Y").otherwise("N")
    k = F.col("p_size") % 5
    kind = F.when(k == 0, " - Warrants to buy Common Stock").when(k == 1, " Fund").when(k == 2, " - Subordinated Notes with Common Shares").when(k == 3, " Class A Common Stock").otherwise(" - Ordinary Shares")
    symbol = F.concat(F.lit("P"), "p_partkey", F.when(F.col("p_partkey") % 13 == 0, ".A").otherwise(""))
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, "Rights ").otherwise("Units "), "p_name", kind)
    line = F.concat_ws("|", F.lit("Y"), symbol, name, F.when(F.col("p_partkey") % 3 == 0, "X").otherwise("N"), F.lit(" "), flag(7, 1), F.lit("100"), flag(11, 2), F.when(F.col("p_partkey") % 19 == 0, "D").otherwise(""), symbol, symbol, flag(23, 3))
    head = "Nasdaq Traded|Symbol|Security Name|Listing Exchange|Market Category|ETF|Round Lot Size|Test Issue|Financial Status|CQS Symbol|NASDAQ Symbol|NextShares"
    ends = spark.range(2).select(F.when(F.col("id") == 0, head).otherwise("File Creation Time: 0101202400:00|||||||||||").alias("line"))
    return files.traded_universe(p.select(line.alias("line")).unionByName(ends), "line")


def traded_universe(spark, sf_dir):
    """Why each row of a traded universe is out of it, counted."""
    return selection.drop_report(_universe(spark, sf_dir).withColumn("reason", co.ineligible_reason()), "reason")


def issuers(spark, sf_dir):
    """The eligible symbols with their issuers' names."""
    rows = _universe(spark, sf_dir).where(co.ineligible_reason().isNull())
    return rows.select("symbol", co.issuer_name("name").alias("issuer"), co.descriptor("name").alias("descriptor"))


def announcement_kinds(spark, sf_dir):
    """Events as filings with item lists: earnings releases and material events by user."""
    e = _read(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "view", "10-Q").otherwise("8-K/A").alias("form"), F.format_string("%d.02; 5.0%d and %d.02", F.col("event_id") % 4, F.col("event_id") % 3, F.col("event_id") % 4).alias("raw"))
    e = e.withColumn("items", files.items("raw"))
    return e.groupBy("user_id").agg(F.count_if(co.is_earnings_release("form", "items")).alias("releases"), F.count_if(co.is_material_event("form", "items", ["5.01", "1.02"])).alias("material"))


def earnings_risk(spark, sf_dir):
    """Whether each customer's next order, expected 80 days after the last one, falls into a window of 30 days from 1998-08-01."""
    o = _read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.date_add(F.max(F.to_date("o_orderdate")), 80).alias("expected"), F.least(F.lit(60), F.count("*").cast("int")).alias("spread"))
    o = o.withColumns({"entry": F.lit("1998-08-01").cast("date"), "exit": F.lit("1998-08-31").cast("date")})
    return o.groupBy(F.coalesce(co.earnings_risk("expected", "spread", "entry", "exit"), F.lit("none")).alias("risk")).agg(F.count("*").alias("n"))


def figures_and_ids(spark, sf_dir):
    """Ratios that need a positive base, clipped values and hashed ids of line items by order."""
    g = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.sum(F.col("l_linenumber") - 4).cast("double").alias("base"))
    return g.select("l_orderkey", F.round(co.ratio("q", "base"), 6).alias("ratio"), F.round(co.clip(F.col("base") / 10, -0.5, 0.5), 6).alias("clipped"), co.short_id(F.lit("order"), F.col("l_orderkey")).alias("id"))


def preferred_series(spark, sf_dir):
    """For each customer the first order status, in the order F, P, O, that has two orders the last of which is of 1998."""
    o = _read(spark, sf_dir, "orders")
    usable = o.groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"), F.max(F.to_date("o_orderdate")).alias("last")).where("n >= 2 and last >= date'1998-01-01'")
    place = F.array_position(F.array(*map(F.lit, ["F", "P", "O"])), F.col("o_orderstatus"))
    best = usable.groupBy("o_custkey").agg(F.min(F.struct(place.alias("p"), "o_orderstatus", "n")).alias("x"))
    return best.select("o_custkey", F.col("x.o_orderstatus").alias("series"), F.col("x.n").alias("n"))


def seeded_pick(spark, sf_dir):
    """One customer a nation, at a place drawn by the nation's key."""
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return selection.seeded_pick(c, "c_nationkey", [F.asc("c_custkey")], F.col("c_nationkey").cast("long"))


def pick_and_runners(spark, sf_dir):
    """Each nation's supplier of the greatest balance and the three after it."""
    s = _read(spark, sf_dir, "supplier")
    return selection.pick_and_runners(s, "s_nationkey", [F.desc("s_acctbal"), F.asc("s_suppkey")]).select("s_nationkey", "s_suppkey", "place", "role")


def scoreboard(spark, sf_dir):
    """Orders as picks: from the first price of the priority on or after the pick's month to its last; the mean by priority."""
    o = _read(spark, sf_dir, "orders")
    bars = o.groupBy("o_orderpriority", F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("close"))
    picks = o.select("o_orderpriority", F.trunc("o_orderdate", "month").alias("date")).distinct()
    ends = bars.groupBy("o_orderpriority").agg(F.max_by("close", "date").alias("last"))
    firsts = bars.groupBy("o_orderpriority", F.trunc("date", "month").alias("month")).agg(F.min_by("close", "date").alias("first"))
    each = picks.join(firsts.withColumnRenamed("month", "date"), ["o_orderpriority", "date"]).join(ends, "o_orderpriority")
    return each.groupBy("o_orderpriority").agg(F.count("*").alias("picks"), F.round(F.avg(F.col("last") / F.col("first") - 1), 4).alias("mean"))


def holding_windows(spark, sf_dir):
    """For each day of the calendar the entry (the next session) and the exit (20 sessions on), with the sessions held by its end."""
    days = _read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    idx = days.withColumn("i", F.row_number().over(W.orderBy("date")) - 1)  # a row a day
    n = idx.agg((F.max("i")).alias("top"))
    at = lambda k, c: idx.select((F.col("i") - k).alias("i"), F.col("date").cast("string").alias(c))
    out = idx.crossJoin(F.broadcast(n)).join(at(1, "entry"), "i", "left").join(at(21, "exit"), "i", "left")
    return out.select(F.col("date").cast("string").alias("date"), "entry", "exit", F.greatest(F.lit(0), F.least(F.lit(21), F.col("top") - F.col("i"))).cast("int").alias("held"))


def benchmark_legs(spark, sf_dir):
    """Positions of each priority between first and last order day of a year, matched with all orders' mean on the same days."""
    o = _read(spark, sf_dir, "orders").select("o_orderpriority", F.to_date("o_orderdate").alias("date"), "o_totalprice")
    bench = o.groupBy("date").agg(F.avg("o_totalprice").alias("b"))
    own = o.groupBy("o_orderpriority", "date").agg(F.avg("o_totalprice").alias("p"))
    legs = own.groupBy("o_orderpriority", F.year("date").alias("year")).agg(F.min("date").alias("entry"), F.max("date").alias("exit"), F.min_by("p", "date").alias("p0"), F.max_by("p", "date").alias("p1"))
    one, two = (bench.select(F.col("date").alias(d), F.col("b").alias(b)) for d, b in (("entry", "b0"), ("exit", "b1")))
    both = legs.join(one, "entry").join(two, "exit")
    return both.select("o_orderpriority", "year", F.round(F.col("p1") / F.col("p0") - F.col("b1") / F.col("b0"), 4).alias("excess"))


def ingest_gate(spark, sf_dir):
    """Why documents stay out of an edition, by language: the first rule that a row fails."""
    d = _read(spark, sf_dir, "documents").withColumn("title", F.trim(F.substring_index("text", "\n", 1)))
    rules = [("no-text", F.coalesce(F.trim("text"), F.lit("")) == ""), ("short-title", F.length("title") < 20), ("long-title", F.length("title") > 400), ("shouting", F.col("title") == F.upper("title"))]
    return selection.drop_report(d.withColumn("reason", selection.first_reason(rules)), "reason", "lang")


def fresh_unseen(spark, sf_dir):
    """Events of the last two days whose user was not seen in the two weeks before."""
    e = _read(spark, sf_dir, "events").select("event_id", "ts", F.concat(F.lit("https://www.e.org/u/"), "user_id", F.lit("/?utm_source=x")).alias("url"))
    seen = e.where(F.col("ts").between(F.lit("2024-01-15").cast("timestamp_ntz"), F.lit("2024-01-28").cast("timestamp_ntz"))).select(F.regexp_replace("url", "www[.]", "").alias("url")).distinct()
    return selection.fresh(e.where(F.col("ts") <= F.lit("2024-01-30").cast("timestamp_ntz")), seen, "url", "ts", F.lit("2024-01-30").cast("timestamp_ntz"), 48).select("event_id")


def item_scores(spark, sf_dir):
    """Parts as stories: weight by size, age by key, boosts by name."""
    p, n = _read(spark, sf_dir, "part"), F.col("p_name")
    score = selection.item_score(F.col("p_size") / 10, (F.col("p_partkey") % 72).cast("double"), n, n, F.repeat(n, 4), F.col("p_brand") == "Brand#1", [("(?i)small", 1.3), ("bolt|ring", 0.7)], ["^hot ", "widget$"])
    return p.select("p_partkey", F.round(score, 6).alias("score"))


def edition_top(spark, sf_dir):
    """Five documents a language: by length of the title, with at most two of a source (one in the first three), different first
    words in the first three, and no two with three proper nouns in common."""
    d = _read(spark, sf_dir, "documents").where("text is not null")
    title = F.substring_index("text", "\n", 1)
    items = d.select("doc_id", "lang", "source", F.least(F.lit(80), F.length(title)).cast("double").alias("score"), (F.col("doc_id") % 5 == 0).alias("foreign"), F.lower(F.substring_index(title, " ", 1)).alias("subject"), selection.proper_nouns(title, F.lit(""), F.col("source")).alias("tokens"))
    path = f"{scratch(spark)}/items"  # the walk reads them once a pick
    items.write.parquet(path)
    return selection.select_per_topic(spark.read.parquet(path), 5, topic="lang", key="doc_id", publisher="source")


def game_slots(spark, sf_dir):
    """Line items as games of a part and a supplier on a day: same-day repeats get slots, unknown times come last."""
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fixtures.pair(F.col("l_suppkey"), F.col("l_partkey") % 20).cast("string").alias("pair"), F.trunc("l_shipdate", "month").alias("date"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_quantity")).alias("time"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("place"))
    return fixtures.slots(li, ["pair", "date"], "time", "place").select("l_orderkey", "l_linenumber", "slot")


def merged_games(spark, sf_dir):
    """Events of a user's day as reports of one game by several sources."""
    e = _read(spark, sf_dir, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), F.concat(F.lit("s"), F.col("event_id") % 3).alias("source"), F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "HH:mm")).alias("time"), F.element_at(F.create_map(*[F.lit(x) for x in ("click", "scheduled", "view", "scheduled", "signup", "postponed", "error", "cancelled", "purchase", "final")]), F.col("event_type")).alias("status"), F.when(F.col("event_type") == "purchase", F.floor("value").cast("long")).alias("score"), "event_id")
    return fixtures.merged_games(e, ["user_id", "day"], "source", "time", "status", ["score"], "event_id")


def quarantine(spark, sf_dir):
    """Orders to publish: those with a bad total come from the last publication, which had double prices, where that is sound."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("total"))
    before = o.withColumn("total", F.round(F.col("total") * 2, 2))
    return fixtures.quarantined(o, before, "o_orderkey", F.col("total") < 3000, share=0.5)


def host_identities(spark, sf_dir):
    """Pages' first path words as names on hosts: names that agree become one."""
    p = _read(spark, sf_dir, "pages").select(F.parse_url("url", F.lit("HOST")).alias("host"), F.concat(F.lit("team "), (F.col("page_id") % 3).cast("string"), F.when(F.col("page_id") % 2 == 0, F.lit(" state")).otherwise("")).alias("name"))
    names = p.withColumns({"slug": F.replace("name", F.lit(" "), F.lit("-")), "host": F.concat("host", F.substring("name", 6, 1))})
    merges = fixtures.identities(names, "slug", "name", "host")
    return fixtures.canonical(names.select("slug").distinct().withColumn("was", F.col("slug")), merges, "slug").select("was", F.col("slug").alias("team"))


QUERIES = {
    f.__name__: f
    for f in (
        sic_groups, traded_universe, announcement_kinds, earnings_risk, figures_and_ids, preferred_series, seeded_pick, pick_and_runners, scoreboard, holding_windows, benchmark_legs,
        ingest_gate, fresh_unseen, item_scores, edition_top, issuers, game_slots, merged_games, quarantine, host_identities,
    )
}
ORACLE_SQL = {
    "sic_groups": """WITH p AS (SELECT CASE WHEN p_partkey % 17 <> 0 THEN p_partkey * 7 % 10000 END AS n FROM part), g AS (SELECT n,
  CASE WHEN n BETWEEN 6000 AND 6999 THEN 'finance' WHEN n BETWEEN 4900 AND 4999 THEN 'utilities' WHEN n BETWEEN 1200 AND 1399 OR n BETWEEN 2900 AND 2999 THEN 'energy' ELSE 'operating' END AS sector,
  CASE WHEN n IS NULL OR n <= 0 THEN 'Unclassified' WHEN n < 1000 THEN 'Agriculture, Forestry and Fishing' WHEN n < 1500 THEN 'Mining' WHEN n < 1800 THEN 'Construction' WHEN n < 2000 THEN 'Unclassified'
    WHEN n < 4000 THEN 'Manufacturing' WHEN n < 5000 THEN 'Transportation, Communications and Utilities' WHEN n < 5200 THEN 'Wholesale Trade' WHEN n < 6000 THEN 'Retail Trade'
    WHEN n < 6800 THEN 'Finance, Insurance and Real Estate' WHEN n < 7000 THEN 'Unclassified' WHEN n < 9000 THEN 'Services' ELSE 'Public Administration' END AS division FROM p)
SELECT sector, division, count(*) AS n, count(DISTINCT CASE WHEN n >= 100 THEN lpad(CAST(n AS VARCHAR), 4, '0')[1:2] END) AS majors FROM g GROUP BY 1, 2""",
    "traded_universe": """WITH r AS (SELECT CASE WHEN p_partkey % 13 = 0 THEN 'symbol carries a class or status suffix' WHEN p_partkey % 11 = 2 THEN 'test issue' WHEN p_partkey % 7 = 1 THEN 'exchange-traded fund' WHEN p_partkey % 23 = 3 THEN 'NextShares fund'
  WHEN p_partkey % 3 = 0 THEN 'exchange X not accepted' WHEN p_partkey % 19 = 0 THEN 'financial status D' WHEN p_size % 5 = 1 THEN 'not described as common or ordinary shares' WHEN p_size % 5 IN (0, 2) THEN 'derivative or non-equity instrument' ELSE 'kept' END AS reason FROM part)
SELECT reason, count(*) AS n FROM r GROUP BY 1""",
    "issuers": """SELECT 'P' || p_partkey AS symbol, CASE WHEN p_partkey % 2 = 0 THEN 'Rights ' ELSE 'Units ' END || p_name AS issuer, CASE WHEN p_size % 5 = 3 THEN 'Common Stock' ELSE ' - Ordinary Shares' END AS descriptor FROM part
WHERE p_partkey % 13 <> 0 AND p_partkey % 11 <> 2 AND p_partkey % 7 <> 1 AND p_partkey % 23 <> 3 AND p_partkey % 3 <> 0 AND p_partkey % 19 <> 0 AND p_size % 5 IN (3, 4)""",
    "announcement_kinds": """SELECT user_id, count(*) FILTER (WHERE event_type <> 'view' AND event_id % 4 = 2) AS releases, count(*) FILTER (WHERE event_type <> 'view' AND (event_id % 4 = 1 OR event_id % 3 = 1)) AS material FROM events GROUP BY 1""",
    "earnings_risk": """WITH o AS (SELECT o_custkey, CAST(max(CAST(o_orderdate AS DATE)) + 80 AS DATE) AS x, CAST(least(60, count(*)) AS INTEGER) AS s FROM orders GROUP BY 1)
SELECT CASE WHEN x BETWEEN DATE '1998-08-01' AND DATE '1998-08-31' THEN 'in' WHEN x BETWEEN DATE '1998-08-01' - s AND DATE '1998-08-31' + s THEN 'near' ELSE 'none' END AS risk, count(*) AS n FROM o GROUP BY 1""",
    "figures_and_ids": """SELECT l_orderkey, CASE WHEN sum(l_linenumber - 4) > 0 THEN round(sum(l_quantity) / sum(l_linenumber - 4), 6) END AS ratio, round(least(0.5, greatest(-0.5, sum(l_linenumber - 4) / 10)), 6) AS clipped,
  substr(sha1('order|' || l_orderkey), 1, 12) AS id FROM lineitem GROUP BY 1""",
    "preferred_series": """WITH u AS (SELECT o_custkey, o_orderstatus, count(*) AS n, max(o_orderdate) AS last FROM orders GROUP BY 1, 2 HAVING count(*) >= 2 AND max(o_orderdate) >= DATE '1998-01-01')
SELECT o_custkey, o_orderstatus AS series, n FROM u QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY list_position(['F', 'P', 'O'], o_orderstatus)) = 1""",
    "seeded_pick": """SELECT c_custkey, c_nationkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 = abs((CAST(c_nationkey AS BIGINT) * 1103515245 + 12345) % 2147483648) % count(*) OVER (PARTITION BY c_nationkey)""",
    "pick_and_runners": """SELECT s_nationkey, s_suppkey, CAST(row_number() OVER w AS INTEGER) AS place, CASE WHEN row_number() OVER w = 1 THEN 'pick' ELSE 'runner-up' END AS role FROM supplier
WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) QUALIFY row_number() OVER w <= 4""",
    "scoreboard": """WITH b AS (SELECT o_orderpriority AS p, CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS c FROM orders GROUP BY 1, 2),
m AS (SELECT p, date_trunc('month', d) AS m, arg_min(c, d) AS f FROM b GROUP BY 1, 2), l AS (SELECT p, arg_max(c, d) AS l FROM b GROUP BY 1)
SELECT m.p AS o_orderpriority, count(*) AS picks, round(avg(l / f - 1), 4) AS mean FROM m JOIN l ON m.p = l.p GROUP BY 1""",
    "holding_windows": """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), i AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM d)
SELECT CAST(d AS VARCHAR) AS date, CAST(lead(d, 1) OVER (ORDER BY d) AS VARCHAR) AS entry, CAST(lead(d, 21) OVER (ORDER BY d) AS VARCHAR) AS exit, CAST(greatest(0, least(21, n - 1 - i)) AS INTEGER) AS held FROM i""",
    "benchmark_legs": """WITH o AS (SELECT o_orderpriority AS p, CAST(o_orderdate AS DATE) AS d, o_totalprice AS t FROM orders), b AS (SELECT d, avg(t) AS b FROM o GROUP BY 1), w AS (SELECT p, d, avg(t) AS c FROM o GROUP BY 1, 2),
l AS (SELECT p, year(d) AS y, min(d) AS e, max(d) AS x, arg_min(c, d) AS p0, arg_max(c, d) AS p1 FROM w GROUP BY 1, 2)
SELECT p AS o_orderpriority, CAST(y AS INTEGER) AS year, round(p1 / p0 - b1.b / b0.b, 4) AS excess FROM l JOIN b b0 ON b0.d = e JOIN b b1 ON b1.d = x""",
    "ingest_gate": r"""WITH d AS (SELECT lang, text, trim(string_split(text, chr(10))[1]) AS title FROM documents),
r AS (SELECT lang, CASE WHEN coalesce(trim(text), '') = '' THEN 'no-text' WHEN length(title) < 20 THEN 'short-title' WHEN length(title) > 400 THEN 'long-title' WHEN title = upper(title) THEN 'shouting' ELSE 'kept' END AS reason FROM d)
SELECT lang, reason, count(*) AS n FROM r GROUP BY 1, 2""",
    "fresh_unseen": """SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-30' AND floor(epoch(ts)) >= epoch(TIMESTAMP '2024-01-28')
AND user_id NOT IN (SELECT user_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-15' AND TIMESTAMP '2024-01-28')""",
    "item_scores": """SELECT p_partkey, round(p_size / 10 * pow(0.5, (p_partkey % 72) / 18) * CASE WHEN regexp_matches(p_name, '(?i)small') THEN 1.3 ELSE 1 END * CASE WHEN regexp_matches(p_name, 'bolt|ring') THEN 0.7 ELSE 1 END
  * CASE WHEN regexp_matches(p_name, '^hot |widget$') THEN 0.35 ELSE 1 END * CASE WHEN p_brand = 'Brand#1' THEN 0.85 ELSE 1 END * CASE WHEN 4 * length(p_name) > 60 THEN 1.05 ELSE 1 END, 6) AS score FROM part""",
    "game_slots": """WITH l AS (SELECT *, least(l_suppkey, l_partkey % 20) AS a, greatest(l_suppkey, l_partkey % 20) AS b, date_trunc('month', l_shipdate) AS m, CASE WHEN l_linenumber % 3 > 0 THEN l_quantity END AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY a, b, m ORDER BY t NULLS LAST, l_orderkey * 8 + l_linenumber) - 1 AS INTEGER) AS slot FROM l""",
    "merged_games": """WITH e AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, 's' || event_id % 3 AS source, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%H:%M') END AS time, event_id,
  CASE event_type WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 WHEN 'error' THEN 1 ELSE 0 END AS r, CASE event_type WHEN 'purchase' THEN 'final' WHEN 'signup' THEN 'postponed' WHEN 'error' THEN 'cancelled' ELSE 'scheduled' END AS status,
  CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) END AS score FROM events)
SELECT user_id, day, arg_max(status, {'r': r, 'i': event_id}) AS status, arg_max(time, event_id) FILTER (WHERE time IS NOT NULL) AS time, count(DISTINCT source) AS sources, arg_max(score, event_id) FILTER (WHERE score IS NOT NULL) AS score, min(score) < max(score) AS score_conflict FROM e GROUP BY 1, 2""",
    "quarantine": """WITH o AS (SELECT o_orderkey, round(o_totalprice, 2) AS total FROM orders), b AS (SELECT o_orderkey, round(total * 2, 2) AS total FROM o)
SELECT *, 'new' AS origin FROM o WHERE total >= 3000 UNION ALL SELECT b.*, 'rescued' FROM b JOIN o USING (o_orderkey) WHERE o.total < 3000 AND b.total >= 3000""",
    "host_identities": """WITH n AS (SELECT DISTINCT 'team ' || page_id % 3 || CASE WHEN page_id % 2 = 0 THEN ' state' ELSE '' END AS name, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) || page_id % 3 AS host, page_id % 3 AS k FROM pages),
g AS (SELECT k, max(CASE WHEN name LIKE '% state' THEN name END) AS long, count(DISTINCT name) AS c FROM n GROUP BY host, k)
SELECT replace(name, ' ', '-') AS was, replace(CASE WHEN bool_or(c = 2) THEN any_value(long) ELSE name END, ' ', '-') AS team FROM (SELECT DISTINCT name, k FROM n) x JOIN g USING (k) GROUP BY name""",
}
