"""Queries on schedules and polls: the driver's orders written as web pages in the markups that are read, and what is read from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import teams as T
from ..operators import fixtures, schedules

HOME = ["Navy", "Fordham", "Iona", "Bucknell"]
AWAY = ["Brown", "Wagner", "La Verne"]
ALIASES = {t.lower(): t.lower().replace(" ", "-") for t in HOME + AWAY}


def _slug(raw):
    return T.team_slug(raw, ALIASES)


def _pick(values: list[str], at):
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def _orders(spark, sf_dir):
    """k, c, d and season (which begins in August) of all orders, the two teams of each and how its date is printed."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.to_date("o_orderdate").alias("d"))
    k = F.col("k")
    hour = F.when(k % 3 == 0, " (Noon)").when(k % 3 == 1, " 7:30 p.m. ET/4:30 p.m. PT").otherwise("")
    return o.withColumns({
        "season": F.year("d") - F.when(F.month("d") >= 8, 0).otherwise(1), "home": _pick(HOME, k % 4), "away": _pick(AWAY, k % 3),
        "when": F.when(k % 19 == 0, F.lit("TBD")).otherwise(F.concat(F.date_format("d", "EEE., MMM. d"), hour)),
    })


def _printed(team, k):
    """A team's name in one of the ways that pages print it."""
    return F.when(k % 5 == 0, F.concat(F.lit("No. 7 "), team)).when(k % 5 == 1, F.concat(team, F.lit(" University"))).when(k % 5 == 2, F.concat(team, F.lit("&nbsp;(Calif.)"))).when(k % 5 == 3, F.concat(F.lit("(RV) "), team)).otherwise(team)


def _paged(rows, by: list[str], body):
    """One page for each key (a customer's orders of a season), its rows in the order of k."""
    # rows are dealt before they are written as markup, into a number of tasks that stays, since pages take long to read for their size
    spark = rows.sparkSession
    rows = rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *by)
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", body.alias("row")))), lambda x: x["row"]), "").alias("body"))


def _conference_pages(spark, sf_dir):
    o, k, even = _orders(spark, sf_dir), F.col("k"), F.col("c") % 2 == 0
    match = F.when(k % 11 == 0, F.lit("4th Seed vs. 5th Seed (Game 1)")).otherwise(F.concat(_printed(F.col("home"), k), F.when(k % 2 == 0, " vs. ").otherwise(" vs "), _printed(F.when(k % 13 == 0, F.col("home")).otherwise(F.col("away")), k + 1), F.when(k % 7 == 1, " (Game 2)").otherwise("")))
    dark, white = F.when(k % 2 == 0, (k % 23).cast("string")).otherwise(""), F.when(k % 9 == 0, "n/a").otherwise((k % 10).cast("string"))
    cell = lambda v: F.concat(F.lit("<td><b>"), v, F.when(even, "</b></td>").otherwise("</b>"))
    order = lambda d, m, s, w: F.concat(F.lit("<tr>"), F.when(even, F.concat(d, m, s, w)).otherwise(F.concat(m, d, w, s)), F.when(even, "</tr>").otherwise("\n"))
    row = order(cell(F.col("when")), cell(match), cell(dark), cell(white))
    row = F.concat(row, F.when(k % 17 == 0, row).otherwise(""), F.when(k % 6 == 0, "<tr><td>&nbsp;</td><td> </td></tr>").otherwise(""))
    head = lambda v: F.lit(f"<th>{v}</th>")
    p = _paged(o, ["c", "season"], row)
    heads = F.when(F.col("c") % 31 == 0, F.lit("<tr><th>Matchup</th><th>When</th></tr>")).otherwise(order(head("Date"), head("Matchup"), head("Dark Score"), head("White Score")))
    html = F.concat(F.lit("<html><script>var t = '<table>';</script><table><tr><td>Standings</td></tr></table><!-- <table> --><table>"), heads, "body", F.lit("</table><table><tr><th>Date</th><th>Matchup</th></tr><tr><td>Nov. 20</td><td>Navy vs. Iona</td></tr></table></html>"))
    return p.select("c", "season", F.when(F.col("c") % 29 == 0, "<html><p>Coming soon</p></html>").otherwise(html).alias("html"), F.concat(F.lit("K"), F.col("c") % 3).alias("conference"), F.format_string("https://c%d.example.com/%d", "c", "season").alias("url"))


def conference_schedule(spark, sf_dir):
    """Every row of the schedules that conferences publish: fixtures, and what is missing in the others."""
    x = schedules.conference_rows(_conference_pages(spark, sf_dir), "html", ["c", "season"], "season", _slug)
    return x.groupBy("c", "season", "date", "time", F.array_join("teams", "|").alias("teams"), F.array_join("scores", "-", "?").alias("scores"), "why").agg(F.count("*").alias("n"))


def conference_games(spark, sf_dir):
    """Line items as games, with the conference that lists them."""
    x = schedules.conference_rows(_conference_pages(spark, sf_dir), "html", ["c", "season", "conference", "url"], "season", _slug)
    known = schedules.claimed_fixtures(x, "url", "conference", "url")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(_orders(spark, sf_dir).select("k", "d"), F.col("l_orderkey") == F.col("k"))
    games = li.select("l_orderkey", "l_linenumber", F.col("d").cast("string").alias("date"), F.array_sort(F.array(_slug(_pick(HOME, F.col("l_partkey") % 4)), _slug(_pick(AWAY, F.col("l_suppkey") % 3)))).alias("teams"))
    return schedules.classified(games, known).select("l_orderkey", "l_linenumber", "date", F.array_join("teams", "|").alias("teams"), "conference", "conference_source")


def _score(k):
    """A result as the owner of the page prints it; some do not agree with themselves, some games are off."""
    return F.when(k % 8 == 0, F.lit("Postponed")).when(k % 8 == 1, F.lit("Cancelled")).when(k % 8 == 2, "").when(k % 8 == 3, "W, 9-11").when(k % 8 == 4, F.concat(F.lit("L, 8–"), (9 + k % 4).cast("string"), F.lit(" (2 OT)"))).when(k % 8 == 5, "T, 7-7 OT").otherwise(F.concat(F.lit("W, "), (10 + k % 5).cast("string"), F.lit("-9")))


def school_schedules(spark, sf_dir):
    """Customers' orders as schools' schedules: of even customers in the classic markup (each game twice), of odd ones in the newer one."""
    o, k = _orders(spark, sf_dir), F.col("k")
    name = F.when(k % 14 == 0, F.lit("NCAA Opening Round")).otherwise(_printed(F.col("away"), k))
    site = F.when(k % 4 == 0, "http://www.Brown.example.com/x").when(k % 4 == 1, "wagner.example.com").when(k % 4 == 2, "/sports").otherwise("#")
    link = F.concat(F.lit("<a href='"), site, F.lit("'>"), name, F.lit("</a>"))
    place = F.when(k % 9 == 0, F.lit("<span>Providence</span> <span>Pool</span>")).when(k % 9 == 1, F.lit("<span>Home&amp;Away</span>")).otherwise("")
    report = F.when(k % 6 == 0, F.lit("<a href='/box/1'>Box Score</a>")).when(k % 6 == 1, F.lit("<a href='//x.example.com/r'> Recap </a>")).otherwise(F.lit("<a href='/t'>Tickets</a>"))
    kind = F.when(k % 3 == 0, F.lit("neutral")).when(k % 3 == 1, F.lit("away")).otherwise(F.lit("home"))
    c = schedules.CLASSIC
    row = F.concat(F.lit(f"<li class='{c}game {c}"), kind, F.lit("-game' data-game-id='"), k, F.lit(f"'><div class='{c}game-opponent-name'>"), link, F.lit(f"</div><div class='{c}game-opponent-date'><span>"), "when", F.lit(f"</span></div><div class='{c}game-result'>"), _score(k), F.lit(f"</div><div class='{c}game-location'>"), place, F.lit("</div>"), report, F.when(k % 10 == 0, f"<p class='{c}game-note'>Exhibition</p>").otherwise(""))
    cup = F.when(k % 7 == 0, F.concat(F.lit(f"<li class='{c}tournament'><p>Cup &amp; Bowl</p><ul>"), row, F.lit("</li></ul></li>"))).otherwise(F.concat(row, F.lit("</li>")))
    classic = _paged(o.where("c % 2 = 0"), ["c", "season"], F.concat(cup, row, F.lit("</li>"))).withColumn("html", F.concat(F.lit("<ul>"), "body", F.lit("</ul>")))
    n, h = schedules.NEWER, schedules.NEWER + "header-"
    at = lambda i, inner: F.concat(F.lit(f"<div data-test-id='{i}'>"), inner, F.lit("</div>"))
    card = F.concat(F.lit(f"<div data-test-id='{n}root'><i class='s-game-card__header__stamp'>"), F.when(k % 3 == 1, "At").otherwise("VS"), F.lit("</i>"), F.concat(F.lit(f"<a data-test-id='{h}team-opponent-link' href='"), site, F.lit("'>"), name, F.lit("</a>")), at(h + "game-date", F.regexp_replace("when", r"\d*:.*", "")), at(h + "game-time", F.regexp_extract("when", r"(\d+:.*)", 1)), at(h + "game-team-score", _score(k)),
                    F.when(k % 2 == 0, "<div class='s-game-card__header__conf-text'><b data-test-id='s-descriptor__text'>CWPA</b></div>").otherwise(""), F.when(k % 7 == 0, "<b data-test-id='s-descriptor__text'>Cup &amp; Bowl</b>").otherwise(""), F.when(k % 10 == 0, "<b class='s-game-card__promotion-btn-text'>Scrimmage</b>").otherwise(""), report, F.lit("</div>"))
    newer = _paged(o.where("c % 2 = 1"), ["c", "season"], card).withColumnRenamed("body", "html")
    url = F.format_string("https://c%d.example.com/%d", "c", "season")
    one = schedules.classic_schedule(classic.withColumn("url", url), "html", ["c", "season"], "url", "season")
    two = schedules.newer_schedule(newer.withColumn("url", url), "html", ["c", "season"], "url", "season")
    out = one.unionByName(two)
    counted = ["date", "time", "opponent", "status", "us", "them", "ot", "neutral", "away", "exhibition", "venue", "tournament", "conference_marker", "opponent_site", "detail_url"]
    return out.groupBy("c", "season", *counted).agg(F.count("*").alias("n"))


def team_evidence(spark, sf_dir):
    """Orders as links to teams' sites: the names on a host agree, or they do not and its teams stay apart."""
    o = _orders(spark, sf_dir).select("k", "c")
    base = F.format_string("Team%d", "c")
    name = F.when(F.col("k") % 3 == 0, base).when(F.col("k") % 3 == 1, F.concat(F.lit("#4 "), base, F.lit(" State"))).otherwise(F.concat(F.when(F.col("c") % 5 == 0, "UC ").otherwise(""), base, F.lit(" State (Md.)")))
    rows = o.select(T.team_name(name).alias("name"), F.format_string("c%d.example.com", "c").alias("host")).withColumn("slug", _slug(F.col("name")))
    own = o.select(F.lit(None).cast("string").alias("name"), F.format_string("c%d.example.com", "c").alias("host"), F.format_string("team%d-state-west", "c").alias("slug")).where("host like '%7.example.com'")
    x = fixtures.identity_evidence(rows.unionByName(own), "slug", "name", "host")
    return x.select("host", F.array_join("slugs", ",").alias("slugs"), F.array_join(F.transform("links", lambda n: n.cast("string")), ",").alias("links"), "merged", "winner")


def _polls(spark, sf_dir):
    """A week's twenty dearest orders as a poll; every seventh week's page lacks the table, every fifth lacks its rows from the eleventh on."""
    from pyspark.sql import Window as W

    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).alias("_d"), "o_totalprice")
    o = o.withColumn("week", F.floor(F.col("_d") / 7).cast("int") + 1)
    o = o.withColumn("place", F.row_number().over(W.partitionBy("week").orderBy(F.desc("o_totalprice"), "k"))).where("place <= 20 and (place <= 10 or week % 5 > 0)")
    k = F.col("k")
    rank = F.when(k % 12 == 0, "RV").otherwise(F.concat("place", F.when(k % 4 == 0, " (T)").otherwise("")))
    points = F.when(k % 6 == 0, "").when(k % 6 == 1, "n/a").otherwise((k % 500).cast("string"))
    row = F.concat(F.lit("<tr><td>"), rank, F.lit("</td><td>"), _printed(_pick(HOME + AWAY, k % 7), k), F.lit("</td><td>"), F.when(k % 2 == 0, "3").otherwise(""), F.lit("</td><td>"), points, F.lit("</td></tr>"))
    p = o.groupBy("week").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", row.alias("row")))), lambda x: x["row"]), "").alias("body"))
    table = lambda title: F.concat(F.lit(f"<table><tr><td>{title} (Week "), "week", F.lit(")</td></tr><tr><th>Rank</th><th>Team</th><th>2026 Week "), F.col("week") - 1, F.lit(" Poll</th><th>Points</th></tr>"), "body", F.lit("</table>"))
    html = F.concat(table("Division III Men&rsquo;s Varsity Top 20"), F.when(F.col("week") % 7 > 0, table("Men's Varsity Top 20")).otherwise(""))
    return p.select("week", html.alias("html"), F.when(F.col("week") % 9 > 0, "2026-09-01").alias("published")).withColumnRenamed("week", "page")


def _poll_rows(spark, sf_dir):
    return schedules.poll_rows(_polls(spark, sf_dir), "html", ["page", "published"], "(?i)Men's Varsity Top 20", _slug)


def weekly_polls(spark, sf_dir):
    return _poll_rows(spark, sf_dir).drop("published")


def poll_gate(spark, sf_dir):
    """What keeps a week's poll from being published."""
    return schedules.poll_problems(_poll_rows(spark, sf_dir), ["page"], "published").select("page", F.array_join("problems", "; ").alias("problems"))


QUERIES = {f.__name__: f for f in (conference_schedule, conference_games, school_schedules, team_evidence, weekly_polls, poll_gate)}

_O = """o AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS d, CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) >= 8 THEN 0 ELSE 1 END AS INTEGER) AS season,
  ['navy', 'fordham', 'iona', 'bucknell'][o_orderkey % 4 + 1] AS home, ['brown', 'wagner', 'la-verne'][o_orderkey % 3 + 1] AS away FROM orders),
f AS (SELECT *, CASE WHEN k % 19 > 0 THEN CASE k % 3 WHEN 0 THEN '12:00' WHEN 1 THEN '19:30' END END AS time FROM o)"""
_ROWS = f"""{_O}, r AS (SELECT c, season, CASE WHEN k % 11 = 0 OR k % 13 = 0 THEN 'not two identifiable teams' WHEN k % 19 = 0 THEN 'no readable date' END AS why, CAST(d AS VARCHAR) AS date, time,
  CASE WHEN home < away THEN home || '|' || away ELSE away || '|' || home END AS teams, CASE WHEN k % 2 = 0 THEN CAST(k % 23 AS VARCHAR) ELSE '?' END || '-' || CASE WHEN k % 9 = 0 THEN '?' ELSE CAST(k % 10 AS VARCHAR) END AS scores,
  CASE WHEN k % 17 = 0 THEN 2 ELSE 1 END AS n FROM f WHERE c % 29 > 0 AND c % 31 > 0)"""
ORACLE_SQL = {
    "conference_schedule": f"""WITH {_ROWS}
SELECT c, season, CASE WHEN why IS NULL THEN date END AS date, CASE WHEN why IS NULL THEN time END AS time, CASE WHEN why IS NULL THEN teams END AS teams, CASE WHEN why IS NULL THEN scores END AS scores, why, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY ALL
UNION ALL SELECT DISTINCT c, season, NULL, NULL, NULL, NULL, CASE WHEN c % 29 = 0 THEN 'no schedule table found' ELSE 'no date or matchup column' END, 1 FROM o WHERE c % 29 = 0 OR c % 31 = 0""",
    "conference_games": f"""WITH {_ROWS}, p AS (SELECT date, teams, c, season, sum(n) AS n FROM r WHERE why IS NULL GROUP BY ALL),
u AS (SELECT date, teams, 'K' || min(c % 3) AS conference, max('https://c' || c || '.example.com/' || season) AS url FROM p GROUP BY 1, 2 HAVING max(n) = 1 AND min(c % 3) = max(c % 3)),
g AS (SELECT l_orderkey, l_linenumber, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, ['navy', 'fordham', 'iona', 'bucknell'][l_partkey % 4 + 1] AS a, ['brown', 'wagner', 'la-verne'][l_suppkey % 3 + 1] AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, g.date, CASE WHEN a < b THEN a || '|' || b ELSE b || '|' || a END AS teams, conference, url AS conference_source FROM g LEFT JOIN u ON g.date = u.date AND u.teams = CASE WHEN a < b THEN a || '|' || b ELSE b || '|' || a END""",
    "school_schedules": f"""WITH {_O} SELECT c, season, CAST(d AS VARCHAR) AS date, CASE WHEN c % 2 = 1 OR k % 3 > 0 THEN nullif(time, '12:00') END AS time,
  ['Brown', 'Wagner', 'La Verne'][k % 3 + 1] || CASE WHEN k % 5 = 1 THEN ' University' ELSE '' END AS opponent,
  CASE WHEN k % 8 = 0 THEN 'postponed' WHEN k % 8 = 1 THEN 'cancelled' WHEN k % 8 IN (2, 3) THEN 'scheduled' ELSE 'final' END AS status,
  CAST(CASE k % 8 WHEN 4 THEN 8 WHEN 5 THEN 7 WHEN 6 THEN 10 + k % 5 WHEN 7 THEN 10 + k % 5 END AS INTEGER) AS us, CAST(CASE k % 8 WHEN 4 THEN 9 + k % 4 WHEN 5 THEN 7 WHEN 6 THEN 9 WHEN 7 THEN 9 END AS INTEGER) AS them,
  CASE k % 8 WHEN 4 THEN '2OT' WHEN 5 THEN 'OT' END AS ot, CASE WHEN c % 2 = 0 THEN k % 3 = 0 END AS neutral, k % 3 = 1 AS away, k % 10 = 0 AS exhibition,
  CASE WHEN c % 2 = 0 THEN CASE k % 9 WHEN 0 THEN 'Providence Pool' WHEN 1 THEN 'Home&Away' END END AS venue, CASE WHEN k % 7 = 0 THEN 'Cup & Bowl' END AS tournament, CASE WHEN c % 2 = 1 AND k % 2 = 0 THEN 'CWPA' END AS conference_marker,
  CASE k % 4 WHEN 0 THEN 'https://brown.example.com' WHEN 1 THEN 'https://wagner.example.com' END AS opponent_site, CASE k % 6 WHEN 0 THEN 'https://c' || c || '.example.com/box/1' WHEN 1 THEN 'https://x.example.com/r' END AS detail_url,
  count(*) AS n FROM f WHERE k % 19 > 0 AND k % 14 > 0 GROUP BY ALL""",
    "team_evidence": """WITH n AS (SELECT o_custkey AS c, CASE o_orderkey % 3 WHEN 0 THEN 'team' || o_custkey WHEN 1 THEN 'team' || o_custkey || '-state' ELSE CASE WHEN o_custkey % 5 = 0 THEN 'uc-' ELSE '' END || 'team' || o_custkey || '-state' END AS slug FROM orders
  UNION ALL SELECT o_custkey, 'team' || o_custkey || '-state-west' FROM orders WHERE o_custkey % 10 = 7),
g AS (SELECT c, slug, count(*) AS n FROM n GROUP BY 1, 2)
SELECT 'c' || c || '.example.com' AS host, string_agg(slug, ',' ORDER BY slug) AS slugs, string_agg(CAST(n AS VARCHAR), ',' ORDER BY slug) AS links, NOT bool_or(slug LIKE 'uc-%') AS merged,
  CASE WHEN NOT bool_or(slug LIKE 'uc-%') THEN arg_max(slug, length(slug)) END AS winner FROM g GROUP BY c HAVING count(*) > 1""",
}
_P = """p AS (SELECT o_orderkey AS k, CAST(datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) // 7 + 1 AS INTEGER) AS w, o_totalprice AS t FROM orders),
q AS (SELECT *, CAST(row_number() OVER (PARTITION BY w ORDER BY t DESC, k) AS INTEGER) AS place FROM p QUALIFY row_number() OVER (PARTITION BY w ORDER BY t DESC, k) <= 20),
a AS (SELECT *, CASE WHEN k % 12 = 0 THEN 'RV' ELSE place || CASE WHEN k % 4 = 0 THEN ' (T)' ELSE '' END END AS rank, CASE WHEN k % 6 > 1 THEN CAST(k % 500 AS INTEGER) END AS points FROM q WHERE place <= 10 OR w % 5 > 0)"""
ORACLE_SQL |= {
    "weekly_polls": f"""WITH {_P}, n AS (SELECT *, ['Navy', 'Fordham', 'Iona', 'Bucknell', 'Brown', 'Wagner', 'La Verne'][k % 7 + 1] AS team FROM a)
SELECT w AS page, w AS week, w - 1 AS previous_week, place, rank, CASE k % 5 WHEN 0 THEN 'No. 7 ' WHEN 3 THEN '(RV) ' ELSE '' END || team || CASE k % 5 WHEN 1 THEN ' University' WHEN 2 THEN ' (Calif.)' ELSE '' END AS name, replace(lower(team), ' ', '-') AS team,
  CASE WHEN k % 2 = 0 THEN '3' END AS previous, points, CASE WHEN k % 6 = 1 THEN 'n/a' ELSE CAST(points AS VARCHAR) END AS points_text, NULL AS why FROM n WHERE w % 7 > 0
UNION ALL SELECT DISTINCT w, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'no table of that title' FROM p WHERE w % 7 = 0""",
    "poll_gate": f"""WITH {_P}, g AS (SELECT w, CASE WHEN w % 7 > 0 THEN count(*) ELSE 0 END AS n, CASE WHEN w % 7 > 0 THEN count(*) FILTER (WHERE k % 12 > 0) ELSE 0 END AS r, CASE WHEN w % 7 > 0 THEN count(points) ELSE 0 END AS s FROM a GROUP BY 1)
SELECT w AS page, concat_ws('; ', CASE WHEN w % 7 = 0 THEN 'no week number' END, CASE WHEN n < 15 THEN 'only ' || n || ' rows' END, CASE WHEN r < 15 THEN 'only ' || r || ' numbered ranks' END, CASE WHEN s = 0 THEN 'no points were readable' END, CASE WHEN w % 9 = 0 THEN 'no publication date' END) AS problems FROM g""",
}
