"""Games of an archive. Shipments are what two pages print of games: teams by supplier and part, a quarter as the date, the flag of a
return says which run has read the row (A in the first, the others in the second)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import archive
from .tables import stored

SEASON = "2024"


def readings(spark, sf_dir) -> DataFrame:
    """Rows as pages print them: by odd lines the supplier's page tells of the game, by even ones the part's."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x, y = F.concat(F.lit("t"), F.col("l_suppkey") % 40), F.concat(F.lit("t"), F.col("l_partkey") % 37)
    odd = F.col("l_linenumber") % 2 == 1
    k = F.col("l_orderkey")
    return li.select(
        "l_returnflag", F.when(odd, x).otherwise(y).alias("source"), F.col("l_shipdate").cast("date").cast("string").alias("verified_at"), (k * 8 + F.col("l_linenumber")).alias("seq"),
        F.concat(F.year("l_shipdate"), F.lit("-"), F.quarter("l_shipdate")).alias("date"), F.when(odd, x).otherwise(y).alias("team"), F.when(odd, y).otherwise(x).alias("opponent"),
        F.when(F.col("l_linestatus") == "F", F.col("l_quantity").cast("int") % 20).alias("us"), F.when(F.col("l_linestatus") == "F", F.round(F.col("l_tax") * 100).cast("int")).alias("them"),
        F.when(F.col("l_linenumber") % 3 > 0, F.concat(F.lpad((k % 12).cast("string"), 2, "0"), F.lit(":00"))).alias("time"), F.when(k % 2 == 0, "east").alias("zone"),
        F.when(F.col("l_linestatus") == "F", "final").when(F.col("l_discount") > 0.08, "postponed").otherwise("scheduled").alias("status"), (k % 3 == 0).alias("away"),
        F.when(k % 5 > 2, None).otherwise(k % 5 == 0).alias("neutral"), F.when(F.col("l_partkey") % 4 == 0, F.concat(F.lit("hall "), F.col("l_partkey") % 7)).alias("venue"), (F.col("l_quantity") >= 50).alias("exhibition"),
    )


def _merged(spark, sf_dir) -> DataFrame:
    rows = readings(spark, sf_dir)
    none = spark.createDataFrame([], ", ".join(f"{k} {v}" for k, v in archive.GAME.items()))
    first = archive.merge_into_archive(none, archive.candidates(rows.where("l_returnflag = 'A'"), SEASON)).select(*archive.GAME)
    # results that were decided elsewhere: for each pair the quarter of its last shipment
    settled = rows.where("team <> opponent").select("date", F.least("team", "opponent").alias("a"), F.greatest("team", "opponent").alias("b")).groupBy("a", "b").agg(F.max("date").alias("date"))
    settled = settled.withColumns({"settled_a": F.length("a"), "settled_b": F.length("b"), "evidence": F.lit("box score")})
    return archive.merge_into_archive(stored(first, "archive"), archive.candidates(rows.where("l_returnflag <> 'A'"), SEASON), settled)


def _told(column: str):
    return F.concat_ws(" ", F.transform(column, lambda s: F.concat_ws(":", s["id"], F.coalesce(s["score_a"].cast("string"), F.lit("-")), F.coalesce(s["score_b"].cast("string"), F.lit("-")))))


def archive_merge(spark, sf_dir):
    """The archive after both runs, with its sources and conflicts."""
    c = F.col("conflict")
    return _merged(spark, sf_dir).select(
        "id", "date", "a", "b", "slot", "time", "zone", "status", "score_a", "score_b", "home", "neutral", "venue", "exhibition", "first_seen", _told("sources").alias("sources"),
        c["detected_at"].alias("detected_at"), c["withheld"].alias("withheld"), c["showing_a"].alias("showing_a"), c["evidence"].alias("evidence"), _told("conflict.readings").alias("readings"),
    )


def archive_counts(spark, sf_dir):
    """What the second run did: games added, scores corrected, readings that changed nothing, conflicts, those a settled result decided."""
    return _merged(spark, sf_dir).agg(*[F.sum(n).cast("long").alias(n) for n in archive.COUNTS], F.count("*").alias("games"))


def _repaired(spark, sf_dir):
    """Teams of 30 and more turn out to be those of 20 and more, in a chain by way of those of 10 less."""
    merges = spark.range(30, 40).select(F.concat(F.lit("t"), "id").alias("slug"), F.concat(F.lit("t"), F.col("id") - 10).alias("winner"))
    merges = merges.unionByName(spark.range(20, 25).select(F.concat(F.lit("t"), "id").alias("slug"), F.concat(F.lit("t"), F.col("id") - 20).alias("winner")))
    games = stored(_merged(spark, sf_dir).select(*archive.GAME), "games")
    return archive.repair_identities(games, merges, SEASON, stored)


def archive_repair(spark, sf_dir):
    """The archive under its teams' new names."""
    games, _ = _repaired(spark, sf_dir)
    return games.select("id", "date", "a", "b", "slot", "time", "status", "score_a", "score_b", "home", "venue", "first_seen", _told("sources").alias("sources"), F.col("conflict.showing_a").alias("showing_a"))


def archive_self_matches(spark, sf_dir):
    """Games that were of two names of one team."""
    _, lost = _repaired(spark, sf_dir)
    return lost.select("id", "date", "team", "was_a", "was_b", F.concat_ws(",", "publishers").alias("publishers"))


QUERIES = {q.__name__: q for q in (archive_merge, archive_counts, archive_repair, archive_self_matches)}

_RANK = lambda s: f"CASE {s} WHEN 'final' THEN 2 WHEN 'postponed' THEN 1 WHEN 'cancelled' THEN 1 ELSE 0 END"
_ID = "substr(sha1('2024|' || a || '|' || b || '|' || date || '|' || slot), 1, 12)"
_TOLD = lambda c: f"coalesce(array_to_string(list_transform({c}, lambda s: s.id || ':' || coalesce(CAST(s.sa AS VARCHAR), '-') || ':' || coalesce(CAST(s.sb AS VARCHAR), '-')), ' '), '')"
_READING = "STRUCT(id VARCHAR, verified VARCHAR, sa INTEGER, sb INTEGER)"
_GAME = f"""STRUCT(slot INTEGER, id VARCHAR, date VARCHAR, a VARCHAR, b VARCHAR, time VARCHAR, zone VARCHAR, status VARCHAR, sa INTEGER, sb INTEGER, home VARCHAR, neutral BOOLEAN, venue VARCHAR, exhibition BOOLEAN,
  first_seen VARCHAR, sources {_READING}[], detected VARCHAR, withheld BOOLEAN, showing_a INTEGER, showing_b INTEGER, evidence VARCHAR, readings {_READING}[], run INTEGER)"""
_MERGED = f"""WITH RECURSIVE rows AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 1 ELSE 2 END AS run, l_orderkey * 8 + l_linenumber AS seq, strftime(l_shipdate, '%Y-%m-%d') AS verified, year(l_shipdate) || '-' || quarter(l_shipdate) AS date,
    't' || CASE WHEN l_linenumber % 2 = 1 THEN l_suppkey % 40 ELSE l_partkey % 37 END AS team, 't' || CASE WHEN l_linenumber % 2 = 1 THEN l_partkey % 37 ELSE l_suppkey % 40 END AS opponent,
    CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS INTEGER) % 20 END AS us, CASE WHEN l_linestatus = 'F' THEN CAST(round(l_tax * 100) AS INTEGER) END AS them,
    CASE WHEN l_linenumber % 3 > 0 THEN lpad(CAST(l_orderkey % 12 AS VARCHAR), 2, '0') || ':00' END AS time, CASE WHEN l_orderkey % 2 = 0 THEN 'east' END AS zone,
    CASE WHEN l_linestatus = 'F' THEN 'final' WHEN l_discount > 0.08 THEN 'postponed' ELSE 'scheduled' END AS status, l_orderkey % 3 = 0 AS away,
    CASE WHEN l_orderkey % 5 <= 2 THEN l_orderkey % 5 = 0 END AS neutral, CASE WHEN l_partkey % 4 = 0 THEN 'hall ' || l_partkey % 7 END AS venue, l_quantity >= 50 AS exhibition
  FROM lineitem),
pairs AS (SELECT *, least(team, opponent) AS a, greatest(team, opponent) AS b FROM rows WHERE team <> opponent),
settled AS (SELECT a, b, max(date) AS date, length(a) AS settled_a, length(b) AS settled_b FROM pairs GROUP BY a, b),
slotted AS (SELECT *, CAST(row_number() OVER (PARTITION BY run, team, date, a, b ORDER BY time NULLS LAST, seq, verified, sa NULLS LAST, sb NULLS LAST) - 1 AS INTEGER) AS slot FROM (
    SELECT *, CASE WHEN team < opponent THEN us ELSE them END AS sa, CASE WHEN team < opponent THEN them ELSE us END AS sb,
    CASE WHEN neutral THEN NULL WHEN away THEN opponent WHEN NOT neutral THEN team END AS home FROM pairs)),
c AS (SELECT s.*, {_ID} AS id, row_number() OVER (PARTITION BY date, a, b ORDER BY run, seq, team, slot) AS n,
    CASE WHEN run = 2 THEN settled_a END AS settled_a, CASE WHEN run = 2 THEN settled_b END AS settled_b FROM slotted s LEFT JOIN settled USING (date, a, b)),
state AS (
  SELECT DISTINCT date, a, b, CAST(0 AS BIGINT) AS n, 1 AS run, CAST([] AS {_GAME}[]) AS games, CAST([0, 0, 0, 0, 0] AS INTEGER[]) AS counts FROM c
  UNION ALL
  SELECT date, a, b, n, run, CASE WHEN place IS NULL THEN list_append(games, g) ELSE list_transform(games, lambda x, i: CASE WHEN i = place THEN g ELSE x END) END AS games,
    CASE WHEN run = 1 THEN counts ELSE list_transform(counts, lambda k, i: k + CASE WHEN i = 1 AND place IS NULL OR i = 2 AND kind = 'corrected' OR i = 3 AND kind = 'unchanged' OR i = 4 AND kind IN ('conflict', 'resolved') OR i = 5 AND kind = 'resolved' THEN 1 ELSE 0 END) END AS counts
  FROM (SELECT *, CAST(struct_pack(slot := o.slot, id := o.id, date := date, a := a, b := b, time := coalesce(time, o.time), zone := CASE WHEN time IS NOT NULL THEN zone ELSE coalesce(zone, o.zone) END,
      status := CASE WHEN {_RANK('status')} > {_RANK('o.status')} THEN status ELSE o.status END,
      sa := CASE WHEN kind IN ('scored', 'corrected') THEN sa WHEN kind = 'resolved' THEN settled_a WHEN kind = 'conflict' AND NOT published THEN NULL ELSE o.sa END,
      sb := CASE WHEN kind IN ('scored', 'corrected') THEN sb WHEN kind = 'resolved' THEN settled_b WHEN kind = 'conflict' AND NOT published THEN NULL ELSE o.sb END,
      home := CASE WHEN coalesce(neutral, o.neutral, false) THEN NULL ELSE coalesce(home, o.home) END, neutral := coalesce(neutral, o.neutral), venue := coalesce(venue, o.venue), exhibition := o.exhibition OR exhibition,
      first_seen := o.first_seen, sources := sources,
      detected := CASE WHEN kind IN ('conflict', 'resolved') THEN verified WHEN kind <> 'agreed' THEN o.detected END, withheld := CASE WHEN kind = 'resolved' THEN false WHEN kind = 'conflict' THEN NOT published WHEN kind <> 'agreed' THEN o.withheld END,
      showing_a := CASE WHEN kind = 'conflict' AND published THEN o.sa WHEN kind NOT IN ('agreed', 'conflict', 'resolved') THEN o.showing_a END, showing_b := CASE WHEN kind = 'conflict' AND published THEN o.sb WHEN kind NOT IN ('agreed', 'conflict', 'resolved') THEN o.showing_b END,
      evidence := CASE WHEN kind = 'resolved' THEN 'box score' WHEN kind NOT IN ('agreed', 'conflict') THEN o.evidence END, readings := CASE WHEN kind IN ('conflict', 'resolved') THEN sources WHEN kind <> 'agreed' THEN o.readings END, run := o.run) AS {_GAME}) AS g
  FROM (SELECT *, o.run < run AS published, CASE WHEN sa IS NULL OR sb IS NULL THEN 'unchanged' WHEN o.sa IS NULL OR o.sb IS NULL THEN 'scored'
      WHEN o.sa = sa AND o.sb = sb THEN CASE WHEN o.detected IS NOT NULL AND len(list_filter(sources, lambda s: NOT coalesce(s.sa = o.sa AND s.sb = o.sb, false))) = 0 THEN 'agreed' ELSE 'unchanged' END
      WHEN len(sources) = 1 THEN 'corrected' WHEN settled_a IS NOT NULL THEN 'resolved' ELSE 'conflict' END AS kind
  FROM (SELECT *, CASE WHEN list_contains(list_transform(o.sources, lambda s: s.id), team) THEN list_transform(o.sources, lambda s: CASE WHEN s.id = team THEN mine ELSE s END) ELSE list_append(o.sources, mine) END AS sources
  FROM (SELECT *, CAST(struct_pack(id := team, verified := verified, sa := sa, sb := sb) AS {_READING}) AS mine,
      CASE WHEN place IS NOT NULL THEN games[place] ELSE CAST(struct_pack(slot := slot, id := id, date := date, a := a, b := b, time := time, zone := NULL, status := 'scheduled', sa := NULL, sb := NULL, home := NULL, neutral := NULL, venue := NULL,
        exhibition := false, first_seen := verified, sources := [], detected := NULL, withheld := NULL, showing_a := NULL, showing_b := NULL, evidence := NULL, readings := NULL, run := run) AS {_GAME}) END AS o
  FROM (SELECT *, coalesce(CASE WHEN time IS NOT NULL THEN nullif(list_position(list_transform(games, lambda x: x.time), time), 0) END, nullif(list_position(list_transform(games, lambda x: x.id), id), 0),
      CASE WHEN len(games) = 1 AND NOT list_contains(list_transform(games[1].sources, lambda s: s.id), team) AND (games[1].time IS NULL OR time IS NULL) THEN 1 END) AS place
  FROM (SELECT c.*, CASE WHEN c.run > s.run THEN list_sort(s.games) ELSE s.games END AS games, s.counts FROM state s JOIN c ON c.date = s.date AND c.a = s.a AND c.b = s.b AND c.n = s.n + 1))))))
), final AS (SELECT date, a, b, arg_max(games, n) AS games, arg_max(counts, n) AS counts FROM state GROUP BY date, a, b),
games AS (SELECT unnest(games, recursive := false) AS g FROM final)"""
_NOW = lambda c: f"""CASE WHEN CAST(substr({c}, 2) AS INTEGER) >= 35 THEN 't' || CAST(substr({c}, 2) AS INTEGER) - 10 WHEN CAST(substr({c}, 2) AS INTEGER) >= 30 THEN 't' || CAST(substr({c}, 2) AS INTEGER) - 30
  WHEN CAST(substr({c}, 2) AS INTEGER) BETWEEN 20 AND 24 THEN 't' || CAST(substr({c}, 2) AS INTEGER) - 20 ELSE {c} END"""  # noqa: E731
_LATEST = f"""list_transform(list_sort(list_distinct(list_transform(sources, lambda s: {_NOW('s.id')}))), lambda i:
  list_sort(list_transform(list_filter(sources, lambda s: {_NOW('s.id')} = i), lambda s, n: struct_pack(verified := s.verified, n := n, s := CAST(struct_pack(id := i, verified := s.verified, sa := s.sa, sb := s.sb) AS {_READING}))))[-1].s)"""
_REPAIRED = f"""{_MERGED},
new AS (SELECT g.*, g.a AS was_a, g.b AS was_b, {_NOW('g.a')} AS na, {_NOW('g.b')} AS nb, list_transform(g.sources, lambda s: s.id) AS publishers FROM games),
turned AS (SELECT * EXCLUDE (a, b, sa, sb, sources, home, showing_a, showing_b), least(na, nb) AS a, greatest(na, nb) AS b, CASE WHEN na > nb THEN sb ELSE sa END AS sa, CASE WHEN na > nb THEN sa ELSE sb END AS sb,
    CASE WHEN na > nb THEN list_transform(sources, lambda s: CAST(struct_pack(id := s.id, verified := s.verified, sa := s.sb, sb := s.sa) AS {_READING})) ELSE sources END AS sources,
    CASE WHEN home IS NOT NULL THEN {_NOW('home')} END AS home, CASE WHEN na > nb THEN showing_b ELSE showing_a END AS showing_a FROM new),
lost AS (SELECT * FROM turned WHERE a = b),
marked AS (SELECT *, bool_or(a <> was_a OR b <> was_b) OVER (PARTITION BY date, a, b) AS touched FROM turned WHERE a <> b),
queue AS (SELECT *, row_number() OVER (PARTITION BY date, a, b ORDER BY slot, id) AS n, count(*) OVER (PARTITION BY date, a, b) AS total FROM marked WHERE touched),
kept AS (
  SELECT date, a, b, CAST(0 AS BIGINT) AS n, [x][1:0] AS xs FROM (SELECT date, a, b, any_value(struct_pack(id := id, time := time, status := status, sa := sa, sb := sb, home := home, neutral := neutral, venue := venue, first_seen := first_seen, sources := sources, showing_a := showing_a, publishers := publishers)) AS x FROM queue GROUP BY date, a, b)
  UNION ALL
  SELECT date, a, b, n, CASE WHEN twin IS NULL THEN list_append(xs, x) ELSE list_transform(xs, lambda k, i: CASE WHEN i = twin THEN struct_pack(id := k.id, time := coalesce(k.time, x.time),
      status := CASE WHEN {_RANK('x.status')} > {_RANK('k.status')} THEN x.status ELSE k.status END, sa := CASE WHEN k.sa IS NULL OR k.sb IS NULL THEN x.sa ELSE k.sa END, sb := CASE WHEN k.sa IS NULL OR k.sb IS NULL THEN x.sb ELSE k.sb END,
      home := coalesce(k.home, x.home), neutral := coalesce(k.neutral, x.neutral), venue := coalesce(k.venue, x.venue), first_seen := least(k.first_seen, x.first_seen),
      sources := list_concat(k.sources, list_filter(x.sources, lambda s: NOT list_contains(list_transform(k.sources, lambda m: m.id), s.id))), showing_a := k.showing_a, publishers := list_concat(k.publishers, x.publishers)) ELSE k END) END AS xs
  FROM (SELECT *, nullif(list_position(list_transform(xs, lambda k: NOT list_has_any(k.publishers, x.publishers) AND (coalesce(k.time = x.time, true) OR total = 2)), true), 0) AS twin
  FROM (SELECT q.date, q.a, q.b, q.n, q.total, k.xs, struct_pack(id := q.id, time := q.time, status := q.status, sa := q.sa, sb := q.sb, home := q.home, neutral := q.neutral, venue := q.venue, first_seen := q.first_seen, sources := q.sources, showing_a := q.showing_a, publishers := q.publishers) AS x
    FROM kept k JOIN queue q ON q.date = k.date AND q.a = k.a AND q.b = k.b AND q.n = k.n + 1))
), ends AS (SELECT date, a, b, unnest(arg_max(xs, n)) AS x FROM kept GROUP BY date, a, b),
slots AS (SELECT date, a, b, x.* EXCLUDE (id, sources), list_sort({_LATEST.replace('sources', 'x.sources')}) AS sources, row_number() OVER (PARTITION BY date, a, b ORDER BY x.time NULLS LAST, x.id) - 1 AS slot FROM ends),
named AS (SELECT * EXCLUDE (sources), {_LATEST} AS sources FROM marked)"""

ORACLE_SQL = {
    "archive_merge": f"""{_MERGED}
SELECT g.id AS id, g.date AS date, g.a AS a, g.b AS b, g.slot AS slot, g.time AS time, g.zone AS zone, g.status AS status, g.sa AS score_a, g.sb AS score_b, g.home AS home, g.neutral AS neutral, g.venue AS venue, g.exhibition AS exhibition,
  g.first_seen AS first_seen, {_TOLD('g.sources')} AS sources, g.detected AS detected_at, g.withheld AS withheld, g.showing_a AS showing_a, g.evidence AS evidence, {_TOLD('g.readings')} AS readings FROM games""",
    "archive_repair": f"""{_REPAIRED}
SELECT {_ID} AS id, date, a, b, CAST(slot AS INTEGER) AS slot, time, status, sa AS score_a, sb AS score_b, home, venue, first_seen, {_TOLD('sources')} AS sources, showing_a FROM slots
UNION ALL SELECT id, date, a, b, slot, time, status, sa, sb, home, venue, first_seen, {_TOLD('sources')}, showing_a FROM named WHERE NOT touched""",
    "archive_self_matches": f"""{_REPAIRED}
SELECT id, date, a AS team, was_a, was_b, array_to_string(publishers, ',') AS publishers FROM lost""",
    "archive_counts": f"""{_MERGED}
SELECT CAST(sum(counts[1]) AS BIGINT) AS added, CAST(sum(counts[2]) AS BIGINT) AS corrected, CAST(sum(counts[3]) AS BIGINT) AS unchanged, CAST(sum(counts[4]) AS BIGINT) AS conflicts, CAST(sum(counts[5]) AS BIGINT) AS resolved,
  CAST(sum(len(games)) AS BIGINT) AS games FROM final""",
}
