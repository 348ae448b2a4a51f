"""Queries on publishing: snapshots under a manifest, backfills that go on where they stopped, what scheduled runs have to do, shuffled choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import due
from ..sources import snapshots
from .tables import scratch

DAYS = ["2024-01-01", "2024-01-02", "2024-01-03"]


def _read(spark, sf_dir, t):
    return spark.read.parquet(f"{sf_dir}/{t}.parquet")


def _published(spark, sf_dir):
    """Parts published on three days: a second day's first try lacks most rows, a first day is published twice, one column of the second day is patched
    (twice, the second time nothing changes), the third day has a few rows less, and only two days are kept."""
    root = f"{scratch(spark)}/parts"
    parts = _read(spark, sf_dir, "part").select("p_partkey", F.round("p_retailprice", 2).alias("price"), "p_size")
    dearer = parts.withColumn("price", F.round(F.col("price") + F.when(F.col("p_size") > 25, 10).otherwise(0), 2))
    sale = parts.where("p_size = 7").select("p_partkey")
    done = [
        snapshots.publish(parts, root, DAYS[0], least=1), snapshots.publish(parts.where("p_size <= 10"), root, DAYS[1], share=0.8), snapshots.publish(parts, root, DAYS[0]),
        snapshots.publish(dearer, root, DAYS[1], share=0.8, note={"prepared": "06:00"}), snapshots.patch(sale, root, "p_partkey", {"price": F.lit(0.0)}, note={"patched": "09:30"}),
        snapshots.patch(sale, root, "p_partkey", {"price": F.lit(0.0)}), snapshots.publish(dearer.where("p_size <= 45"), root, DAYS[2], share=0.8),
    ]
    snapshots.prune(spark, root, keep=2)
    return root, done


def snapshot_rows(spark, sf_dir):
    """The rows of the two days that are kept, as readers find them."""
    root, _ = _published(spark, sf_dir)
    one, two = (snapshots.current(spark, root, day).withColumn("day", F.lit(day)) for day in DAYS[1:])
    return one.unionByName(two)


def snapshot_log(spark, sf_dir):
    """The manifest, with how many tries came to each outcome."""
    root, done = _published(spark, sf_dir)
    tries = {f"n_{outcome}": F.lit(done.count(outcome)) for outcome in ("published", "unchanged", "refused")}
    return snapshots.manifest(spark, root).select("version", "label", "rows", "note").withColumns(tries)


def order_backfill(spark, sf_dir):
    """Orders published year by year, three years a run, each run taking up where the one before stopped."""
    root, o = f"{scratch(spark)}/orders", _read(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").cast("string").alias("label"), F.round("o_totalprice", 2).alias("total"))
    run = 0
    notes = []
    while todo := [r.label for r in snapshots.pending(o, root, 3).collect()]:  # three labels
        run += 1
        for label in todo:
            notes.append(snapshots.publish(o.where(F.col("label") == label), root, label, least=1, note={"run": run}))
    folder = F.concat(F.lit(f"{root}/data/"), "folder")
    log = snapshots.labels(spark, root).select("label", "version", "rows", "note", folder.alias("folder"))
    back = spark.read.schema("o_orderkey long, label string, total double").parquet(f"{root}/data/*")
    return back.groupBy("label").agg(F.max("total").alias("largest"), F.count("*").alias("n")).join(log.drop("folder"), "label")


def _ticks(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))


def weekly_checks(spark, sf_dir):
    """Events as runs of a weekly check; purchases save something."""
    e = _ticks(spark, sf_dir)
    slot = due.weekly_slot(F.col("ts"), (4, "18:00"), (5, "06:00"))
    saved = e.where("event_type = 'purchase'").select(slot["key"].alias("key"), F.col("ts").alias("at")).where("key is not null")
    x = due.weekly_due(e.select("event_id", "ts"), "ts", saved, "2024-01-03", "2024-01-25")
    return x.select("event_id", "slot", F.col("key").cast("string").alias("key"), "action")


def run_decisions(spark, sf_dir):
    """Events as runs that build an edition and a pick: what each has to do."""
    e, i = _ticks(spark, sf_dir), F.col("event_id")
    made = F.col("ts") - F.make_dt_interval(mins=(i % 300).cast("int"))
    today = F.to_date(due.local(F.col("ts")))
    edition = due.edition_action(F.col("ts"), F.when(i % 17 > 0, F.to_date(due.local(made))), made)
    decided = F.date_sub(today, (i % 3).cast("int"))
    outcome = F.when(i % 4 == 1, "pick").when(i % 4 == 2, "none").when(i % 4 == 3, "incomplete")
    ticker = lambda n: F.concat(F.lit("T"), F.col("user_id") % n)
    feed = {"decided_for": F.when(i % 19 > 0, decided), "outcome": outcome, "kind": F.when(F.col("event_type").isin("purchase", "view"), "pick").otherwise("none"), "ticker": ticker(10), "session": F.date_sub(decided, (i % 4).cast("int"))}
    card = {"date": F.when(i % 23 > 0, F.date_sub(today, (i % 2).cast("int"))), "kind": F.when(i % 5 > 0, "pick").otherwise("none"), "ticker": ticker(9)}
    return e.select("event_id", edition.alias("edition"), due.pick_action(F.col("ts"), feed, card).alias("pick"))


def shuffled_choices(spark, sf_dir):
    """Each part's texts as the choices of a question, in a seeded order."""
    p = _read(spark, sf_dir, "part")
    both = due.shuffled(F.array("p_name", "p_brand", "p_type", F.col("p_size").cast("string")), F.col("p_partkey") % 5, F.col("p_partkey") * 1000 + 13)
    return p.select("p_partkey", both.alias("x")).select("p_partkey", F.array_join("x.choices", "|").alias("choices"), F.col("x.answer").alias("answer"))


QUERIES = {f.__name__: f for f in (snapshot_rows, snapshot_log, order_backfill, weekly_checks, run_decisions, shuffled_choices)}

# New York is five hours behind UTC in the month of the events
_T = """t AS (SELECT *, ts - INTERVAL 5 HOUR AS l FROM events), c AS (SELECT *, CAST(l AS DATE) AS d, dayofweek(l) AS w, hour(l) AS h FROM t),
s AS (SELECT *, CASE WHEN w = 3 AND h >= 18 THEN 'primary' WHEN w = 4 AND h < 6 THEN 'primary' WHEN w = 4 THEN 'backup' END AS slot, CASE WHEN w = 3 AND h >= 18 THEN d WHEN w = 4 THEN CAST(d - 1 AS DATE) END AS key FROM c)"""
_DRAW = "CAST(CAST({} AS DOUBLE) * CAST(1103515245 AS DOUBLE) + CAST(12345 AS DOUBLE) AS BIGINT) & 2147483647"


def _swap(order: str, k: int) -> str:
    return "[" + ", ".join(f"CASE WHEN {i} = j{k} THEN {order}[{k + 1}] " + (f"WHEN TRUE THEN {order}[j{k} + 1] END" if i == k else f"ELSE {order}[{i + 1}] END") for i in range(4)) + "]"


ORACLE_SQL = {
    "snapshot_rows": """WITH d AS (SELECT p_partkey, round(round(p_retailprice, 2) + CASE WHEN p_size > 25 THEN 10 ELSE 0 END, 2) AS price, p_size FROM part)
SELECT p_partkey, CASE WHEN p_size = 7 THEN 0.0 ELSE price END AS price, p_size, '2024-01-02' AS day FROM d UNION ALL SELECT p_partkey, price, p_size, '2024-01-03' FROM d WHERE p_size <= 45""",
    "snapshot_log": """SELECT v AS version, l AS label, CAST(CASE WHEN v = 4 THEN few ELSE n END AS BIGINT) AS rows, t AS note, CAST(4 AS INTEGER) AS n_published, CAST(2 AS INTEGER) AS n_unchanged, CAST(1 AS INTEGER) AS n_refused
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE p_size <= 45) AS few FROM part), (VALUES (CAST(1 AS BIGINT), '2024-01-01', NULL), (2, '2024-01-02', '{"prepared": "06:00"}'), (3, '2024-01-02', '{"patched": "09:30"}'), (4, '2024-01-03', NULL)) x(v, l, t)""",
    "order_backfill": """WITH y AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS label, round(max(o_totalprice), 2) AS largest, count(*) AS n FROM orders GROUP BY 1)
SELECT *, n AS rows, row_number() OVER (ORDER BY label) AS version, '{"run": ' || ((row_number() OVER (ORDER BY label) - 1) // 3 + 1) || '}' AS note FROM y""",
    "weekly_checks": f"""WITH {_T}, f AS (SELECT key, min(ts) AS done FROM s WHERE event_type = 'purchase' AND key IS NOT NULL GROUP BY 1),
g AS (SELECT event_id, ts, CASE WHEN d BETWEEN DATE '2024-01-03' AND DATE '2024-01-25' THEN slot END AS slot, CASE WHEN d BETWEEN DATE '2024-01-03' AND DATE '2024-01-25' THEN key END AS key FROM s)
SELECT event_id, slot, CAST(g.key AS VARCHAR) AS key, CASE WHEN slot IS NOT NULL AND (done IS NULL OR done > ts) THEN 'run' ELSE 'skip' END AS action FROM g LEFT JOIN f ON g.key = f.key""",
    "run_decisions": f"""WITH {_T}, x AS (SELECT *, event_id AS i, CAST(l - to_minutes(event_id % 300) AS DATE) AS made, CAST(d - CAST(event_id % 3 AS INTEGER) AS DATE) AS decided, CASE w WHEN 1 THEN 3 WHEN 0 THEN 2 ELSE 1 END AS back,
  coalesce(CASE event_id % 4 WHEN 1 THEN 'pick' WHEN 2 THEN 'none' WHEN 3 THEN 'incomplete' END, CASE WHEN event_type IN ('purchase', 'view') THEN 'pick' ELSE 'incomplete' END) AS outcome FROM s)
SELECT event_id, CASE WHEN i % 17 = 0 OR made <> d THEN 'build' WHEN h BETWEEN 4 AND 8 AND i % 300 >= 150 THEN 'refresh' ELSE 'skip' END AS edition,
  CASE WHEN w IN (0, 6) THEN 'skip' WHEN i % 19 > 0 AND i % 3 = 0 THEN CASE WHEN outcome = 'incomplete' THEN 'pick' WHEN i % 23 > 0 AND i % 2 = 0 AND event_type IN ('purchase', 'view') AND NOT (i % 5 > 0 AND user_id % 9 = user_id % 10) THEN 'patch' ELSE 'skip' END
    WHEN i % 3 + i % 4 = back THEN 'skip' ELSE 'pick' END AS pick FROM x""",
    "shuffled_choices": f"""WITH a AS (SELECT p_partkey, [p_name, p_brand, p_type, CAST(p_size AS VARCHAR)] AS v, {_DRAW.format("p_partkey * 1000 + 13")} AS s3 FROM part), b AS (SELECT *, {_DRAW.format("s3")} AS s2 FROM a), c AS (SELECT *, {_DRAW.format("s2")} AS s1 FROM b),
d AS (SELECT *, CAST(floor(s3 / CAST(2147483647 AS DOUBLE) * 4) AS INTEGER) AS j3, CAST(floor(s2 / CAST(2147483647 AS DOUBLE) * 3) AS INTEGER) AS j2, CAST(floor(s1 / CAST(2147483647 AS DOUBLE) * 2) AS INTEGER) AS j1, [0, 1, 2, 3] AS o FROM c),
e AS (SELECT * EXCLUDE (o), {_swap("o", 3)} AS o FROM d), f AS (SELECT * EXCLUDE (o), {_swap("o", 2)} AS o FROM e), g AS (SELECT * EXCLUDE (o), {_swap("o", 1)} AS o FROM f)
SELECT p_partkey, v[o[1] + 1] || '|' || v[o[2] + 1] || '|' || v[o[3] + 1] || '|' || v[o[4] + 1] AS choices, CAST(list_position(o, CAST(p_partkey % 5 AS INTEGER)) - 1 AS INTEGER) AS answer FROM g""",
}
