"""Point-in-time queries: events are facts, user_id the entity, event_type the tag, ts the time of knowledge."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof



def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _middle(spark, sf_dir):
    """The time at the middle of the events' range, as one bounded scalar."""
    r = _events(spark, sf_dir).agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    return r["a"] + (r["b"] - r["a"]) / 2


def pit_latest_by_asof(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("superseded", F.col("event_id") % 7 == 0)
    mid = F.lit(_middle(spark, sf_dir).replace(microsecond=0)).cast("timestamp_ntz")
    out = asof.known_at(e, ["user_id", "event_type"], mid, "ts", "superseded", "event_id")
    return out.select("user_id", "event_type", "event_id", F.round("value", 4).alias("value"))


def asof_price(spark, sf_dir):
    """The last view of a user at or before each purchase."""
    e = _events(spark, sf_dir)
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = e.where("event_type = 'view'").select(F.col("event_id").alias("tie"), "user_id", "ts", "value")
    out = asof.as_of_backward(buys, views, "user_id", "ts", "ts", "value", "tie")
    return out.select("event_id", F.round("as_of_value", 4).alias("seen_value"), F.col("as_of_ts").alias("seen_ts"))


def nearest_within_tolerance(spark, sf_dir):
    """The purchase day nearest to 30 days after each purchase day of a user, within 10 days."""
    days = _events(spark, sf_dir).where("event_type = 'purchase'").select("user_id", F.to_date("ts").alias("day")).distinct()
    return asof.nearest_within(days, "user_id", "day", F.date_add("day", 30), 10)


def band_previous(spark, sf_dir):
    days = _events(spark, sf_dir).select("user_id", F.to_date("ts").alias("day")).distinct()
    return asof.band_previous(days, "user_id", "day", 5, 12)


def split_adjust_product(spark, sf_dir):
    """Each shipment date of a part with the product of (1 + discount) of all later shipments."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", F.to_date("l_shipdate").alias("day"), "l_discount")
    days = li.select("l_partkey", "day").distinct()
    splits = li.select("l_partkey", F.col("day").alias("split_day"), (1 + F.col("l_discount")).alias("ratio"))
    return asof.adjust_by_later(days, splits, "l_partkey", "day", "split_day", "ratio").withColumn("factor", F.round("factor", 4))


def facts_overlay_left_wins(spark, sf_dir):
    """Late facts overlay early ones by (user, type, day); the late side keeps its last row of a key."""
    mid = F.lit(_middle(spark, sf_dir).replace(microsecond=0)).cast("timestamp_ntz")
    e = _events(spark, sf_dir).select("event_id", "user_id", "event_type", (F.dayofmonth("ts") % 5).alias("slot"), "ts")
    out = asof.overlay(e.where(F.col("ts") <= mid), e.where(F.col("ts") > mid), ["user_id", "event_type", "slot"], [F.desc("event_id")])
    return out.select("event_id", "user_id", "event_type", F.col("slot").cast("long").alias("slot"))


QUERIES = {f.__name__: f for f in (pit_latest_by_asof, asof_price, nearest_within_tolerance, band_previous, split_adjust_product, facts_overlay_left_wins)}
_MID = "m AS (SELECT date_trunc('second', min(ts) + (max(ts) - min(ts)) / 2) AS mid FROM events)"
ORACLE_SQL = {
    "pit_latest_by_asof": f"""WITH {_MID}
SELECT user_id, event_type, event_id, round(value, 4) AS value FROM events, m WHERE ts <= mid
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 7 = 0, ts DESC, event_id DESC) = 1""",
    "asof_price": """WITH v AS (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT p.event_id, round(v.value, 4) AS seen_value, v.ts AS seen_ts
FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""",
    "nearest_within_tolerance": """WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase'),
f AS (SELECT a.user_id, a.day, b.day AS near, abs(b.day - (a.day + 30)) AS gap FROM d a JOIN d b ON a.user_id = b.user_id AND abs(b.day - (a.day + 30)) <= 10
  QUALIFY row_number() OVER (PARTITION BY a.user_id, a.day ORDER BY abs(b.day - (a.day + 30)), b.day) = 1)
SELECT d.user_id, d.day, near, CAST(gap AS INTEGER) AS gap FROM d LEFT JOIN f ON d.user_id = f.user_id AND d.day = f.day""",
    "band_previous": """WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events)
SELECT a.user_id, a.day, max(b.day) AS previous FROM d a LEFT JOIN d b ON a.user_id = b.user_id AND a.day - b.day BETWEEN 5 AND 12 GROUP BY ALL""",
    "split_adjust_product": """WITH l AS (SELECT l_partkey, CAST(l_shipdate AS DATE) AS day, l_discount FROM lineitem), d AS (SELECT DISTINCT l_partkey, day FROM l)
SELECT d.l_partkey, d.day, round(product(1 + l.l_discount), 4) AS factor FROM d JOIN l ON d.l_partkey = l.l_partkey AND l.day >= d.day GROUP BY ALL""",
    "facts_overlay_left_wins": f"""WITH {_MID}, e AS (SELECT event_id, user_id, event_type, day(ts) % 5 AS slot, ts FROM events),
late AS (SELECT e.* FROM e, m WHERE ts > mid QUALIFY row_number() OVER (PARTITION BY user_id, event_type, slot ORDER BY event_id DESC) = 1)
SELECT event_id, user_id, event_type, slot FROM late
UNION ALL SELECT event_id, user_id, event_type, slot FROM e, m WHERE ts <= mid AND NOT EXISTS (
  SELECT 1 FROM late l WHERE l.user_id = e.user_id AND l.event_type = e.event_type AND l.slot = e.slot)""",
}
