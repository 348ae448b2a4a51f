"""Queries over keyed tables: upserts, expiry, claims, gates, set operations, recommendation and search."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions.text import first_rule
from ..operators import merge, search

NOW = "2024-01-31 00:00:00"
RANKS = {"click": 0, "view": 1, "signup": 2, "purchase": 3, "error": 0}


def _read(spark, sf_dir, t):
    return spark.read.parquet(f"{sf_dir}/{t}.parquet")


def scratch(spark) -> str:
    """A shared folder for written rounds: the session's checkpoint folder; a local one only where all runs in one JVM."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


def stored(df, name: str):
    """df written once to the shared folder and read again."""
    path = f"{scratch(df.sparkSession)}-{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def buy_again(spark, sf_dir):
    h = _read(spark, sf_dir, "events").where("event_type in ('purchase', 'view')").select(
        F.concat_ws(":", "user_id", F.get_json_object("props", "$.k")).alias("key"),
        F.when(F.col("event_type") == "purchase", "purchased").otherwise("added").alias("kind"), F.col("ts").alias("at"))
    out = search.buy_again(h, F.lit(NOW).cast("timestamp_ntz"))
    return out.select("key", F.round("score", 6).alias("score"), "times", "last_at")


def discover_unseen(spark, sf_dir):
    """Parts that no purchase or view names (the events' k is the key of a part), by shared brand, name word and type."""
    p = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_type").alias("section"), F.array("p_brand").alias("tags"))
    h = _read(spark, sf_dir, "events").where("event_type in ('purchase', 'view')").select(F.get_json_object("props", "$.k").cast("long").alias("product_id"))
    return search.discover(h, p, 3)


def fuzzy_search(spark, sf_dir):
    out = search.search(_read(spark, sf_dir, "part"), "small gizom", 30, "p_name", "p_partkey")
    return out.select("id", "name", F.round("score", 4).alias("score"))


def rule_classify(spark, sf_dir):
    p, n = _read(spark, sf_dir, "part"), F.col("p_name")
    section = first_rule([("fasteners", n.rlike(r"\b(bolt|screw|nut)s?\b")), ("rings", n.rlike(r"\brings?\b")), ("hot", n.startswith("hot ")), ("large", F.col("p_size") > 40), ("promo", F.col("p_type") == "PROMO")])
    return p.select("p_partkey", section.alias("section"))


def dedupe_keep_best(spark, sf_dir):
    """One part for each name and brand: with the larger size, then the dearer, then the smaller key."""
    p = _read(spark, sf_dir, "part")
    out = merge.keep_best(p, [F.lower("p_name"), "p_brand"], [F.desc("p_size"), F.desc("p_retailprice"), F.asc("p_partkey")])
    return out.select("p_partkey", "p_name", "p_brand")


def ttl_expiry(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    return merge.expired(e.where("event_type = 'click'"), "ts", F.lit(NOW).cast("timestamp_ntz"), 14 * 24).select("event_id", "user_id")


def slot_claim(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    slots = e.where("event_type = 'view'").select(F.col("user_id").alias("name"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("due")).distinct()
    claims = e.where("event_type = 'purchase'").select(F.col("user_id").alias("name"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("due")).distinct()
    return merge.claim_slots(slots, claims, F.lit("2024-01-30 20:00:00").cast("timestamp_ntz"), 48)


def renumber_orders(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    return merge.renumbered(o, ["o_custkey", "o_orderpriority"], [F.asc("o_orderdate"), F.asc("o_orderkey")], "place").select("o_orderkey", "place")


def keep_last_n(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    return merge.keep_last(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 14).select("event_id", "user_id")


def quality_gate_report(spark, sf_dir):
    li = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "orders").select(F.col("o_orderkey"), "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    checks = [
        ("order-exists", F.col("o_orderkey").isNotNull()), ("quantity", F.col("l_quantity").between(1, 45)), ("discount", F.col("l_discount") <= 0.09),
        ("shipped-after-order", F.col("l_shipdate") >= F.col("o_orderdate")), ("flag", F.col("l_returnflag").isin("A", "N", "R")),
    ]
    return merge.problem_counts(li, checks)


def row_problems(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    found = merge.problems([("price", F.col("o_totalprice") >= 5000), ("status", F.col("o_orderstatus").isin("F", "O")), ("customer", F.col("o_custkey") % 10 != 3)])
    return o.select("o_orderkey", F.array_join(found, ",").alias("problems")).where("problems <> ''")


def snapshot_gate(spark, sf_dir):
    """Whether each day's events may replace the day's before: at least 80 % of its count."""
    from pyspark.sql import Window as W

    d = _read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    before = F.lag("n").over(W.orderBy("day"))
    return d.withColumn("accepted", before.isNull() | merge.supersedes(F.col("n"), before))


def anti_semi_set_ops(spark, sf_dir):
    """Customers by whether they order, order urgently, and neither."""
    c, o = _read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), _read(spark, sf_dir, "orders")
    urgent = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    every = o.select(F.col("o_custkey").alias("c_custkey"))
    parts = [
        c.join(urgent, "c_custkey", "left_semi").withColumn("kind", F.lit("urgent")),
        c.join(every, "c_custkey", "left_semi").join(urgent, "c_custkey", "left_anti").withColumn("kind", F.lit("calm")),
        c.join(every, "c_custkey", "left_anti").withColumn("kind", F.lit("none")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def array_set_ops(spark, sf_dir):
    """For each customer the priorities of even and odd orders: shared, joined and only even."""
    o = _read(spark, sf_dir, "orders")
    sets = o.groupBy("o_custkey").agg(F.collect_set(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority"))).alias("e"), F.collect_set(F.when(F.col("o_orderkey") % 2 == 1, F.col("o_orderpriority"))).alias("d"))
    return sets.select("o_custkey", F.size(F.array_intersect("e", "d")).alias("shared"), F.size(F.array_union("e", "d")).alias("joined"), F.size(F.array_except("e", "d")).alias("only_even"))


def stream_upsert(spark, sf_dir):
    """The events as a stream: last value and order of each user and slot, with a status that never steps back in rank."""
    from ..streaming.upserts import stream_into_archive

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select(
        F.concat_ws(":", "user_id", (F.col("event_id") % 3).cast("string")).alias("key"), "event_id", F.col("event_type").alias("status"), "value")
    base = scratch(spark)
    out = stream_into_archive(spark, source, f"{base}/archive", f"{base}/checkpoint", "key", "event_id", "status", RANKS)
    return out.select("key", "event_id", "status", F.round("value", 4).alias("value"))


def replaced_days(spark, sf_dir):
    """Events of which those of the last ten days replace all earlier ones of their users."""
    e = _read(spark, sf_dir, "events").select("user_id", "event_id")
    late = _read(spark, sf_dir, "events").where("ts >= timestamp_ntz'2024-01-21'").select("user_id", "event_id")
    return merge.replace_by_key(e, late, ["user_id"])


def orphan_parts(spark, sf_dir):
    """Parts that the events name and the table of parts lacks."""
    named = _read(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k")).distinct()
    return merge.orphans(named, _read(spark, sf_dir, "part"), "k", "p_partkey")


QUERIES = {
    f.__name__: f
    for f in (
        buy_again, discover_unseen, fuzzy_search, rule_classify, dedupe_keep_best, ttl_expiry, slot_claim, renumber_orders, keep_last_n, quality_gate_report,
        row_problems, snapshot_gate, anti_semi_set_ops, array_set_ops, stream_upsert,
        replaced_days, orphan_parts,
    )
}
ORACLE_SQL = {
    "buy_again": f"""SELECT concat_ws(':', user_id, json_extract_string(props, '$.k')) AS key,
  round(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0.4 END * (0.4 + 0.6 * exp(-greatest(0, (epoch(TIMESTAMP '{NOW}') - floor(epoch(ts))) / 86400) / 45))), 6) AS score,
  count(*) FILTER (WHERE event_type = 'purchase') AS times, max(ts) AS last_at
FROM events WHERE event_type IN ('purchase', 'view') GROUP BY 1""",
    "discover_unseen": """WITH h AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS id FROM events WHERE event_type IN ('purchase', 'view')), b AS (SELECT p.* FROM h JOIN part p ON p_partkey = id),
tag AS (SELECT p_brand AS t, count(*) AS w FROM b GROUP BY 1), sec AS (SELECT p_type AS t, count(*) AS w FROM b GROUP BY 1),
tok AS (SELECT t, count(*) AS w FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS t FROM b) GROUP BY 1),
fresh AS (SELECT * FROM part WHERE p_partkey NOT IN (SELECT id FROM h)),
ft AS (SELECT p_partkey, arg_min(w, i) AS w FROM (SELECT p_partkey, u.i AS i, string_split(lower(p_name), ' ')[u.i] AS t FROM fresh, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS u(i)) x JOIN tok USING (t) GROUP BY 1),
s AS (SELECT f.p_partkey, p_name, p_type, 3 * coalesce(tag.w, 0) + 2 * coalesce(ft.w, 0) + coalesce(sec.w, 0) AS score
  FROM fresh f LEFT JOIN tag ON tag.t = p_brand LEFT JOIN ft ON ft.p_partkey = f.p_partkey LEFT JOIN sec ON sec.t = p_type)
SELECT p_partkey AS product_id, p_name AS name, p_type AS section, score FROM s WHERE score >= 2
QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY score DESC, p_name, p_partkey) <= 3""",
    "rule_classify": r"""SELECT p_partkey, CASE WHEN regexp_matches(p_name, '\b(bolt|screw|nut)s?\b') THEN 'fasteners' WHEN regexp_matches(p_name, '\brings?\b') THEN 'rings'
  WHEN p_name LIKE 'hot %' THEN 'hot' WHEN p_size > 40 THEN 'large' WHEN p_type = 'PROMO' THEN 'promo' ELSE 'Other' END AS section FROM part""",
    "dedupe_keep_best": """SELECT p_partkey, p_name, p_brand FROM part
QUALIFY row_number() OVER (PARTITION BY lower(p_name), p_brand ORDER BY p_size DESC, p_retailprice DESC, p_partkey) = 1""",
    "ttl_expiry": f"SELECT event_id, user_id FROM events WHERE event_type = 'click' AND epoch(TIMESTAMP '{NOW}') - floor(epoch(ts)) >= 14 * 24 * 3600",
    "slot_claim": """WITH s AS (SELECT DISTINCT user_id AS name, date_trunc('hour', ts) AS due FROM events WHERE event_type = 'view'),
c AS (SELECT DISTINCT user_id AS name, date_trunc('hour', ts) AS due FROM events WHERE event_type = 'purchase'),
l AS (SELECT name, max(due) AS due FROM s WHERE due <= TIMESTAMP '2024-01-30 20:00:00' AND due >= TIMESTAMP '2024-01-28 20:00:00' GROUP BY 1)
SELECT name, due FROM l ANTI JOIN c USING (name, due)""",
    "renumber_orders": "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS place FROM orders",
    "keep_last_n": "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 14",
    "quality_gate_report": """WITH j AS (SELECT l.*, o_orderkey, o_orderdate FROM lineitem l LEFT JOIN orders ON l_orderkey = o_orderkey), c AS (
  SELECT count(*) AS total, count(*) FILTER (WHERE o_orderkey IS NULL) AS a, count(*) FILTER (WHERE NOT l_quantity BETWEEN 1 AND 45) AS b, count(*) FILTER (WHERE NOT l_discount <= 0.09) AS c,
         count(*) FILTER (WHERE NOT coalesce(l_shipdate >= o_orderdate, false)) AS d, count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N', 'R')) AS e FROM j)
SELECT 'order-exists' AS check, a AS failed, total FROM c UNION ALL SELECT 'quantity', b, total FROM c UNION ALL SELECT 'discount', c, total FROM c
UNION ALL SELECT 'shipped-after-order', d, total FROM c UNION ALL SELECT 'flag', e, total FROM c""",
    "row_problems": """WITH p AS (SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice < 5000 THEN 'price' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' END,
  CASE WHEN o_custkey % 10 = 3 THEN 'customer' END) AS problems FROM orders) SELECT * FROM p WHERE problems <> ''""",
    "snapshot_gate": """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)
SELECT day, n, lag(n) OVER (ORDER BY day) IS NULL OR n >= 0.8 * lag(n) OVER (ORDER BY day) AS accepted FROM d""",
    "anti_semi_set_ops": """SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') THEN 'urgent'
  WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'calm' ELSE 'none' END AS kind FROM customer""",
    "array_set_ops": """WITH s AS (SELECT o_custkey, o_orderpriority AS p, bool_or(o_orderkey % 2 = 0) AS e, bool_or(o_orderkey % 2 = 1) AS d FROM orders GROUP BY 1, 2)
SELECT o_custkey, CAST(count(*) FILTER (WHERE e AND d) AS INTEGER) AS shared, CAST(count(*) AS INTEGER) AS joined, CAST(count(*) FILTER (WHERE e AND NOT d) AS INTEGER) AS only_even FROM s GROUP BY 1""",
    "stream_upsert": """WITH e AS (SELECT concat_ws(':', user_id, event_id % 3) AS key, event_id, event_type AS status, value,
  CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS r FROM events)
SELECT key, max(event_id) AS event_id, arg_max(status, {'r': r, 'at': event_id}) AS status, round(arg_max(value, event_id) FILTER (WHERE value IS NOT NULL), 4) AS value FROM e GROUP BY 1""",
    "replaced_days": """SELECT user_id, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-21' UNION ALL
SELECT user_id, event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-21')""",
    "orphan_parts": "SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) NOT IN (SELECT p_partkey FROM part)",
}
