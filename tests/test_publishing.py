"""Snapshots, claims, due runs and seeded orders, by hand cases."""

import math
import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import due
from tessera.sources import snapshots


def rows(table):
    return sorted(tuple(r) for r in table.collect())


def test_readers_see_whole_publications_only(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    one = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, v string")
    assert snapshots.manifest(spark, root).count() == 0
    with pytest.raises(LookupError):
        snapshots.current(spark, root)
    assert snapshots.publish(one, root, "d1") == "published"
    one.write.parquet(f"{root}/data/left-by-a-dead-job")  # no manifest row
    os.makedirs(f"{tmp_path}/s/manifest/000000000002/_temporary/0")  # nor here
    assert rows(snapshots.current(spark, root).fillna("")) == [(1, "a"), (2, ""), (2, "")]
    assert snapshots.publish(one.limit(1), root, "d2", share=0.5) == "refused" and snapshots.publish(one, root, "d2", least=4) == "refused"
    assert snapshots.publish(one.orderBy(F.desc("k")), root, "d1") == "unchanged"
    assert snapshots.publish(one, root, "d2") == "published"  # the same content on another day
    assert rows(snapshots.labels(spark, root).select("label", "version", "rows")) == [("d1", 1, 3), ("d2", 2, 3)]
    with pytest.raises(LookupError):
        snapshots.current(spark, root, "d3")


def test_checksums_tell_contents_apart(spark):
    make = lambda *r: snapshots.checksum(spark.createDataFrame(list(r), "a string, b string"))[1]
    assert make(("x", None)) != make((None, "x")) != make(("", "x")) and make(("x", "y"), ("x", "y")) != make(("x", "y"))
    assert make(("x", "y"), ("z", None)) == make(("z", None), ("x", "y"))
    both = spark.createDataFrame([("x", "y")], "a string, b string")
    assert snapshots.checksum(both) == snapshots.checksum(both.select("b", "a")) and snapshots.checksum(both.limit(0))[0] == 0


def test_a_patch_touches_one_column_and_pruning_keeps_labels(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    table = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (None, "c", 7)], "k int, v string, age int")
    for day in ("d1", "d2", "d3"):
        snapshots.publish(table.withColumn("age", F.col("age") + int(day[1])), root, day)
    updates = spark.createDataFrame([(2, "B"), (9, "Z")], "k int, new string")
    assert snapshots.patch(updates, root, "k", {"v": F.col("new")}, note={"by": "x"}) == "published"
    assert snapshots.patch(updates, root, "k", {"v": F.col("new")}) == "unchanged"
    now = {r.age: (r.k, r.v) for r in snapshots.current(spark, root).collect()}
    assert now == {8: (1, "a"), 9: (2, "B"), 10: (None, "c")}
    assert snapshots.patch(updates, root, "k", {"v": F.lit(None)}) == "published" and {r.v for r in snapshots.current(spark, root).collect()} == {"a", None, "c"}
    assert snapshots.prune(spark, root, keep=2) == 3  # d1 and two readings of d3 that were replaced
    assert snapshots.current(spark, root, "d2").count() == 3 and snapshots.current(spark, root).count() == 3
    assert snapshots.prune(spark, root, keep=2) == 0 and snapshots.manifest(spark, root).count() == 5


def test_a_backfill_goes_on_where_it_stopped(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    found = spark.createDataFrame([("c",), ("a",), ("b",), ("a",)], "label string")
    assert [r.label for r in snapshots.pending(found, root, 2).collect()] == ["a", "b"]
    snapshots.publish(found, root, "a")
    assert [r.label for r in snapshots.pending(found, root, 2).collect()] == ["b", "c"]


def test_a_held_out_window_is_opened_under_one_set_of_rules(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert snapshots.open_once(spark, root, "2024", {"t": 1.5, "n": 3})
    assert snapshots.open_once(spark, root, "2024", {"n": 3, "t": 1.5})
    assert not snapshots.open_once(spark, root, "2024", {"t": 1.6, "n": 3})
    assert snapshots.open_once(spark, root, "2025", {"t": 1.6, "n": 3})


def at(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("now", F.col("now").cast("timestamp_ntz"))


def test_weekly_slots(spark):
    """Wednesday from 18:00, a late start on Thursday before 06:00, the backup after it; a saved run claims the week, the season bounds all."""
    ticks = [
        ("2026-09-16 21:59:00", None, None, "skip"), ("2026-09-16 22:00:00", "primary", "2026-09-16", "run"), ("2026-09-17 09:59:00", "primary", "2026-09-16", "run"), ("2026-09-17 10:00:00", "backup", "2026-09-16", "run"),
        ("2026-09-18 10:00:00", None, None, "skip"), ("2026-09-23 22:30:00", "primary", "2026-09-23", "run"), ("2026-09-24 11:00:00", "backup", "2026-09-23", "skip"), ("2026-07-29 23:00:00", None, None, "skip"),
        ("2026-12-16 22:30:00", None, None, "skip"), ("2026-12-16 23:00:00", "primary", "2026-12-16", "run"),
    ]
    saved = spark.createDataFrame([("2026-09-23", "2026-09-23 23:00:00"), ("2026-09-23", "2026-09-24 12:00:00")], "key string, at string").select(F.col("key").cast("date").alias("key"), F.col("at").cast("timestamp_ntz").alias("at"))
    got = due.weekly_due(at(spark, [t[:1] for t in ticks], "now string"), "now", saved, "2026-08-01", "2027-01-31").collect()
    assert sorted((str(r.now), r.slot, r.key and str(r.key), r.action) for r in got) == sorted(ticks)


def test_editions(spark):
    cases = [
        ("2026-09-16 10:00:00", None, None, "build"), ("2026-09-16 10:00:00", "2026-09-15", "2026-09-15 10:00:00", "build"), ("2026-09-16 10:00:00", "2026-09-16", "2026-09-16 07:30:00", "refresh"),
        ("2026-09-16 10:00:00", "2026-09-16", "2026-09-16 07:31:00", "skip"), ("2026-09-16 13:00:00", "2026-09-16", "2026-09-16 07:00:00", "skip"), ("2026-09-16 07:59:00", "2026-09-16", "2026-09-16 04:10:00", "skip"),
        ("2026-09-16 03:00:00", "2026-09-15", "2026-09-15 20:00:00", "skip"), ("2026-09-16 10:00:00", "2026-09-16", None, "skip"),
    ]
    df = at(spark, [(i, *c) for i, c in enumerate(cases)], "i int, now string, date string, prepared string, want string")
    got = df.select("want", due.edition_action(F.col("now"), F.col("date").cast("date"), F.col("prepared").cast("timestamp_ntz")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_picks(spark):
    wed, sat, mon = "2026-09-16 14:00:00", "2026-09-19 14:00:00", "2026-09-21 14:00:00"
    day = "2026-09-16"
    cases = [  # now, decided_for, outcome, kind, ticker, session, card date, card kind, card ticker
        (sat, None, None, None, None, None, None, None, None, "skip"), (wed, None, None, None, None, None, None, None, None, "pick"), (wed, day, "incomplete", "none", None, None, None, None, None, "pick"),
        (wed, day, None, "none", None, None, None, None, None, "pick"), (wed, day, "none", "none", None, None, day, "open-position", None, "skip"), (wed, day, "pick", "pick", "A", None, day, "pick", "A", "skip"),
        (wed, day, None, "pick", "A", None, day, "pick", "B", "patch"), (wed, day, "pick", "pick", "A", None, day, None, None, "patch"), (wed, day, "pick", "pick", "A", None, "2026-09-15", "pick", "B", "skip"),
        (wed, day, "pick", "pick", "A", None, None, None, None, "skip"), (mon, "2026-09-18", "pick", "pick", "A", "2026-09-18", None, None, None, "skip"), (mon, "2026-09-18", "pick", "pick", "A", "2026-09-17", None, None, None, "pick"),
    ]
    df = at(spark, [(*c,) for c in cases], "now string, decided_for string, outcome string, kind string, ticker string, session string, date string, ckind string, cticker string, want string")
    feed = {c: F.col(c).cast("date") if c in ("decided_for", "session") else F.col(c) for c in ("decided_for", "outcome", "kind", "ticker", "session")}
    card = {"date": F.col("date").cast("date"), "kind": F.col("ckind"), "ticker": F.col("cticker")}
    got = df.select("want", due.pick_action(F.col("now"), feed, card).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def sequential(seed, n):
    """The same order, drawn one number after another."""
    order = list(range(n))
    for k in range(n - 1, 0, -1):
        seed = int(float(seed) * 1103515245.0 + 12345.0) & 0x7FFFFFFF
        j = min(k, math.floor(seed / float(0x7FFFFFFF) * (k + 1)))
        order[k], order[j] = order[j], order[k]
    return order


def test_seeded_orders(spark):
    cases = [(w * 1000 + i * 7 + 13, n) for w in (1, 2, 53, 2_000_000) for i in range(20) for n in (0, 1, 2, 4, 9)]
    got = spark.createDataFrame(cases, "seed long, n int").select("seed", "n", due.seeded_order(F.col("seed"), F.col("n")).alias("o")).collect()
    assert len(got) == len(cases) and all(r.o == sequential(r.seed, r.n) for r in got)
    df = spark.createDataFrame([(["a", "b", "c", "d"], 2), (["a", "b"], 5), ([], 0), (None, 0)], "c array<string>, a int").select("c", "a", due.shuffled(F.col("c"), F.col("a"), F.lit(1020)).alias("x")).collect()
    assert df[0].x.choices[df[0].x.answer] == "c" and sorted(df[0].x.choices) == list("abcd")
    assert df[1].x.answer is None and df[2].x.choices == [] and df[3].x is None
