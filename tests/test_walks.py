"""Samples, pools, lesson weeks and pack checks on small cases."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import walks

DAY = dt.date(2024, 1, 1)


def _day(n):
    return DAY + dt.timedelta(days=n)


def test_forward_sample_needs_exact_sessions(spark):
    rows = [(t, _day(i), 10.0 + i, 10.0 + i * k) for t, k in (("a", 2), ("m", 1)) for i in range(12) if (t, i) != ("a", 7)]
    bars = spark.createDataFrame(rows, "ticker string, date date, open double, close double")
    sessions = spark.createDataFrame([(_day(i), i) for i in range(12)], "date date, session_idx int")
    got = {r.session_idx: (r.trailing, r.excess) for r in walks.forward_sample(bars, sessions, "m", back=2, ahead=3).collect()}
    close, own = (lambda i: 10.0 + 2 * i), (lambda i: 10.0 + i)
    # without session 7: neither it nor its neighbours that need it
    want = {i: (close(i) / close(i - 2) - 1, close(i + 3) / own(i + 1) - own(i + 3) / own(i + 1)) for i in range(2, 9) if not {i, i - 2, i + 1, i + 3} & {7}}
    assert got.keys() == want.keys()
    assert all(abs(x - y) < 1e-12 for i in want for x, y in zip(got[i], want[i]))
    assert walks.forward_sample(bars.limit(0), sessions, "m").count() == 0


def test_trailing_pool_takes_the_first_of_each_key(spark):
    rows = [("x", _day(0), 5), ("x", _day(0), 4), ("x", _day(1), 1), ("y", _day(3), 9), (None, _day(3), 2), ("z", None, 3)]
    items = spark.createDataFrame(rows, "url string, seen date, n int")
    got = sorted(tuple(r) for r in walks.trailing_pool(items, "url", "seen", "n", 3).select("day", "url", "first").collect())
    assert got == [(_day(0), "x", 4), (_day(1), "x", 4), (_day(3), "x", 1), (_day(3), "y", 9)]
    assert walks.trailing_pool(items.limit(0), "url", "seen", "n", 3).count() == 0


def test_lessons_begin_on_the_first_monday_and_wrap(spark):
    dates = spark.createDataFrame([(dt.date(2024, 1, 7),), (dt.date(2024, 1, 8),), (dt.date(2024, 1, 21),), (dt.date(2024, 1, 22),), (None,)], "d date")
    start = F.lit("2024-01-03").cast("date")
    got = [tuple(r) for r in dates.select(*walks.lesson_of(F.col("d"), start, 2).values()).collect()]
    assert got == [(None,) * 3, (0, 0, 1), (1, 1, 7), (2, 0, 1), (None,) * 3]
    later = dates.where("d = '2024-01-22'").select(*walks.lesson_of(F.col("d"), start, 2, offset_weeks=2).values()).first()
    assert tuple(later) == (0, 0, 1)
    monday = spark.range(1).select(walks.first_monday(F.lit("2024-01-01").cast("date"))).first()[0]
    assert monday == DAY


def test_pack_checks(spark):
    rows = [("ok", 1, 1), ("ok", 2, 1), ("twice", 1, 1), ("twice", 1, 1), ("gap", 1, 1), ("gap", 3, 1), ("empty", 1, None), ("none", None, 1)]
    got = {r[0]: tuple(r)[1:] for r in walks.pack_checks(spark.createDataFrame(rows, "pack string, n int, q int"), "pack", "n", F.col("q") > 0).collect()}
    assert got == {"ok": (2, True, True, True), "twice": (2, False, True, False), "gap": (2, False, True, False), "empty": (1, True, False, False), "none": (1, False, True, False)}
