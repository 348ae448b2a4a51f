"""Hand-computed cases of operators whose ties, nulls and order matter."""

import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import asof, calendar, merge, ranking, search, similarity, standings, timeseries


def test_known_at_prefers_not_superseded_then_latest_then_greatest(spark):
    facts = spark.createDataFrame(
        [("k", datetime(2024, 1, 1), True, "a", 1.0), ("k", datetime(2024, 1, 2), False, "b", 2.0), ("k", datetime(2024, 1, 2), False, "c", 3.0), ("k", datetime(2024, 1, 3), True, "d", 4.0), ("k", datetime(2024, 2, 1), False, "e", 5.0)],
        "key string, accepted timestamp, superseded boolean, adsh string, value double",
    )
    at = lambda day: [r.value for r in asof.known_at(facts, ["key"], F.lit(day).cast("timestamp"), "accepted", "superseded", "adsh").collect()]
    assert at("2024-01-10") == [3.0] and at("2024-01-01") == [1.0] and at("2023-12-31") == [] and at("2024-03-01") == [5.0]


def test_mean_of_rounded_does_not_hang_on_the_order(spark):
    """The exact mean -0.8322135 is a tie; a sum of doubles gives -0.832213 for one of these orders."""
    values = [-0.401383, -0.391154, -1.995584, -0.540733]
    mean = lambda rows: spark.createDataFrame([(x,) for x in rows], "x double").coalesce(1).agg(ranking.mean_of_rounded(F.col("x"))).first()[0]
    assert mean(values) == mean(values[::-1]) == -0.832214
    assert mean([0.000001, 0.000002, None]) == 0.000002 and mean([None]) is None


def bars(spark, closes, ticker="t"):
    return spark.createDataFrame([(ticker, date.fromordinal(738000 + i), float(c), 10.0 + i) for i, c in enumerate(closes)], "ticker string, date date, close double, volume double")


def test_realised_vol_needs_a_full_frame_and_positive_prices(spark):
    closes = [100, 110, 99, 120, 0, 130, 140, 150, 160]
    out = timeseries.with_log_returns(bars(spark, closes)).select("date", timeseries.realised_vol(3).alias("v")).orderBy("date").collect()
    r = [math.log(b / a) for a, b in zip(closes[:3], closes[1:4])]
    mean = sum(r) / 3
    assert [x.v is None for x in out] == [True, True, True, False, True, True, True, True, False]
    assert out[3].v == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in r) / 2))


def test_sma_drawdown_and_trailing_return(spark):
    out = bars(spark, [4, 8, 6, 2, 10]).select("date", timeseries.sma(2).alias("s"), timeseries.drawdown("close").alias("d"), timeseries.trailing_return(2).alias("r")).orderBy("date").collect()
    assert [x.s for x in out] == [None, 6.0, 7.0, 4.0, 6.0]
    assert [x.d for x in out] == [0.0, 0.0, -0.25, -0.75, 0.0]
    assert out[4].r == pytest.approx(10 / 6 - 1) and out[1].r is None


def test_newey_west_by_hand(spark):
    v = [0.1, -0.2, 0.3, 0.05]
    rows = spark.createDataFrame([("k", i, x) for i, x in enumerate(v)], "key string, i int, x double")
    mean = sum(v) / 4
    u = [x - mean for x in v]
    spread = sum(x * x for x in u) / 4 + 2 * 0.5 * sum(a * b for a, b in zip(u, u[1:])) / 4
    got = timeseries.newey_west(rows, "x", "key", "i", lags=1).first()
    want = mean / math.sqrt(spread / 4) if spread > 0 else None
    assert (got.t is None and want is None) or got.t == pytest.approx(want)


def test_winsorised_and_z(spark):
    few = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 100)] + [("b", 5.0)] * 6 + [("c", None)], "g string, x double")
    rows = ranking.cohort_z(few.withColumnRenamed("x", "w"), ["w"], "g").withColumnRenamed("z_w", "z").collect()
    assert max(r.w for r in rows if r.g == "a") == 100.0 and {r.z for r in rows if r.g == "b"} == {0.0} and {r.z for r in rows if r.g == "c"} == {None}


def test_deciles_leave_the_rest_to_the_last(spark):
    rows = spark.createDataFrame([(float(i), i) for i in range(105)], "v double, tie int")
    n = {r.decile: r["count"] for r in ranking.deciles(rows, "v", "tie").groupBy("decile").count().collect()}
    assert n == {**dict.fromkeys(range(1, 10), 10), 10: 15}


def test_upper_median_and_first_failure(spark):
    assert spark.createDataFrame([(x,) for x in (1.0, 4.0, 2.0, 3.0)], "x double").agg(ranking.upper_median("x")).first()[0] == 3.0
    rows = spark.createDataFrame([(1, 1), (None, 1), (1, 5)], "a int, b int")
    test = ranking.first_failure([("a", F.col("a") > 0), ("b", F.col("b") < 3)])
    assert [r[0] for r in rows.select(test).collect()] == [None, "a", "b"]


def test_slot_portfolio_keeps_empty_slots(spark):
    p = spark.createDataFrame([(0, 0.1), (21, 0.2), (5, -0.5)], "i int, net double")
    got = {r.slot: r.growth for r in ranking.slot_portfolio(p, "i", "net").collect()}
    assert len(got) == 21 and got[0] == pytest.approx(1.32) and got[5] == 0.5 and got[1] == 1.0


def test_standings_ranks_and_members_without_games(spark):
    members = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 1)], "team string, g int")
    games = spark.createDataFrame([(1, "a", 3, "c", 1), (2, "b", 4, "c", 2), (2, "b", 4, "c", 2), (3, "a", None, "b", None)], "game_id int, home string, home_score int, away string, away_score int")
    got = {r.team: (r.position, r.played, r.points) for r in standings.standings(members, games, "g").collect()}
    assert got == {"a": (1, 1, 3), "b": (1, 1, 3), "c": (4, 2, 0), "d": (3, 0, 0)}


def test_upsert_keeps_rank_and_values(spark):
    schema = "id int, at int, status string, score int"
    old = spark.createDataFrame([(1, 5, "final", 3), (2, 5, "scheduled", None), (4, 1, "final", 1)], schema)
    new = spark.createDataFrame([(1, 6, "scheduled", None), (2, 4, "final", 9), (3, 1, "scheduled", None), (3, 2, "final", 2)], schema)
    got = {r.id: tuple(r)[1:] for r in merge.upsert(old, new, "id", "at", {"scheduled": 0, "final": 2}, "status").collect()}
    assert got == {1: (6, "final", 3), 2: (5, "final", 9), 3: (2, "final", 2), 4: (1, "final", 1)}


def test_greedy_keep_is_the_sequential_pass(spark, tmp_path):
    import random

    rng = random.Random(5)
    n, links = 60, set()
    for _ in range(120):
        a, b = rng.sample(range(n), 2)
        links.add((min(a, b), max(a, b)))
    order = rng.sample(range(n), n)
    kept = set()
    for i in sorted(range(n), key=order.__getitem__):
        if not any((min(i, k), max(i, k)) in links for k in kept):
            kept.add(i)
    items = spark.createDataFrame(list(enumerate(order)), "k int, r int")
    got = similarity.greedy_keep(items, spark.createDataFrame(sorted(links), "a int, b int"), "k", "r", str(tmp_path))
    assert {r.k for r in got.collect() if r.kept} == kept


def test_search_words(spark):
    p = spark.createDataFrame([(1, "Cheddar Cheese"), (2, "Butter"), (3, "Butternut Squash"), (4, "Fig Butter"), (5, "Salted Butter")], "id int, name string")
    ids = lambda q: [r.id for r in search.search(p, q).collect()]
    assert ids("butter") == [2, 5, 4, 3] and ids("cheddra") == [1] and ids("butters") == [2, 5, 4] and ids("milk") == []


def test_alignment_distance(spark):
    rows = spark.createDataFrame([("ab", "ba"), ("kitten", "sitting"), ("", "abc"), ("ca", "abc")], "a string, b string")
    assert [r[0] for r in rows.select(search.alignment_distance("a", "b")).collect()] == [1, 3, 3, 3]


def test_urls_and_truncation(spark):
    cases = {
        "https://www.Example.com/a/?utm_source=x&b=1#top": "https://example.com/a/?b=1", "http://example.com/": "http://example.com", "not a url": "not a url",
        "https://m.example.com/x?ref=a": "https://m.example.com/x", "https://example.com:8080/p/": "https://example.com:8080/p",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r.u: r.c for r in rows.select("u", text.canonical_url("u").alias("c")).collect()} == cases
    t = spark.createDataFrame([("short",), ("word " * 10,), ("x" * 30,)], "t string").select(text.truncated("t", 20).alias("t")).collect()
    assert [r.t for r in t] == ["short", "word word word word…", "x" * 20 + "…"]


def test_stream_upsert_equals_the_batch(spark, tmp_path):
    from tessera.streaming.upserts import stream_into_archive, windowed_counts

    schema = "key int, at int, status string, value int"
    for i in range(4):
        spark.createDataFrame([(k, 10 * i + k, "final" if (i + k) % 2 else "scheduled", i) for k in range(5)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = stream_into_archive(spark, source, str(tmp_path / "archive"), str(tmp_path / "check"), "key", "at", "status", {"scheduled": 0, "final": 1})
    assert {r.key: (r["at"], r.status, r.value) for r in out.collect()} == {k: (30 + k, "final", 3) for k in range(5)}
    events = spark.createDataFrame([(datetime(2024, 1, 1, 0, 5), "a", 1.0), (datetime(2024, 1, 1, 0, 55), "a", 2.0), (datetime(2024, 1, 1, 1, 5), "b", 4.0)], "ts timestamp_ntz, kind string, value double")
    assert sorted((r.kind, r.n, r.total) for r in windowed_counts(events, "ts", "kind").collect()) == [("a", 2, 3.0), ("b", 1, 4.0)]


def test_trailing_sum_never_gives_a_part(spark):
    rows = spark.createDataFrame([("a", p, 10) for p in (1, 2, 3, 4, 6, 7, 8, 9)], "k string, p int, v int")
    got = {r.p: r.trailing for r in calendar.trailing_sum(rows, "k", "p", "v").collect()}
    assert got == {1: None, 2: None, 3: None, 4: 40, 6: None, 7: None, 8: None, 9: 40}


def test_next_by_median_gap_and_changes(spark):
    rows = spark.createDataFrame([("a", date(2024, 1, d)) for d in (1, 5, 11)] + [("b", date(2024, 1, 1))], "k string, d date")
    got = calendar.next_by_median_gap(rows, "k", "d").collect()
    assert [tuple(r) for r in got] == [("a", date(2024, 1, 11), date(2024, 1, 16), 3, 2)]
    old, new = (spark.createDataFrame(x, "id int, v string") for x in ([(1, "x"), (2, "y"), (3, None)], [(1, "x"), (2, "z"), (3, None), (4, "n")]))
    assert {tuple(r) for r in calendar.changes(old, new, "id", ["v"]).collect()} == {(2, "changed"), (4, "came")}


def test_upsert_in_any_batches(spark):
    """The same state from one, two and many batches, in any order, with repeats."""
    import itertools

    rows = [("a", 1, "scheduled", 1.0), ("a", 2, "final", 5.0), ("a", 3, "scheduled", None), ("b", 4, None, None), ("b", 2, "scheduled", 2.0), ("a", 2, "final", 5.0)]
    schema, ranks = "k string, at long, status string, v double", {"scheduled": 0, "final": 2}
    whole = merge.folded(spark.createDataFrame(rows, schema), "k", "at", ranks, "status")
    want = sorted(tuple(r) for r in merge.state_rows(whole, "k", "at").collect())
    assert want == [("a", 3, "final", 5.0), ("b", 4, "scheduled", 2.0)]
    for cut, flip in itertools.product((1, 3, 5), (False, True)):
        parts = [rows[:cut], rows[cut:], rows[cut:]]
        states = [merge.folded(spark.createDataFrame(p, schema), "k", "at", ranks, "status") for p in (parts[::-1] if flip else parts)]
        both = merge.refolded(states[0].unionByName(states[1]).unionByName(states[2]), "k")
        assert sorted(tuple(r) for r in merge.state_rows(both, "k", "at").collect()) == want


def test_stream_restarts(spark, tmp_path):
    """Batches of one file each, a restart without new files, and a compacted archive give the batch result."""
    from tessera.streaming.upserts import compact, read_archive, stream_into_archive

    schema, ranks = "k long, at long, status string, v double", {"view": 1, "purchase": 3}

    def land(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        return sorted(tuple(r) for r in stream_into_archive(spark, source, f"{tmp_path}/archive", f"{tmp_path}/check", "k", "at", "status", ranks).collect())

    land([(1, 1, "purchase", 2.0), (2, 2, "view", None)])
    land([(1, 3, "view", None)])
    want = [(1, 3, "purchase", 2.0), (2, 2, "view", None)]
    assert run() == want
    assert run() == want
    compact(spark, f"{tmp_path}/archive", "k")
    land([(2, 1, "purchase", 7.0)])
    assert run() == [(1, 3, "purchase", 2.0), (2, 2, "purchase", 7.0)]
    assert read_archive(spark, f"{tmp_path}/nothing", "k", "at") is None


def _walked(items, per_topic, top=3, cap=2, share=0.5, min_shared=3, min_overlap=0.25):
    """Picks of one topic by a sequential walk; items (key, score, publisher, foreign, subject, tokens)."""
    ranked, picks = sorted(items, key=lambda x: (-x[1], x[0])), []
    most = -int(-per_topic * share // 1)
    for relaxed in (False, True):
        for it in ranked:
            if len(picks) >= per_topic or it in picks:
                continue
            first = len(picks) < top
            abroad = sum(p[3] for p in picks)
            if it[3] and (abroad >= most or (first and abroad >= max(1, top // 2))):
                continue
            if not relaxed and sum(p[2] == it[2] for p in picks) >= (1 if first else cap):
                continue
            if first and it[4] is not None and any(p[4] == it[4] for p in picks):
                continue
            shared = [(len(set(p[5]) & set(it[5])), min(len(p[5]), len(it[5]))) for p in picks]
            if any(n >= min_shared and n >= min_overlap * m for n, m in shared):
                continue
            picks.append(it)
    return [p[0] for p in picks]


def test_constrained_top_n(spark):
    import random

    from tessera.operators.selection import select_per_topic

    rng = random.Random(5)
    rows = []
    for i in range(160):
        tokens = rng.sample(["ada", "bela", "cora", "dina", "enid", "fay"], rng.randint(0, 4)) + [f"own{i}"]
        rows.append((["en", "it", None][i % 3], i, float(rng.randint(1, 30)), rng.choice("PQRS"), rng.random() < 0.3, rng.choice(["x", "y", "z", None]), tokens))
    items = spark.createDataFrame(rows, "topic string, id long, score double, publisher string, foreign boolean, subject string, tokens array<string>")
    got = {}
    for r in select_per_topic(items, 6).orderBy("place").collect():
        got.setdefault(r.topic, []).append(r.key)
    assert got == {t: _walked([r[1:] for r in rows if r[0] == t], 6) for t in ("en", "it", None)}


def test_proper_nouns(spark):
    from tessera.operators.selection import proper_nouns

    one = spark.createDataFrame([("The Match of Leipzig and Roma's Men", "Goals by Anna. Then Zurich won\nGood Total Sport", "Total Sport"), (None, None, None)], "t string, e string, p string")
    assert [sorted(r.n) for r in one.select(proper_nouns(F.col("t"), F.col("e"), F.col("p")).alias("n")).collect()] == [["anna", "leipzig", "match", "roma", "zurich"], []]
