"""Readings folded into an archive of games, and games under new identities, by hand cases."""

import itertools
import random
import time

import pytest

from tessera.operators import archive
from tessera.plans.tables import stored

ROW = "source string, verified_at string, seq long, date string, team string, opponent string, us int, them int, time string, zone string, status string, away boolean, neutral boolean, venue string, exhibition boolean"
GAME = ", ".join(f"{k} {v}" for k, v in archive.GAME.items())
count = itertools.count()


def row(team="ann", opponent="bob", us=None, them=None, **more):
    base = dict(source=team, verified_at="d1", seq=next(count), date="2024-09-01", team=team, opponent=opponent, us=us, them=them, time=None, zone=None, status="final" if us is not None else "scheduled", away=False, neutral=None, venue=None, exhibition=False)
    return tuple((base | more).values())


@pytest.fixture
def run(spark):
    def merged(*rounds, settled=None):
        """The archive after rounds of rows, and the counts of the last round."""
        games, counts = spark.createDataFrame([], GAME), None
        for rows in rounds:
            rows = spark.createDataFrame(rows, ROW).repartition(2)
            out = stored(archive.merge_into_archive(games, archive.candidates(rows, "s"), settled), "test")
            counts = {n: sum(r[n] for r in out.select(n).collect()) for n in archive.COUNTS}
            games = out.select(*archive.GAME)
        return sorted(games.collect(), key=lambda r: (r.date, r.a, r.b, r.slot)), {k: v for k, v in counts.items() if v}

    return merged


def test_both_pages_are_one_game(run):
    (g,), counts = run([row(us=9, them=7), row("bob", "ann", 7, 9, away=True, venue="hall")])
    assert (g.a, g.b, g.score_a, g.score_b, g.home, g.venue, [s.id for s in g.sources], g.status) == ("ann", "bob", 9, 7, "ann", "hall", ["ann", "bob"], "final")
    assert counts == {"added": 1, "unchanged": 1}


def test_a_schedule_becomes_a_result_and_is_corrected(run):
    (g,), counts = run([row(time="18:00", zone="east")], [row(us=9, them=7, time="19:00")], [row(us=9, them=8)])
    assert (g.score_a, g.score_b, g.time, g.zone, g.status, g.conflict, g.first_seen) == (9, 8, "19:00", None, "final", None, "d1")
    assert counts == {"corrected": 1}
    (g,), counts = run([row(us=9, them=7)], [row(status="postponed")])
    assert (g.status, g.score_a) == ("final", 9) and counts == {"unchanged": 1}


def test_what_vanishes_stays(run):
    games, _ = run([row(us=9, them=7), row(opponent="cyd")], [row(opponent="dan")])
    assert [(g.b, g.score_a) for g in games] == [("bob", 9), ("cyd", None), ("dan", None)]


def test_conflicts(run, spark):
    ours, theirs = row(us=9, them=7), row("bob", "ann", 8, 9, verified_at="d2")
    (g,), counts = run([ours, theirs])
    assert g.score_a is None and g.conflict.withheld and g.conflict.detected_at == "d2" and counts == {"added": 1, "conflicts": 1}
    assert [(r.id, r.score_a, r.score_b) for r in g.conflict.readings] == [("ann", 9, 7), ("bob", 9, 8)]
    (g,), counts = run([ours], [theirs])
    assert (g.score_a, g.score_b, g.conflict.withheld, g.conflict.showing_b) == (9, 7, False, 7) and counts == {"conflicts": 1}
    (g,), counts = run([ours], [theirs], [row("bob", "ann", 7, 9)])
    assert g.conflict is None and (g.score_a, g.score_b) == (9, 7) and counts == {}
    settled = spark.createDataFrame([("2024-09-01", "ann", "bob", 10, 8, "recap")], "date string, a string, b string, settled_a int, settled_b int, evidence string")
    (g,), counts = run([ours], [theirs], settled=settled)
    assert (g.score_a, g.score_b, g.conflict.evidence, g.conflict.showing_a) == (10, 8, "recap", None) and counts == {"conflicts": 1, "resolved": 1}


def test_two_games_on_a_day(run):
    """A pair that meets twice has two slots; the times tell which is which, also where a page lists one of them only."""
    first, second = row(us=9, them=7, time="10:00"), row(us=5, them=6, time="16:00")
    games, _ = run([second, first], [row("bob", "ann", 6, 5, time="16:00")])
    assert [(g.slot, g.time, g.score_a, len(g.sources)) for g in games] == [(0, "10:00", 9, 1), (1, "16:00", 5, 2)]
    assert len({g.id for g in games}) == 2


def test_the_only_game_is_met_without_a_time_but_not_at_another_time_and_slot(run):
    games, _ = run([row(time="10:00")], [row("bob", "ann")])
    assert len(games) == 1 and games[0].time == "10:00" and len(games[0].sources) == 2
    # bob's second game of the day is another one: its id has another slot, and the times contradict
    games, _ = run([row(time="10:00")], [row("bob", "ann", time="09:00", us=1, them=2), row("bob", "ann", time="12:00", us=3, them=4)])
    assert [(g.slot, g.time) for g in games] == [(0, "09:00"), (1, "12:00")]


def test_rows_that_name_no_game(run):
    games, _ = run([row(), row(opponent="ann"), row(opponent=None), row(date=None), row("zed", "yan", us=None, them=3, status="final")])
    assert [(g.a, g.b, g.score_a) for g in games] == [("ann", "bob", None), ("yan", "zed", None)]


def test_hosts(run):
    hosts = {}
    for away, neutral in itertools.product((True, False), (True, False, None)):
        (g,), _ = run([row(away=away, neutral=neutral)])
        hosts[away, neutral] = g.home
    assert hosts == {(True, True): None, (True, False): "bob", (True, None): "bob", (False, True): None, (False, False): "ann", (False, None): None}


def repaired(spark, games, merges):
    games = spark.createDataFrame(games, GAME)
    out, lost = archive.repair_identities(games, spark.createDataFrame(merges, "slug string, winner string"), "s", stored)
    return sorted(out.collect(), key=lambda r: (r.date, r.a, r.b, r.slot)), lost.collect()


def test_one_event_under_two_names(run, spark):
    """Ann's page calls the team bob, the team itself bobby; the readings follow their teams, also where the pair's order turns."""
    games, _ = run([row("ann", "bob", 9, 7, time="10:00"), row("zoe", "ann", 7, 9, venue="hall"), row(opponent="cyd", us=1, them=2, date="2024-09-03")])
    assert len(games) == 3
    out, lost = repaired(spark, games, [("zoe", "abe"), ("bob", "abe")])
    assert lost == [] and [(g.a, g.b, g.score_a, g.score_b, g.slot) for g in out] == [("abe", "ann", 7, 9, 0), ("ann", "cyd", 1, 2, 0)]
    g = out[0]
    assert (g.time, g.venue) == ("10:00", "hall") and [(s.id, s.score_a, s.score_b) for s in g.sources] == [("abe", 7, 9), ("ann", 7, 9)]
    assert out[1].id == next(x.id for x in games if x.b == "cyd")
    again, _ = repaired(spark, out, [("zoe", "abe"), ("bob", "abe")])
    assert again == out


def test_a_doubleheader_stays_two_games(run, spark):
    games, _ = run([row("ann", "bob", 9, 7, time="10:00"), row("ann", "bob", 5, 6, time="16:00"), row("bob", "ann", 7, 9, time="10:00"), row("bob", "ann", 6, 5, time="16:00")])
    out, _ = repaired(spark, games, [("bob", "bobby")])
    assert [(g.b, g.slot, g.time, g.score_a) for g in out] == [("bobby", 0, "10:00", 9), ("bobby", 1, "16:00", 5)]


def test_a_team_that_plays_itself_leaves(run, spark):
    games, _ = run([row("ann", "bob", 9, 7), row("ann", "cyd")])
    out, lost = repaired(spark, games, [("bob", "ben"), ("ben", "ann")])
    assert [g.b for g in out] == ["cyd"] and [(x.team, x.was_a, x.was_b, x.publishers) for x in lost] == [("ann", "ann", "bob", ["ann"])]


def test_empty(run, spark):
    games, counts = run([])
    assert games == [] and counts == {}
    assert repaired(spark, [], [("a", "b")]) == ([], [])


def dealt_by_scan(times, ids, told, sources, new_times, new_ids):
    """The rule itself: every candidate looks at every game."""
    times, ids, told, taken = list(times), list(ids), set(told), [[] for _ in times]
    for n, (s, t, i) in enumerate(zip(sources, new_times, new_ids)):
        at = next((k for k, x in enumerate(times) if t is not None and x == t), next((k for k, x in enumerate(ids) if x == i), None))
        if at is None:
            at = 0 if len(times) == 1 and s not in told and (times[0] is None or t is None) else len(times)
        if at == len(times):
            times.append(t), ids.append(i), taken.append([])
        taken[at].append(n)
        times[at] = times[at] if t is None else t
        told |= {s} if at == 0 else set()
    return taken


def events_by_scan(times, publishers):
    events = []
    for n, (t, p) in enumerate(zip(times, publishers)):
        e = next((e for e in events if not e[1] & set(p) and (None in (e[0], t) or e[0] == t or len(times) == 2)), None)
        if e is None:
            events.append([t, set(p), [n]])
        else:
            e[0], e[1] = e[0] if e[0] is not None else t, e[1] | set(p)
            e[2].append(n)
    return [e[2] for e in events]


def test_look_ups_deal_as_a_scan_does():
    rng = random.Random(3)
    for k in range(400):
        pick = lambda xs, n: [rng.choice(xs) for _ in range(n)]  # noqa: E731, B023
        held, n = rng.randint(0, 4), rng.randint(0, 1 + k % 14)
        clock = [None, "1", "2", "3"][: rng.randint(1, 4)]
        bucket = (pick(clock, held), [f"g{i}" for i in range(held)], pick("abc", rng.randint(0, 2)), pick("abc", n), pick(clock, n), [f"g{rng.randint(0, 5)}" for _ in range(n)])
        assert archive._deal(*bucket) == dealt_by_scan(*bucket)
        publishers = [rng.sample("abcd", rng.randint(0, 2)) for _ in range(n)]
        assert archive._one_event(bucket[4], publishers) == events_by_scan(bucket[4], publishers)


def test_a_bucket_of_very_many_readings():
    """Each reading looks at few games however many there are: 200,000 games in one bucket are a matter of a second."""
    n = 200_000
    ids, names = [f"g{i}" for i in range(n)], [*"ab"] * (n // 2)
    begin = time.perf_counter()
    assert len(archive._deal([], [], [], ["a"] * n, [None] * n, ids)) == n
    assert len(archive._one_event([None] * n, [[x] for x in names])) == n / 2
    assert time.perf_counter() - begin < 20
