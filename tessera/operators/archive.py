"""An archive of games: readings of several sources are matched to the games they are views of and folded in, and stored
games move to new team identities.

A game is a row of GAME. Everything about it lies in one bucket, the pair of teams on a date, so a bucket's readings are one array
that is taken in order. Buckets are independent. Which game a reading belongs to follows from times, ids and sources alone: one
pass over these with look-up tables says which readings each game takes, then each game is folded on its own by an expression on
the JVM, so that the work grows with the readings however many of them a bucket holds.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .fixtures import STATUS, canonical

_READING = "struct<id:string,verified_at:string,score_a:int,score_b:int>"
_CONFLICT = "struct<detected_at:string,withheld:boolean,showing_a:int,showing_b:int,evidence:string,readings:array<struct<id:string,score_a:int,score_b:int>>>"
#: team a sorts before team b; a score belongs to its team; sources hold the last reading of each source.
GAME = {
    "id": "string", "date": "string", "a": "string", "b": "string", "slot": "int", "time": "string", "zone": "string", "status": "string", "score_a": "int", "score_b": "int",
    "home": "string", "neutral": "boolean", "venue": "string", "exhibition": "boolean", "first_seen": "string", "sources": f"array<{_READING}>", "conflict": _CONFLICT,
}
#: What a source prints: source and verified_at in place of sources, seq the order of reading over all sources.
CANDIDATE = {k: v for k, v in GAME.items() if k not in ("first_seen", "sources", "conflict")} | {"source": "string", "verified_at": "string", "seq": "long"}
_HELD = f"struct<{','.join(f'{k}:{v}' for k, v in GAME.items())},from_archive:boolean>"
COUNTS = ("added", "corrected", "unchanged", "conflicts", "resolved")


def game_id(season: Column, a: Column, b: Column, date: Column, slot: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", season, a, b, date, slot.cast("string")).cast("binary")), 1, 12)


def candidates(rows: DataFrame, season: str) -> DataFrame:
    """Rows of sources as candidates: the pair in order, each score at its team, the host where it is known, the slot among the
    source's rows of the pair and date (by time, unknown ones last, then seq, verified_at and scores) and the id that follows.

    rows: source, verified_at, seq, date, team, opponent, us, them, time, zone, status, away, neutral, venue, exhibition. Scores count
    for final games with both; at a neutral site nobody hosts; 'at' is the opponent's, 'vs' the team's own only if the site is known not to
    be neutral. Rows that lack a team or the date, or name one team twice, are left out.
    """
    first = F.col("team") < F.col("opponent")
    final = (F.coalesce("status", F.lit("final")) == "final") & F.col("us").isNotNull() & F.col("them").isNotNull()
    home = F.when(F.coalesce("neutral", F.lit(False)), None).when(F.col("away"), F.col("opponent")).when(~F.coalesce("neutral", F.lit(True)), F.col("team"))
    out = rows.where("date is not null and team <> opponent").select(
        "source", "verified_at", "seq", "date", F.least("team", "opponent").alias("a"), F.greatest("team", "opponent").alias("b"), "time", "zone",
        F.coalesce("status", F.lit("final")).alias("status"), F.when(final, F.when(first, F.col("us")).otherwise(F.col("them"))).alias("score_a"),
        F.when(final, F.when(first, F.col("them")).otherwise(F.col("us"))).alias("score_b"), home.alias("home"), "neutral", "venue", F.coalesce("exhibition", F.lit(False)).alias("exhibition"),
    )
    slot = F.row_number().over(W.partitionBy("source", "date", "a", "b").orderBy(F.col("time").asc_nulls_last(), "seq", *[F.col(c).asc_nulls_last() for c in ("verified_at", "score_a", "score_b")])) - 1
    out = out.withColumn("slot", slot).withColumn("id", game_id(F.lit(season), F.col("a"), F.col("b"), F.col("date"), F.col("slot")))
    return out.select(*[F.col(k).cast(v).alias(k) for k, v in CANDIDATE.items()])


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _rank(status: Column) -> Column:
    out = F.lit(0)
    for name, rank in STATUS.items():
        out = F.when(status == name, rank).otherwise(out)
    return out


def _deal(times: list, ids: list, told: list, sources: list, new_times: list, new_ids: list) -> list[list[int]]:
    """For each game of a bucket, the stored ones (times, ids, told: the sources of the first one) and then the new ones, the places of
    the candidates (sources, new_times, new_ids) that are views of it.

    A candidate belongs to the game at the same time; else to that of the same id; else to the only one, if this source has not told of
    it and the times do not contradict one another; else it is another game. A game takes the time of its last candidate that has one.
    """
    times, told, taken = list(times), set(told), [[] for _ in times]
    at_time: dict[str, list[int]] = {}
    of_id: dict[str, int] = {}
    for i, (time, id_) in enumerate(zip(times, ids, strict=True)):
        at_time.setdefault(time, []).append(i)
        of_id.setdefault(id_, i)
    for n, (source, time, id_) in enumerate(zip(sources, new_times, new_ids, strict=True)):
        if time is not None and at_time.get(time):
            at = at_time[time][0]
        elif id_ is not None and id_ in of_id:
            at = of_id[id_]
        elif len(times) == 1 and (times[0] is None or time is None) and not (told and (source is None or told & {source, None})):
            at = 0
        else:
            at = len(times)
            times.append(time)
            taken.append([])
            at_time.setdefault(time, []).append(at)
            of_id.setdefault(id_, at)
        taken[at].append(n)
        if at == 0:
            told.add(source)
        if time is not None and times[at] != time:
            at_time[times[at]].remove(at)
            insort(at_time.setdefault(time, []), at)
            times[at] = time
    return taken


def _one_event(times: list, publishers: list[list]) -> list[list[int]]:
    """The places of the games of a bucket that are one event: each goes to the first event whose publishers are all others and whose
    time does not differ, or of any time where the bucket has two games. Events of the same publishers and time are looked up as one."""
    events: list[list[int]] = []
    alike: dict[tuple, list[int]] = {}
    apart = lambda a, b: not (a and b and (None in a | b or a & b))
    for n, (time, names) in enumerate(zip(times, map(frozenset, publishers), strict=True)):
        fits = [(at[0], key) for key, at in alike.items() if apart(key[1], names) and (len(times) == 2 or None in (key[0], time) or key[0] == time)]
        if fits:
            at, (event_time, event_names) = min(fits, key=lambda x: x[0])
            events[at].append(n)
            alike[event_time, event_names].pop(0)
            if not alike[event_time, event_names]:
                del alike[event_time, event_names]
            key = (event_time if event_time is not None else time, event_names | names)
        else:
            at, key = len(events), (time, names)
            events.append([n])
        insort(alike.setdefault(key, []), at)
    return events


def _by_bucket(pick: Callable[..., list[list[int]]]) -> Callable[..., Column]:
    """pick over the arrays of one bucket as a column function."""

    def each(*columns: pa.Array) -> pa.Array:
        return pa.array([pick(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)], pa.list_(pa.list_(pa.int32())))

    return F.arrow_udf(each, "array<array<int>>")


def _folded(game: Column, c: Column) -> Column:
    """(game, counted): a game with a candidate's reading. What is known is never overwritten by nothing; a status only rises; a
    source that alone reported a score may correct it; scores of several sources that differ are a conflict, which a settled result
    decides, and which hides the score of a game that was not published before."""
    reading = F.struct(c["source"].alias("id"), c["verified_at"].alias("verified_at"), c["score_a"].alias("score_a"), c["score_b"].alias("score_b")).cast(_READING)
    is_mine = lambda s: s["id"] == c["source"]
    sources = F.when(F.exists(game["sources"], is_mine), F.transform(game["sources"], lambda s: F.when(is_mine(s), reading).otherwise(s))).otherwise(F.concat(game["sources"], F.array(reading)))

    def with_sources(sources: Column) -> Column:
        neutral = F.coalesce(c["neutral"], game["neutral"])
        same = (game["score_a"] == c["score_a"]) & (game["score_b"] == c["score_b"])
        agree = F.forall(sources, lambda s: F.coalesce((s["score_a"] == game["score_a"]) & (s["score_b"] == game["score_b"]), F.lit(False)))
        settled = c["settled_a"].isNotNull() & c["settled_b"].isNotNull()
        case = (
            F.when(c["score_a"].isNull() | c["score_b"].isNull(), "unchanged").when(game["score_a"].isNull() | game["score_b"].isNull(), "scored")
            .when(same & game["conflict"].isNotNull() & agree, "agreed").when(same, "unchanged").when(F.size(sources) == 1, "corrected").when(settled, "resolved").otherwise("conflicts")
        )

        def decided(case: Column) -> Column:
            disputed, published = case.isin("conflicts", "resolved"), F.coalesce(game["from_archive"], F.lit(False))

            def score(s: str) -> Column:
                kept = F.when(published, game[f"score_{s}"])
                return F.when(case.isin("scored", "corrected"), c[f"score_{s}"]).when(case == "resolved", c[f"settled_{s}"]).when(case == "conflicts", kept).otherwise(game[f"score_{s}"])

            shown = lambda s: F.when((case == "conflicts") & published, game[f"score_{s}"])
            conflict = F.struct(
                c["verified_at"].alias("detected_at"), ((case == "conflicts") & ~published).alias("withheld"), shown("a").alias("showing_a"), shown("b").alias("showing_b"),
                F.when(case == "resolved", c["evidence"]).alias("evidence"), F.transform(sources, lambda s: F.struct(s["id"], s["score_a"], s["score_b"])).alias("readings"),
            ).cast(_CONFLICT)
            values = {k: game[k] for k in GAME} | {
                "time": F.coalesce(c["time"], game["time"]), "zone": F.when(c["time"].isNotNull(), c["zone"]).otherwise(F.coalesce(c["zone"], game["zone"])),
                "status": F.when(_rank(c["status"]) > _rank(game["status"]), c["status"]).otherwise(game["status"]), "neutral": neutral, "venue": F.coalesce(c["venue"], game["venue"]),
                "home": F.when(~F.coalesce(neutral, F.lit(False)), F.coalesce(c["home"], game["home"])), "exhibition": game["exhibition"] | c["exhibition"], "sources": sources,
                "score_a": score("a"), "score_b": score("b"), "conflict": F.when(disputed, conflict).when(case != "agreed", game["conflict"]),
            }
            return F.struct(F.struct(*[values[k].cast(v).alias(k) for k, v in GAME.items()], game["from_archive"].alias("from_archive")).cast(_HELD).alias("game"), case.alias("case"))

        return _let(case, decided)

    return _let(sources, with_sources)


def _empty(c: Column) -> Column:
    nothing = {k: F.lit(None) for k in GAME}
    known = nothing | {k: c[k] for k in ("id", "date", "a", "b", "slot", "time")} | {"status": F.lit("scheduled"), "exhibition": F.lit(False), "first_seen": c["verified_at"], "sources": F.array()}
    return F.struct(*[known[k].cast(v).alias(k) for k, v in GAME.items()], F.lit(False).alias("from_archive")).cast(_HELD)


def merge_into_archive(archive: DataFrame, found: DataFrame, settled: DataFrame | None = None) -> DataFrame:
    """The games of the archive and the candidates found, each game once, in the columns of GAME, and for each game the numbers of COUNTS.

    Candidates are taken in the order of seq (ties: source, slot), a bucket's archive games in the order of slot and id; a game that no source tells of any more stays.
    settled (date, a, b, settled_a, settled_b, evidence; one row a bucket) decides conflicts.
    """
    if settled is None:
        settled = archive.sparkSession.createDataFrame([], "date string, a string, b string, settled_a int, settled_b int, evidence string")
    key = ["date", "a", "b"]
    held = archive.select(*key, F.struct(*[F.col(k).cast(v).alias(k) for k, v in GAME.items()], F.lit(True).alias("from_archive")).cast(_HELD).alias("g"), "slot", "id")
    told = found.join(settled.select(*key, F.col("settled_a").cast("int").alias("settled_a"), F.col("settled_b").cast("int").alias("settled_b"), "evidence"), key, "left")
    told = told.select(*key, F.struct("seq", "source", "slot", *[k for k in (*CANDIDATE, "settled_a", "settled_b", "evidence") if k not in ("seq", "source", "slot")]).alias("c"))
    # one shuffle of both sides by bucket
    both = held.select(*key, F.struct("slot", "id", "g").alias("g")).unionByName(told, allowMissingColumns=True)
    lists = both.groupBy(*key).agg(F.sort_array(F.collect_list("g")).alias("gs"), F.sort_array(F.collect_list("c")).alias("cs"))

    of = lambda c, k: F.transform(c, lambda x: x[k])
    told_first = F.coalesce(F.transform(F.get("gs", F.lit(0))["g"]["sources"], lambda s: s["id"]), F.array())
    lists = lists.withColumn("taken", _by_bucket(_deal)(F.transform("gs", lambda x: x["g"]["time"]), of("gs", "id"), told_first, of("cs", "source"), of("cs", "time"), of("cs", "id")))

    def begin(mine: Column, i: Column) -> Column:
        stored = F.get("gs", i)["g"]
        game = F.when(stored.isNotNull(), stored).otherwise(_let(F.get("cs", mine[0]), _empty))
        return F.struct(game.alias("game"), *[(stored.isNull().cast("int") if n == "added" else F.lit(0)).alias(n) for n in COUNTS])

    def step(state: Column, j: Column) -> Column:
        def put(x: Column) -> Column:
            # a resolved conflict is a conflict, too
            hit = {"added": F.lit(False), "conflicts": x["case"].isin("conflicts", "resolved")}
            return F.struct(x["game"].alias("game"), *[(state[n] + hit.get(n, x["case"] == n).cast("int")).alias(n) for n in COUNTS])

        return _let(F.get("cs", j), lambda c: _let(_folded(state["game"], c), put))

    done = lists.select(F.explode(F.transform("taken", lambda mine, i: F.aggregate(mine, begin(mine, i), step))).alias("s"))
    return done.select("s.game.*", *[F.col(f"s.{n}").alias(n) for n in COUNTS]).drop("from_archive")


def _renamed(games: DataFrame, merges: DataFrame, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """games under the ends of merges (slug, winner): was_a and was_b hold the old pair, publishers the old ids of sources."""
    names = games.select(F.explode(F.array_distinct(F.concat(F.array("a", "b", "home"), F.transform("sources", lambda s: s["id"])))).alias("slug")).where("slug is not null").distinct()
    moved = write(canonical(names.withColumn("was", F.col("slug")), merges, "slug").where("was <> slug").select("was", F.col("slug").alias("now")), "moves")

    def to(df: DataFrame, column: str, into: str) -> DataFrame:
        return df.join(moved.select(F.col("was").alias(column), F.col("now").alias("_n")), column, "left").withColumn(into, F.coalesce("_n", column)).drop("_n")

    out = games.withColumns({"was_a": F.col("a"), "was_b": F.col("b"), "publishers": F.transform("sources", lambda s: s["id"])})
    for c in ("a", "b", "home"):
        out = to(out, c, c)
    swap = F.col("a") > F.col("b")
    flip = lambda s: F.struct(s["id"].alias("id"), s["verified_at"].alias("verified_at"), s["score_b"].alias("score_a"), s["score_a"].alias("score_b"))
    both = lambda x, y: (F.when(swap, F.col(y)).otherwise(F.col(x)), F.when(swap, F.col(x)).otherwise(F.col(y)))
    (a, b), (sa, sb) = both("a", "b"), both("score_a", "score_b")
    f = F.col("conflict")
    turned = F.struct(f["detected_at"].alias("detected_at"), f["withheld"].alias("withheld"), f["showing_b"].alias("showing_a"), f["showing_a"].alias("showing_b"), f["evidence"].alias("evidence"),
                      F.transform(f["readings"], lambda r: F.struct(r["id"].alias("id"), r["score_b"].alias("score_a"), r["score_a"].alias("score_b"))).alias("readings"))
    return out.withColumns({
        "a": a, "b": b, "score_a": sa, "score_b": sb, "sources": F.when(swap, F.transform("sources", flip)).otherwise(F.col("sources")),
        "conflict": F.when(swap & f.isNotNull(), turned).otherwise(f),
    }).withColumn("changed", (F.col("a") != F.least("was_a", "was_b")) | (F.col("b") != F.greatest("was_a", "was_b")))


#: Filled from the absorbed game where the first one has nothing.
_FILLED = ("time", "zone", "venue", "neutral", "home")


def _absorbed(into: Column, other: Column) -> Column:
    mine = F.transform(into["g"]["sources"], lambda s: s["id"])
    sources = F.concat(into["g"]["sources"], F.filter(other["g"]["sources"], lambda s: ~F.array_contains(mine, s["id"])))
    g, o = into["g"], other["g"]
    unscored = g["score_a"].isNull() | g["score_b"].isNull()
    values = {k: g[k] for k in GAME} | {k: F.coalesce(g[k], o[k]) for k in _FILLED} | {
        "sources": sources, "exhibition": g["exhibition"] | o["exhibition"], "first_seen": F.least(g["first_seen"], o["first_seen"]),
        "status": F.when(_rank(o["status"]) > _rank(g["status"]), o["status"]).otherwise(g["status"]),
        **{f"score_{s}": F.when(unscored, o[f"score_{s}"]).otherwise(g[f"score_{s}"]) for s in "ab"},
    }
    return F.struct(F.struct(*[values[k].cast(v).alias(k) for k, v in GAME.items()]).alias("g"), F.array_union(into["publishers"], other["publishers"]).alias("publishers"))


def repair_identities(games: DataFrame, merges: DataFrame, season: str, write: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(games, self_matches) after teams merged: merges (slug, winner; one row a slug, chains of up to 8 links).

    Teams, hosts, scores and readings follow. A game of a team with itself leaves, with its date, team, old pair and sources. In
    buckets that the renaming touched, games whose publishers do not overlap are one event (if their times differ, only where there are
    two games in all); the first in the order of slot and id absorbs the others, and what is left gets slots by time (unknown last) and new ids. Other games keep
    their ids. Each source stays once, with its latest reading, in the order of ids. Run again, it changes nothing.
    """
    renamed = write(_renamed(games, merges, write), "renamed")
    itself = F.col("a") == F.col("b")
    lost = renamed.where(itself).select("id", "date", F.col("a").alias("team"), "was_a", "was_b", "publishers")
    kept = renamed.where(~itself)
    key = ["date", "a", "b"]
    touched = kept.where("changed").select(*key).distinct()
    still = kept.join(touched, key, "left_anti").select(*GAME)

    # fields whose order has no meaning come after slot and id, so that the array is in their order
    of_bucket = kept.join(touched, key, "left_semi").select(*key, F.struct("slot", "id", F.struct(*GAME).alias("g"), "publishers").alias("x")).groupBy(*key).agg(F.sort_array(F.collect_list("x")).alias("xs"))
    both = "struct<g:struct<{}>,publishers:array<string>>".format(",".join(f"{k}:{v}" for k, v in GAME.items()))
    plain = F.transform("xs", lambda x: F.struct(x["g"].alias("g"), x["publishers"].alias("publishers"))).cast(f"array<{both}>")

    of_bucket = of_bucket.select(plain.alias("xs")).withColumn("events", _by_bucket(_one_event)(F.transform("xs", lambda x: x["g"]["time"]), F.transform("xs", lambda x: x["publishers"])))
    absorb = lambda into, j: _let(F.get("xs", j), lambda x: _absorbed(into, x).cast(both))
    whole = F.transform("events", lambda e: F.aggregate(F.slice(e, F.lit(2), F.size(e)), F.get("xs", e[0]), absorb))
    folded = of_bucket.select(F.explode(whole).alias("x")).select("x.g.*")
    order = W.partitionBy(*key).orderBy(F.col("time").asc_nulls_last(), F.col("id").asc_nulls_first())
    folded = folded.withColumn("slot", F.row_number().over(order) - 1).withColumn("id", game_id(F.lit(season), F.col("a"), F.col("b"), F.col("date"), F.col("slot")))
    out = write(still.unionByName(folded), "repaired")

    # each source under its new id, the latest reading of each
    each = out.select("id", F.posexplode("sources").alias("n", "s")).select("id", "n", "s.*", F.col("s.id").alias("slug"))
    moves = canonical(each.select("slug").distinct().withColumn("was", F.col("slug")), merges, "slug").select(F.col("was").alias("slug"), F.col("slug").alias("now"))
    latest = F.max(F.struct(F.coalesce("verified_at", F.lit("")).alias("at"), "n", F.struct(F.col("now").alias("id"), "verified_at", "score_a", "score_b").cast(_READING).alias("s")))["s"]
    game = each.toDF("game", "n", "source", "verified_at", "score_a", "score_b", "slug").join(moves, "slug")
    sources = game.groupBy("game", "now").agg(latest.alias("s")).groupBy("game").agg(F.sort_array(F.collect_list("s")).alias("_sources"))
    fixed = out.join(sources, out["id"] == sources["game"], "left").withColumn("sources", F.coalesce("_sources", F.array().cast(f"array<{_READING}>")))
    return fixed.select(*GAME), lost
