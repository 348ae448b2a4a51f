"""What a scheduled run has to do: decisions over the log of earlier runs, as expressions on rows and joins on slots. Clocks are
timestamp_ntz columns in UTC; days, hours and weekdays are those of a time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TZ = "America/New_York"


def local(instant: Column, tz: str = TZ) -> Column:
    """The wall clock of an instant."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), instant)


def weekday_before(day: Column) -> Column:
    """The last day before it that is no Saturday or Sunday."""
    return F.date_sub(day, F.when(F.dayofweek(day) == 2, 3).when(F.dayofweek(day) == 1, 2).otherwise(1))


def edition_action(now: Column, date: Column, prepared: Column, tz: str = TZ, hours: tuple[int, int] = (4, 9), least_minutes: int = 150) -> Column:
    """build where there is no edition of the local day, refresh where it is at least so many minutes old within the hours, else skip."""
    clock = local(now, tz)
    age = F.floor(F.timestamp_diff("MICROSECOND", prepared, now) / 60e6 + 0.5)
    fits = F.hour(clock).between(hours[0], hours[1] - 1) & (age >= least_minutes)
    return F.when(date.isNull() | (date != F.to_date(clock)), "build").when(F.coalesce(fits, F.lit(False)), "refresh").otherwise("skip")


def pick_action(now: Column, feed: dict[str, Column], card: dict[str, Column], tz: str = TZ) -> Column:
    """pick, patch or skip. feed is the last publication (decided_for, outcome, kind, ticker, session: nulls where unknown; decided_for is null where there
    is none), card what the edition shows (date, kind, ticker; date is null without an edition).

    Nothing is done on weekends. A run of today that came to no decision is done again; a pick of today that today's card does not show is patched in; a
    decision of another day is made unless no session closed since the last one. An outcome that is not told is that of the kind."""
    today = F.to_date(local(now, tz))
    outcome = F.coalesce(feed["outcome"], F.when(feed["kind"] == "pick", "pick").otherwise("incomplete"))
    hidden = (card["date"] == today) & (feed["kind"] == "pick") & ~(F.coalesce(card["kind"] == "pick", F.lit(False)) & card["ticker"].eqNullSafe(feed["ticker"]))
    of_today = F.when(outcome == "incomplete", "pick").when(F.coalesce(hidden, F.lit(False)), "patch").otherwise("skip")
    other = F.when(feed["session"] == weekday_before(today), "skip").otherwise("pick")
    return F.when(F.dayofweek(today).isin(1, 7), "skip").when(feed["decided_for"] == today, of_today).otherwise(other)


def weekly_slot(now: Column, first: tuple[int, str], backup: tuple[int, str], tz: str = TZ) -> Column:
    """slot and key (the first day's date) of an instant: primary on the first weekday (1: Sunday) from its hour on and on the day after before the backup's,
    which is a late start; backup from then on. Null at other times."""
    clock = local(now, tz)
    day, time, date = F.dayofweek(clock), F.date_format(clock, "HH:mm"), F.to_date(clock)
    one = lambda name, key: F.struct(F.lit(name).alias("slot"), key.alias("key"))
    before = F.date_sub(date, 1)
    return F.when((day == first[0]) & (time >= first[1]), one("primary", date)).when((day == backup[0]) & (time < backup[1]), one("primary", before)).when(day == backup[0], one("backup", before))


def weekly_due(ticks: DataFrame, now: str, saved: DataFrame, start: str, end: str, first: tuple[int, str] = (4, "18:00"), backup: tuple[int, str] = (5, "06:00"), tz: str = TZ) -> DataFrame:
    """ticks with slot, key and action: run in a slot of the season (local days, both ends included) that no run saved before, else skip. saved (key, at):
    runs that saved something new; a run that saved nothing claims nothing. A key is a day, so the log of saved runs is one row a week."""
    at = weekly_slot(F.col(now), first, backup, tz)
    inside = F.to_date(local(F.col(now), tz)).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    x = ticks.withColumn("_slot", F.when(inside, at)).withColumns({"slot": F.col("_slot.slot"), "key": F.col("_slot.key")}).drop("_slot")
    done = saved.groupBy("key").agg(F.min("at").alias("_done"))
    return x.join(done, "key", "left").withColumn("action", F.when(F.col("slot").isNotNull() & (F.col("_done").isNull() | (F.col("_done") > F.col(now))), "run").otherwise("skip")).drop("_done")


def _swapped(order: Column, i: Column, j: Column) -> Column:
    return F.transform(order, lambda v, at: F.when(at == i, F.get(order, j)).when(at == j, F.get(order, i)).otherwise(v))


def seeded_order(seed: Column, n: Column) -> Column:
    """The numbers 0 to n - 1 shuffled from the last place down, by a congruential generator in doubles: a seed's product beyond 2^53 is rounded before its
    lower 31 bits are taken, as in languages whose numbers are all doubles. The same seed gives the same order."""

    def step(state, k):
        following = (state["seed"].cast("double") * F.lit(1103515245.0) + F.lit(12345.0)).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))
        drawn = F.struct(following.alias("seed"), state["order"].alias("order"))
        at = F.least(k, F.floor(following / F.lit(float(0x7FFFFFFF)) * (k + 1)).cast("int"))
        return F.struct(drawn["seed"].alias("seed"), _swapped(state["order"], k, at).alias("order"))

    last = n.cast("int") - 1
    start = F.struct(seed.cast("long").alias("seed"), F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")).alias("order"))
    places = F.when(last >= 1, F.sequence(last, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, lambda s: s["order"])


def shuffled(choices: Column, answer: Column, seed: Column) -> Column:
    """choices in their seeded order and the new place of the answer (null where it is none of them)."""
    order = seeded_order(seed, F.size(choices))
    both = F.struct(F.transform(order, lambda i: F.get(choices, i)).alias("choices"), (F.array_position(order, answer.cast("int")) - 1).cast("int").alias("answer"))
    return F.when(choices.isNotNull(), F.struct(both["choices"].alias("choices"), F.when(both["answer"] >= 0, both["answer"]).alias("answer")))
