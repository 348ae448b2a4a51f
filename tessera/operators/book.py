"""Choosing one position a session while earlier choices are still held.

A day's candidates depend on the book: a stock that is held, a division that has its share, or a full book keep candidates out,
and that comes before the day's own statistics (volatility cut, peer percentiles, z-scores of cohorts). So the choice of a session
needs all choices before it. The walk does not visit sessions one by one over the data. Each round computes the statistics of all
open sessions at once under assumed books, keeps a short list a session and division, and folds these lists in the order of sessions
with the true book. Sessions whose assumed book was the true one are settled, at least one a round, since the first open session
follows settled ones only. The result is that of a sequential walk; what a round leaves on the driver is the short lists,
sessions x divisions x (positions held + runners) rows whatever the number of candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: How candidates of a session are ranked: rows with `test` (null: passed so far) come back with test, score and late. Rows that fail
#: count for nothing in the scores of the others.
Score = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Signal:
    """A column that counts towards the composite, up (1) or down (-1), for all sector groups or for some."""

    name: str
    direction: int = 1
    groups: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Strategy:
    """before and after name the columns with a row's first failed test, before and after those of the book; a position keeps its
    stock out for `hold` sessions, its own included."""

    name: str
    score: Score
    before: str = "fails_before"
    after: str = "fails_after"
    hold: int = 21
    most_open: int | None = 21
    most_per_division: int | None = 3


def signals_for(group: str, signals: Iterable[Signal]) -> list[Signal]:
    """The signals that are defined for a sector group."""
    return [s for s in signals if s.groups is None or group in s.groups]


def capped_by_volatility(rows: DataFrame, column: str = "volatility", share: float = 0.85, least: int = 5) -> DataFrame:
    """rows whose test turns to 'volatility' where the column is above the session's quantile among those that pass, or unknown.

    With fewer than `least` known values nothing changes.
    """
    session = W.partitionBy("session")
    known = F.when(F.col("test").isNull(), F.col(column))
    cut = F.when(F.count(known).over(session) >= least, F.percentile(known, F.lit(share)).over(session))
    high = F.col(column).isNull() | (F.col(column) > F.col("_cut"))
    return rows.withColumn("_cut", cut).withColumn("test", F.when(F.col("test").isNull() & F.col("_cut").isNotNull() & high, "volatility").otherwise(F.col("test"))).drop("_cut")


def with_peer_percentile(rows: DataFrame, measure: Column, narrow: str = "major", wide: str = "grp", least: int = 8, name: str = "peer_percentile") -> DataFrame:
    """rows with the share of peers whose measure is at most as high: those of the narrow group in the session, or of the wide one if
    the narrow one has fewer than `least`. Rows that pass so far are peers; the others and those without a measure get null."""
    rows = rows.withColumns({"_m": F.when(F.col("test").isNull(), measure), "_narrow": F.coalesce(F.col(narrow), F.lit("--"))})

    def share(of: str) -> tuple[Column, Column]:
        peers = W.partitionBy("session", of)
        n = F.count("_m").over(peers)
        return n, F.count("_m").over(peers.orderBy(F.col("_m").asc_nulls_first()).rangeBetween(W.unboundedPreceding, 0)) / n

    n, near = share("_narrow")
    _, far = share(wide)
    rows = rows.withColumns({"_few": n < least, "_near": near, "_far": far})
    return rows.withColumn(name, F.when(F.col("_m").isNotNull(), F.when(F.col("_few"), F.col("_far")).otherwise(F.col("_near")))).drop("_m", "_narrow", "_few", "_near", "_far")


def composite_of(rows: DataFrame, signals: Sequence[Signal], least_peers: int = 8, least_values: int = 3, p: float = 0.02, least_clipped: int = 5) -> DataFrame:
    """rows with score: the mean of the directed z-scores of a row's signals among the rows that pass in its session and group, or in
    its session where the group has fewer than `least_peers`. Values are clipped to the p and 1 - p quantiles first (from
    `least_clipped` values on); a signal with fewer than `least_values` values in the cohort does not count; null without any.

    All windows are of a session or parts of it, so rows that are dealt by session are not shuffled again.
    """
    passes, session, group, cohort = F.col("test").isNull(), W.partitionBy("session"), W.partitionBy("session", "grp"), W.partitionBy("session", "_grp")
    rows = rows.withColumns({"_grp": F.coalesce("grp", F.lit("")), "_small": passes & (F.count_if(passes).over(group) < least_peers)})
    rows = rows.withColumn("_any", F.max("_small").over(session))
    finite = lambda c: F.when(passes & ~F.isnan(c) & (F.abs(c) < float("inf")), c)
    at = range(len(signals))
    # a row counts among its group, and among all of its session for the groups that are too small
    kinds = {"own": cohort, "all": session}
    values = {f"_own{i}": finite(F.col(s.name).cast("double")) for i, s in enumerate(signals)}
    rows = rows.withColumns(values).withColumns({f"_all{i}": F.when(F.col("_any"), F.col(f"_own{i}")) for i in at})
    for kind, w in kinds.items():
        rows = rows.withColumns({f"_n_{kind}{i}": F.count(f"_{kind}{i}").over(w) for i in at} | {f"_q_{kind}{i}": F.percentile(f"_{kind}{i}", F.array(F.lit(p), F.lit(1 - p))).over(w) for i in at})

    def clipped(kind: str, i: int) -> Column:
        v, q = F.col(f"_{kind}{i}"), F.col(f"_q_{kind}{i}")
        return F.when(v.isNotNull(), F.when(F.col(f"_n_{kind}{i}") < least_clipped, v).otherwise(F.least(q[1], F.greatest(q[0], v))))

    rows = rows.withColumns({f"_{kind}{i}": clipped(kind, i) for kind in kinds for i in at})
    for kind, w in kinds.items():
        rows = rows.withColumns({f"_m_{kind}{i}": F.avg(f"_{kind}{i}").over(w) for i in at} | {f"_d_{kind}{i}": F.stddev_samp(f"_{kind}{i}").over(w) for i in at})

    def z(kind: str, i: int) -> Column:
        v, n, m, d = (F.col(f"_{x}{kind}{i}") for x in ("", "n_", "m_", "d_"))
        return F.when(v.isNotNull() & (n >= least_values), F.when(d > 0, (v - m) / d).otherwise(0.0) * signals[i].direction)

    defined = lambda s: F.lit(True) if s.groups is None else F.coalesce(F.col("grp").isin(*s.groups), F.lit(False))
    rows = rows.withColumns({f"_z{i}": F.when(defined(s), F.when(F.col("_small"), z("all", i)).otherwise(z("own", i))) for i, s in enumerate(signals)})
    used = sum((F.col(f"_z{i}").isNotNull().cast("long") for i in at), F.lit(0).cast("long"))
    total = sum((F.coalesce(f"_z{i}", F.lit(0.0)) for i in at), F.lit(0.0))
    rows = rows.withColumns({"signals_used": F.nullif(used, F.lit(0).cast("long")), "_total": total}).withColumn("score", F.col("_total") / F.col("signals_used"))
    made = [f"_{x}{kind}{i}" for x in ("", "n_", "q_", "m_", "d_") for kind in kinds for i in at]
    return rows.drop("_grp", "_small", "_any", "_total", *[f"_z{i}" for i in at], *made)


def by_composite(signals: Sequence[Signal], measure: str, extension: str = "extension", most_extension: float = 3, **limits) -> Score:
    """Volatility cut, peer percentile of an expression over the rows, composite; rows far above their average come late."""

    def score(rows: DataFrame) -> DataFrame:
        # peers are those that passed the tests, whether or not the volatility cut takes them
        out = with_peer_percentile(rows, F.expr(measure), least=limits.get("least_peers", 8))
        out = composite_of(capped_by_volatility(out), signals, **limits)
        return out.withColumn("late", F.coalesce(F.col(extension) > most_extension, F.lit(False)))

    return score


def by_weighted_z(weights: dict[str, tuple[float, float | None]]) -> Score:
    """Sum of weight x z over the session's rows that pass (population deviation, 1 where it is 0), z up to a most where one is given."""

    def score(rows: DataFrame) -> DataFrame:
        session = W.partitionBy("session")
        total = F.lit(0.0)
        for name, (weight, most) in weights.items():
            v = F.when(F.col("test").isNull(), F.col(name))
            sd = F.coalesce(F.nullif(F.stddev_pop(v).over(session), F.lit(0.0)), F.lit(1.0))
            z = (F.col(name) - F.avg(v).over(session)) / sd
            total = total + weight * (z if most is None else F.least(F.lit(float(most)), z))
        return rows.withColumns({"score": F.when(F.col("test").isNull(), total), "late": F.lit(False)})

    return score


def _tested(spark: SparkSession, rows: DataFrame, strategy: Strategy, books: dict[int, list[tuple[str, str | None]]]) -> DataFrame:
    """rows with test: the first that a row fails. books: the positions open as a session begins."""
    held = spark.createDataFrame([(s, t) for s, book in books.items() for t in {t for t, _ in book}], "session long, ticker string")
    counts = [(s, d, sum(d == e for _, e in book)) for s, book in books.items() for d in {d for _, d in book if d is not None}]
    of_division = spark.createDataFrame(counts, "session long, division string, in_division int")
    open_ = spark.createDataFrame([(s, len(book)) for s, book in books.items()], "session long, n_open int")
    # at most sessions x hold rows, whatever the number of candidates
    out = rows.join(F.broadcast(held.withColumn("is_held", F.lit(True))), ["session", "ticker"], "left")
    out = out.join(F.broadcast(of_division), ["session", "division"], "left").join(F.broadcast(open_), "session", "left")
    tests = [F.col(strategy.before), F.when(F.col("is_held"), "already-held")]
    if strategy.most_open is not None:
        tests.insert(0, F.when(F.col("n_open") >= strategy.most_open, "book-full"))
    if strategy.most_per_division is not None:
        tests.append(F.when(F.col("in_division") >= strategy.most_per_division, "division-cap"))
    return out.withColumn("test", F.coalesce(*tests, F.col(strategy.after))).drop("is_held", "in_division", "n_open")


def _scored(strategy: Strategy, rows: DataFrame) -> DataFrame:
    """Scores to nine digits: sums of doubles differ in the last ones by the order of their terms."""
    return strategy.score(rows).withColumn("score", F.round("score", 9))


def _order(rows: DataFrame) -> list[Column]:
    return [F.col("late"), F.col("score").desc(), F.col("ticker")]


def _fold(short: dict[int, list], sessions: list[int], strategy: Strategy, open_: list[tuple[int, str, str | None]]) -> tuple[dict, dict]:
    """The choice of each session out of its short list, and the book that each session begins with."""
    open_, choices, books = list(open_), {}, {}
    for at in sessions:
        open_ = [x for x in open_ if at - x[0] < strategy.hold]
        books[at] = [(t, d) for _, t, d in open_]
        held, full = {t for _, t, _ in open_}, strategy.most_open is not None and len(open_) >= strategy.most_open
        fits = lambda r: r.ticker not in held and (strategy.most_per_division is None or r.division is None or sum(d == r.division for _, _, d in open_) < strategy.most_per_division)  # noqa: E731, B023
        found = None if full else next((r for r in short.get(at, []) if fits(r)), None)
        if found is not None:
            choices[at] = (found.ticker, found.division)
            open_.append((at, found.ticker, found.division))
    return choices, books


def walk(rows: DataFrame, strategies: Sequence[Strategy], write: Callable[[DataFrame, str], DataFrame], runners: int = 3) -> dict[str, DataFrame]:
    """For each strategy its scored rows under the true books: the columns of rows, test, score, late, place (1: chosen, then runners-up,
    null: not ranked).

    rows: session (index in the calendar), ticker, division, the tests' columns and what scores read, one row a session and ticker;
    sessions follow one another in the order of their index. write(table, name) keeps a table where all executors can read it. A null division is under no cap.
    Ties of score go to the smaller ticker. Sessions without rows choose nothing.
    """
    spark = rows.sparkSession
    rows = write(rows, "walk-rows")
    sessions = sorted(r["session"] for r in rows.select("session").distinct().collect())  # the calendar
    settled: dict[str, dict] = {s.name: {} for s in strategies}
    books: dict[str, dict] = {s.name: {at: [] for at in sessions} for s in strategies}
    first = {s.name: 0 for s in strategies}  # the place of the first session that is not settled
    while going := [s for s in strategies if first[s.name] < len(sessions)]:
        lists = None
        for s in going:
            left = sessions[first[s.name] :]
            tested = _tested(spark, rows.where(F.col("session") >= left[0]), s, {at: books[s.name][at] for at in left})
            # dealt by session once; every window after that is within a session
            ranked = _scored(s, tested.where("test is null").repartition("session")).where("test is null and score is not null")
            near = F.row_number().over(W.partitionBy("session", "division").orderBy(*_order(ranked)))
            part = ranked.withColumn("n", near).where(F.col("n") <= s.hold + runners).select(F.lit(s.name).alias("strategy"), "session", "ticker", "division", "score", "late")
            lists = part if lists is None else lists.unionByName(part)
        short: dict[str, dict[int, list]] = {s.name: {} for s in going}
        for r in sorted(lists.collect(), key=lambda r: (r.late, -r.score, r.ticker)):
            short[r.strategy].setdefault(r.session, []).append(r)
        for s in going:
            left = sessions[first[s.name] :]
            so_far = [(at, *settled[s.name][at]) for at in sessions[: first[s.name]] if at in settled[s.name]]
            choices, true = _fold(short[s.name], left, s, so_far)
            n = next((i for i, at in enumerate(left) if set(true[at]) != set(books[s.name][at])), len(left))
            settled[s.name].update({at: choices[at] for at in left[:n] if at in choices})
            books[s.name].update(true)
            first[s.name] += n
    out = {}
    for s in strategies:
        scored = _scored(s, _tested(spark, rows, s, books[s.name]).repartition("session"))
        passed = F.col("test").isNull() & F.col("score").isNotNull()
        place = F.when(passed, F.row_number().over(W.partitionBy("session", passed).orderBy(*_order(scored))))
        out[s.name] = write(scored.withColumn("place", F.when(place <= runners + 1, place)), f"walk-{s.name.replace(' ', '-')}")
    return out


def decisions(scored: DataFrame) -> DataFrame:
    """One row a session: scanned, eligible, ticker, division, score, rank_score (share of the ranked rows with a score at most as high, in
    percent) and runners_up; where nothing is chosen, reason and binding, the test that took the most rows (ties: its name)."""
    rank = F.floor(100 * F.count("score").over(W.partitionBy("session").orderBy(F.col("score").asc_nulls_first()).rangeBetween(W.unboundedPreceding, 0)) / F.count("score").over(W.partitionBy("session")) + 0.5)
    passed = F.col("test").isNull()
    chosen = scored.where("place is not null").select("session", F.struct("place", "ticker", "division", "score").alias("p"))
    scores = scored.select("session", "ticker", F.when(passed, F.col("score")).alias("score")).where("score is not null").withColumn("rank_score", rank.cast("int"))
    picks = chosen.groupBy("session").agg(F.sort_array(F.collect_list("p")).alias("p"))  # runners + 1 rows
    best = picks.select("session", F.col("p")[0].alias("x"), F.transform(F.slice("p", 2, 100), lambda x: x["ticker"]).alias("runners_up"))
    best = scores.select("session", "ticker", "rank_score").join(F.broadcast(best.select("session", "x.ticker", "x.division", "x.score", "runners_up")), ["session", "ticker"])  # a row a session
    counts = scored.groupBy("session", "test").agg(F.count("*").alias("n"))
    day = counts.groupBy("session").agg(
        F.sum("n").alias("scanned"), F.coalesce(F.sum(F.when(passed, F.col("n"))), F.lit(0)).alias("eligible"),
        F.min_by(F.when(~passed, F.col("test")), F.when(~passed, F.struct(-F.col("n"), F.col("test")))).alias("binding"),
    )
    none = F.col("ticker").isNull()
    reason = F.when(none & (F.col("eligible") > 0), "no eligible candidate had enough comparable signals to be scored").when(none, "no candidate passed the eligibility tests")
    return day.join(best, "session", "left").withColumns({"reason": reason, "binding": F.when(none, F.col("binding"))})


def seeded_choices(scored: DataFrame, first: int) -> DataFrame:
    """(session, ticker, division): of each session one row that passes, at a seeded place of the order of tickers; seed 1 is session `first`."""
    from .selection import seeded_place

    w = W.partitionBy("session")
    passed = scored.where("test is null").withColumns({"_i": F.row_number().over(w.orderBy("ticker")) - 1, "_n": F.count("*").over(w)})
    return passed.where(F.col("_i") == seeded_place(F.col("session") - first + 1, F.col("_n"))).select("session", "ticker", "division")


def open_book(log: DataFrame, calendar: DataFrame, at: str, published: str = "published_at", horizon: int = 21, opens: str = "09:30") -> DataFrame:
    """Rows of a log of choices that are still held on the session `at`, with `held`, the sessions since the buy, its own included.

    A choice is bought at the open of the same day's session if it was published before that, else of the next session; one that the
    calendar (date, session_idx) does not reach yet is held for 0 sessions, and counts. published is a local time of the exchange;
    choices without one are left out.
    """
    day = F.to_date(published)
    early = F.date_format(published, "HH:mm") < opens
    # from this day on the next session buys: one row a day of the log meets a window over the calendar
    wanted = log.where(F.col(published).isNotNull()).withColumn("_from", F.when(early, day).otherwise(F.date_add(day, 1)))
    marks = calendar.select(F.col("date").alias("_from"), F.col("session_idx").cast("long").alias("_i"))
    days = wanted.select("_from").distinct().unionByName(marks, allowMissingColumns=True).groupBy("_from").agg(F.max("_i").alias("_i"))
    entry = days.withColumn("_entry", F.min("_i").over(W.orderBy("_from").rowsBetween(0, W.unboundedFollowing))).drop("_i")
    now = calendar.where(F.col("date") <= F.lit(at).cast("date")).agg(F.max("session_idx").alias("_now"))
    held = F.coalesce(F.col("_now") - F.col("_entry") + 1, F.lit(0)).cast("int")
    return wanted.join(entry, "_from").crossJoin(F.broadcast(now)).withColumn("held", F.greatest(F.lit(0), held)).where(F.col("held") < horizon).select(*log.columns, "held")
