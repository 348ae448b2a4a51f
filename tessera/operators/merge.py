"""Keyed tables: upserts, keep-best, expiry, slot claims, renumbering, and data-quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_best(rows: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """One row a key: the first in the given order, which must break all ties."""
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new, and the rows of old whose key new lacks."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def folded(rows: DataFrame, key: str, order: str, ranks: dict[str, int], status: str) -> DataFrame:
    """The state of each key: the last order seen, the status of the greatest rank (the later of equals), and of every other
    column the last value that is not null, each with the order it came with.

    Folding states again gives the state of all their rows, in whatever pieces and order they come, and however often.
    """
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.col(status)), F.lit(-1))
    best = {c: F.struct(*([rank.alias("rank")] if c == status else []), F.col(order).alias("at"), F.col(c).alias("v")) for c in rows.columns if c not in (key, order)}
    return rows.groupBy(key).agg(F.max(order).alias(order), *[F.max(F.when(F.col(c).isNotNull(), x)).alias(c) for c, x in best.items()])


def refolded(states: DataFrame, key: str) -> DataFrame:
    """One state a key out of several; equals are one, so that a state may come twice."""
    return states.groupBy(key).agg(*[F.max(c).alias(c) for c in states.columns if c != key])


def state_rows(states: DataFrame, key: str, order: str) -> DataFrame:
    """The plain columns of states."""
    return states.select(key, order, *[F.col(f"{c}.v").alias(c) for c in states.columns if c not in (key, order)])


def upsert(archive: DataFrame, batch: DataFrame, key: str, order: str, ranks: dict[str, int], status: str) -> DataFrame:
    """Merge a batch of rows into an archive of rows: nothing vanishes, later values win where they are not null, and a status
    never steps back in rank."""
    return state_rows(folded(archive.unionByName(batch), key, order, ranks, status), key, order)


def expired(rows: DataFrame, done_at: str, now: Column, hours: float) -> DataFrame:
    """Rows done at least so many hours ago."""
    return rows.where(F.col(done_at).isNotNull() & (F.unix_timestamp(now) - F.unix_timestamp(done_at) >= hours * 3600))


def claim_slots(slots: DataFrame, claims: DataFrame, now: Column, grace_hours: float) -> DataFrame:
    """The latest slot of each name that is due, not older than the grace and not claimed; slots (name, due), claims (name, due)."""
    age = F.unix_timestamp(now) - F.unix_timestamp("due")
    due = slots.where((age >= 0) & (age <= grace_hours * 3600))
    last = keep_best(due, ["name"], [F.desc("due")])
    return last.join(claims, ["name", "due"], "left_anti")


def renumbered(rows: DataFrame, by: list[str], order: list[Column], column: str = "order") -> DataFrame:
    """Dense numbers from 0 within each group."""
    return rows.withColumn(column, F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1)


def keep_last(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def problems(checks: list[tuple[str, Column]]) -> Column:
    """The names of all checks that a row does not pass."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks]), lambda x: x.isNotNull())


def problem_counts(rows: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """(check, failed, total) in one pass over the rows."""
    counts = rows.agg(F.count("*").alias("total"), *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"c{i}") for i, (_, ok) in enumerate(checks)])
    each = F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"c{i}").alias("failed")) for i, (n, _) in enumerate(checks)])
    return counts.select(F.explode(each).alias("x"), "total").select("x.check", "x.failed", "total")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias("_p")), F.col(child_key) == F.col("_p"), "left_anti")


def supersedes(new_count: Column, old_count: Column, least_share: float = 0.8) -> Column:
    """A snapshot replaces another only if it holds at least so much of it."""
    return new_count >= least_share * old_count
