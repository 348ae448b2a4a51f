"""Standings: two-sided results folded to one record a team, ranked by points and goal difference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sides(games: DataFrame) -> DataFrame:
    """One row for each side of a game: (group, team, scored, conceded). A game counts once by its id."""
    once = games.dropDuplicates(["game_id"]).where(F.col("home_score").isNotNull() & F.col("away_score").isNotNull())
    both = F.array(
        F.struct(F.col("home").alias("team"), F.col("home_score").alias("scored"), F.col("away_score").alias("conceded")),
        F.struct(F.col("away").alias("team"), F.col("away_score").alias("scored"), F.col("home_score").alias("conceded")),
    )
    return once.select(F.inline(both))


def records(games: DataFrame) -> DataFrame:
    """Wins, losses, ties, goals for and against by team."""
    won, lost = F.col("scored") > F.col("conceded"), F.col("scored") < F.col("conceded")
    return sides(games).groupBy("team").agg(
        F.count("*").alias("played"),
        F.count_if(won).alias("wins"),
        F.count_if(lost).alias("losses"),
        F.count_if(~won & ~lost).alias("ties"),
        F.sum("scored").alias("goals_for"),
        F.sum("conceded").alias("goals_against"),
    )


def standings(members: DataFrame, games: DataFrame, group: str, points_for_win: int = 3) -> DataFrame:
    """Every member with its record, teams without a game included, and its competition rank (1, 1, 3) in its group."""
    counts = ["played", "wins", "losses", "ties", "goals_for", "goals_against"]
    table = members.join(records(games), "team", "left").fillna(0, counts)
    table = table.withColumn("points", F.col("wins") * points_for_win + F.col("ties")).withColumn("goal_diff", F.col("goals_for") - F.col("goals_against"))
    order = W.partitionBy(group).orderBy(F.desc("points"), F.desc("goal_diff"))
    return table.withColumn("position", F.rank().over(order))
