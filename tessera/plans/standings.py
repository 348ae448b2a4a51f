"""Standings over the driver's tables: each pair of consecutive orders is a game between two nations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.standings import standings


def standings_by_segment(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    owner = read("orders").join(read("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    side = owner.select(
        F.floor((F.col("o_orderkey") + 1) / 2).cast("long").alias("game_id"),
        (F.col("o_orderkey") % 2).alias("odd"),
        F.col("c_nationkey").alias("team"),
        F.floor(F.col("o_totalprice") / 1000).cast("long").alias("score"),
    )
    pick = lambda odd, c: F.max(F.when(F.col("odd") == odd, F.col(c)))
    games = (
        side.groupBy("game_id")
        .agg(pick(1, "team").alias("home"), pick(1, "score").alias("home_score"), pick(0, "team").alias("away"), pick(0, "score").alias("away_score"))
        .where("home <> away")
    )
    members = read("nation").select(F.col("n_nationkey").alias("team"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return standings(members, games, "region")


QUERIES = {"standings_by_segment": standings_by_segment}
ORACLE_SQL = {
    "standings_by_segment": """
WITH side AS (
  SELECT CAST(floor((o_orderkey + 1) / 2.0) AS BIGINT) AS game_id, o_orderkey % 2 AS odd, c_nationkey AS team,
         CAST(floor(o_totalprice / 1000) AS BIGINT) AS score
  FROM orders JOIN customer ON o_custkey = c_custkey),
games AS (
  SELECT game_id, max(CASE WHEN odd = 1 THEN team END) AS home, max(CASE WHEN odd = 1 THEN score END) AS hs,
         max(CASE WHEN odd = 0 THEN team END) AS away, max(CASE WHEN odd = 0 THEN score END) AS aws
  FROM side GROUP BY game_id),
sides AS (
  SELECT home AS team, hs AS f, aws AS a FROM games WHERE home <> away AND hs IS NOT NULL AND aws IS NOT NULL
  UNION ALL
  SELECT away, aws, hs FROM games WHERE home <> away AND hs IS NOT NULL AND aws IS NOT NULL),
rec AS (
  SELECT team, count(*) AS played, count(*) FILTER (WHERE f > a) AS wins, count(*) FILTER (WHERE f < a) AS losses,
         count(*) FILTER (WHERE f = a) AS ties, CAST(sum(f) AS BIGINT) AS goals_for, CAST(sum(a) AS BIGINT) AS goals_against
  FROM sides GROUP BY team),
t AS (
  SELECT n_nationkey AS team, n_name AS name, n_regionkey AS region, coalesce(played, 0) AS played, coalesce(wins, 0) AS wins,
         coalesce(losses, 0) AS losses, coalesce(ties, 0) AS ties, coalesce(goals_for, 0) AS goals_for,
         coalesce(goals_against, 0) AS goals_against
  FROM nation LEFT JOIN rec ON n_nationkey = team)
SELECT *, 3 * wins + ties AS points, goals_for - goals_against AS goal_diff,
       CAST(rank() OVER (PARTITION BY region ORDER BY 3 * wins + ties DESC, goals_for - goals_against DESC) AS INTEGER) AS position
FROM t""",
}
