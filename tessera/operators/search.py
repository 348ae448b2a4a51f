"""Ranked fuzzy search over a catalogue, and history-based recommendation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normal_title

# Words that name a variant of the same thing; they cost a sixth of other words that a query lacks.
NEUTRAL = tuple(
    "organic salted unsalted original plain classic regular whole fresh natural quarters sticks stick sliced shredded grated large small mini pack cultured "
    "european style traditional lightly reduced fat low free gluten wild caught raw roasted unsweetened sweetened the and with in of a".split()
)


@F.pandas_udf(T.IntegerType())
def alignment_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edits with swaps of neighbours (optimal string alignment)."""

    def of(x: str, y: str) -> int:
        before, last = [], list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            now = [i]
            for j, d in enumerate(y, 1):
                best = min(last[j] + 1, now[-1] + 1, last[j - 1] + (c != d))
                if i > 1 and j > 1 and c == y[j - 2] and x[i - 2] == d:
                    best = min(best, before[j - 2] + 1)
                now.append(best)
            before, last = last, now
        return last[-1]

    memo: dict[tuple[str, str], int] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair not in memo:
            memo[pair] = of(*pair)
        out.append(memo[pair])
    return pd.Series(out, dtype="int32")


def singular(t: Column) -> Column:
    n = F.length(t)
    return (
        F.when((n > 4) & t.endswith("ies"), F.concat(t.substr(F.lit(1), n - 3), F.lit("y")))
        .when((n > 3) & t.rlike("(ch|sh|ss|x)es$"), t.substr(F.lit(1), n - 2))
        .when((n > 3) & t.endswith("s") & ~t.endswith("ss"), t.substr(F.lit(1), n - 1))
        .otherwise(t)
    )


def search(products: DataFrame, query: str, limit: int = 30, name: str = "name", key: str = "id") -> DataFrame:
    """The best products for a query: every query word must match a name word (exactly, as singular, as prefix, with a typo
    or inside it). Words are scored once for each distinct name word, so the slow distance sees the vocabulary, not the rows."""
    asked = products.sparkSession.range(1).select(F.explode(F.array_distinct(F.split(normal_title(F.lit(query)), " "))).alias("q")).where("q <> ''")
    named = products.select(F.col(key).alias("id"), F.col(name).alias("name"), normal_title(name).alias("normal")).withColumn("tokens", F.filter(F.split("normal", " "), lambda w: w != ""))
    words = named.select(F.explode("tokens").alias("w")).distinct()
    both = words.crossJoin(F.broadcast(asked))
    q, w = F.col("q"), F.col("w")
    near = both.where((F.length(q) >= 5) & (F.abs(F.length(singular(q)) - F.length(singular(w))) <= 2)).withColumn("d", alignment_distance(singular(q), singular(w)))
    typed = both.join(near.select("q", "w", "d"), ["q", "w"], "left")
    most = F.when(F.length(q) >= 8, 2).otherwise(1)
    score = (
        F.when(q == w, 3.0).when(singular(q) == singular(w), 2.8)
        .when((F.length(q) >= 3) & F.startswith(w, q), 2 - F.least(F.lit(0.6), (F.length(w) - F.length(q)) * 0.08))
        .when(F.col("d") <= most, 1.6 - F.col("d") * 0.3)
        .when((F.length(q) >= 4) & F.contains(w, q), 1.0).otherwise(0.0)
    )
    scores = typed.withColumn("s", score).where("s > 0").select("q", "w", "s")
    placed = named.select("id", F.posexplode("tokens").alias("i", "w"), F.size("tokens").alias("n"))
    hits = placed.join(F.broadcast(scores), "w").withColumn("head", (F.col("i") == F.col("n") - 1) & (F.col("s") >= 2.8))
    # the last word's bonus counts only where its own score is above those of the words before it
    best = hits.groupBy("id", "q").agg(F.max("s").alias("top"), F.max(F.when(F.col("i") < F.col("n") - 1, F.col("s"))).alias("before"), F.max(F.when(F.col("head"), F.col("s"))).alias("last"))
    gain = F.when(F.col("last") > F.coalesce("before", F.lit(0.0)), F.col("last") + 2.5).otherwise(F.col("top"))
    n_asked = asked.agg(F.count("*").alias("asked"))
    total = best.groupBy("id").agg(F.sum(gain).alias("score"), F.count("*").alias("met")).crossJoin(F.broadcast(n_asked)).where("met = asked")
    whole = normal_title(F.lit(query))
    bonus = F.when(F.col("normal") == whole, 6.0).when(F.startswith("normal", whole), 1.0).otherwise(0.0)
    terms = sorted(set(query.lower().split()))
    unasked = F.filter("tokens", lambda t: ~F.exists(F.array(*map(F.lit, terms)), lambda x: (singular(x) == singular(t)) | F.startswith(t, x)))
    cost = F.aggregate(unasked, F.lit(0.0), lambda sum_, t: sum_ + F.when(t.isin(*NEUTRAL), 0.1).otherwise(0.6))
    out = total.join(named, "id").select("id", "name", (F.col("score") + bonus - cost).alias("score"))
    return out.orderBy(F.desc("score"), F.length("name"), "name", "id").limit(limit)


def buy_again(history: DataFrame, now: Column, half: float = 45.0) -> DataFrame:
    """Score by key: purchases weigh 1 and other events 0.4, fading with age; history (key, kind, at)."""
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(now) - F.unix_timestamp("at")) / 86400)
    weight = F.when(F.col("kind") == "purchased", 1.0).otherwise(0.4) * (0.4 + 0.6 * F.exp(-age / half))
    return history.groupBy("key").agg(F.sum(weight).alias("score"), F.count_if(F.col("kind") == "purchased").alias("times"), F.max("at").alias("last_at"))


def discover(history: DataFrame, catalogue: DataFrame, limit_by_section: int = 1) -> DataFrame:
    """Products never bought, scored by shared tag (3), name token (2) and section (1); the best of each section.

    history (product_id), catalogue (product_id, name, section, tags); only the first shared tag or token of a product counts.
    """
    bought = history.join(catalogue, "product_id")
    tag_w = bought.select(F.explode("tags").alias("t")).groupBy("t").agg(F.count("*").alias("w"))
    tok_w = bought.select(F.explode(F.split(normal_title("name"), " ")).alias("t")).groupBy("t").agg(F.count("*").alias("w"))
    sec_w = bought.groupBy("section").agg(F.count("*").alias("section_w"))
    fresh = catalogue.join(history.select("product_id").distinct(), "product_id", "left_anti")

    def first_shared(column: Column, weights: DataFrame, name: str) -> DataFrame:
        each = fresh.select("product_id", F.posexplode(column).alias("i", "t")).join(weights, "t")
        return each.groupBy("product_id").agg(F.min_by("w", "i").alias(name))

    scored = (
        fresh.join(first_shared(F.col("tags"), tag_w, "tag_w"), "product_id", "left")
        .join(first_shared(F.split(normal_title("name"), " "), tok_w, "tok_w"), "product_id", "left")
        .join(sec_w, "section", "left").fillna(0, ["tag_w", "tok_w", "section_w"])
        .withColumn("score", 3 * F.col("tag_w") + 2 * F.col("tok_w") + F.col("section_w")).where("score >= 2")
    )
    best = F.row_number().over(W.partitionBy("section").orderBy(F.desc("score"), "name", "product_id"))
    return scored.withColumn("place", best).where(F.col("place") <= limit_by_section).select("product_id", "name", "section", "score")
