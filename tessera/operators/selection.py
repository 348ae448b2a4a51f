"""Choosing items: gates with a drop log, scores, constrained top-N per topic, seeded picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import canonical_url


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds (a null does not), or null."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        out = F.when(F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def drop_report(rows: DataFrame, reason: str, *by: str) -> DataFrame:
    """Counts by reason (null: kept)."""
    return rows.groupBy(*by, F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def fresh(items: DataFrame, seen: DataFrame, url: str, published: str, now: Column, most_hours: Column | float) -> DataFrame:
    """Items of at most that age whose canonical URL is not among seen (url)."""
    age = (F.unix_timestamp(now) - F.unix_timestamp(published)) / 3600
    return items.where(age <= most_hours).join(seen.select(canonical_url("url").alias("_seen")), canonical_url(url) == F.col("_seen"), "left_anti")


def item_score(weight: Column, age_hours: Column, text: Column, title: Column, excerpt: Column, french: Column, boosts: list[tuple[str, float]], reports: list[str], half_life: float = 18, penalty: float = 0.35) -> Column:
    """Weight by recency, boosts of patterns in the text, a penalty for match reports by title, French and long excerpts."""
    out = weight * F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_hours) / half_life)
    for pattern, factor in boosts:
        out = out * F.when(text.rlike(pattern), factor).otherwise(1.0)
    if reports:
        out = out * F.when(title.rlike("|".join(f"(?:{p})" for p in reports)), penalty).otherwise(1.0)
    return out * F.when(french, 0.85).otherwise(1.0) * F.when(F.length(excerpt) > 60, 1.05).otherwise(1.0)


_WORD = r"([A-Za-zÀ-ÖØ-öø-ÿ][\wÀ-ÖØ-öø-ÿ'’-]*|[.!?\n—])"


def proper_nouns(title: Column, excerpt: Column, publisher: Column) -> Column:
    """Capitalised words of four letters or more that do not open a sentence and are not the publisher's, lower-cased."""

    def inside(text: Column) -> Column:
        words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORD), 1)
        # each word beside the one before; a lambda that looked into the array would read it again for every word
        both = F.zip_with(F.concat(F.array(F.lit(".")), words), F.concat(words, F.array(F.lit("."))), lambda before, w: F.struct(before.alias("before"), w.alias("w")))
        kept = F.filter(both, lambda x: ~x["before"].rlike(r"^[.!?\n—]$") & (F.length(x["w"]) >= 4) & x["w"].rlike("^[A-ZÀ-Ö]"))
        return F.transform(kept, lambda x: F.regexp_replace(F.lower(x["w"]), "['’]s$", ""))

    byline = F.split(F.lower(F.coalesce(publisher, F.lit(""))), "[^a-z0-9]+")
    return F.array_except(F.array_distinct(F.concat(inside(title), inside(excerpt))), byline)


def select_per_topic(
    items: DataFrame, per_topic: int, topic: str = "topic", key: str = "id", score: str = "score", publisher: str = "publisher", foreign: str = "foreign",
    subject: str = "subject", tokens: str = "tokens", most_of_publisher: int = 2, foreign_share: float = 0.5, top: int = 3, min_shared: int = 3, min_overlap: float = 0.25,
) -> DataFrame:
    """topic, place, key of at most per_topic items a topic, taken by score (then key) under these rules:

    in the first `top` places publishers and subjects differ and half of the places at most are foreign; later a publisher has
    most_of_publisher places; foreign items have their share; and no two picks share min_shared tokens that are min_overlap of
    the smaller set. A second walk ignores the publisher rule. tokens holds an item's distinctive tokens. Null topics form one.

    Topics are walked side by side, one distributed step a pick: what is broadcast are the picks, per_topic rows a topic.
    """
    ranked = items.select(F.col(topic).alias("topic"), F.col(key).alias("key"), F.col(score).alias("score"), publisher, foreign, subject, tokens)
    most_foreign, top_foreign = -int(-per_topic * foreign_share // 1), max(1, top // 2)
    x = F.struct(F.col(publisher).alias("publisher"), F.coalesce(foreign, F.lit(False)).alias("foreign"), F.col(subject).alias("subject"), F.col(tokens).alias("tokens"), "key", "score")
    state = ranked.select("topic").distinct().select("topic", F.lit(0).alias("walk"), F.lit(None).cast("double").alias("at"), F.lit(None).cast(dict(ranked.dtypes)["key"]).alias("at_key"), F.filter(F.array(F.lit(None).cast(ranked.select(x.alias("x")).schema["x"].dataType)), lambda p: p.isNotNull()).alias("picks"))
    spark, shape = items.sparkSession, state.schema
    held = spark.createDataFrame(state.collect(), shape)  # a row a topic
    while True:
        going = held.where((F.size("picks") < per_topic) & (F.col("walk") < 2))
        if going.isEmpty():
            return held.select("topic", F.posexplode("picks").alias("place", "p")).select("topic", "place", "p.key")
        rows = ranked.withColumn("x", x).join(F.broadcast(going), ranked["topic"].eqNullSafe(going["topic"])).drop(going["topic"])
        same = lambda f, v: F.size(F.filter("picks", lambda p: p[f] == v))
        placed, in_top, abroad = F.size("picks"), F.size("picks") < top, F.size(F.filter("picks", lambda p: p["foreign"]))
        shared = lambda p: F.size(F.array_intersect(p["tokens"], F.col("x.tokens")))
        twin = F.exists("picks", lambda p: (shared(p) >= min_shared) & (shared(p) >= min_overlap * F.least(F.size(p["tokens"]), F.size("x.tokens"))))
        behind = F.col("at").isNull() | (F.col("score") < F.col("at")) | ((F.col("score") == F.col("at")) & (F.col("key") > F.col("at_key")))
        fits = (
            behind & ~F.exists("picks", lambda p: p["key"] == F.col("key")) & ~(F.col("x.foreign") & (abroad >= F.when(in_top, min(top_foreign, most_foreign)).otherwise(most_foreign)))
            & ((F.col("walk") == 1) | F.col("x.publisher").isNull() | (same("publisher", F.col("x.publisher")) < F.when(in_top, 1).otherwise(most_of_publisher)))
            & ~(in_top & F.col("x.subject").isNotNull() & (same("subject", F.col("x.subject")) > 0)) & ~twin & placed.isNotNull()
        )
        # best by score, then by the smaller key
        taken = rows.where(fits).groupBy("topic").agg(F.min_by("x", F.struct(-F.col("score"), F.col("key"))).alias("x"))
        found = {r.topic: r.x for r in taken.collect()}  # a row a topic
        after = []
        for r in held.collect():
            if len(r.picks) >= per_topic or r.walk > 1:
                after.append(r)
            elif r.topic in found:
                p = found[r.topic]
                after.append((r.topic, r.walk, p.score, p.key, [*r.picks, p]))
            else:
                after.append((r.topic, r.walk + 1, None, None, r.picks))
        held = spark.createDataFrame(after, shape)


def seeded_place(seed: Column, n: Column) -> Column:
    """A place from 0 to n - 1 by one step of a linear congruential generator."""
    return F.abs((seed * F.lit(1103515245) + F.lit(12345)) % F.lit(2147483648)) % n


def seeded_pick(rows: DataFrame, by: str, order: list[Column], seed: Column) -> DataFrame:
    """One row a group, at the seeded place of its order."""
    w = W.partitionBy(by)
    placed = rows.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    return placed.where(F.col("_i") == seeded_place(seed, F.col("_n"))).drop("_i", "_n")


def pick_and_runners(rows: DataFrame, by: str, order: list[Column], runners: int = 3) -> DataFrame:
    """Each group's first row (role 'pick') and the next ones (role 'runner-up'), with their place."""
    placed = rows.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("place") <= runners + 1)
    return placed.withColumn("role", F.when(F.col("place") == 1, "pick").otherwise("runner-up"))
