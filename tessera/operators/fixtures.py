"""Games from several sources: slots, merging, identities, row quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.teams import name_words

STATUS = {"scheduled": 0, "cancelled": 1, "postponed": 1, "final": 2}


def pair(a: str, b: str) -> Column:
    return F.array_sort(F.array(a, b))


def slots(rows: DataFrame, by: list[str], time: str, order: str) -> DataFrame:
    """slot: the place of a game among those of one source with the same key, by time (unknown times last), then input order."""
    return rows.withColumn("slot", F.row_number().over(W.partitionBy(*by).orderBy(F.col(time).asc_nulls_last(), F.asc(order))) - 1)


def merged_games(rows: DataFrame, key: list[str], source: str, time: str, status: str, values: list[str], seen_at: str) -> DataFrame:
    """One game for each key (with its slot): the status of the greatest rank, of the time and every value the last one known (schools
    move games, so the newest reading counts), the number of sources, and whether sources disagree about a value."""
    last = lambda v: F.max(F.when(F.col(v).isNotNull(), F.struct(seen_at, F.col(source), F.col(v).alias("v"))))["v"]
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), F.col(status)), F.lit(-1))
    return rows.groupBy(*key).agg(
        F.max(F.struct(rank.alias("r"), F.col(seen_at), F.col(status).alias("s")))["s"].alias(status), last(time).alias(time), F.count_distinct(source).alias("sources"),
        *[last(v).alias(v) for v in values],
        *[(F.min(v) < F.max(v)).alias(f"{v}_conflict") for v in values],
    )


def names_agree(names: Column) -> Column:
    """Whether of every two names the words of the shorter one begin the longer one: each begins the longest."""
    words = F.transform(names, lambda n: F.concat(F.trim(n), F.lit(" ")))
    longest = F.reduce(words, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    return F.forall(words, lambda w: F.startswith(longest, w))


def identities(names: DataFrame, slug: str, name: str, host: str) -> DataFrame:
    """slug, winner: slugs whose pages are on one host and whose names all agree become the one with the most words, then the
    longest name, then the first. A slug's name is the longest one printed for it."""
    named = names.where(F.col(slug).isNotNull()).groupBy(slug).agg(F.max(F.struct(F.length(name).alias("n"), F.col(name).alias("name")))["name"].alias("name"))
    on = names.where(F.col(host).isNotNull()).select(host, slug).distinct().join(named, slug)
    groups = on.groupBy(host).agg(F.collect_set("name").alias("names"), F.count("*").alias("n"), F.min(F.struct(-F.size(F.split("name", " ")), -F.length("name"), F.col(slug).alias("slug")))["slug"].alias("winner"))
    good = groups.where((F.col("n") > 1) & names_agree(F.col("names")))
    return on.join(good.select(host, "winner"), host).where(F.col(slug) != F.col("winner")).groupBy(slug).agg(F.min("winner").alias("winner"))


def identity_evidence(rows: DataFrame, slug: str, name: str, host: str) -> DataFrame:
    """What speaks for slugs being one team: a row for each host that two slugs or more link to, with slugs (sorted), links (how many rows said so, by
    slug in that order), merged, winner, why. They are merged where of every two names the words of one begin the other's; a host that two teams link to
    by mistake is left alone as a whole. A slug's name is the longest printed one (ties: the first), or the slug itself, as for the owner of a page, whose
    rows have no name. The winner's name has the most words, then the most letters, then the first slug. Rows without slug or host speak for nothing.
    """
    named = rows.where(F.col(slug).isNotNull()).groupBy(slug).agg(F.min(F.when(F.col(name).isNotNull(), F.struct((-F.length(name)).alias("n"), F.col(name).alias("name"))))["name"].alias("_name"))
    claims = rows.where(F.col(slug).isNotNull() & F.col(host).isNotNull()).groupBy(host, slug).agg(F.count("*").alias("_links"))
    each = claims.join(named, slug).withColumn("_name", F.coalesce("_name", slug)).withColumn("_words", name_words(F.col("_name")))
    one = F.struct(F.col(slug).alias("slug"), F.col("_links").alias("links"), F.col("_words").alias("words"))
    best = F.min(F.struct(-F.size("_words"), -F.length("_name"), F.col(slug).alias("slug")))["slug"]
    g = each.groupBy(host).agg(F.sort_array(F.collect_list(one)).alias("all"), best.alias("winner")).where(F.size("all") > 1)
    longest = F.reduce("all", F.array().cast("array<string>"), lambda a, x: F.when(F.size(x["words"]) > F.size(a), x["words"]).otherwise(a))
    g = g.withColumn("_longest", longest).withColumn("merged", F.forall("all", lambda x: F.slice("_longest", 1, F.size(x["words"])) == x["words"]))
    return g.select(
        host, F.col("all.slug").alias("slugs"), F.col("all.links").alias("links"), "merged", F.when(F.col("merged"), F.col("winner")).alias("winner"),
        F.when(F.col("merged"), F.lit("all link to the host and their names agree")).otherwise("names on the host do not agree").alias("why"),
    )


def merges_of(evidence: DataFrame, slug: str = "slug") -> DataFrame:
    """slug, winner of the merges that evidence allows, as `canonical` takes them; a slug merged on several hosts goes to the first winner."""
    x = evidence.where("merged").select(F.explode("slugs").alias(slug), "winner")
    return x.where(F.col(slug) != F.col("winner")).groupBy(slug).agg(F.min("winner").alias("winner"))


def canonical(names: DataFrame, merges: DataFrame, slug: str, steps: int = 8) -> DataFrame:
    """names with slug replaced by the end of its chain of merges, of at most `steps` links."""
    end = merges.select(F.col(slug).alias("_s"), F.col("winner").alias("_w"))
    hops = 1
    while hops < steps:  # each round doubles the links that are followed
        far = end.select(F.col("_s").alias("_m"), F.col("_w").alias("_far"))
        end = end.join(far, F.col("_w") == F.col("_m"), "left").select("_s", F.coalesce("_far", "_w").alias("_w"))
        hops *= 2
    return names.join(end, F.col(slug) == F.col("_s"), "left").withColumn(slug, F.coalesce("_w", slug)).drop("_s", "_w")


def quarantined(rows: DataFrame, before: DataFrame, key: str, bad: Column, least: int = 5, share: float = 0.01) -> DataFrame:
    """The rows to publish, with their origin: sound rows ('new'), and for unsound ones the published row where it is sound
    ('rescued'), else nothing. More unsound rows than max(least, share of all) publish nothing. key is unique on both sides."""
    checked = rows.withColumn("_bad", F.coalesce(bad, F.lit(False)))
    few = checked.agg((F.count_if("_bad") <= F.greatest(F.lit(least), F.ceil(F.count("*") * share))).alias("_few"))
    allowed = checked.crossJoin(F.broadcast(few)).where("_few").drop("_few")  # one row
    rescued = before.where(~F.coalesce(bad, F.lit(False))).join(allowed.where("_bad").select(key), key, "left_semi").withColumn("origin", F.lit("rescued"))
    return allowed.where("not _bad").drop("_bad").withColumn("origin", F.lit("new")).unionByName(rescued)
