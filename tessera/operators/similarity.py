"""Set-similarity joins over titles and the greedy removal of near duplicates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import jaccard


def classes(rows: DataFrame, key: str, tokens: str) -> DataFrame:
    """One row for each distinct token set: its smallest key and its number of rows. Copies are never paired with each other."""
    return rows.groupBy(F.col(tokens).alias("tokens")).agg(F.min(key).alias("rep"), F.count("*").alias("copies"))


#: Longs of 64 bits in the sketch of a token set.
_SKETCH = 4


def candidate_pairs(reps: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(a, b) of token sets (rep, tokens) that may have a Jaccard above the threshold; none that has is missing.

    Prefix filter: sets so alike share one of their rarest tokens, so each is listed under those only and common tokens never
    make long lists. Two bounds of the overlap hold back in the join itself, before anything is shuffled, what cannot reach it:
    the tokens that are left from the place of the shared one on, and the bits in which sketches differ (each bit is the parity of
    the tokens that hash to it, so two sets differ in at least as many tokens).
    """
    words = reps.where(F.size("tokens") > 0).select("rep", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    df = words.groupBy("token").agg(F.count("*").alias("df"))
    of_rep = W.partitionBy("rep")
    bit = F.expr("shiftleft(1L, cast(_h & 63 as int))")
    sketch = {f"s{i}": F.coalesce(F.bit_xor(F.when(F.expr(f"shiftright(_h, 6) & {_SKETCH - 1} = {i}"), bit)).over(of_rep), F.lit(0).cast("long")) for i in range(_SKETCH)}
    placed = words.join(df, "token").withColumn("_h", F.xxhash64("token")).withColumns(sketch | {"place": F.row_number().over(of_rep.orderBy("df", "token"))})
    listed = placed.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1)
    kept = ("n", "place", *sketch)
    left, right = (listed.select("token", F.col("rep").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in kept]) for x in "ab")
    fits = (F.col("n_a") >= F.col("n_b") * threshold) & (F.col("n_b") >= F.col("n_a") * threshold)
    both = F.col("n_a") + F.col("n_b")
    need = F.ceil(both * (threshold / (1 + threshold)) - 1e-9)
    differ = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in sketch), F.lit(0))
    reach = (1 + F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) >= need) & (both - differ >= 2 * need)
    return left.join(right, "token").where((F.col("a") < F.col("b")) & fits & reach).select("a", "b").distinct()


def similar_pairs(reps: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(a, b, similarity) of token sets (rep, tokens) with a Jaccard above the threshold: candidates compared in full."""
    pairs = candidate_pairs(reps, threshold)
    for x in "ab":
        pairs = pairs.join(reps.select(F.col("rep").alias(x), F.col("tokens").alias(f"t_{x}")), x)
    return pairs.withColumn("similarity", jaccard(F.col("t_a"), F.col("t_b"))).where(F.col("similarity") > threshold).select("a", "b", "similarity")


def rare_token_pairs(rows: DataFrame, key: str, tokens: str, max_share: float = 0.15, min_limit: int = 2, min_shared: int = 3, min_overlap: float = 0.25, most_df: int | None = None) -> DataFrame:
    """(a, b, shared) of rows that share min_shared distinctive tokens and min_overlap of the smaller set of these.

    Distinctive: in at most max(min_limit, floor(rows * max_share)) rows, or in most_df if that is given.
    Prefix filter: from the rarest token that two rows share, each has at least as many tokens left as they must share, so
    candidates meet under such tokens only; then whole sets are compared.
    """
    words = rows.select(F.col(key).alias("k"), F.explode(tokens).alias("token")).distinct()
    total = rows.agg(F.count("*").alias("total"))
    df = words.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total))
    limit = F.lit(most_df) if most_df else F.greatest(F.lit(min_limit), F.floor(F.col("total") * max_share))
    distinctive = words.join(df.where(F.col("df") <= limit).select("token", "df"), "token")
    # tokens of one row count for the overlap but are never shared
    by_df = F.array_sort(F.collect_list(F.when(F.col("df") > 1, F.struct("df", "token"))))
    sets = distinctive.groupBy("k").agg(F.count("*").alias("n"), by_df["token"].alias("tokens")).where(F.size("tokens") >= min_shared)
    listed = sets.select("k", "n", F.posexplode("tokens").alias("i", "token"), F.size("tokens").alias("m")).withColumn("rest", F.col("m") - F.col("i")).where(F.col("rest") >= min_shared)
    a, b = (listed.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("k", "n", "rest")]) for x in "ab")
    need = min_overlap * F.least("n_a", "n_b")
    pairs = a.join(b, "token").where("k_a < k_b").where((F.col("rest_a") >= need) & (F.col("rest_b") >= need)).select(F.col("k_a").alias("a"), F.col("k_b").alias("b")).distinct()
    for x in "ab":
        pairs = pairs.join(sets.select(F.col("k").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}")), x)
    out = pairs.withColumn("shared", F.size(F.array_intersect("t_a", "t_b")).cast("long"))
    return out.where((F.col("shared") >= min_shared) & (F.col("shared") >= need)).select("a", "b", "shared")


def greedy_keep(items: DataFrame, links: DataFrame, key: str, rank: str, scratch: str) -> DataFrame:
    """Items in order of rank, each dropped if it is linked with an item kept before: (key, kept).

    The same as the sequential pass, in rounds: an undecided item without an undecided better neighbour is kept, and its
    neighbours are dropped. Links are (a, b) of keys; ranks are distinct; each round is a written table under `scratch`.
    """
    spark = items.sparkSession

    def written(df: DataFrame) -> DataFrame:
        path = f"{scratch}/greedy-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    ranks = items.select(F.col(key).alias("k"), F.col(rank).alias("r"))
    links = written(links.select("a", "b"))
    both = links.select(F.col("a").alias("k"), F.col("b").alias("o")).union(links.select(F.col("b"), F.col("a"))).distinct()
    better = written(both.join(ranks, "k").join(ranks.select(F.col("k").alias("o"), F.col("r").alias("ro")), "o").where("ro < r").select("k", "o"))
    linked = better.select("k").distinct()
    state = written(ranks.select("k").join(linked, "k", "left_semi").select("k", F.lit(None).cast("boolean").alias("kept")).union(
        ranks.select("k").join(linked, "k", "left_anti").select("k", F.lit(True))))
    while not state.where("kept is null").isEmpty():
        seen = better.join(state.select(F.col("k").alias("o"), F.col("kept").alias("ko")), "o").groupBy("k").agg(
            F.coalesce(F.bool_or("ko"), F.lit(False)).alias("beaten"), F.count_if(F.col("ko").isNull()).alias("waiting"))
        decided = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("beaten"), False).when(F.col("waiting") == 0, True)
        state = written(state.join(seen, "k", "left").select("k", decided.alias("kept")))
    return state.select(F.col("k").alias(key), "kept")
