"""Mixing sources to target weights with hash-threshold histograms, by DataFrame operations only.

Every document has a place on a line of 2^60 by the hash of its id and text. A source's budget is a whole number of copies of all its
documents and a threshold on that line: documents before it are taken once more. To find the threshold, tokens are summed by source
and hash bucket; the bucket in which the running sum passes the budget is the boundary bucket, and only its documents are summed
again by finer buckets, until it holds one document or rows that are alike. No rows are sorted: one pass sums, one pass filters,
and what lies between reads the boundary buckets alone. Larger budgets take what smaller ones take, and more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import join_counted, stage

WEIGHTS = (1, 2, 3)
#: No document is taken more often than this.
MOST = 3
SEED = 42
#: Places are numbers of so many bits; each round looks at so many of them.
BITS, STEP = 60, 10


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text, 0 for null."""
    bare = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return (F.size(F.split(bare, " +")) - (bare == "").cast("int")).cast("long")


def _place(seed: int) -> Column:
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).cast("binary"))
    return F.conv(F.substring(hashed, 1, BITS // 4), 16, 10).cast("long")


def ranked(keys: DataFrame, column: str) -> DataFrame:
    """keys (distinct values of a column) with rank, from 0, in the order of their bytes: a range sort, then a count a part."""
    placed = stage(keys.orderBy(column).withColumn("at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).alias("first"))
    return placed.withColumn("part", part).join(offsets, "part").withColumn("rank", F.col("first") + F.col("at") - F.shiftleft("part", 33)).drop("at", "part", "first")


def shares(sources: DataFrame, total: int, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sources (key, source_size, rank) with target: total dealt out by weight, none above `most` times its size.

    What a capped source leaves is dealt out again by weight among the others, until none is above its cap. Each round moves three sums
    to the driver.
    """
    each = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * most
    level, free = 0.0, -1
    while True:
        # the level never falls, so a source that is capped once stays so
        open_ = (cap > F.col("weight") * F.lit(level)) if free >= 0 else F.lit(True)
        sums = each.agg(F.sum(F.when(open_, F.col("weight"))).alias("weights"), F.sum(F.when(~open_, cap)).alias("capped"), F.count(F.when(open_, 1)).alias("free")).first()
        if not sums["free"] or sums["free"] == free:
            break
        free, level = sums["free"], (total - (sums["capped"] or 0)) / sums["weights"]
    return each.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(level)))


def mix(docs: DataFrame, budgets: Sequence[float] = (1.0,), weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of docs: doc_id, source, size (words), source_size, and by budget (a share of all words, at most `most`)
    the arrays target (of its source) and taken (words that the mix takes of this document, repeats counted).

    Sources in the order of their bytes, null as one of its own at the end, have the weights in turn. The words taken of a source are
    those of a whole number of copies plus the documents before a threshold; of the two thresholds around the exact budget, it is
    the one that comes nearer, the lower one in a tie. Null and empty texts have no words and are taken with none; a null id draws by its text; rows alike in
    id and text are taken alike, so that a threshold cannot part them. Texts are read whole, however long; an empty table gives no
    rows; other columns are ignored. A hot source is summed before it is shuffled; its documents meet the threshold by a
    broadcast of the heaviest sources only (see join_counted).
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[source_col].cast("string").alias("source"))
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source"))).alias("key")
    rows = stage(rows.select("doc_id", "source", key, word_count(F.col("text")).alias("size"), _place(seed).alias("place")), "mix-sizes")

    def summed(df: DataFrame, by: list[str], shift: int) -> DataFrame:
        by = [*by, F.shiftright("place", shift).alias("bucket")]
        return df.groupBy(*by).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.min("place").alias("low"), F.max("place").alias("high"))

    shift = BITS - STEP
    histogram = stage(summed(rows, ["key"], shift), "mix-buckets")
    sources = histogram.groupBy("key").agg(F.sum("words").alias("source_size"), F.sum("n").alias("rows"))
    sources = stage(ranked(stage(sources, "mix-sources"), "key"), "mix-ranks")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    goals = None
    for i, share in enumerate(budgets):
        own = shares(sources, total * share, weights, most).withColumn("budget", F.lit(i))
        goals = own if goals is None else goals.unionByName(own)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = goals.withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    goals = stage(goals, "mix-goals")

    # the words before the boundary bucket, and the places it spans; refined while it holds places that differ
    begun = goals.select("key", "budget", "rest", F.lit(0).cast("long").alias("before"))
    sums = histogram.join(begun, "key")
    found, near, on = None, rows, ["key", "bucket"]
    while True:
        order = W.partitionBy("key", "budget").orderBy("bucket")
        upto = F.col("before") + F.sum("words").over(order)
        boundary = sums.withColumn("upto", upto).where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
        last = stage(boundary.select("key", "budget", "rest", (F.col("upto") - F.col("words")).alias("before"), "upto", "bucket", "low", "high"), "mix-boundary")
        settled = last.where(F.col("low") == F.col("high"))
        found = settled if found is None else found.unionByName(settled)
        rough = last.where(F.col("low") < F.col("high"))
        if rough.isEmpty():
            break
        near = near.select("key", "place", "size", *on[2:], F.shiftright("place", shift).alias("bucket"))
        near = stage(near.join(rough.select("key", "bucket", "budget", "rest", "before"), on).drop("bucket"), "mix-inside")
        shift, on = shift - STEP, ["key", "bucket", "budget"]
        sums = summed(near, ["key", "budget", "rest", "before"], shift)
    nearer = (F.col("upto") - F.col("rest")) < (F.col("rest") - F.col("before"))
    cuts = found.select("key", "budget", F.when(nearer, F.col("high") + 1).otherwise(F.col("low")).alias("cut"))
    by_budget = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("budget", c))), lambda x: x[c]).alias(c)
    plan = goals.join(cuts, ["key", "budget"], "left").withColumn("cut", F.coalesce("cut", F.lit(0)))
    plan = plan.groupBy("key", "source_size", F.col("rows").alias("n")).agg(by_budget("target"), by_budget("copies"), by_budget("cut"))
    met = join_counted(rows, stage(plan, "mix-plan"), ["key"])
    times = F.zip_with("copies", "cut", lambda c, cut: F.col("size") * (c + F.when(F.col("place") < cut, 1).otherwise(0)))
    return met.select("doc_id", "source", "size", "source_size", "target", times.alias("taken"))


def op12_hash_threshold_mix(spark, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), budgets=(0.5, 1.0))
    return out.select("doc_id", "size", "source_size", F.col("target")[1].alias("target"), F.col("taken")[1].alias("taken"), F.col("target")[0].alias("half_target"), F.col("taken")[0].alias("half_taken"))


def _sql_budget(name: str, share: str) -> str:
    """Targets and taken words of one budget: caps are met in the order of cap / weight, and the level is highest where the caps below it are met."""
    return f"""
{name}_levels AS (
  SELECT *, ({share} * CAST((SELECT sum(source_size) FROM sources) AS DOUBLE)
      - coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY 3.0 * source_size / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources
), {name}_goals AS (
  SELECT key, source_size, least(CAST(3 * source_size AS DOUBLE), weight * (SELECT max(level) FROM {name}_levels)) AS target
  FROM sources
), {name}_rest AS (
  SELECT key, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies,
    target - CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END * source_size AS rest
  FROM {name}_goals
), {name}_cuts AS (
  SELECT key, copies, target, rest, place, upto, upto - words AS before
  FROM {name}_rest LEFT JOIN running USING (key)
), {name}_plan AS (
  SELECT key, any_value(copies) AS copies, any_value(target) AS target,
    coalesce(max(CASE WHEN upto <= rest OR upto - rest < rest - before THEN place END), -1) AS cut
  FROM {name}_cuts WHERE place IS NULL OR upto <= rest OR before <= rest GROUP BY key
)"""


OP12_SQL = rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS place
  FROM documents
), sources AS (
  SELECT key, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY key) - 1) % 3 + 1 AS weight FROM d GROUP BY key
), running AS (
  SELECT key, place, words, sum(words) OVER (PARTITION BY key ORDER BY place) AS upto FROM (SELECT key, place, sum(size) AS words FROM d GROUP BY key, place)
), {_sql_budget("whole", "1.0")}, {_sql_budget("half", "0.5")}
SELECT d.doc_id, d.size, s.source_size, w.target, CAST(d.size * (w.copies + CASE WHEN d.place <= w.cut THEN 1 ELSE 0 END) AS BIGINT) AS taken,
  h.target AS half_target, CAST(d.size * (h.copies + CASE WHEN d.place <= h.cut THEN 1 ELSE 0 END) AS BIGINT) AS half_taken
FROM d JOIN sources s USING (key) JOIN whole_plan w USING (key) JOIN half_plan h USING (key)
"""
