"""Sharding by sampled splitters.

Rows are ordered by (hash of text, doc_id, row), so that equal texts are neighbours. Boundaries lie between texts; only a text
of which the copies hold more than `tolerance` of a shard can be cut. A size-weighted sample of keys gives quantile boundaries; exact bytes by range show which ranges are overfull, and
those get boundaries of their own from a denser sample. What reaches the driver is the sample and one row a range,
both bounded by parameters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import id_and_text, plain_id, stage


def _packed(key: np.ndarray, doc: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Three signed longs as 24 bytes whose order is the order of the triples."""
    cols = np.stack([a.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63) for a in (key, doc, row)], axis=1)
    return np.ascontiguousarray(cols.astype(">u8")).view("S24").ravel()


def _range_of(splitters: np.ndarray):
    @F.pandas_udf("int")
    def of(key: pd.Series, doc: pd.Series, row: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splitters, _packed(key.to_numpy(), doc.to_numpy(), row.to_numpy()), side="right"))

    return of("key", "doc", "row")


def _sampled(rows: DataFrame, share, hot: np.ndarray) -> np.ndarray:
    """Keys of rows taken with the given probability, by a hash of the row and not by chance; before the first copy of a text that is not hot."""
    drawn = F.pmod(F.xxhash64("row", "key", F.lit(17)), F.lit(1 << 30)) < share * (1 << 30)
    got = rows.where(drawn).select("key", "doc", "row").toPandas()
    key, doc, row = (got[c].to_numpy(np.int64) for c in ("key", "doc", "row"))
    cut, lowest = np.isin(key, hot), np.iinfo(np.int64).min
    return _packed(key, np.where(cut, doc, lowest), np.where(cut, row, lowest))


def shard(docs: DataFrame, n_shards: int = 8, n_ranges: int = 2048, sample: int = 16_384, cuts: int = 256, rounds: int = 4, tolerance: float = 0.005, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal documents to n_shards shards of near equal bytes.

    Returns doc_id, size (UTF-8 bytes + 1), text_crc32, range_id, shard, slot (gapless from 0 in each shard).
    Null text counts as empty, null doc_id sorts first, repeated rows each get a slot, an empty table gives no rows,
    other columns are ignored. A single document larger than a share is not cut, however long; copies of a text share a shard
    unless together they hold more than `tolerance` of one (at most n_shards / tolerance texts are so hot).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stage(
        id_and_text(docs, id_col, text_col).select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
            plain_id().alias("doc"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-keys",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    of_text = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    hot = of_text.where((F.col("n") > 1) & (F.col("bytes") > total * tolerance / n_shards)).select("key").toPandas()["key"].to_numpy(np.int64)
    found = np.unique(_sampled(rows, F.least(F.lit(1.0), F.col("size") * (sample / max(total, 1))), hot))
    at = np.unique(np.linspace(0, len(found), min(n_ranges, len(found) + 1), endpoint=False).astype(int)[1:])
    splitters = found[at] if len(at) else np.empty(0, "S24")
    for last in [False] * rounds + [True]:
        placed = rows.withColumn("range_id", _range_of(splitters))
        sums = placed.groupBy("range_id").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("range_id").toPandas()
        ends = sums["bytes"].cumsum()
        # where a range crosses the end of a shard, its size is the shards' inequality
        crosses = (ends * n_shards // max(total, 1)) != ((ends - sums["bytes"]) * n_shards // max(total, 1))
        coarse = (sums["bytes"] > 2 * total / n_ranges) | (crosses & (sums["bytes"] > total / (1000 * n_shards)))
        over = sums[coarse & (sums["n"] > 1)]
        if last or not len(over):
            break
        # each of these is sampled as densely as its own bytes ask for, about `cuts` keys
        share = np.zeros(int(sums["range_id"].max()) + 1)
        share[over["range_id"]] = cuts / over["bytes"]
        share_of = F.pandas_udf(lambda r, share=share: pd.Series(share[r.to_numpy()]), "double")
        more = np.unique(np.concatenate([splitters, _sampled(placed, F.least(F.lit(1.0), F.col("size") * share_of("range_id")), hot)]))
        if len(more) == len(splitters):
            break
        splitters = more
    before = sums["bytes"].cumsum() - sums["bytes"]
    sums["shard"] = np.minimum(n_shards - 1, (before + sums["bytes"] / 2) * n_shards // max(total, 1)).astype(int)
    sums["first"] = sums.groupby("shard")["n"].cumsum() - sums["n"]
    width = int(sums["range_id"].max()) + 1 if len(sums) else 1
    to_shard, first = np.zeros(width, np.int32), np.zeros(width, np.int64)
    to_shard[sums["range_id"]], first[sums["range_id"]] = sums["shard"], sums["first"]
    shard_of = F.pandas_udf(lambda r: pd.Series(to_shard[r.to_numpy()]), "int")
    first_of = F.pandas_udf(lambda r: pd.Series(first[r.to_numpy()]), "long")
    order = W.partitionBy("range_id").orderBy("key", "doc", "row")
    return placed.select(
        "doc_id", "size", "text_crc32", "range_id",
        shard_of("range_id").alias("shard"),
        (first_of("range_id") + F.row_number().over(order) - 1).alias("slot"),
    )


def op10_sampled_splitter_shards(spark, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "range_id")
