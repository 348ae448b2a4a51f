"""Bounded samples of documents for fitting a classifier; everything else covers all documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(F.encode(F.col(column).cast("string"), "utf-8")) % folds


def sampled_ids(ids: DataFrame, most: int, seed: int = 7) -> DataFrame:
    """At most `most` rows of ids, those with the smallest hash of doc_id: the same ones at every run."""
    return ids.where("doc_id is not null").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text) for a bounded table of ids, one for each id; the ids travel, the texts stay where they are."""
    got = docs.join(F.broadcast(ids), "doc_id")
    return got.groupBy("doc_id").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), *[c for c in ids.columns if c != "doc_id"])).alias("x")).select("doc_id", "x.*")
