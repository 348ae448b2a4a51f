"""The corpus pipeline: documents -> toxicity -> line dedup -> near-dedup -> decontamination -> packed pieces.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last return the columns of
documents; run() writes each stage to the shared folder and reads it again.

Every stage reads texts whole, however long, ignores columns that documents does not have, gives no rows for an empty table, and
bears a null in any column; what it does with empty texts, ties and repeated rows is said with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from tessera.llm.common import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled model scores under one half; one of exactly one half goes. Null and empty texts get
    the score of a text without known words, repeated rows stay or go together, a null doc_id counts in no label."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, carry=("text", "lang", "source", "n_chars"))
    return scored.where("score < 0.5").select(COLUMNS)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that a document of a smaller id holds; n_chars follows the text. No document goes: null and empty texts
    read as empty, rows that share a doc_id hold their lines together, a null doc_id is the smallest."""
    kept = line_dedup.dedup_lines(docs, carry=("lang", "source"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates. A row stored twice stays once; other texts under that id
    go or stay by their own group; texts without words stay."""
    return near_dedup.kept_documents(docs).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold benchmark passages in a twentieth of their words; one at exactly a twentieth goes. Null and empty
    texts stay, repeated rows stay or go together."""
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=("text", "lang", "source", "n_chars"))
    return found.where(~decontaminate.contaminated()).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, packed into sequences; a null or empty text is one piece of its end mark, each repeated
    row has pieces of its own."""
    out = packing.pack(docs, packing.vocabulary())
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
#: Learning and packing are not expressible in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, each in STAGES:
        docs = stage(each(spark, docs, sf_dir), name)
    return docs
