"""What the training-data operators share: scratch tables, per-batch mapping and word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id inside a plan, so that joins and sorts need no null rules.
NULL_ID = -(2**63)
#: Words end at these bytes; they are the ones that bytes.split() takes.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
MASK64 = (1 << 64) - 1


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the session's checkpoint folder.

    A machine-local folder is made only for a session that runs in one JVM and names none, as in tests.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


@contextmanager
def small_batches(spark: SparkSession, most: int = 2000) -> Iterator[None]:
    """Arrow batches of at most so many rows while a stage is written: rows here hold whole texts, and a batch is off-heap memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(min(most, int(was)) if int(was) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_counted(big: DataFrame, keys: DataFrame, on: list[str], how: str = "inner", wide: bool = False, floor: int = 1000, most: int = 100_000) -> DataFrame:
    """big joined with keys, which has one row a key and, in n, the number of rows of big with it (and may lack keys).

    Keys with more than a 1/most share of the rows of `keys` (and than floor) are heavy, `most` of them at the utmost. They are
    broadcast, so that their rows stay where they are; if the rows of keys are wide, only the heavy keys' numbers are, and
    their rows are dealt out in shares of that bound, each to a copy of the key's row. All others meet by a shuffle.
    """
    total = keys.agg(F.sum("n")).first()[0] or 0
    bound = max(floor, total // most)
    if total <= bound:
        return big.join(keys, on, how)
    if wide:
        shares = F.ceil(F.col("n") / bound).cast("int")
        heavy = F.broadcast(keys.where(F.col("n") > bound).select(*on, shares.alias("shares")))
        dealt = big.join(heavy, on, "left").withColumn("share", F.coalesce(F.pmod(F.xxhash64(*big.columns), "shares"), F.lit(0)).cast("int")).drop("shares")
        return dealt.join(keys.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))), [*on, "share"], how).drop("share")
    heavy = keys.where(F.col("n") > bound)
    light = big.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(keys.where(F.col("n") <= bound), on, how)
    return light.unionByName(big.join(F.broadcast(heavy), on))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that text operators read, whatever else the table holds."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def plain_id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column), F.lit(NULL_ID))


def null_id(column: str = "doc_id") -> Column:
    return F.when(F.col(column) != NULL_ID, F.col(column))


def map_batches(df: DataFrame, schema: str, start: Callable[[], Callable[[pa.RecordBatch], dict | None]]) -> DataFrame:
    """mapInArrow with per-task state: start() runs once a task and returns the function of a batch.

    That function returns the output columns by name, or None for no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = start()
        for batch in chain.from_iterable(map(sliced, batches)):
            if (out := each(batch)) is not None:
                yield pa.RecordBatch.from_arrays([_as_array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def sliced(batch: pa.RecordBatch, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about so many bytes, so that a task's Python objects stay few whatever the session's batch size."""
    rows = max(1, int(batch.num_rows * most_bytes / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _as_array(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered up to a number of words; a word's hash never depends on what is remembered."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that scatters them."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def gram_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n words, by position."""
    size = len(word_hashes) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += mixed(word_hashes[i : i + size] + np.uint64(i + 1))
    return mixed(out)


def arrow_lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column out of numpy arrays, without a Python object for each value."""
    ends = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=ends[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))
