"""Incremental upserts: a file stream folded into one state a key, exactly once, by foreachBatch.

Each batch writes its own folded states as one version of a log, so a batch that is run again after a failure overwrites its
own version, no batch rewrites the archive, and the result does not depend on how rows are dealt into batches. Reading folds
the last base with the versions after it; compact() writes a new base.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import folded, refolded, state_rows


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    """What is committed under path, None for nothing; a folder that cannot be read is an error."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # no folder, or one without versions
            return None
        raise


def _states(spark: SparkSession, archive: str, key: str) -> DataFrame | None:
    log, base = (_versions(spark, f"{archive}/{x}") for x in ("log", "base"))
    if base is None:
        return log if log is None else refolded(log.drop("archive_version"), key)
    last = base.agg(F.max("archive_version")).first()[0]
    whole = base.where(F.col("archive_version") == last).drop("archive_version")
    if log is None:  # its versions were deleted after a compaction
        return refolded(whole, key)
    return refolded(whole.unionByName(log.where(F.col("archive_version") > last).drop("archive_version")), key)


def read_archive(spark: SparkSession, archive: str, key: str, order: str) -> DataFrame | None:
    """The rows of an archive, None where nothing was written."""
    states = _states(spark, archive, key)
    return states if states is None else state_rows(states, key, order)


def compact(spark: SparkSession, archive: str, key: str) -> None:
    """Write all versions so far as a base; they can then be deleted."""
    states, log = _states(spark, archive, key), _versions(spark, f"{archive}/log")
    if log is not None and (last := log.agg(F.max("archive_version")).first()[0]) is not None:
        states.write.mode("overwrite").parquet(f"{archive}/base/archive_version={last}")


def stream_into_archive(spark: SparkSession, source: DataFrame, archive: str, checkpoint: str, key: str, order: str, status: str, ranks: dict[str, int]) -> DataFrame | None:
    """Run the stream to its end and return the archive's rows; a restart without new files returns what is there."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        folded(batch, key, order, ranks, status).write.mode("overwrite").parquet(f"{archive}/log/archive_version={batch_id}")

    query = source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return read_archive(spark, archive, key, order)


def windowed_counts(events: DataFrame, ts: str, by: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by tumbling window; rows later than the watermark are dropped when this runs as a stream."""
    stamped = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    return stamped.withWatermark("_ts", late).groupBy(F.window("_ts", width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("window_start"), by, "n", "total")
