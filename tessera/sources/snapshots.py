"""Published snapshots of a table: each publication is a folder of Parquet files, and a manifest row written after it makes it count.

Readers go by the manifest, so they see the last whole publication or nothing, also while a job writes or after it died; what such a job left has no
manifest row and a name that is never used again. One job at a time publishes under a root. A manifest has one row a publication and is read as a table;
only its newest row reaches the driver. Files are shared by all executors (root is a folder of the cluster's file system)."""

from __future__ import annotations

import json
import uuid
from hashlib import sha256

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MANIFEST = "version long, label string, folder string, rows long, checksum string, note string"


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The publications under root: version (from 1), label, folder, rows, checksum, note; none where nothing was published."""
    fs, path = _files(spark, f"{root}/manifest")
    if not fs.exists(path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", True).json(f"{root}/manifest").where("version is not null")


def _newest(spark: SparkSession, root: str, label: str | None = None):
    rows = manifest(spark, root)
    rows = rows if label is None else rows.where(F.col("label") == label)
    return rows.orderBy(F.desc("version")).first()


def checksum(table: DataFrame) -> tuple[int, str]:
    """Rows and a checksum of a table that does not depend on the order of its rows or columns and tells nulls from empty texts; repeated rows count."""
    row = F.sha2(F.to_json(F.struct(*sorted(table.columns)), {"ignoreNullFields": "false"}), 256)
    got = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("s")).first()
    return got["n"], f"{got['n']}-{got['s']}"


def publish(table: DataFrame, root: str, label: str, least: int = 0, share: float = 0.0, note: dict | None = None) -> str:
    """Publish a table under a label, one of 'published', 'unchanged' and 'refused'.

    It is refused with fewer rows than `least` or than that share of the newest publication, and unchanged where the newest publication has its label and
    content. What was written is read again for the counts, so the manifest tells of what readers will find. Publishing a label again replaces it for
    readers; other labels stay."""
    spark = table.sparkSession
    folder = f"{root}/data/{uuid.uuid4().hex}"
    table.write.parquet(folder)
    rows, found = checksum(spark.read.schema(table.schema).parquet(folder))
    last = _newest(spark, root)
    outcome = "published"
    if rows < least or (last is not None and rows < share * last["rows"]):
        outcome = "refused"
    elif last is not None and (last["label"], last["checksum"]) == (label, found):
        outcome = "unchanged"
    if outcome != "published":
        _delete(spark, folder)
        return outcome
    entry = (last["version"] + 1 if last else 1, label, folder.rsplit("/", 1)[1], rows, found, json.dumps(note, sort_keys=True) if note else None)
    spark.createDataFrame([entry], MANIFEST).coalesce(1).write.mode("append").json(f"{root}/manifest/{entry[0]:012d}")
    return outcome


def current(spark: SparkSession, root: str, label: str | None = None) -> DataFrame:
    """The newest publication, or the newest one of a label; an error where there is none."""
    last = _newest(spark, root, label)
    if last is None:
        raise LookupError(f"nothing was published under {root}" + (f" as {label}" if label else ""))
    return spark.read.parquet(f"{root}/data/{last['folder']}")


def labels(spark: SparkSession, root: str) -> DataFrame:
    """The newest publication of each label."""
    return manifest(spark, root).withColumn("_rn", F.row_number().over(W.partitionBy("label").orderBy(F.desc("version")))).where("_rn = 1").drop("_rn")


def patch(updates: DataFrame, root: str, key: str, columns: dict[str, Column], note: dict | None = None) -> str:
    """Publish the newest publication again under its label with other values in some columns: for rows whose key updates has (once), the given
    expressions over updates' columns; all other rows and columns stay, so what a column says of the publication's age is not touched."""
    spark = updates.sparkSession
    last = _newest(spark, root)
    table = current(spark, root)
    new = updates.select(F.col(key).alias("_key"), *[c.alias(f"_new_{n}") for n, c in columns.items()])
    joined = table.join(new, F.col(key) == F.col("_key"), "left")
    out = joined.select(*[F.when(F.col("_key").isNotNull(), F.col(f"_new_{c}")).otherwise(F.col(c)).cast(table.schema[c].dataType).alias(c) if c in columns else F.col(c) for c in table.columns])
    return publish(out, root, last["label"], least=last["rows"], note=note)


def pending(found: DataFrame, root: str, most: int) -> DataFrame:
    """The first `most` labels of found (label) that were never published, in order: what a run that may be stopped and started again does next."""
    return found.select("label").distinct().join(manifest(found.sparkSession, root).select("label").distinct(), "label", "left_anti").orderBy("label").limit(most)


def prune(spark: SparkSession, root: str, keep: int) -> int:
    """Delete the data of all but the newest publication of each of the last `keep` labels, the newest publication of all always staying. The manifest
    keeps its rows. Readers that began before may fail and begin again. Returns the number of folders deleted."""
    rows = labels(spark, root)
    kept = rows.orderBy(F.desc("label")).limit(keep).unionByName(rows.orderBy(F.desc("version")).limit(1)).select("folder").distinct()
    gone = manifest(spark, root).select("folder").distinct().join(kept, "folder", "left_anti")
    return sum(_delete(spark, f"{root}/data/{r.folder}") for r in gone.toLocalIterator())


def _delete(spark: SparkSession, path: str) -> bool:
    fs, p = _files(spark, path)
    return bool(fs.delete(p, True))


def open_once(spark: SparkSession, root: str, window: str, rules: dict) -> bool:
    """Whether these rules may see a held-out window: the first rules that ask may, also again, and no others ever, since a window that is opened under new
    rules is no longer held out. The ledger is a file a window, made only if it is not there, that holds the hash of the rules."""
    found = sha256(json.dumps(rules, sort_keys=True).encode()).hexdigest()
    fs, p = _files(spark, f"{root}/opened/{sha256(window.encode()).hexdigest()}")
    if not fs.exists(p):
        try:
            out = fs.create(p, False)
        except Py4JJavaError as e:  # another job was first
            if not fs.exists(p):
                raise e
        else:
            out.write(bytearray(found.encode()))
            out.close()
    held = spark.read.text(p.toString()).first()  # one line; none while another job writes it
    return held is not None and held["value"] == found
