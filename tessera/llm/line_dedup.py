"""Line dedup: hashes of line keys are range-partitioned with a secondary sort by document and position; one pass over the
sorted rows finds each key's first document, and what travels back to a document is a compressed keep bitmap, not text.

The range boundaries are drawn over (hash, document, position), so a line that a third of all documents hold is spread
over many ranges. A key whose rows cross a boundary is settled afterwards from one row for each range.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, plain_id, stage

MIN_KEY = 10
_SPACE = " \t\n\x0b\x0c\r"


def line_key(line: str) -> str:
    """A line without space at its ends and with A-Z lower-cased."""
    bare = line.strip(_SPACE)
    return bare.lower() if bare.isascii() else bare.encode().lower().decode()


def _hashes(min_key: int):
    def start():
        def each(batch: pa.RecordBatch):
            digests, row_of, pos_of = [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                for pos, line in enumerate(text.split("\n") if text else ()):
                    key = line_key(line)
                    if len(key) >= min_key:
                        digests.append(xxhash.xxh3_128_digest(key.encode()))
                        row_of.append(row)
                        pos_of.append(pos)
            if not digests:
                return None
            h = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
            at = pa.array(row_of, pa.int32())
            return {"h1": h[:, 0], "h2": h[:, 1], "doc": batch.column("doc").take(at), "tk": batch.column("tk").take(at), "pos": pos_of}

        return each

    return start


def _first_occurrences(batches):
    """Over rows sorted by (h1, h2, doc, tk, pos): the rows to drop (kind 0); the rows of the range's first key, which may
    have begun in an earlier range (kind 1); and the first row of its last key (kind 2)."""
    schema = pa.schema([("kind", pa.int8()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("tk", pa.int64()), ("pos", pa.int32())])
    key = lead = None  # the key at hand, and the first key of this range
    first = (0, 0, 0)
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        lead = lead or (h1[0], h2[0])
        begins = np.empty(len(h1), bool)
        begins[0] = key != (h1[0], h2[0])
        begins[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        start = np.maximum.accumulate(np.where(begins, np.arange(len(h1)), -1))
        owner = np.where(start >= 0, doc[start], first[0])
        leading = (h1 == lead[0]) & (h2 == lead[1])
        kind = np.where(leading, 1, np.where(doc != owner, 0, 9)).astype(np.int8)
        out = pa.RecordBatch.from_arrays([pa.array(kind), *batch.columns[:4], batch.column(4).cast(pa.int32())], schema=schema)
        yield out.filter(pa.array(kind != 9))
        if start[-1] >= 0:
            first = (doc[start[-1]], batch.column(3)[int(start[-1])].as_py(), batch.column(4)[int(start[-1])].as_py())
        key = (h1[-1], h2[-1])
    if key is not None and key != lead:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((2, *key, *first), schema, strict=True)], schema=schema)


def _bitmap(positions: list[int]) -> bytes:
    keep = np.ones(max(positions) // 8 * 8 + 8, np.uint8)  # whole bytes, so that padding keeps lines
    keep[positions] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def dropped_lines(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """The keep flags of a document's lines, from its bitmap; lines past the bitmap's end stay."""
    keep = np.ones(n_lines, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n_lines]
        keep[: len(bits)] = bits == 1
    return keep


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and text with the key of a row: its id and a hash of its text, as rows may repeat an id."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *[docs[c].alias(f"carry_{c}") for c in carry])
    return rows.withColumns({"doc": plain_id(), "tk": F.xxhash64(F.coalesce("text", F.lit("")))})


def keep_bitmaps(rows: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """(doc, tk, keep) of the rows of keyed() that lose lines; keep is a zlib-compressed bitmap, one bit a line."""
    lines = stage(map_batches(rows.select("doc", "tk", "text"), "h1 long, h2 long, doc long, tk long, pos int", _hashes(min_key)), "line-keys")
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["h1", "h2", "doc", "tk", "pos"]
    ranges = lines.repartitionByRange(n, *order).sortWithinPartitions(*order)
    found = stage(ranges.mapInArrow(_first_occurrences, "kind byte, h1 long, h2 long, doc long, tk long, pos int"), "line-finds")
    # one key a range at most, so this side has at most one row for each range
    owners = found.where("kind > 0").groupBy("h1", "h2").agg(F.min("doc").alias("owner"))
    crossing = found.where("kind = 1").join(F.broadcast(owners), ["h1", "h2"]).where("doc <> owner")
    drops = found.where("kind = 0").select("doc", "tk", "pos").unionByName(crossing.select("doc", "tk", "pos"))
    bitmap = F.udf(_bitmap, "binary", useArrow=True)
    return drops.groupBy("doc", "tk").agg(F.sort_array(F.collect_set("pos")).alias("pos")).select("doc", "tk", bitmap("pos").alias("keep"))


def dedup_lines(docs: DataFrame, min_key: int = MIN_KEY, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, kept_text, n_lines, n_dropped for each row of docs, with the columns of carry.

    A line whose key has min_key code points and is in two documents or more stays only in the smallest doc_id. Null or
    empty text is one empty line (kept_text ''); a null doc_id counts as one document that comes before all others; rows
    that share a doc_id are one document and keep or lose a line together; other columns are ignored.
    """
    rows = keyed(docs, id_col, text_col, carry)
    both = rows.join(keep_bitmaps(rows, min_key), ["doc", "tk"], "left").drop("doc", "tk")
    carried = [c for c in rows.columns if c.startswith("carry_")]

    def start():
        def each(batch: pa.RecordBatch):
            out, lines_of, dropped = [], [], []
            for text, bitmap in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist(), strict=True):
                lines = (text or "").split("\n")
                lines_of.append(len(lines))
                if bitmap is None:
                    out.append(text or "")
                    dropped.append(0)
                    continue
                keep = dropped_lines(bitmap, len(lines))
                out.append("\n".join(x for x, k in zip(lines, keep, strict=True) if k))
                dropped.append(int(len(keep) - keep.sum()))
            return {"doc_id": batch.column("doc_id"), "kept_text": out, "n_lines": lines_of, "n_dropped": dropped} | {c: batch.column(c) for c in carried}

        return each

    kinds = "doc_id long, kept_text string, n_lines long, n_dropped long" + "".join(f", `{c}` {t}" for c, t in rows.dtypes if c in carried)
    return map_batches(both, kinds, start).select("doc_id", "kept_text", "n_lines", "n_dropped", *[F.col(f"carry_{c}").alias(c) for c in carry])


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP2_SQL = """
WITH lines AS (
  SELECT doc_id, u.i AS pos, s[u.i] AS line,
         translate(trim(s[u.i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents) d, unnest(range(1, len(s) + 1)) AS u(i)),
shared AS (SELECT k, min(doc_id) AS owner FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
flagged AS (SELECT l.*, s.k IS NOT NULL AND s.owner <> l.doc_id AS dropped FROM lines l LEFT JOIN shared s ON l.k = s.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM flagged GROUP BY doc_id"""
