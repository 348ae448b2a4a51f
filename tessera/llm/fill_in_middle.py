"""Fill-in-the-middle: each text is cut into tokens, two hashed cuts part it into prefix, middle and suffix, and the parts are
written in another order behind marks.

One numpy kernel handles all rows of an Arrow batch at once, on the UTF-8 bytes as they lie in the batch: a table of byte classes
finds the spaces, a mask of neighbouring bytes finds where tokens begin, running sums that start anew with each document count
them, and one searchsorted finds both cuts of every row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
SEED = 42
#: Of 100 texts so many are rearranged, and of 100 of these so many in the order suffix, prefix, middle.
SHARE, SPM_SHARE = 50, 80
PLAIN, PSM, SPM = FORMS = ("plain", "psm", "spm")

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MARKED = np.zeros(256, bool)
_MARKED[list(b"PSM")] = True
_CONTINUES = (np.arange(256) & 0xC0) == 0x80
#: Output bytes that are gathered at a time, so that the index stays small whatever the length of a text.
_GATHER = 8 << 20


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 places where its rows begin; null rows are empty."""
    wide = pa.types.is_large_string(texts.type)
    ends = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)) if len(texts) else np.zeros(1, np.int32)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.empty(0, np.uint8)
    at = ends.astype(np.int64) - int(ends[0])
    return data[int(ends[0]) : int(ends[-1])], at


def _gather(source: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all pieces, one after the other."""
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for a in range(0, len(out), _GATHER):
        b = min(a + _GATHER, len(out))
        first, last = np.searchsorted(ends, a, "right"), np.searchsorted(ends, b, "left") + 1
        here = np.minimum(ends[first:last], b) - np.maximum(ends[first:last] - size[first:last], a)
        out[a:b] = source[np.repeat(begin[first:last] - ends[first:last] + size[first:last], here) + np.arange(a, b)]
    return out


def _chars(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Code points of each span."""
    before = np.concatenate([[0], np.cumsum(~_CONTINUES[data], dtype=np.int64)])
    return before[end] - before[begin]


def rearrange(texts: pa.Array, h: np.ndarray, share: int = SHARE, spm_share: int = SPM_SHARE) -> dict:
    """n, form, prefix_chars, middle_chars and output of every row of a batch; h has four unsigned numbers a row."""
    data, at = _buffers(texts)
    begin, end = at[:-1], at[1:]
    space = _SPACE[data]
    starts = np.empty(len(data), bool)
    starts[1:] = space[1:] & ~space[:-1]
    starts[begin[begin < end]] = True
    counted = np.cumsum(starts, dtype=np.int64 if len(data) >= 1 << 31 else np.int32)
    before = np.where(begin > 0, counted[np.maximum(begin, 1) - 1] if len(data) else 0, 0).astype(np.int64)
    n = np.where(end > 0, counted[np.maximum(end, 1) - 1] if len(data) else 0, 0).astype(np.int64) - before
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    # the byte where token number k of a row begins; behind its last token that is the row's end
    place = np.searchsorted(counted, (before[:, None] + cuts + 1).ravel(), "left").reshape(-1, 2)
    place = np.minimum(place, end[:, None])
    first, second = place[:, 0], place[:, 1]

    open_ = np.flatnonzero(data[:-2] == ord("<")) if len(data) > 2 else np.empty(0, np.int64)
    open_ = open_[(data[open_ + 2] == ord(">")) & _MARKED[data[open_ + 1]]]
    row = np.searchsorted(end, open_, "right")
    marked = np.zeros(len(n), bool)
    marked[row[open_ + 2 < end[row]]] = True

    plain = (n == 0) | marked | (h[:, 2] % 100 >= share)
    form = np.where(plain, 0, np.where(h[:, 3] % 100 < spm_share, 2, 1))
    # pieces of a row: mark, part, mark, part, mark, part; the marks lie behind the data
    p, s, m = len(data) + 3 * np.arange(3)
    full, zero, three = lambda v: np.full(len(n), v), np.zeros(len(n), np.int64), np.full(len(n), 3)
    parts = {"P": (full(p), three, begin, first - begin), "S": (full(s), three, second, end - second), "M": (full(m), three, first, second - first)}
    choice = [(begin, end - begin, zero, zero, zero, zero, zero, zero, zero, zero, zero, zero)]
    choice += [tuple(x for part in order for x in parts[part]) for order in ("PSM", "SPM")]
    pieces = np.stack([np.choose(form, each) for each in zip(*choice, strict=True)], axis=1).reshape(-1, 2)
    size = np.ascontiguousarray(pieces[:, 1])
    out = _gather(np.concatenate([data, np.frombuffer("".join(MARKS).encode(), np.uint8)]), np.ascontiguousarray(pieces[:, 0]), size)
    ends = np.concatenate([[0], np.cumsum(size.reshape(-1, 6).sum(axis=1))])
    small = ends[-1] < 1 << 31
    kind = pa.StringArray if small else pa.LargeStringArray
    return {
        "n": n,
        "form": pa.array(np.array(FORMS, dtype=object)[form], pa.string()),
        "prefix_chars": pa.array(_chars(data, begin, first), pa.int64(), mask=plain),
        "middle_chars": pa.array(_chars(data, first, second), pa.int64(), mask=plain),
        "output": kind.from_buffers(len(n), pa.py_buffer(ends.astype(np.int32 if small else np.int64)), pa.py_buffer(out)),
    }


def _draws(column: str, seed: int) -> Column:
    """Four unsigned 32-bit numbers out of the sha256 of seed:id."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def fill_in_middle(docs: DataFrame, seed: int = SEED, share: int = SHARE, spm_share: int = SPM_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n (tokens), form, prefix_chars, middle_chars, output.

    Null and empty texts have no tokens and stay plain and empty; texts that hold a mark stay as they are. Cuts depend on the id and
    the number of tokens alone, so rows of one id and text get the same output, and there are no ties to break: equal cuts give an
    empty middle. A null id draws as an empty one. Texts are read whole, however long; an empty table gives no rows; other columns
    are ignored.
    """
    kinds = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))

    def start():
        def each(batch: pa.RecordBatch):
            h = batch.column("h").flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
            return {"doc_id": batch.column("doc_id")} | rearrange(batch.column("text"), h, share, spm_share)

        return each

    return map_batches(rows.withColumn("h", _draws("doc_id", seed)), kinds, start)


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text that an output and its form were made from. A rearranged text holds each mark once, since texts with marks stay plain."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "<[PSM]>", -1)
    prefix, suffix = F.when(form == PSM, parts[1]).otherwise(parts[2]), F.when(form == PSM, parts[2]).otherwise(parts[1])
    return F.when(form == PLAIN, output).otherwise(F.concat(prefix, parts[3], suffix))


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored()).alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens
  FROM documents
), numbers AS (
  SELECT doc_id, text, tokens, CAST(len(tokens) AS BIGINT) AS n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM d
), cut AS (
  SELECT doc_id, text, n,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
         WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(tokens[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS prefix,
    array_to_string(tokens[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS middle,
    array_to_string(tokens[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS suffix
  FROM numbers
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM cut
"""
