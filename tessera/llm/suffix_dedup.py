"""Suffix-array dedup: bytes inside a 400-byte string that also starts elsewhere are removed.

Suffixes are sorted only at anchors: of the 100-byte grams in each 400-byte window the one with the smallest hash is the
window's anchor, so equal windows have equal anchors at equal offsets. Anchors whose gram is unique are done. The suffixes at
the others go, as front-coded sorted runs, to ranges of the anchor hash, where a loser tree that never re-compares a known
prefix merges them. Neighbours' common prefixes to the right, and the same of the left contexts, tell exactly which of an
anchor's windows occur again. Texts with equal bytes are one class with one representative.

Before the merge, anchors with equal windows become one entry. A gram that more entries hold than a task should gather
(`bound`) is split: they are dealt out by more of their bytes, half of the windows at a time, until each group fits. Every group
is merged and settled in the same way; none is gathered whole.
"""

from __future__ import annotations

import hashlib
import struct
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_lists, id_and_text, join_counted, map_batches, mixed, null_id, plain_id, sliced, stage
from .lcp_merge import common_prefix, common_suffix, front_code, merged

LENGTH, GRAM = 400, 100
#: Entries of a group that a task compares at once (about 3 MB); larger groups are split.
GROUP = 4096
#: Entries of a run, and of a part of the merge.
RUN, PART = 20_000, 10_000
_PLACE = 28  # low bits of a key that hold the position


class Rolling:
    """Hashes of all grams of a text from prefix sums modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.table = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(base | 1))
        self.up = self.down = np.ones(1, np.uint64)

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    def prefix(self, raw: bytes) -> np.ndarray:
        n = len(raw) + 1
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (self._powers(x, size) for x in (self.base, self.inverse))
        out = np.zeros(n, np.uint64)
        np.cumsum(self.table[np.frombuffer(raw, np.uint8)] * self.up[: n - 1], out=out[1:])
        return out

    def grams(self, prefix: np.ndarray, n: int) -> np.ndarray:
        size = len(prefix) - n
        return mixed((prefix[n:] - prefix[:-n]) * self.down[:size]) if size > 0 else np.empty(0, np.uint64)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    pad = -len(x) % w
    blocks = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(raw: bytes, rolling: Rolling, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram hash and position of each anchor, with the first and last window start that it stands for."""
    if len(raw) < length:
        none = np.empty(0, np.int64)
        return none.view(np.uint64), none, none, none
    hashes = rolling.grams(rolling.prefix(raw), gram)
    low = np.uint64((1 << _PLACE) - 1)
    keys = (hashes & ~low) | (np.arange(len(hashes), dtype=np.uint64) & low)
    best = _sliding_min(keys, length - gram + 1)
    first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    last = np.append(first[1:], len(best)) - 1
    start = first.astype(np.uint64)
    pos = ((start & ~low) | (best[first] & low)).astype(np.int64)
    pos = np.where(pos < first, pos + (1 << _PLACE), pos)
    return hashes[pos], pos, first, last


def _scan(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """One row for each document: its text's 128-bit fingerprint, size, digest and anchors."""

    def start():
        rolling = Rolling(0x9E3779B97F4A7C15)

        def each(batch: pa.RecordBatch):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            found = [anchors(t, rolling, length, gram) for t in texts]
            prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t) for t in texts), ">i8").reshape(-1, 2).astype(np.int64)
            return {
                "doc": batch.column("doc"), "tk": batch.column("tk"), "t1": prints[:, 0], "t2": prints[:, 1],
                "n_bytes": [len(t) for t in texts], "sha": [hashlib.sha256(t).hexdigest() for t in texts],
                "g": arrow_lists([f[0].view(np.int64) for f in found], pa.int64()), "pos": arrow_lists([f[1] for f in found], pa.int32()),
                "first": arrow_lists([f[2] for f in found], pa.int32()), "last": arrow_lists([f[3] for f in found], pa.int32()),
            }

        return each

    rows = map_batches(docs, "doc long, tk long, t1 long, t2 long, n_bytes long, sha string, g array<long>, pos array<int>, first array<int>, last array<int>", start)
    return rows.withColumn("row", F.monotonically_increasing_id())


def _candidate_texts(docs: DataFrame, reps: DataFrame) -> tuple[DataFrame, int]:
    """(row, packed text, anchors whose gram occurs again) of the representatives that have such, and the anchors' number."""
    each = reps.select("row", F.explode(F.arrays_zip("g", "pos", "first", "last")).alias("x")).select("row", "x.*")
    again = stage(each.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "grams")
    found = join_counted(each, again, ["g"]).select("row", F.struct("pos", "first", "last").alias("x"))
    wanted = stage(found.groupBy("row").agg(F.sort_array(F.collect_list("x")).alias("anchors")).join(reps.select("row", "doc", "tk"), "row"), "anchors")
    n = wanted.agg(F.sum(F.size("anchors"))).first()[0] or 0

    def start():
        pack = zstandard.ZstdCompressor(level=1)
        return lambda batch: {"doc": batch.column("doc"), "tk": batch.column("tk"), "packed": [pack.compress((t or "").encode()) for t in batch.column("text").to_pylist()]}

    packed = map_batches(docs, "doc long, tk long, packed binary", start)
    # a repeated row is the same text again; the join has brought both to one place
    return stage(packed.join(wanted, ["doc", "tk"]).dropDuplicates(["doc", "tk"]).select("row", "packed", "anchors"), "texts"), n


def _piece_hashes(pieces: DataFrame, length: int) -> DataFrame:
    """For pieces (offsets low..high of the range, of which the anchor has least..most) of texts: the hash of the bytes that all
    windows of the range share (c1, c2), and that of all bytes of the anchor's own windows (e1, e2)."""

    def start():
        unpack = zstandard.ZstdDecompressor()

        def each(batch: pa.RecordBatch):
            out: dict[str, list] = {c: [] for c in ("row", "pos", "low", "high", "least", "most", "core", "extent")}
            for row, packed, marks in zip(*(batch.column(c).to_pylist() for c in ("row", "packed", "pieces")), strict=True):
                raw = unpack.decompress(packed)
                for m in marks:
                    pos, low, high, least, most = (m[c] for c in ("pos", "low", "high", "least", "most"))
                    core = struct.pack("<II", low, high) + raw[pos - low : pos + length - high]
                    extent = struct.pack("<IIII", low, high, least, most) + raw[pos - most : pos + length - least]
                    for name, value in zip(out, (row, pos, low, high, least, most, xxhash.xxh3_128_digest(core), xxhash.xxh3_128_digest(extent)), strict=True):
                        out[name].append(value)
            if not out["row"]:
                return None
            cores, extents = (np.frombuffer(b"".join(out.pop(c)), ">i8").reshape(-1, 2).astype(np.int64) for c in ("core", "extent"))
            return out | {"c1": cores[:, 0], "c2": cores[:, 1], "e1": extents[:, 0], "e2": extents[:, 1]}

        return each

    return map_batches(pieces, "row long, pos int, low int, high int, least int, most int, c1 long, c2 long, e1 long, e2 long", start)


def _groups(texts: DataFrame, length: int, gram: int, bound: int) -> tuple[DataFrame, DataFrame]:
    """(row, lo, hi) of window starts known to occur again, and the entries (row, pos, least, most, key) of groups to merge.

    Anchors of a gram are a group. Anchors whose windows have equal bytes throughout are one entry: all their windows occur
    again. A group of more than `bound` entries is cut in two by the windows' offset and dealt out by the bytes that all
    windows of a half share, until it fits; a half of one offset has one entry for each different window, so the cutting ends.
    """
    whole = F.transform(
        "anchors",
        lambda m: F.struct(m["pos"].alias("pos"), F.lit(0).alias("low"), F.lit(length - gram).alias("high"), (m["pos"] - m["last"]).alias("least"), (m["pos"] - m["first"]).alias("most")),
    )
    pieces, again, entries = texts.select("row", "packed", whole.alias("pieces")), [], []
    while True:
        hashed = stage(_piece_hashes(pieces, length), "pieces")
        rep = F.min(F.struct("row", "pos", "low", "high", "least", "most")).alias("rep")
        classes = stage(hashed.groupBy("c1", "c2", "e1", "e2").agg(F.count("*").alias("n"), rep), "piece-classes")
        copied = join_counted(hashed, classes.where("n > 1").select("e1", "e2", "n"), ["e1", "e2"])
        again.append(copied.select("row", (F.col("pos") - F.col("most")).cast("long").alias("lo"), (F.col("pos") - F.col("least")).cast("long").alias("hi")))
        groups = classes.groupBy("c1", "c2").agg(F.count("*").alias("n")).where("n > 1")
        left = stage(join_counted(classes.select("c1", "c2", "rep"), groups, ["c1", "c2"]).select("c1", "n", "rep.*"), "piece-groups")
        entries.append(left.where(F.col("n") <= bound).select("row", "pos", "least", "most", F.col("c1").alias("key")))
        large = left.where(F.col("n") > bound)
        if large.isEmpty():
            return reduce(DataFrame.union, again), reduce(DataFrame.union, entries)
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.explode(F.array(
            F.struct("pos", "low", middle.alias("high"), "least", F.least("most", middle).alias("most")),
            F.struct("pos", (middle + 1).alias("low"), "high", F.greatest("least", middle + 1).alias("least"), "most"),
        ))
        cut = large.select("row", halves.alias("x")).where("x.least <= x.most").groupBy("row").agg(F.collect_list("x").alias("pieces"))
        pieces = cut.join(texts.select("row", "packed"), "row").select("row", "packed", "pieces")


def _runs(texts: DataFrame, parts: int, length: int) -> DataFrame:
    """(part, run): front-coded sorted runs of the suffixes of texts' entries (pos, least, most, key) for each range of keys."""

    def run(batches):
        unpack, held, n = zstandard.ZstdDecompressor(), {}, 0

        def flush():
            those = sorted(held)
            blobs = [front_code(sorted(held[p])) for p in those]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(those, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "run"])

        for batch in chain.from_iterable(map(sliced, batches)):
            for row, packed, marks in zip(*(batch.column(c).to_pylist() for c in ("row", "packed", "entries")), strict=True):
                raw = unpack.decompress(packed)
                for m in marks:
                    pos, least, most = m["pos"], m["least"], m["most"]
                    key = m["key"] & ((1 << 64) - 1)
                    entry = (key.to_bytes(8, "big") + raw[pos : pos + length - least], raw[pos - most : pos], row, pos, least, most)
                    held.setdefault(key * parts >> 64, []).append(entry)
                    n += 1
                if n >= RUN:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    return texts.mapInArrow(run, "part int, run binary")


def repeated_windows(members: list[tuple[bytes, int, tuple]], length: int) -> list[list[tuple[int, int]]]:
    """For anchors in the order of their suffixes, each with the common prefix with the one before (8 bytes are the hash):
    the ranges of offsets d for which the window from d bytes before the anchor on occurs at another anchor, too."""
    lefts, n = [m[2][0] for m in members], len(members)
    bounds = [(m[2][3], m[2][4]) for m in members]
    if n == 2:
        lo, hi = length - (members[1][1] - 8), common_suffix(*lefts)
        return [[(max(lo, a), min(hi, b))] if max(lo, a) <= min(hi, b) else [] for a, b in bounds]
    right = np.array([m[1] - 8 for m in members])
    right[0] = -1
    order = sorted(range(n), key=lambda i: lefts[i][::-1])
    left = np.array([-1] + [common_suffix(lefts[a], lefts[b]) for a, b in zip(order, order[1:], strict=False)])
    order = np.array(order)
    # between two of these offsets, who agrees with whom does not change
    cuts = np.unique(np.concatenate([[0], left[1:] + 1, length - right[1:]]))
    cuts = cuts[(cuts >= 0) & (cuts <= length)]
    least, most = (np.array(x) for x in zip(*bounds, strict=True))
    out: list[list[tuple[int, int]]] = [[] for _ in members]
    for d, end in zip(cuts.tolist(), [*(cuts[1:] - 1).tolist(), length], strict=True):
        if d > most.max() or end < least.min():
            continue
        by_left = np.empty(n, np.int64)
        by_left[order] = np.cumsum(left < d)
        # an own left context shorter than d has no such window; its range is cut by `most` below
        _, at, count = np.unique(by_left * (n + 1) + np.cumsum(right < length - d), return_inverse=True, return_counts=True)
        for i in np.flatnonzero((count[at] > 1) & (most >= d) & (least <= end)).tolist():
            out[i].append((max(d, int(least[i])), min(end, int(most[i]))))
    return out


def _from_runs(runs: DataFrame, parts: int, length: int) -> DataFrame:
    """(row, lo, hi): ranges of window starts that occur again, by merging the runs of each range."""

    def merge(table: pa.Table) -> pa.Table:
        rows, los, his = [], [], []
        group: list[tuple[bytes, int, tuple]] = []

        def settle():
            if len(group) > 1:
                for (_, _, (_, row, pos, _, _)), found in zip(group, repeated_windows(group, length), strict=True):
                    for a, b in found:
                        rows.append(row)
                        los.append(pos - b)
                        his.append(pos - a)
            group.clear()

        for entry in merged(table.column("run").to_pylist()):
            if group and entry[1] < 8:
                settle()
            group.append(entry)
        settle()
        return pa.table({"row": pa.array(rows, pa.int64()), "lo": pa.array(los, pa.int64()), "hi": pa.array(his, pa.int64())})

    # as many partitions as parts, so that no task gathers more than a few of them
    return runs.repartition(parts, "part").groupBy("part").applyInArrow(merge, "row long, lo long, hi long")


def _spans(starts: DataFrame, length: int) -> DataFrame:
    """(row, runs of bytes to remove) from ranges of window starts; a row's ranges are met in order, not gathered."""
    by_start = W.partitionBy("row").orderBy("lo", "hi")
    reach = F.max("hi").over(by_start.rowsBetween(W.unboundedPreceding, -1))
    begins = starts.withColumn("begins", F.coalesce(F.col("lo") > reach + length, F.lit(True)).cast("long"))
    runs = begins.withColumn("run", F.sum("begins").over(by_start.rowsBetween(W.unboundedPreceding, 0)))
    spans = runs.groupBy("row", "run").agg(F.min("lo").alias("start"), (F.max("hi") + length).alias("end"))
    return spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bound: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (array of start, end in bytes: the maximal runs to remove) and kept_sha256 for each row of docs.

    Null and empty texts have no bytes; repeated rows are copies of each other, whatever their ids, and lose all from `length`
    bytes on; texts shorter than length keep all; texts of any length are judged whole (a text of one repeated byte has an
    anchor a byte); which of equal rows represents them changes no result; an empty table gives no rows; other columns are
    ignored.
    """
    docs = id_and_text(docs, id_col, text_col).select(plain_id().alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tk"), "text")
    rows = stage(_scan(docs, length, gram), "scan")
    classes = stage(rows.groupBy("t1", "t2").agg(F.min("row").alias("row"), F.count("*").alias("n")), "classes")
    reps = rows.join(classes.select("row"), "row")
    texts, n = _candidate_texts(docs, reps)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // PART + 1)
    known, entries = _groups(texts, length, gram, bound)
    by_row = entries.groupBy("row").agg(F.collect_list(F.struct("pos", "least", "most", "key")).alias("entries"))
    runs = _runs(by_row.join(texts.select("row", "packed"), "row").select("row", "packed", "entries"), parts, length)
    starts = known.union(_from_runs(runs, parts, length))
    by_row = _spans(starts, length).join(texts.select("row", "packed"), "row")

    def start():
        unpack = zstandard.ZstdDecompressor()

        def each(batch: pa.RecordBatch):
            digests = []
            for runs, packed in zip(batch.column("spans").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                raw = unpack.decompress(packed)
                edges = [0, *(x for r in runs for x in (r["start"], r["end"])), len(raw)]
                digests.append(hashlib.sha256(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))).hexdigest())
            return {"row": batch.column("row"), "spans": batch.column("spans"), "cut_sha": digests}

        return each

    cut = map_batches(by_row, "row long, spans array<struct<start: long, end: long>>, cut_sha string", start)
    out = join_counted(rows.select("row", "doc", "t1", "t2", "n_bytes", "sha"), classes.where("n > 1").select("t1", "t2", "n"), ["t1", "t2"], "left").join(cut, "row", "left")
    copied = F.col("n").isNotNull() & (F.col("n_bytes") >= length)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")
    return out.select(
        null_id("doc").alias("doc_id"), "n_bytes", F.when(copied, whole).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )


def op8_anchored_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
