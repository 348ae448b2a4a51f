"""Quality rules by compression bands: zstandard ratios of the whole document and of fixed chunks reject text that is
repetitive (it shrinks too well) or incompressible (it hardly shrinks), with limits by length.

How well clean text shrinks grows with its length, so limits that fit all lengths catch little. limits_of() learns them from
all good rows of the allowed folds: the ratio to be expected at a length, and how far good rows of like length stray from it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WordHashes, arrow_lists, gram_hashes, id_and_text, map_batches, stage
from .sampling import fold

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """Limits of bytes / compressed bytes for documents of up to `upto` bytes; outside them a document is rejected."""

    upto: float
    least: float
    most: float


#: Without good rows to learn from. Short texts carry the frame's cost and no context, so they shrink less; long ones share more of their vocabulary.
BANDS = (Band(256, 0.0, 3.0), Band(1024, 1.05, 3.0), Band(4096, 1.2, 3.2), Band(16_384, 1.4, 3.6), Band(float("inf"), 1.5, 5.0))
CHUNK = 4096
#: For chunks: their limits, and the share of chunks that may lie outside them.
CHUNK_BAND = Band(CHUNK, 1.2, 3.4)
CHUNK_SHARE = 0.3


def base_counts(text: str | None, hashes: WordHashes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    raw = (text or "").encode()
    words = raw.split()
    bare = raw.translate(None, SPACE)
    chars = len(bare) if bare.isascii() else len(bare.decode())
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    grams = gram_hashes(hashes.of(words), 3)
    again = 0
    if len(grams):
        order = np.argsort(grams, kind="stable")
        same = grams[order][1:] == grams[order][:-1]
        twice = np.zeros(len(grams) + 2, bool)
        found = np.zeros(len(grams), bool)
        found[order[1:][same]] = True
        found[order[:-1][same]] = True
        for shift in range(3):
            twice[shift : shift + len(grams)] |= found
        again = int(twice.sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), again


def ratios(raw: bytes, compressor: zstandard.ZstdCompressor, chunk: int = CHUNK) -> tuple[float, list[float]]:
    """bytes / compressed bytes of the whole text and of its full chunks; 1 for an empty text.

    What is left over after them counts with the bytes before it, as a chunk that ends at the text's end.
    """
    if not raw:
        return 1.0, []
    whole = len(raw) / len(compressor.compress(raw))
    starts = list(range(0, len(raw) - chunk + 1, chunk))
    if starts and len(raw) % chunk:
        starts.append(len(raw) - chunk)
    return whole, [chunk / len(compressor.compress(raw[i : i + chunk])) for i in starts]


def verdict(size: int, whole: float, chunks: list[float], bands: tuple[Band, ...], chunk_band: Band, chunk_share: float) -> str:
    """'' or why the compression bands reject a text."""
    band = next(b for b in bands if size <= b.upto)
    if whole > band.most:
        return "repetitive"
    if whole < band.least:
        return "incompressible"
    for why, n in (("repetitive chunks", sum(r > chunk_band.most for r in chunks)), ("incompressible chunks", sum(r < chunk_band.least for r in chunks))):
        if n > chunk_share * len(chunks):
            return why
    return ""


@dataclass(frozen=True)
class Limits:
    """What quality_rules() rejects by."""

    bands: tuple[Band, ...] = BANDS
    chunk_band: Band = CHUNK_BAND


def fit(sizes: np.ndarray, whole: np.ndarray, chunks: np.ndarray, least_rows: int = 60, share: float = 0.005, slack: float = 0.6, groups: int = 4, times: np.ndarray | None = None, chunk_times: np.ndarray | None = None) -> Limits:
    """Limits from the bytes and whole ratios of good texts, and the ratios of their chunks; times: how often each occurs (once).

    The expected ratio is a parabola over the logarithm of the length; in `groups` ranges of length with equally many rows the
    limits lie at the `share` and 1 - share quantiles of the distance from it, and `slack` standard deviations further out. Bands are quarters of an octave. Lengths that no good
    row has, and tables with fewer than least_rows of them, keep the limits of BANDS and CHUNK_BAND.
    """
    times = np.ones(len(sizes), np.int64) if times is None else times
    chunk_times = np.ones(len(chunks), np.int64) if chunk_times is None else chunk_times
    if times.sum() < least_rows:
        return Limits()
    x = np.log2(sizes)
    shape = np.polyfit(x, whole, 2, w=np.sqrt(times))
    away = whole - np.polyval(shape, x)
    ends = _quantiles(x, times, np.linspace(0, 1, groups + 1))
    ends[-1] += 1e-9
    of = [(x >= a) & (x < b) for a, b in zip(ends, ends[1:], strict=False)]
    near = [(a, b, *_outer(away[g], times[g], share, slack)) for a, b, g in zip(ends, ends[1:], of, strict=False) if times[g].sum() >= least_rows / groups] or [(ends[0], ends[-1], *_outer(away, times, share, slack))]
    fixed = lambda size: next(b for b in BANDS if size <= b.upto)
    cuts = sorted({int(2 ** (k / 4)) for k in range(int(4 * ends[0]), int(4 * ends[-1]) + 1)} | {b.upto for b in BANDS[:-1]} | {int(sizes.min()) - 1, int(sizes.max())})
    bands, before = [], 1
    for upto in cuts:
        if before < sizes.min() or upto > sizes.max():
            bands.append(Band(upto, fixed(upto).least, fixed(upto).most))
        else:
            a, b = np.log2(before), np.log2(upto)
            expected = np.polyval(shape, [a, b])
            touched = [n for n in near if n[0] <= b and n[1] >= a] or near
            bands.append(Band(upto, float(expected.min() + min(n[2] for n in touched)), float(expected.max() + max(n[3] for n in touched))))
        before = upto + 1
    bands.append(Band(float("inf"), BANDS[-1].least, BANDS[-1].most))
    if chunk_times.sum() < least_rows:
        return Limits(tuple(bands))
    low, high = _outer(chunks, chunk_times, share, slack)
    return Limits(tuple(bands), Band(CHUNK, float(low), float(high)))


def _quantiles(values: np.ndarray, times: np.ndarray, shares) -> np.ndarray:
    """np.quantile of values that occur so many times each."""
    order = np.argsort(values, kind="stable")
    ends = np.cumsum(times[order])
    at = np.asarray(shares) * (ends[-1] - 1)
    low, high = (values[order][np.searchsorted(ends, np.asarray(i, np.int64), side="right")] for i in (np.floor(at), np.ceil(at)))
    return low + (high - low) * (at - np.floor(at))


def _outer(values: np.ndarray, times: np.ndarray, share: float, slack: float) -> np.ndarray:
    mean = np.average(values, weights=times)
    return _quantiles(values, times, [share, 1 - share]) + np.array([-slack, slack]) * np.sqrt(np.average((values - mean) ** 2, weights=times))


def limits_of(measures: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held_out: int = 2) -> Limits:
    """Limits learned from all rows of measured() that are labelled good outside the held-out fold and whose base rule holds.

    Rows are counted by length to 1/64 of an octave and ratio to 1/100, chunks by ratio to 1/1000; lengths and ratios are bounded,
    so the counts that reach the driver are, however many the rows.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y = 1")
    good = measures.where("n_words >= 50 and 100 * n_repeat_words <= 50 * n_words").join(marks.where(fold("doc_id", folds) != held_out).select("doc_id").distinct(), "doc_id", "left_semi")
    counted = good.groupBy(F.round(64 * F.log2("size")).alias("x"), F.round("whole", 2).alias("whole")).agg(F.count("*").alias("n"), F.min("size").alias("least"), F.max("size").alias("most")).toPandas().sort_values(["x", "whole"])
    parts = good.select(F.explode("parts").alias("r")).groupBy(F.round("r", 3).alias("r")).agg(F.count("*").alias("n")).toPandas().sort_values("r")
    if not len(counted):
        return Limits()
    # the outermost lengths are exact: beyond them the fixed limits hold
    sizes = np.clip(2 ** (counted["x"].to_numpy(float) / 64), counted["least"].min(), counted["most"].max())
    sizes[sizes.argmin()], sizes[sizes.argmax()] = counted["least"].min(), counted["most"].max()
    return fit(sizes, counted["whole"].to_numpy(float), parts["r"].to_numpy(float), times=counted["n"].to_numpy(np.int64), chunk_times=parts["n"].to_numpy(np.int64))


def fit_limits(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held_out: int = 2, chunk: int = CHUNK, level: int = 3, id_col: str = "doc_id", text_col: str = "text") -> Limits:
    """limits_of() the texts of docs."""
    return limits_of(stage(measured(docs, chunk, level, id_col, text_col), "measures"), labels, label, folds, held_out)


def base_fails(counts: tuple[int, int, int, int, int]) -> bool:
    return counts[0] < 50 or 100 * counts[4] > 50 * counts[0]


MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, size long, whole double, parts array<double>"
JUDGED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, zstd_ratio double, chunk_ratio_max double, reason string"


def measured(docs: DataFrame, chunk: int = CHUNK, level: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: the base counts, the text's bytes, its ratio and those of its chunks."""

    def start():
        hashes, compressor = WordHashes(), zstandard.ZstdCompressor(level=level)

        def each(batch: pa.RecordBatch):
            rows = []
            for text in batch.column("text").to_pylist():
                raw = (text or "").encode()
                rows.append((*base_counts(text, hashes), len(raw), *ratios(raw, compressor, chunk)))
            names = [x.split()[0] for x in MEASURES.split(", ")[1:]]
            out = dict(zip(names, zip(*rows, strict=True), strict=True))
            return {"doc_id": batch.column("doc_id")} | out | {"parts": arrow_lists([np.array(p, float) for p in out["parts"]], pa.float64())}

        return each

    return map_batches(id_and_text(docs, id_col, text_col), MEASURES, start)


def judged(measures: DataFrame, limits: Limits = Limits(), chunk_share: float = CHUNK_SHARE) -> DataFrame:
    """The rows of measured() with base_failed, kept, zstd_ratio, chunk_ratio_max and reason by the limits."""

    def start():
        def each(batch: pa.RecordBatch):
            names = [x.split()[0] for x in MEASURES.split(", ")]
            rows = []
            for _, *counts, size, whole, parts in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                failed = base_fails(counts)
                why = verdict(size, whole, parts, limits.bands, limits.chunk_band, chunk_share)
                rows.append((*counts, failed, not failed and not why, whole, max(parts, default=whole), "base" if failed else why))
            return {"doc_id": batch.column("doc_id")} | dict(zip([x.split()[0] for x in JUDGED.split(", ")[1:]], zip(*rows, strict=True), strict=True))

        return each

    return map_batches(measures, JUDGED, start)


def quality_rules(docs: DataFrame, limits: Limits = Limits(), chunk: int = CHUNK, chunk_share: float = CHUNK_SHARE, level: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: the base counts, base_failed, zstd_ratio, chunk_ratio_max, reason, kept.

    Null or empty text has no words and fails the base rule; repeated rows each get a row; an empty table gives none;
    other columns are ignored. Texts are read whole, however long; a ratio at a limit is kept.
    """
    return judged(measured(docs, chunk, level, id_col, text_col), limits, chunk_share)


def op3_compression_bands(spark, sf_dir: str) -> DataFrame:
    measures = stage(measured(spark.read.parquet(f"{sf_dir}/documents.parquet")), "measures")
    return judged(measures, limits_of(measures, spark.read.parquet(f"{sf_dir}/labels.parquet")))
