"""Best-fit packing of token pieces into sequences by linear grouping.

Only the histogram of piece lengths (one count a length, so at most `capacity` rows at any input size) reaches the
driver. There, large lengths are rounded up within groups of equal cardinality, configurations of these few sizes are
optimised, actual lengths take the places of their groups, and small lengths are best-fitted into what is left. Pieces of
one length are interchangeable, so the plan says which ranks of a length go where; ranks are dealt out by Spark.
"""

from __future__ import annotations

import functools
import string
import unicodedata
import zlib
from collections import defaultdict
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_lists, id_and_text, map_batches, stage

CAPACITY = 2048


def byte_letters() -> str:
    """The public byte-to-letter table of byte-level BPE: printable Latin-1 stands for itself, other bytes follow from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in own else chr(next(others)) for b in range(256))


class Encoder:
    """Token ids of whole texts, found space-separated chunk by chunk; the ids of a chunk are remembered, up to a number;
    when that is reached, those that were met again stay.

    The tokenizer lower-cases, drops white space and never joins across it or between a letter and ASCII punctuation other than
    an apostrophe, so A-Z can be lower-cased first, chunks are independent, and the punctuation at a word's end has ids of its
    own. A new word of lower-case Latin letters goes to the tokenizer's model right away, as normalising and splitting would
    leave it as it is; others go through the whole tokenizer.
    """

    TAIL = string.punctuation.replace("'", "")
    LATIN = frozenset(chr(c) for c in range(0x61, 0x250) if chr(c).isalpha() and chr(c) == chr(c).lower())

    def __init__(self, path: str, most: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self._forget()

    def _forget(self) -> None:
        self.at: dict[str, int] = {"": 0}
        self.start, self.size, self.hot = np.zeros(self.most + 1, np.int64), np.zeros(self.most + 1, np.int64), np.zeros(self.most + 1, bool)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _sweep(self) -> None:
        """Forgets chunks that were not met again since the last sweep, and the older of the others beyond half of the memory."""
        kept = np.flatnonzero(self.hot[: len(self.at)])
        kept = kept[kept > 0][-(self.most // 2) :]
        names, sizes, ids = list(self.at), self.size[kept], self._gathered(kept)
        self._forget()
        self._remember([names[i] for i in kept.tolist()], sizes, ids)

    def _remember(self, chunks: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        n = len(self.at)
        self.at.update(zip(chunks, range(n, n + len(chunks)), strict=True))
        self.size[n : n + len(chunks)] = sizes
        self.start[n : n + len(chunks)] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _gathered(self, at: np.ndarray) -> np.ndarray:
        size = self.size[at]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]

    def _is_word(self, stem: str) -> bool:
        """Letters that stay letters when normalised and lower-cased, so that nothing joins what follows."""
        return bool(stem) and (self.LATIN.issuperset(stem) or stem.isalpha() and unicodedata.is_normalized("NFC", stem) and stem.lower().isalpha())

    def _word(self, chunk: str) -> list[int]:
        if not chunk.isascii():
            chunk = chunk.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(chunk)]

    def _learn(self, chunks: set[str]) -> None:
        stems = {c: stem for c in chunks if c[-1] in self.TAIL and self._is_word(stem := c.rstrip(self.TAIL))}
        tails = {c[len(stem) :] for c, stem in stems.items()}
        plain, odd, lists, latin, model = [], [], [], self.LATIN.issuperset, self.model.tokenize
        for c in chunks.difference(stems).union(stems.values(), tails).difference(self.at):
            if latin(c):
                plain.append(c)
                lists.append([t.id for t in model(c)] if c.isascii() else self._word(c))
            else:
                odd.append(c)
        if odd:
            lists += [x.ids for x in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self._remember(plain + odd, sizes, np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())))
        if stems:
            both = np.fromiter((i for c, stem in stems.items() for i in (self.at[stem], self.at[c[len(stem) :]])), np.int64, 2 * len(stems))
            self._remember(list(stems), self.size[both].reshape(-1, 2).sum(axis=1), self._gathered(both))

    def ids(self, text: str | None) -> np.ndarray:
        return self.of(pa.array([text], pa.string()))[0]

    def of(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text. Texts are split together, so that a chunk is looked up once however often it occurs in them."""
        if not len(texts):
            return []
        texts = pc.fill_null(texts, "")
        named = pc.match_substring(texts, "<|")  # may name a special token, which is matched before lower-casing
        lists = pc.split_pattern(pc.replace_substring(pc.ascii_lower(pc.if_else(named, "", texts)), "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        chunks, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        at = np.fromiter(map(self.at.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(at < 0)
        if len(self.at) + 3 * len(missing) > self.most or self.used > 16 * self.most:
            self._sweep()
            at = np.fromiter(map(self.at.get, chunks, repeat(-1)), np.int64, len(chunks))
            missing = np.flatnonzero(at < 0)
            if len(self.at) + 3 * len(missing) > self.most:
                if len(texts) > 1:
                    return self.of(texts[: len(texts) // 2]) + self.of(texts[len(texts) // 2 :])
                return [self._whole(texts[0].as_py())]
        self.hot[at[at >= 0]] = True
        if len(missing):
            new = [chunks[i] for i in missing.tolist()]
            self._learn(set(new))
            at[missing] = np.fromiter(map(self.at.__getitem__, new), np.int64, len(new))
        at = at[place]
        ends = np.concatenate([[0], np.cumsum(self.size[at])])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        found = np.split(self._gathered(at), ends[1:-1])
        for i in np.flatnonzero(named.to_numpy(zero_copy_only=False)).tolist():
            found[i] = self._whole(texts[i].as_py())
        return found

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder a worker process, so that its tasks share what is remembered; ids never depend on that."""
    return Encoder(path)


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (if wanted) and the numbering (part, nth) of a length's pieces by task."""
    kinds = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long" + (", ids array<int>" if with_ids else "")

    def start():
        encoder, seen = encoder_of(tokenizer), np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()

        def each(batch: pa.RecordBatch):
            out, row_of, all_ids = defaultdict(list), [], []
            for row, found in enumerate(encoder.of(batch.column("text"))):
                ids = np.append(found, np.uint32(end_id)).astype("<u4")
                for piece, at in enumerate(range(0, len(ids), capacity)):
                    cut = ids[at : at + capacity]
                    row_of.append(row)
                    for name, value in (("piece", piece), ("start", at), ("length", len(cut)), ("ids_crc32", zlib.crc32(cut.tobytes())), ("nth", int(seen[len(cut)]))):
                        out[name].append(value)
                    seen[len(cut)] += 1
                    if with_ids:
                        all_ids.append(cut.astype(np.int32))
            out["doc_id"] = batch.column("doc_id").take(pa.array(row_of, pa.int32()))
            out["part"] = [part] * len(row_of)
            return out | ({"ids": arrow_lists(all_ids, pa.int32())} if with_ids else {})

        return each

    return map_batches(id_and_text(docs, id_col, text_col), kinds, start)


def grouped(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths and counts, longest first, dealt to groups of equal cardinality (the last may be smaller)."""
    total = sum(counts.values())
    share, out, held = max(1, -(-total // groups)), [[]], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            take = min(left, share - held)
            out[-1].append((length, take))
            left, held = left - take, held + take
            if held == share:
                out.append([])
                held = 0
    return [g for g in out if g]


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pieces by group, times) that use up all counts: each holds the largest size left and the fill that comes nearest to capacity."""
    left, out = list(counts), []
    while any(left):
        head = next(g for g, n in enumerate(left) if n)
        room = capacity - sizes[head]
        # what sums can be reached with which last group; larger sizes first, each as often as pieces are left
        last = np.full(room + 1, -1, np.int64)
        last[0] = len(sizes)
        for g in range(head, len(sizes)):
            for _ in range(min(left[g] - (g == head), room // sizes[g])):
                new = np.flatnonzero((last[: room + 1 - sizes[g]] >= 0) & (last[sizes[g] :] < 0)) + sizes[g]
                if not len(new):
                    break
                last[new] = g
        at, used = int(np.flatnonzero(last >= 0)[-1]), defaultdict(int, {head: 1})
        while at:
            g = int(last[at])
            used[g] += 1
            at -= sizes[g]
        times = max(1, min(left[g] // n for g, n in used.items()))
        if any(left[g] < n for g, n in used.items()):
            used = {g: min(n, left[g]) for g, n in used.items()}
            times = 1
        for g, n in used.items():
            left[g] -= n * times
        out.append((dict(used), times))
    return out


def _substituted(groups: list[list[tuple[int, int]]], found: list[tuple[dict[int, int], int]]) -> list[tuple[list[tuple[int, int]], int]]:
    """Actual lengths in the places of their groups: (pieces as (length, count), number of such sequences)."""
    queues = [[list(x) for x in reversed(g)] for g in groups]
    out = []
    for used, times in found:
        slots = [g for g, n in sorted(used.items()) for _ in range(n)]
        runs = []
        for g in slots:
            need, run = times, []
            while need:
                length, n = queues[g][-1]
                take = min(need, n)
                run.append((length, take))
                need -= take
                queues[g][-1][1] -= take
                if not queues[g][-1][1]:
                    queues[g].pop()
            runs.append(run)
        edges = sorted({0, times, *(int(e) for r in runs for e in np.cumsum([n for _, n in r]))})
        for lo, hi in zip(edges, edges[1:], strict=False):
            held: dict[int, int] = defaultdict(int)
            for r in runs:
                ends = np.cumsum([n for _, n in r])
                held[r[int(np.searchsorted(ends, lo, side="right"))][0]] += 1
            out.append((list(held.items()), hi - lo))
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 512, large_from: int | None = None) -> pd.DataFrame:
    """Where the pieces of each length go: rows (length, lo, hi, each, base, offset).

    Ranks lo to hi - 1 of a length fill sequences from base on, `each` pieces to a sequence from offset on.
    """
    large_from = large_from or capacity // 4 + 1
    large = {x: n for x, n in histogram.items() if x >= large_from and n}
    parts = grouped(large, groups)
    sizes = [g[0][0] for g in parts]  # rounded up to the longest of the group
    filled = _substituted(parts, configurations(sizes, [sum(n for _, n in g) for g in parts], capacity))
    by_room: dict[int, list[tuple[list[tuple[int, int]], int]]] = defaultdict(list)
    for pieces, n in filled:
        by_room[capacity - sum(x * k for x, k in pieces)].append((pieces, n))
    for length in sorted((x for x in histogram if x < large_from), reverse=True):
        left = histogram[length]
        while left:
            room = min((r for r, v in by_room.items() if r >= length and v), default=None)
            pieces, n = by_room[room].pop() if room is not None else ([], left)
            room = capacity if room is None else room
            k = room // length
            full = min(n, left // k)
            if full:
                by_room[room - k * length].append(([*pieces, (length, k)], full))
                left, n = left - full * k, n - full
            if left and n and left < k:
                by_room[room - left * length].append(([*pieces, (length, left)], 1))
                left, n = 0, n - 1
            if n and pieces:
                by_room[room].append((pieces, n))
    rows, used, base = [], defaultdict(int), 0
    for pieces, n in (x for room in sorted(by_room) for x in by_room[room]):
        offset = 0
        for length, k in pieces:
            rows.append((length, used[length], used[length] + n * k, k, base, offset))
            used[length] += n * k
            offset += length * k
        base += n
    return pd.DataFrame(rows, columns=["length", "lo", "hi", "each", "base", "offset"]).sort_values(["length", "lo"], ignore_index=True)


def place(pieces: DataFrame, capacity: int = CAPACITY, groups: int = 512) -> DataFrame:
    """Add sequence_id and offset to the rows of token_pieces(), which must be a written table (the numbering is by task)."""
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    p = plan(histogram, capacity, groups)
    lo, length, each, base, offset = (p[c].to_numpy(np.int64) for c in ("lo", "length", "each", "base", "offset"))
    starts = (length << 48) + lo

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def find(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, rank = size.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(starts, (size << 48) + rank, side="right") - 1
        q = rank - lo[at]
        return pd.DataFrame({"sequence_id": base[at] + q // each[at], "offset": offset[at] + (q % each[at]) * size})

    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    firsts = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("first"))
    ranked = pieces.join(firsts, ["part", "length"]).withColumn("found", find("length", F.col("first") + F.col("nth")))
    return ranked.select(*[c for c in pieces.columns if c not in ("part", "nth")], "found.sequence_id", "found.offset")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, groups: int = 512, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole documents into sequences of at most capacity tokens: one row a piece with its place.

    Null or empty text is the end id alone; only documents longer than capacity are cut; repeated rows are packed each;
    an empty table gives no rows; other columns are ignored.
    """
    return place(stage(token_pieces(docs, tokenizer, end_id, capacity, with_ids, id_col, text_col), "pieces"), capacity, groups)


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from pack(with_ids=True); a sequence holds at most capacity tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_linear_grouping_packing(spark, sf_dir: str) -> DataFrame:
    out = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
