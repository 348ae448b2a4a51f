"""Benchmark decontamination by winnowing.

Of each window of consecutive k-gram hashes the smallest is kept, on both sides, so any shared run of GRAM + WINDOW - 1
words (13) shares a kept hash. Document fingerprints are joined with benchmark fingerprints and each hit is extended word
by word to the full run. Items with fewer words than a window are found by their whole-item hash.

The benchmark is read in blocks of bounded size and each block goes to the tasks as a broadcast; documents are never
shuffled. With more than one block, documents are passed over once a block and the hits of a document are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, arrow_lists, gram_hashes, id_and_text, map_batches

SPAN = 13
GRAM = 5
WINDOW = SPAN - GRAM + 1
#: The contract's words: 0-9, a-z (A-Z lower-cased) and all that is not ASCII. Every other byte parts words.
WORD_TABLE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_TABLE).split() if text else []


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash (the leftmost of equals) of each window; of all hashes if there are fewer."""
    if len(grams) <= window:
        return np.array([int(grams.argmin())]) if len(grams) else np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.unique(views.argmin(axis=1) + np.arange(len(views)))


class Index:
    """The fingerprints of a block of items: sorted hashes with the item and position of each."""

    def __init__(self, items: list[tuple[str, str]], span: int = SPAN, gram: int = GRAM):
        self.span, self.gram = span, gram
        hashes = WordHashes(10_000_000)
        self.ids = [i for i, _ in items]
        self.words, self.known = [], {}
        for _, text in items:
            words = words_of(text)
            self.words.append(hashes.of(words))
            # every word, whatever its length: `hashes` itself remembers short ones only
            self.known.update(zip(words, self.words[-1].tolist()))
        long = [(n, w) for n, w in enumerate(self.words) if len(w) >= span]
        prints, item, pos = [], [], []
        for n, w in long:
            grams = gram_hashes(w, gram)
            at = winnow(grams, span - gram + 1)
            prints.append(grams[at])
            item += [n] * len(at)
            pos += at.tolist()
        self.prints, self.item, self.pos = self._sorted(prints, item, pos)
        self.short = {}
        for size in sorted({len(w) for w in self.words if 0 < len(w) < span}):
            those = [n for n, w in enumerate(self.words) if len(w) == size]
            self.short[size] = self._sorted([gram_hashes(self.words[n], size) for n in those], those, [0] * len(those))

    @staticmethod
    def _sorted(prints, item, pos):
        flat = np.concatenate(prints) if prints else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        return flat[order], np.array(item, np.int64)[order], np.array(pos, np.int64)[order]

    @staticmethod
    def _matches(found: np.ndarray, prints: np.ndarray):
        """(index in found, index in prints) of equal hashes."""
        lo, hi = np.searchsorted(prints, found, "left"), np.searchsorted(prints, found, "right")
        for n in np.flatnonzero(hi > lo).tolist():
            for m in range(lo[n], hi[n]):
                yield n, m

    def hits(self, doc: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """The hit flags of a document's words, and the items with an occurring window."""
        hit, items = np.zeros(len(doc), bool), set()
        if len(self.prints) and len(doc) >= self.span:
            grams = gram_hashes(doc, self.gram)
            seen = np.isin(grams, self.prints)
            if seen.any():
                at = winnow(grams, self.span - self.gram + 1)
                at = at[seen[at]]
                done: set[tuple[int, int, int]] = set()
                for n, m in self._matches(grams[at], self.prints):
                    i, p, q = int(self.item[m]), int(at[n]), int(self.pos[m])
                    lo, hi = self._extended(doc, self.words[i], p, q)
                    if hi - lo >= self.span and (i, p - q, lo) not in done:
                        done.add((i, p - q, lo))
                        hit[lo:hi] = True
                        items.add(i)
        for size, (prints, item, _) in self.short.items():
            if len(doc) >= size:
                grams = gram_hashes(doc, size)
                for n in np.flatnonzero(np.isin(grams, prints)).tolist():
                    lo, hi = np.searchsorted(prints, grams[n], "left"), np.searchsorted(prints, grams[n], "right")
                    for i in item[lo:hi].tolist():
                        if np.array_equal(doc[n : n + size], self.words[i]):
                            hit[n : n + size] = True
                            items.add(i)
        return hit, items

    @staticmethod
    def _extended(doc: np.ndarray, item: np.ndarray, p: int, q: int) -> tuple[int, int]:
        """The longest run of equal words through document position p and item position q."""
        back = min(p, q)
        left = doc[p - back : p][::-1] != item[q - back : q][::-1]
        lo = p - (int(left.argmax()) if left.any() else back)
        ahead = min(len(doc) - p, len(item) - q)
        right = doc[p : p + ahead] != item[q : q + ahead]
        return lo, p + (int(right.argmax()) if right.any() else ahead)


def _blocks(items: DataFrame, most_bytes: int) -> list[list[int]]:
    """Ranges of a block number whose texts hold about most_bytes each, from sizes by hash bucket."""
    sizes = items.groupBy("bucket").agg(F.sum(F.octet_length("text")).alias("b")).orderBy("bucket").collect()
    blocks, held = [[]], 0
    for r in sizes:
        if blocks[-1] and held + (r["b"] or 0) > most_bytes:
            blocks.append([])
            held = 0
        blocks[-1].append(r["bucket"])
        held += r["b"] or 0
    return [b for b in blocks if b]


def find_contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, block_bytes: int = 32 << 20, buckets: int = 4096, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted as strings, distinct) for each row of docs, with the columns of carry.

    A document word is hit inside any occurrence of span consecutive words of an item, or of a whole item that has fewer.
    Null or empty texts have no words; items without words match nothing; repeated items count by id; a null item_id is
    matched but not listed; repeated rows of docs each give a row; other columns and their names do not matter.
    """
    spark = docs.sparkSession
    items = benchmark.select(benchmark[item_id_col].cast("string").alias("item_id"), benchmark[item_text_col].cast("string").alias("text"))
    items = items.where("text is not null").withColumn("bucket", F.pmod(F.xxhash64("text"), F.lit(buckets)).cast("int"))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *[docs[c].alias(f"carry_{c}") for c in carry])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name.startswith("carry_"))
    schema = "doc_id long, n_words long, n_hit long, item_ids array<string>, hit_starts array<int>, hit_ends array<int>" + (", " + kept if kept else "")
    blocks = _blocks(items, block_bytes) or [[]]
    if len(blocks) > 1:
        rows = rows.withColumn("carry_row", F.monotonically_increasing_id())
        schema += ", carry_row long"
    carried = [f for f in rows.columns if f.startswith("carry_")]
    passes = []
    for block in blocks:
        got = [(r["item_id"], r["text"]) for r in items.where(F.col("bucket").isin(block)).select("item_id", "text").toLocalIterator()] if block else []
        shared = spark.sparkContext.broadcast(Index(got, span, gram))

        def start(shared=shared):
            index = shared.value

            def each(batch: pa.RecordBatch):
                n_words, n_hit, ids, starts, ends = [], [], [], [], []
                for text in batch.column("text").to_pylist():
                    words = words_of(text)
                    n_words.append(len(words))
                    doc = np.fromiter((index.known.get(w, 0) for w in words), np.uint64, len(words))
                    hit, found = index.hits(doc)
                    n_hit.append(int(hit.sum()))
                    ids.append(sorted({index.ids[i] for i in found} - {None}))
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                    starts.append(edges[::2])
                    ends.append(edges[1::2])
                out = {"doc_id": batch.column("doc_id"), "n_words": n_words, "n_hit": n_hit, "item_ids": pa.array(ids, pa.list_(pa.string()))}
                out |= {"hit_starts": arrow_lists(starts, pa.int32()), "hit_ends": arrow_lists(ends, pa.int32())}
                return out | {c: batch.column(c) for c in carried}

            return each

        passes.append(map_batches(rows, schema, start))
    out = passes[0]
    if len(passes) > 1:
        out = _merged(passes, carried)
    return out.select("doc_id", "n_words", "n_hit", "item_ids", "hit_starts", "hit_ends", *[F.col(f"carry_{c}").alias(c) for c in carry])


def _merged(passes: list[DataFrame], carried: list[str]) -> DataFrame:
    """Hits of one document from all blocks: rows without a hit are only taken from the first pass."""
    every = passes[0]
    for more in passes[1:]:
        every = every.unionByName(more.where("n_hit > 0"))
    one = every.groupBy("carry_row").agg(
        *[F.first(c).alias(c) for c in ["doc_id", "n_words", *[c for c in carried if c != "carry_row"]]],
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.flatten(F.collect_list(F.arrays_zip("hit_starts", "hit_ends"))).alias("runs"),
    )
    merged = F.aggregate(
        F.array_sort("runs"),
        F.expr("cast(array() as array<struct<hit_starts:int,hit_ends:int>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["hit_ends"] >= x["hit_starts"]),
                              F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["hit_starts"].alias("hit_starts"), F.greatest(F.element_at(acc, -1)["hit_ends"], x["hit_ends"]).alias("hit_ends")))))
        .otherwise(F.concat(acc, F.array(F.struct(x["hit_starts"].alias("hit_starts"), x["hit_ends"].alias("hit_ends"))))),
    )
    one = one.withColumn("runs", F.when(F.size("runs") > 0, merged).otherwise(F.expr("cast(array() as array<struct<hit_starts:int,hit_ends:int>>)")))
    return one.withColumns({
        "hit_starts": F.col("runs.hit_starts"), "hit_ends": F.col("runs.hit_ends"),
        "n_hit": F.aggregate("runs", F.lit(0).cast("long"), lambda a, x: a + x["hit_ends"] - x["hit_starts"]),
    })


def contaminated(n_hit="n_hit", n_words="n_words"):
    """The contract's rule: at least a twentieth of the words, and one at least."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    out = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(
        "doc_id", "n_words", "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


OP9_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[u.i : u.i + least(13, len(w)) - 1], ' ') AS g
  FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, u.i AS pos, array_to_string(w[u.i : u.i + n - 1], ' ') AS g
  FROM d, sizes, unnest(range(1, greatest(len(w) - n + 2, 1))) AS u(i)),
found AS (SELECT g.doc_id, g.pos, g.n, item_id FROM grams g JOIN windows x ON g.n = x.n AND g.g = x.g),
words AS (SELECT doc_id, count(DISTINCT p.p) AS n_hit FROM (SELECT DISTINCT doc_id, pos, n FROM found) f, unnest(range(pos, pos + n)) AS p(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""
