"""Quality classifier: supervised subword embeddings. Hashed word and character n-gram vectors are averaged over a document
and a softmax follows; vectors and output are learned by numpy stochastic gradient descent on a bounded labelled sample."""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_lists, id_and_text, map_batches, stage
from .sampling import fold, sampled_ids, texts_of

BUCKETS = 1 << 16
#: Stands in the text wherever a word repeats the one before it; no word can hold a space.
AGAIN = b" again"


GRAMS = (2, 3)


def subwords(word: bytes, grams: tuple[int, ...] = GRAMS) -> np.ndarray:
    """Buckets of a word: its own and those of its character n-grams, ends marked."""
    chars = f"<{word.decode()}>"
    parts = [word, *(chars[i : i + n].encode() for n in grams for i in range(len(chars) - n + 1))] if word != AGAIN else [word]
    return np.array([xxhash.xxh3_64_intdigest(p, seed=bool(i)) & (BUCKETS - 1) for i, p in enumerate(parts)], np.int64)


def document(text: str | None) -> tuple[list[bytes], int]:
    """The words of a text, and how many repeat the one before."""
    words = text.encode().split() if text else []
    return words, sum(map(eq, words, words[1:]))


def averaged(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a document with their share in its average vector."""
    words, again = document(text)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    if again:
        counts[AGAIN] = again
    total = sum(counts.values())
    if not total:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    parts = [subwords(w) for w in counts]
    share = np.concatenate([np.full(len(p), n / (total * len(p)), np.float32) for p, n in zip(parts, counts.values(), strict=True)])
    ids, at = np.unique(np.concatenate(parts), return_inverse=True)
    return ids, np.bincount(at, share, len(ids)).astype(np.float32)


@dataclass(frozen=True)
class Model:
    word_score: np.ndarray  # by bucket: what its vector adds to logit(1) - logit(0)
    bias: float

    def scorer(self):
        """text -> probability of label 1, whole texts; a word's score is remembered."""
        table = self.word_score.tolist()

        class Grams(dict):
            def __missing__(self, gram: str) -> float:
                if len(self) >= 150_000:
                    self.clear()
                value = self[gram] = table[xxhash.xxh3_64_intdigest(gram.encode(), seed=1) & (BUCKETS - 1)]
                return value

        grams = Grams()

        class Scores(dict):
            def __missing__(self, word: bytes) -> float:
                chars = f"<{word.decode()}>"
                parts = [chars[i : i + n] for n in GRAMS for i in range(len(chars) - n + 1)]
                own = table[xxhash.xxh3_64_intdigest(word) & (BUCKETS - 1)]
                value = (own + sum(map(grams.__getitem__, parts))) / (1 + len(parts))
                if len(word) <= 64:
                    if len(self) >= 150_000:
                        self.clear()
                    self[word] = value
                return value

        known, again_score = Scores(), table[int(subwords(AGAIN)[0])]

        def score(text: str | None) -> float:
            words, again = document(text)
            mean = 0.0
            if words:
                mean = (float(np.fromiter(map(known.__getitem__, words), np.float64, len(words)).sum()) + again * again_score) / (len(words) + again)
            return float(1 / (1 + np.exp(-np.clip(mean + self.bias, -40, 40))))

        return score


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], dims: int = 8, epochs: int = 6, rate: float = 0.05, seed: int = 3) -> Model:
    """Stochastic gradient descent, one document a step, with a rate that falls to zero.

    A bucket's share in a document is small and its frequency differs by orders of magnitude, so every vector's step is divided by the root of the
    sum of its squared gradients so far; steps then have one size and the scores stay bounded.
    """
    if not examples:
        return Model(np.zeros(BUCKETS), 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dims, 1 / dims, (BUCKETS, dims)).astype(np.float32)
    out, bias = rng.uniform(-1 / dims, 1 / dims, (dims, 2)).astype(np.float32), np.zeros(2, np.float32)
    of_vectors, of_out = np.full(BUCKETS, 1e-8, np.float32), np.full((dims, 2), 1e-8, np.float32)
    steps, step = epochs * len(examples), 0
    for _ in range(epochs):
        for n in rng.permutation(len(examples)):
            ids, share, label = examples[n]
            lr, step = rate * (1 - step / steps), step + 1
            hidden = share @ vectors[ids]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back, turn = np.outer(share, out @ p), np.outer(hidden, p)
            of_out += turn * turn
            out -= lr * turn / np.sqrt(of_out)
            bias -= 0.1 * lr * p
            of_vectors[ids] += (back * back).mean(axis=1)
            vectors[ids] -= lr * back / np.sqrt(of_vectors[ids])[:, None]
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held_out: int = 2, max_rows: int = 3000, id_col: str = "doc_id", text_col: str = "text", **options) -> Model:
    """Fit on at most max_rows labelled rows outside the held-out fold. Without labels every score is one half."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    ids = stage(sampled_ids(marks.where(fold("doc_id", folds) != held_out), max_rows), "quality-ids")

    def start():
        def each(batch: pa.RecordBatch):
            got = [averaged(t) for t in batch.column("text").to_pylist()]
            return {"y": batch.column("y"), "ids": arrow_lists([i for i, _ in got], pa.int32()), "share": arrow_lists([s for _, s in got], pa.float32())}

        return each

    table = map_batches(texts_of(id_and_text(docs, id_col, text_col), ids), "y int, ids array<int>, share array<float>", start).toArrow()
    examples = [(i.values.to_numpy().astype(np.int64), s.values.to_numpy(), y) for y, i, s in zip(table["y"].to_pylist(), table["ids"], table["share"], strict=True)]
    examples.sort(key=lambda x: (x[2], x[0].tobytes(), x[1].tobytes()))
    return fit(examples, **options)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (probability of label 1) for each row of docs.

    Null and empty texts get the score of the bias alone; repeated rows get equal scores; an empty table gives none; other
    columns are ignored. Texts are read whole, however long.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        of = shared.value.scorer()
        return lambda batch: {"doc_id": batch.column("doc_id"), "score": [of(t) for t in batch.column("text").to_pylist()]}

    return map_batches(id_and_text(docs, id_col, text_col), "doc_id long, score double", start)


def op6_subword_embeddings(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
