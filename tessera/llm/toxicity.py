"""Toxicity by non-negative positive-unlabelled learning: a linear model over hashed words and word beginnings, fitted in numpy
from confirmed toxic examples and unlabelled text with a class-prior-corrected risk that is kept from going below zero."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_batches, stage
from .decontaminate import words_of
from .sampling import fold, sampled_ids, texts_of

BUCKETS = 1 << 20


#: Word beginnings of so many characters are features, too: forms of one stem share them.
STEMS = (4, 5)


def buckets(word: bytes) -> list[int]:
    """The buckets of a word and of its beginnings."""
    chars = word.decode()
    parts = [word, *(chars[:n].encode() + b"-" for n in STEMS if len(chars) > n)]
    return [xxhash.xxh3_64_intdigest(p) & (BUCKETS - 1) for p in parts]


def _bags(texts: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct word buckets of each text, with the other columns named."""
    kinds = "bag array<int>, " + ", ".join(f"{c} {dict(texts.dtypes)[c]}" for c in columns)

    def start():
        def each(batch: pa.RecordBatch):
            bags = [sorted({b for w in set(words_of(t)) for b in buckets(w)}) for t in batch.column("text").to_pylist()]
            return {"bag": pa.array(bags, pa.list_(pa.int32()))} | {c: batch.column(c) for c in columns}

        return each

    return map_batches(texts, kinds, start)


@dataclass(frozen=True)
class Model:
    features: np.ndarray  # buckets, sorted
    weights: np.ndarray
    bias: float

    def scorer(self):
        """text -> probability of the positive class; each known word counts once a text."""
        weight = dict(zip(self.features.tolist(), self.weights.tolist(), strict=True))
        known: dict[bytes, tuple[int, ...]] = {}

        def score(text: str | None) -> float:
            found = set()
            for w in set(words_of(text)):
                bs = known.get(w)
                if bs is None:
                    bs = tuple(b for b in buckets(w) if b in weight)
                    if len(w) <= 64:
                        if len(known) >= 150_000:
                            known.clear()
                        known[w] = bs
                if bs:
                    found.update(bs)
            z = self.bias + sum(weight[b] for b in sorted(found))
            return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        return score


def _selected(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, most: int, least_odds: float, min_share: float, min_z: float) -> np.ndarray:
    """Buckets that mark the positive class: prior * share in positives / share in unlabelled estimates how often a text with
    the bucket is positive. Those over least_odds, the surest first, at most so many."""
    p, u = (np.bincount(np.concatenate(x) if x else np.empty(0, np.int64), minlength=BUCKETS) for x in (positive, unlabelled))
    n_p, n_u = max(len(positive), 1), max(len(unlabelled), 1)
    share_p, share_u = (p + 0.5) / (n_p + 1), (u + 0.5) / (n_u + 1)
    pooled = (p + u + 1) / (n_p + n_u + 2)
    z = (share_p - share_u) / np.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u))
    good = np.flatnonzero((p >= max(3, min_share * n_p)) & (prior * share_p >= least_odds * share_u) & (z > min_z))
    return np.sort(good[np.argsort(-z[good], kind="stable")][:most])


def _matrix(bags: list[np.ndarray], features: np.ndarray) -> np.ndarray:
    x = np.zeros((len(bags), len(features)), np.float32)
    if len(features):
        for row, bag in enumerate(bags):
            at = np.searchsorted(features, bag)
            at = at[(at < len(features)) & (features[np.minimum(at, len(features) - 1)] == bag)]
            x[row, at] = 1
    return x


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, most_features: int = 1024, least_odds: float = 0.2, min_share: float = 0.01, min_z: float = 4.0, steps: int = 600, batch: int = 1024, rate: float = 0.05, decay: float = 1e-4, seed: int = 5) -> Model:
    """Non-negative PU learning with the sigmoid loss and stochastic (Adam) steps. R_u- minus prior * R_p-, the risk of the
    negatives, estimates something that cannot be negative: where it is in a batch, the step raises that part again and leaves
    the positives' risk alone. The decision is the sign of the learned function, its bias included."""
    features = _selected(positive, unlabelled, prior, most_features, least_odds, min_share, min_z)
    xp, xu = (np.column_stack([_matrix(x, features), np.ones(len(x), np.float32)]) for x in (positive, unlabelled))
    w, rng = np.append(np.zeros(len(features)), np.log(prior / (1 - prior))), np.random.default_rng(seed)
    if not len(xp) or not len(xu):
        return Model(features, w[:-1], float(w[-1]))
    first, second = np.zeros(len(w)), np.zeros(len(w))
    for step in range(1, steps + 1):
        p, u = (x[rng.integers(0, len(x), batch)] for x in (xp, xu))
        # the loss of a negative is sigmoid(z), that of a positive 1 - sigmoid(z)
        sp, su = (1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -40, 40))) for x in (p, u))
        rise = prior * (p.T @ (sp * (1 - sp))) / batch
        negative = (u.T @ (su * (1 - su))) / batch - rise
        g = (negative - rise if su.mean() >= prior * sp.mean() else -negative).astype(np.float64)
        g[:-1] += decay * w[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= rate * (1 - step / (steps + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(features, w[:-1], float(w[-1]))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0, max_positive: int = 2000, max_unlabelled: int = 6000, prior: float | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> Model:
    """Fit on at most max_positive confirmed positives and max_unlabelled other texts; labels count outside the held-out fold
    only. The prior is the positive share of those labels unless it is given."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(f"doc_id is not null and y is not null")
    marks = marks.where(fold("doc_id", folds) != held_out)
    if prior is None:
        n = marks.agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("p")).first()
        prior = min(0.9, max(0.001, n["p"] / max(n["n"], 1)))
    rows = id_and_text(docs, id_col, text_col)
    positive = sampled_ids(marks.where("y = 1").select("doc_id"), max_positive)
    others = sampled_ids(rows.select("doc_id").where(fold("doc_id", folds) != held_out), max_unlabelled, seed=11)
    wanted = positive.withColumn("k", F.lit(1)).unionByName(others.withColumn("k", F.lit(2))).groupBy("doc_id").agg(F.sum("k").cast("int").alias("k"))
    got = _bags(texts_of(rows, stage(wanted, "toxicity-ids")), ["k"]).toArrow()
    bags = sorted(((x.values.to_numpy().astype(np.int64), k) for x, k in zip(got["bag"], got["k"].to_pylist(), strict=True)), key=lambda x: (x[1], x[0].tobytes()))
    return fit([x for x, k in bags if k & 1], [x for x, k in bags if k & 2], prior, **options)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and score (probability of toxic) for each row, with the columns of carry.

    Texts are read whole, however long. Null and empty texts get the score of a text without known words; repeated rows get equal scores; an empty table gives
    none; without any positive label the score is the prior for all.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *[docs[c].alias(f"carry_{c}") for c in carry])
    kinds = "doc_id long, score double" + "".join(f", `{n}` {t}" for n, t in rows.dtypes if n.startswith("carry_"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        of = shared.value.scorer()

        def each(batch: pa.RecordBatch):
            out = {"doc_id": batch.column("doc_id"), "score": [of(t) for t in batch.column("text").to_pylist()]}
            return out | {n: batch.column(n) for n in batch.schema.names if n.startswith("carry_")}

        return each

    return map_batches(rows, kinds, start).select("doc_id", "score", *[F.col(f"carry_{c}").alias(c) for c in carry])


def op7_nnpu_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
