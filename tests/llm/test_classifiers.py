import zlib

import numpy as np
from helpers import frame, mixed_rows

from tessera.llm import quality_classifier, toxicity
from tessera.llm.queries import QUERIES

LABELS = "doc_id long, quality int, toxic int, text string"


def held_out(spark, query, label, d):
    out = QUERIES[query](spark, d)
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = out.collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    return [(r, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels], rows


def test_quality_on_held_out_rows(spark):
    pairs, rows = held_out(spark, "op6_subword_embeddings", "quality", "/root/testdata/sf0.01")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert np.mean([r.predicted == y for r, y in pairs]) >= 0.95
    good, bad = (np.array([r.score for r, y in pairs if y == x]) for x in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() >= 0.98


def test_quality_scores_are_graded(spark):
    """Scores order the rows: the logits stay small, and hardly two texts share a score."""
    scores = np.array([r.score for r in QUERIES["op6_subword_embeddings"](spark, "/root/testdata/sf0.1").collect()])
    assert len(np.unique(scores)) > 5000 and np.abs(np.log(scores / (1 - scores))).max() < 25


def test_toxicity_on_held_out_rows(spark):
    pairs, rows = held_out(spark, "op7_nnpu_toxicity", "toxic", "/root/testdata/sf0.1")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted for r, y in pairs if y]) >= 0.8
    assert np.mean([r.predicted for r, y in pairs if not y]) <= 0.05


def test_non_negative_risk_separates():
    rng = np.random.default_rng(1)
    positive = [np.unique(np.append(rng.integers(0, 500, 30), 900)) for _ in range(80)]
    unlabelled = [np.unique(np.append(rng.integers(0, 500, 30), 900) if i % 10 == 0 else rng.integers(0, 500, 30)) for i in range(600)]
    model = toxicity.fit(positive, unlabelled, 0.1)
    logit = lambda bag: model.bias + model.weights[np.isin(model.features, bag)].sum()
    assert min(map(logit, positive)) > 0 > np.mean([logit(u) for i, u in enumerate(unlabelled) if i % 10])


def test_odd_rows(spark):
    rows = mixed_rows() + [(None, "null id"), (1, "again"), (1, "again")]
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2, "t") for i in range(30)] + [(None, 1, 1, ""), (5, None, None, None), (6, 0, 1, "")], LABELS)
    docs = frame(spark, rows)
    for module in (quality_classifier, toxicity):
        out = module.score(docs, module.learn(docs, labels)).collect()
        assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
        assert module.score(frame(spark, []), module.learn(docs, labels)).collect() == []
        none = module.score(docs, module.learn(docs, labels.where("false"))).collect()
        assert len({r.score for r in none}) == 1
