import hashlib
import random
import re

import pytest
from helpers import mixed_rows, prose
from pyspark.sql import functions as F

from tessera.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, key string, place long, budget int"


def frame(spark, rows):
    """Extra columns clash with the operator's own."""
    return spark.createDataFrame([(i, t, s, 9, "k", 1, 0) for i, t, s in rows], SCHEMA).repartition(3)


def place(doc, text):
    return int(hashlib.md5(f"42:{'' if doc is None else doc}:{text or ''}".encode()).hexdigest()[:15], 16)


def brute(rows, share=1.0, most=3, weights=(1, 2, 3)):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    words = {s: sum(size(t) for _, t, x in rows if x == s) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(words.values()) * share, set()
    while True:
        open_ = [s for s in names if s not in capped]
        level = (total - sum(most * words[s] for s in capped)) / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weight[s] * level >= most * words[s]}
        if not over:
            break
        capped |= over
    target = {s: float(most * words[s]) if s in capped else weight[s] * level for s in names}
    out = []
    for s in names:
        copies = int(target[s] // words[s]) if words[s] else 0
        rest, upto, cut = target[s] - copies * words[s], 0, -1
        mine = sorted((place(i, t), size(t)) for i, t, x in rows if x == s)
        for p in sorted({p for p, _ in mine}):
            before, upto = upto, upto + sum(n for q, n in mine if q == p)
            if upto <= rest or (before <= rest and upto - rest < rest - before):
                cut = p
        out += [(i, s, size(t), words[s], round(target[s], 6), size(t) * (copies + (place(i, t) <= cut))) for i, t, x in rows if x == s]
    return sorted(out, key=repr)


def got(df, at=0):
    return sorted(((r.doc_id, r.source, r["size"], r.source_size, round(r.target[at], 6), r.taken[at]) for r in df.collect()), key=repr)


def corpus(seed=3):
    rng = random.Random(seed)
    rows = [(i, t, "hot") for i, t in mixed_rows()]
    rows += [(1000 + i, prose(rng, rng.randint(1, 60)), rng.choice(["a", "B", "é", "𝔸", "￮", None, "hot", "hot"])) for i in range(500)]
    return rows + [(5000, "tiny source", "t1"), (5001, None, "none"), (5002, "", "none"), (None, "an id that is null", "a"), (None, None, None)] + [(6000, "one and the same row", "same")] * 7


@pytest.mark.parametrize("share", [1.0, 0.3, 2.5, 3.0])
def test_against_brute_force(spark, share):
    rows = corpus()
    out = mixing.mix(frame(spark, rows), budgets=(share,)).collect()
    assert got(mixing.mix(frame(spark, rows), budgets=(share,))) == brute(rows, share) and len(out) == len(rows)
    assert all(r.taken[0] <= 3 * r["size"] for r in out)


def test_budgets_are_nested_and_reruns_agree(spark):
    rows, shares = corpus(4), (0.1, 0.5, 1.0, 1.7)
    out = mixing.mix(frame(spark, rows), budgets=shares)
    assert all(list(r.taken) == sorted(r.taken) for r in out.collect())
    assert got(out) == got(mixing.mix(frame(spark, rows[::-1]), budgets=shares))
    for i, share in enumerate(shares):
        assert got(out, i) == brute(rows, share)


def test_taken_words_come_near_the_target(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(1, 50), rng.choice("aaaabc")) for i in range(3000)]
    out = mixing.mix(frame(spark, rows)).collect()
    for s in "abc":
        mine = [r for r, (_, _, x) in zip(sorted(out, key=lambda r: r.doc_id), rows, strict=True) if x == s]
        assert abs(sum(r.taken[0] for r in mine) - mine[0].target[0]) <= max(r["size"] for r in mine) / 2


def test_many_sources_and_small_steps(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEP", 2)
    rows = [(i, f"text {i} " + "w " * (i % 13), f"s{i % 97}") for i in range(1200)]
    assert got(mixing.mix(frame(spark, rows))) == brute(rows)


def test_words(spark):
    texts = ["", " ", "a", " a\tb\x0bc\x0c\rd \n", "\x00 \x1c \x85 é x", "\n\n", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    assert [r[0] for r in df.coalesce(1).select(mixing.word_count(F.col("text"))).collect()] == want


def test_plan_is_native(spark):
    plan = mixing.mix(frame(spark, corpus()))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table(spark):
    assert mixing.mix(frame(spark, [])).collect() == []
