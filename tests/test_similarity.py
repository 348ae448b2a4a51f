"""Set-similarity joins against all pairs."""

import random

from tessera.operators import similarity


def sets(seed, n, most):
    """Half of them drawn anew, half a set before with some tokens exchanged."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        tokens = set(rng.sample(range(400), rng.randint(0, most)))
        if out and rng.random() < 0.5:
            base = sorted(rng.choice(out))
            tokens = set(rng.sample(base, rng.randint(len(base) // 2, len(base)))) | set(rng.sample(range(400), rng.randint(0, 4)))
        out.append(tokens)
    return [sorted(f"w{t}" for t in x) for x in {frozenset(x) for x in out}]


def true_pairs(tokens, threshold):
    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) > threshold
    return {(i, j) for j, b in enumerate(tokens) for i, a in enumerate(tokens[:j]) if a and b and like(a, b)}


def frame(spark, tokens):
    return spark.createDataFrame(list(enumerate(tokens)), "rep long, tokens array<string>")


def test_no_pair_is_lost(spark):
    for most, threshold in ((6, 0.5), (60, 0.5), (300, 0.5), (30, 0.7)):
        tokens = sets(most, 150, most)
        got = {(r.a, r.b) for r in similarity.similar_pairs(frame(spark, tokens), threshold).collect()}
        assert got == true_pairs(tokens, threshold) and got


def test_the_join_gives_out_few_pairs_that_are_not_alike(spark):
    """Sets of 40 of 400 tokens share some rare one in most pairs; all of those left the join before."""
    rng = random.Random(5)
    tokens = [[f"w{t}" for t in sorted(rng.sample(range(400), 40))] for _ in range(200)]
    tokens += [t[:30] + [f"v{i}"] for i, t in enumerate(tokens[:20])]
    true = true_pairs(tokens, 0.5)
    got = {(r.a, r.b) for r in similarity.candidate_pairs(frame(spark, tokens)).collect()}
    assert true <= got and len(true) == 20 and len(got) <= 40
