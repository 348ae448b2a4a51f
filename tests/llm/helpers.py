"""Small fixtures with what every operator must bear: nulls, empty and long texts, ties, repeated rows, extra columns."""

import random

SCHEMA = "doc_id long, text string, row string, doc string, value string, n long"
WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sigma tau ups".split()


def frame(spark, rows, partitions=3):
    """Documents with extra columns whose names clash with those used inside the operators."""
    return spark.createDataFrame([(i, t, "x", "y", None, 1) for i, t in rows], SCHEMA).repartition(partitions)


def prose(rng, n, vocabulary=400):
    return " ".join(f"{rng.choice(WORDS)}{rng.randrange(vocabulary)}" for _ in range(n))


def mixed_rows(seed=1):
    """Exact and near copies, shared lines and passages, odd texts."""
    rng = random.Random(seed)
    passage = prose(rng, 80)
    base = prose(rng, 120)
    rows = [(i, "\n".join(prose(rng, rng.randint(1, 40)) for _ in range(rng.randint(1, 5)))) for i in range(30)]
    rows += [(40 + i, base) for i in range(5)]
    for i in range(12):
        words = base.split()
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10_000)}"
        rows.append((50 + i, " ".join(words)))
    rows += [(70 + i, f"{prose(rng, 20)}\n{passage}\n{prose(rng, 15)}") for i in range(6)]
    rows += [(80, None), (81, ""), (82, " \n\t"), (83, "one"), (84, "one two three"), (85, "ONE two Three"), (86, "é" * 500), (87, "a" * 3000), (88, "long line here\n" * 50)]
    rows += [(90, prose(rng, 4000))]
    return rows
