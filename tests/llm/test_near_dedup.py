import random
import re

import pytest
from helpers import frame, mixed_rows, prose

from tessera.llm import near_dedup
from tessera.llm.components import connected_components
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.queries import QUERIES


def shingle_sets(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def brute(rows):
    sets = [shingle_sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(s), least[root(i)], d == least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def near_copies(seed, n, size=150, edits=6):
    rng = random.Random(seed)
    base = prose(rng, size).split()
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
        out.append((1000 * seed + i, " ".join(w)))
    return out


def test_against_brute_force(spark):
    rows = mixed_rows() + near_copies(2, 25) + near_copies(3, 20, 30, 2) + [(40, "another text under the same id as before"), (41, "again twice one row"), (41, "again twice one row")]
    assert got(near_duplicates(frame(spark, rows))) == brute(rows)


def test_hot_lists(spark, monkeypatch):
    """With a low bound nearly all lists are hot and no list is expanded."""
    monkeypatch.setattr(near_dedup, "COLD", 4)
    rows = mixed_rows() + near_copies(4, 120) + near_copies(5, 60, 60, 3)
    assert got(near_duplicates(frame(spark, rows))) == brute(rows)


def test_null_ids_and_empty_table(spark):
    rows = [(None, "a b c d e f"), (3, "A b c d e f"), (4, None), (None, None)]
    out = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame(spark, rows)).collect()}
    assert out == {(None, 3, None, True), (3, 3, None, False), (4, 0, 4, True), (None, 0, None, True)}
    assert got(near_duplicates(frame(spark, []))) == []


def test_kept_documents(spark):
    """Repeated rows stay once; an id's other text goes with its own group; texts without words stay."""
    one, two = "a b c d e f g h", "q r s t u v w x"
    rows = [(5, one), (5, one), (6, one), (6, two), (3, two), (None, two), (None, one), (8, None), (9, "")]
    kept = near_dedup.kept_documents(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(None, one), (None, two), (8, None), (9, "")], key=repr)
    rows = [r for r in rows if r[0] is not None]
    assert sorted(((r.doc_id, r.text) for r in near_dedup.kept_documents(frame(spark, rows)).collect()), key=repr) == sorted([(5, one), (3, two), (8, None), (9, "")], key=repr)


def test_unrelated_texts_around_one_passage(spark, monkeypatch):
    """Lists of one passage hold texts that link with nothing, and some that do."""
    monkeypatch.setattr(near_dedup, "COLD", 4)
    rng = random.Random(8)
    passage = prose(rng, 60)
    rows = [(i, f"{prose(rng, 25)} {passage} {prose(rng, rng.randint(0, 20))}") for i in range(150)]
    rows += [(200 + i, f"{passage} {prose(rng, rng.randint(0, 9))}") for i in range(60)]
    rows += [(300 + i, rows[i][1] + " end") for i in range(0, 150, 5)]
    assert got(near_duplicates(frame(spark, rows))) == brute(rows)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    labels = {r.node: r.label for r in connected_components(links).collect()}
    assert all(labels[i] == 0 for i in range(41)) and labels[100] == labels[101] == 100


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001"])
def test_query(spark, d):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert got(QUERIES["op4_bottom_k_near_dedup"](spark, d)) == brute(rows)
