import hashlib
import random
import re

from helpers import frame, mixed_rows, prose

from tessera.llm.decontaminate import find_contamination
from tessera.llm.queries import QUERIES

ITEMS = "item_id long, text string, doc_id long"


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(rows, items, span=13):
    grams = {}
    for i, t in items:
        w = words(t)
        n = min(span, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    sizes = {len(g) for g in grams}
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
                    found |= grams[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randint(14, 60))) for i in range(20)] + [(20, "one two"), (21, "solo"), (22, None), (23, ""), (24, "..."), (25, prose(rng, 13)), (2, "second text of item two with words enough for a window of thirteen words ok"), (None, prose(rng, 20)), (26, "ba " * 20)]
    rows = mixed_rows()
    for i in range(60):
        w = words(rng.choice([t for _, t in items if t]))
        a = rng.randrange(len(w) + 1)
        part = " ".join(w[a : a + rng.choice([5, 12, 13, 14, 30])])
        rows.append((200 + i, f"{prose(rng, rng.randint(0, 20))} {part.upper()}, {prose(rng, rng.randint(0, 200))}"))
    return rows + [(None, items[0][1]), (400, "Solo; one... TWO"), (401, "ba " * 60), (402, items[3][1]), (402, items[3][1])], items


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in df.collect()), key=repr)


def test_against_brute_force(spark):
    rows, items = cases()
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    assert got(find_contamination(frame(spark, rows), bench)) == brute(rows, items)


def test_in_blocks(spark):
    rows, items = cases()
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    out = find_contamination(frame(spark, rows), bench, block_bytes=1500, buckets=64)
    assert got(out) == brute(rows, items)
    for r in out.collect():
        assert r.n_hit == sum(b - a for a, b in zip(r.hit_starts, r.hit_ends)) and r.hit_starts == sorted(r.hit_starts)


def test_long_words(spark):
    rng = random.Random(5)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    token, sentence = "x" * 65, han(22)
    spread = prose(rng, 6) + f" {token} {sentence} " + prose(rng, 12)
    items = [(1, spread), (2, sentence), (3, f"{han(40)}, {han(30)}"), (4, token + " " + token), (5, " ".join(han(25) for _ in range(15)))]
    rows = [(i, f"{prose(rng, 9)} {t}, {prose(rng, 30)}") for i, t in items] + [(6, han(22)), (7, f"{han(40)} {sentence} {token}"), (8, spread.replace(token, "y" * 65))]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    want = brute(rows, items)
    assert [r[0] for r in want if r[2]] == [1, 2, 3, 4, 5, 7, 8] and want[4][2] >= 15
    assert got(find_contamination(frame(spark, rows), bench)) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEMS)
    assert got(find_contamination(frame(spark, []), none)) == []
    assert got(find_contamination(frame(spark, [(1, "a b")]), none)) == [(1, 2, 0, [])]


def test_query(spark):
    d = "/root/testdata/sf0.001"
    read = lambda t, c: [tuple(r) for r in spark.read.parquet(f"{d}/{t}.parquet").select(c, "text").collect()]
    want = {i: (n, h, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), h > 0 and 20 * h >= n) for i, n, h, x in brute(read("documents", "doc_id"), read("benchmark", "item_id"))}
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op9_benchmark_decontamination"](spark, d).collect()} == want
