import hashlib
import random

import numpy as np
from helpers import frame, mixed_rows, prose

from tessera.llm.lcp_merge import common_prefix, decoded, front_code, merged
from tessera.llm.suffix_dedup import op8_anchored_suffix_dedup, repeated_spans


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for (i, _), t in zip(rows, texts):
        cut = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                cut[k : k + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], cut, [0]]).astype(int)))
        spans = list(zip(edges[::2].tolist(), edges[1::2].tolist()))
        out.append((i, len(t), spans, hashlib.sha256(bytes(b for b, c in zip(t, cut) if not c)).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], r.kept_sha256) for r in df.collect()), key=repr)


def pieced(seed, n):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcd é") for _ in range(rng.randint(20, 150))) for _ in range(6)]
    return [(i, "".join(rng.choice(pool)[rng.randint(0, 15) :] if rng.random() < 0.6 else "".join(rng.choice("abcd") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 6)))) for i in range(n)]


def test_against_brute_force(spark):
    rows = pieced(3, 80) + [(None, "n" * 200), (None, None), (7, "same row " * 12), (7, "same row " * 12)] + mixed_rows()
    want = brute(rows, 60)
    assert got(repeated_spans(frame(spark, rows), length=60, gram=15)) == want
    # groups over the bound are split, with the same result
    for bound in (3,):
        assert got(repeated_spans(frame(spark, rows), length=60, gram=15, bound=bound)) == want


def test_large_groups_at_production_size(spark):
    """One passage in 400 documents of other text around it, texts of short periods, and a bound that all of them exceed."""
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(900))
    rows = [(i, prose(rng, 40) + passage[rng.randint(0, 150) : 900 - rng.randint(0, 200)] + prose(rng, 40)) for i in range(400)]
    rows += [(1000 + i, unit * 120 + prose(rng, 70)) for i, unit in enumerate(["a", "ab", "one line of it\n", "one line of it\n"])]
    want = brute(rows, 400)
    assert got(repeated_spans(frame(spark, rows), bound=50)) == want
    assert got(repeated_spans(frame(spark, rows))) == want


def test_production_parameters(spark):
    assert got(repeated_spans(frame(spark, mixed_rows(5)))) == brute(mixed_rows(5), 400)


def test_planted_passages(spark, tmp_path):
    """Passages of over 50 words: from 400 bytes on, also with fewer characters, they go; shorter ones and clean documents stay. n_bytes tells nothing of it."""
    rng = random.Random(12)
    long, short = prose(rng, 90), prose(rng, 51, 10)
    accents = " ".join(f"é{w}é" for w in prose(rng, 51, 10).split()[:51])
    assert len(long) > 400 and len(short) < 396 and len(accents) < 396 and len(accents.encode()) >= 400
    rows = [(100 * k + i, f"{prose(rng, 60)} {passage} {prose(rng, 60)}") for k, passage in enumerate((long, accents, short, "")) for i in range(5)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = op8_anchored_suffix_dedup(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in found) == sorted((i, n, sum(b - a for a, b in spans), len(spans), sha) for i, n, spans, sha in brute(rows, 400))
    assert all((r.n_removed > 0) == (r.doc_id < 200) for r in found)
    assert [r.n_bytes for r in sorted(found, key=lambda r: r.doc_id)] == [len(t.encode()) for _, t in rows]


def test_empty_table(spark):
    assert got(repeated_spans(frame(spark, []))) == []


def test_loser_tree():
    rng = random.Random(9)
    for k in (0, 1, 2, 3, 7):
        runs = [sorted((bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))), b"left", i, j, 0, 0) for j in range(rng.randint(1, 30))) for i in range(k)]
        blobs = [front_code(r) for r in runs]
        assert [[x[0] for x in decoded(b)] for b in blobs] == [[e[0] for e in r] for r in runs]
        out, last = list(merged(blobs)), b""
        assert [x[0] for x in out] == sorted(e[0] for r in runs for e in r)
        for string, lcp, _ in out:
            assert lcp == common_prefix(last, string)
            last = string
