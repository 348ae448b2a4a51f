import hashlib
import random

from helpers import frame, mixed_rows

from tessera.llm.line_dedup import dedup_lines, line_key
from tessera.llm.queries import QUERIES


def brute(rows):
    owners = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(line_key(line)) >= 10:
                owners.setdefault(line_key(line), set()).add(-1 if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(owners.get(line_key(x), ())) < 2 or min(owners[line_key(x)]) == (-1 if i is None else i)]
        out.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in df.collect()), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(2)
    pool = [f"  Shared line number {i} " for i in range(6)] + ["short", "", "ÄÖÜ shared line ß"]
    rows = mixed_rows() + [(100 + i, "\n".join(rng.choice(pool).upper() if rng.random() < 0.3 else rng.choice(pool) for _ in range(rng.randint(1, 8)))) for i in range(60)]
    rows += [(None, "  shared line number 1"), (200, "x\nshared line number 2"), (200, "shared line number 3\ny"), (201, "twice the same\ntwice the same"), (201, "twice the same\ntwice the same")]
    assert got(dedup_lines(frame(spark, rows))) == brute(rows)


def test_one_line_in_every_document(spark):
    """A hot key crosses range boundaries; its rows still find their first document."""
    rows = [(i, f"the one common line\nown {i} line of text") for i in range(400)]
    out = got(dedup_lines(frame(spark, rows, 8)))
    assert sum(r[3] for r in out) == 399 and ("the one common line" in next(r[1] for r in out if r[0] == 0))


def test_empty_table(spark):
    assert got(dedup_lines(frame(spark, []))) == []


def test_query_on_smallest_tables(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = sorted((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, k in brute(rows))
    assert sorted(tuple(r) for r in QUERIES["op2_line_dedup"](spark, d).collect()) == want
