import zlib

from helpers import frame, mixed_rows

from tessera.llm.queries import QUERIES
from tessera.llm.sharding import shard


def check(rows, out, n_shards=8):
    assert len(out) == len(rows)
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in out), key=repr) == want
    for s in range(n_shards):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    return [sum(r["size"] for r in out if r.shard == s) for s in range(n_shards)]


def test_even_bytes(spark):
    rows = [(i, "x" * (i % 97 + 20)) for i in range(4000)] + [(None, None), (7, ""), (7, "")]
    sums = check(rows, shard(frame(spark, rows)).collect())
    assert max(sums) <= 1.02 * min(sums)


def test_one_text_in_half_of_the_rows_is_cut(spark):
    rows = [(i, "hot text " * 20) for i in range(1500)] + [(10_000 + i, f"text {i} " * 20) for i in range(1500)]
    sums = check(rows, shard(frame(spark, rows), n_ranges=64, sample=128).collect())
    assert max(sums) <= 1.1 * min(sums)


def test_equal_texts_share_a_shard(spark):
    rows = [(i, f"text {i % 3000} " + "y" * (i % 53)) for i in range(9000)]
    rows = [(i, rows[i % 3000][1]) for i in range(9000)]
    out = shard(frame(spark, rows), n_ranges=64, sample=512).collect()
    sums = check(rows, out)
    texts, homes = dict(rows), {}
    for r in out:
        homes.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(h) == 1 for h in homes.values()) and max(sums) <= 1.05 * min(sums)


def test_odd_rows_and_empty_table(spark):
    check(mixed_rows(), shard(frame(spark, mixed_rows())).collect())
    assert shard(frame(spark, [])).collect() == []


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    out = QUERIES["op10_sampled_splitter_shards"](spark, d).collect()
    check(rows, out)
    assert {r.law for r in out} == {"bytes"} and {r.grown_shard for r in out} == {None}
