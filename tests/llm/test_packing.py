import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from helpers import frame, mixed_rows
from tokenizers import Tokenizer

from tessera.llm.packing import Encoder, configurations, encoder_of, grouped, pack, plan, sequences, vocabulary
from tessera.llm.queries import QUERIES

ODD = ["<|endoftext|> a<|startoftext|>b  c", "É́ é ﬁ Σας ΟΔΟΣ don't it's 'll x y z\x1cq\x85r", "日本語 テキスト 12345 a1b2", "\t\n\r\x0b ", "I'M WE'LL", "e ́x \ń", "", "x" * 500, "ʼİ< b漢İ| \u0958! #?é_ (word)-,", "Ünïcödé ñandú straße ÿ ŉ ǆ ªº µ word., İstanbul ıI ſt ŀl"]


def test_encoder_equals_the_tokenizer():
    whole = Tokenizer.from_file(vocabulary())
    texts = [t or "" for _, t in mixed_rows()] + ODD
    for most in (200, 300_000):  # a small memory is often cleared
        encoder = Encoder(vocabulary(), most)
        for t in texts + texts:
            assert encoder.ids(t).tolist() == whole.encode(t, add_special_tokens=False).ids


def test_encoder_keeps_what_is_met_again():
    whole = Tokenizer.from_file(vocabulary())
    encoder = Encoder(vocabulary(), 300)
    texts = [f"again, and Again {' '.join(f'w{a}{b}' for b in range(40))}" for a in range(30)]
    for t in texts:
        assert encoder.ids(t).tolist() == whole.encode(t, add_special_tokens=False).ids
    assert {"again", "again,", "and"} <= set(encoder.at) and "w00" not in encoder.at and len(encoder.at) <= 301
    rows = [t for _, t in mixed_rows()] + [None] + ODD + texts  # texts of one batch
    for most in (300, 300_000):
        got = Encoder(vocabulary(), most).of(pa.array(rows, pa.string()).slice(1))
        assert [x.tolist() for x in got] == [whole.encode(t or "", add_special_tokens=False).ids for t in rows[1:]]
    assert encoder_of(vocabulary()) is encoder_of(vocabulary())  # one a worker process


def valid(rows, out, capacity):
    whole = Tokenizer.from_file(vocabulary())
    want = sorted((i, p, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())) for i, t in rows for ids in [whole.encode(t or "", add_special_tokens=False).ids + [0]] for p, at in enumerate(range(0, len(ids), capacity)) for cut in [ids[at : at + capacity]])
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by), -(-sum(r.length for r in out) // capacity)


def test_pieces_and_places(spark):
    rows = mixed_rows() + [(500, "again and again"), (500, "again and again")]
    n, least = valid(rows, pack(frame(spark, rows), vocabulary(), capacity=256).collect(), 256)
    assert n <= least * 1.05 + 2
    assert pack(frame(spark, []), vocabulary()).collect() == []


def test_round_trip_of_sequences(spark):
    rows = mixed_rows()
    packed = pack(frame(spark, rows), vocabulary(), capacity=256, with_ids=True).cache()
    whole = {r.sequence_id: r.ids for r in sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids


def test_plan_uses_each_rank_once():
    rng = random.Random(6)
    for histogram in ({2048: 7}, {1: 5000}, {700: 10_000, 650: 3, 699: 1}, {rng.randint(1, 2048): rng.randint(1, 10**6) for _ in range(400)}):
        p = plan(histogram)
        for length, rows in p.groupby("length"):
            assert rows["lo"].iloc[0] == 0 and rows["hi"].iloc[-1] == histogram[length] and (rows["lo"].iloc[1:].to_numpy() == rows["hi"].iloc[:-1].to_numpy()).all()
        total = sum(k * n for k, n in histogram.items())
        assert (p["base"] + (p["hi"] - p["lo"] - 1) // p["each"]).max() + 1 <= max(1.03 * total / 2048 + 2, sum(n for k, n in histogram.items() if k > 1024), sum(n for k, n in histogram.items() if k > 682) / 2 + 2)


def test_groups_and_configurations():
    parts = grouped({10: 5, 9: 5, 8: 2}, 3)
    assert [sum(n for _, n in g) for g in parts] == [4, 4, 4] and parts[0] == [(10, 4)]
    found = configurations([10, 9, 8], [4, 4, 4], 18)
    assert [sum(used.get(g, 0) * n for used, n in found) for g in range(3)] == [4, 4, 4]
    assert all(sum([10, 9, 8][g] * k for g, k in used.items()) <= 18 for used, _ in found)


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    n, least = valid(rows, QUERIES["op5_linear_grouping_packing"](spark, d).collect(), 2048)
    assert n <= least * 1.03 + 2
