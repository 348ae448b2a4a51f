import math
import random

from helpers import frame, mixed_rows, prose

from tessera.llm.common import WordHashes, gram_hashes
from tessera.llm.decontaminate import words_of
from tessera.llm.licenses import TEMPLATES, bands_for, scan_licenses, shingle_set, size_classes
from tessera.llm.queries import QUERIES


def brute(rows, contained=0.8):
    """Containment over every stretch of a document, without windows or bands."""
    found = {}
    for i, t in rows:
        seq = gram_hashes(WordHashes().of(words_of(t)), 5)
        for name, (_, text) in TEMPLATES.items():
            s, reach = set(shingle_set(text).tolist()), math.ceil(2.5 * (len(words_of(text)) - 4))
            where = [k for k, h in enumerate(seq.tolist()) if h in s]
            share = max((len({int(h) for h in seq[k : k + reach]} & s) / len(s) for k in where), default=0)
            if share >= contained:
                found[i, name] = max(found.get((i, name), 0), share)
    return found


def cases():
    rng = random.Random(10)
    rows = mixed_rows()
    for n, (name, (_, text)) in enumerate(sorted(TEMPLATES.items())):
        for k in range(3):
            words = text.split()
            for _ in range(k * len(words) // 80):
                words[rng.randrange(len(words))] = "changed"
            rows.append((1000 + 10 * n + k, f"{prose(rng, rng.randint(0, 90))} {' '.join(words).upper()} {prose(rng, rng.randint(0, 300))}"))
    return rows + [(2000, TEMPLATES["mit-line"][1]), (2001, "Released under the MIT"), (2002, f"{TEMPLATES['mit-line'][1]} x {TEMPLATES['mit-line'][1]}")]


def test_against_all_stretches(spark):
    rows = cases()
    out = scan_licenses(frame(spark, rows)).collect()
    assert {(r.doc_id, r.template_id): r.containment for r in out} == brute(rows)
    twice = next(r for r in out if r.doc_id == 2002 and r.template_id == "mit-line")
    assert [(s.start, s.end) for s in twice.spans] == [(0, 5), (6, 11)] and twice.license == "MIT"


def test_every_template_is_found(spark):
    found = {(r.doc_id, r.template_id) for r in scan_licenses(frame(spark, cases())).collect()}
    for n, name in enumerate(sorted(TEMPLATES)):
        assert (1000 + 10 * n, name) in found


def test_notices_cut_by_other_words_are_found_wherever_they_lie(spark):
    rng, rows, names = random.Random(5), [], ["apache-2.0-header", "mit-notice", "gpl-notice", "bsd-conditions"]
    for n, name in enumerate(names):
        words = TEMPLATES[name][1].split()
        for k in range(60):
            half = len(words) // 2
            rows.append((100 * n + k, f"{prose(rng, 7 * k + 1)} {' '.join(words[:half])} {prose(rng, 80)} {' '.join(words[half:])} {prose(rng, 300 - k)}"))
    out = {(r.doc_id, r.template_id): r.containment for r in scan_licenses(frame(spark, rows)).collect()}
    assert out == brute(rows)
    assert sum((100 * n + k, name) in out for n, name in enumerate(names) for k in range(60)) == 240


def test_repeats_and_empty_table(spark):
    line = TEMPLATES["mit-line"][1]
    assert scan_licenses(frame(spark, [(1, line), (1, line), (None, line)])).count() == 3
    assert scan_licenses(frame(spark, [])).collect() == []
    assert 10 < bands_for(size_classes(TEMPLATES)) < 120


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    out = QUERIES["op1_license_scan"](spark, d).collect()
    assert {(r.doc_id, r.template_id): r.containment for r in out} == brute(rows)
