import corpus_pipeline
import pytest
from helpers import mixed_rows
from test_decontaminate import brute as contamination
from test_line_dedup import brute as lines
from test_near_dedup import brute as components
from test_packing import valid

from tessera.llm import toxicity
from tessera.llm.common import stage

D = "/root/testdata/sf0.001"


def test_each_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.dtypes
    bench = [tuple(r) for r in spark.read.parquet(f"{D}/benchmark.parquet").select("item_id", "text").collect()]
    want = None
    for name, each in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        rows = sorted((i, r.text) for i, r in before.items())
        out = stage(each(spark, docs, D), name)
        after = {r.doc_id: r for r in out.collect()}
        if name == "packing":
            valid(rows, out.collect(), 2048)
            break
        assert out.dtypes == columns
        if name == "toxicity":
            model = toxicity.learn(docs, spark.read.parquet(f"{D}/labels.parquet"))
            want = {r.doc_id for r in toxicity.score(docs, model).collect() if r.score < 0.5}
            assert 0 < len(want) < len(rows)
        elif name == "line_dedup":
            kept = {i: t for i, t, _, _ in lines(rows)}
            assert {i: (r.text, r.n_chars) for i, r in after.items()} == {i: (t, len(t)) for i, t in kept.items()}
            want = set(kept)
        elif name == "near_dedup":
            want = {i for i, _, _, kept in components(rows) if kept}
        elif name == "decontamination":
            want = {i for i, n, h, _ in contamination(rows, bench) if not (h and 20 * h >= n)}
        assert set(after) == want
        docs = out


def test_run_equals_the_stages(spark):
    out = corpus_pipeline.run(spark, D)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


ODD = [(None, "a null id of six words"), (None, None), (85, "ONE two Three"), (85, "ONE two Three"), (86, "another text of that id")]


@pytest.mark.parametrize("rows", [mixed_rows() + ODD, []], ids=["odd", "empty"])
def test_odd_rows_in_each_stage(spark, rows):
    """Nulls, empty and long texts, ties, repeated rows, an empty table and extra columns of clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, value long, label string"
    docs = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "r", 1, "l") for i, t in rows], schema).repartition(3)
    bench = [tuple(r) for r in spark.read.parquet(f"{D}/benchmark.parquet").select("item_id", "text").collect()]
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    for name, each in corpus_pipeline.STAGES:
        out = stage(each(spark, docs, D), f"odd-{name}")
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {i for i, _ in rows}
            continue
        assert out.columns == corpus_pipeline.COLUMNS
        if name == "line_dedup":
            assert sorted((r.doc_id is None, r.doc_id) for r in out.collect() if r.doc_id) == sorted((False, i) for i, _ in rows if i)
            assert out.where("n_chars <> length(text)").isEmpty()
            continue
        got = pairs(out)
        if name == "toxicity":
            assert len(got) >= 0.5 * len(rows) and set(got) <= set(rows)
        elif name == "near_dedup":
            plain = [(-1 if i is None else i, t) for i, t in rows]
            want = {(None if i < 0 else i, t) for (i, t), (j, _, c, k) in zip(sorted(plain, key=lambda r: r[0]), components_in_order(plain)) if k}
            assert set(got) == want and len(got) == len(want)
        elif name == "decontamination":
            hit = {i for i, n, h, _ in contamination([(n, t) for n, (_, t) in enumerate(rows)], bench) if h and 20 * h >= n}
            assert got == sorted((r for n, r in enumerate(rows) if n not in hit), key=repr)


def components_in_order(rows):
    """brute() by row: ties of an id keep the order of a stable sort."""
    order = sorted(range(len(rows)), key=lambda at: rows[at][0])
    spread = [(rows[at][0] * 1000 + n, rows[at][1]) for n, at in enumerate(order)]
    return [(i // 1000, n, c // 1000, i // 1000 == c // 1000) for i, n, c, _ in components(spread)]
