"""Operators whose queries once read a part of their input, on small fixtures."""

import math

import pytest

from tessera.operators import ranking


def test_slot_growth_beyond_a_double(spark):
    p = spark.range(3000).selectExpr("cast(0 as int) i", "1.0D net").union(spark.createDataFrame([(1, -1.0), (1, 0.5)], "i int, net double"))
    got = {r.slot: r for r in ranking.slot_portfolio(p, "i", "net").collect()}
    assert got[0].log_growth == pytest.approx(3000 * math.log(2)) and got[1].growth == 0 and got[1].log_growth is None and got[2].log_growth == 0


def test_rare_tokens_of_many_rows(spark):
    from tessera.operators.similarity import rare_token_pairs

    sets = [(i, ["often", f"t{i % 5}", f"u{i % 10}", f"v{i % 15}", f"own{i}"] + [f"pad{i}-{j}" for j in range(i % 11)]) for i in range(60)]
    for options in ({"max_share": 0.4}, {"most_df": 15}, {"max_share": 1.0, "min_shared": 2, "min_overlap": 0.4}):
        o = {"max_share": 0.15, "min_shared": 3, "min_overlap": 0.25, "most_df": None} | options
        df = {}
        for _, s in sets:
            for t in s:
                df[t] = df.get(t, 0) + 1
        kept = {i: {t for t in s if df[t] <= (o["most_df"] or max(2, int(60 * o["max_share"])))} for i, s in sets}
        want = {(a, b, n) for a in kept for b in kept if a < b and (n := len(kept[a] & kept[b])) >= o["min_shared"] and n >= o["min_overlap"] * min(len(kept[a]), len(kept[b]))}
        assert want and {tuple(r) for r in rare_token_pairs(spark.createDataFrame(sets, "k int, tokens array<string>"), "k", "tokens", **options).collect()} == want


def test_numbered_with_gaps(spark):
    from tessera.operators.calendar import numbered

    keys = [-3000, -1, 0, 5, 1023, 1024, 5000, 5001]
    rows = spark.createDataFrame([(k,) for k in reversed(keys)], "k long")
    assert {r.k: r.i for r in numbered(rows, "k", "i").collect()} == {k: i for i, k in enumerate(keys)}
