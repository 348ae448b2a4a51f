import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from helpers import frame, mixed_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import fill_in_middle as fim

TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc, text):
    text = text or ""
    tokens = TOKENS.findall(text)
    h = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc, len(tokens), "plain", None, None, text)
    form, out = ("spm", f"<S>{suffix}<P>{prefix}<M>{middle}") if h4 % 100 < 80 else ("psm", f"<P>{prefix}<S>{suffix}<M>{middle}")
    return (doc, len(tokens), form, len(prefix), len(middle), out)


def rows_():
    odd = ["<P>", "<p> x", "a<P", "P> b", "<S>\x1c\x85 x", " lead", "trail  ", "  ", "\n\n", "a b c", "<M", ">", "𝔸𝔹 é", "<P", "S>", "x<P>y z"]
    rng = random.Random(5)
    rows = mixed_rows() + [(1000 + i, odd[i % len(odd)]) for i in range(400)]
    rows += [(2000 + i, "".join(rng.choice("ab<>PSM \n\té𝔸") for _ in range(rng.randrange(60)))) for i in range(600)]
    return rows + [(None, None), (None, "one two three four"), (3000, "same text here"), (3000, "same text here"), (-5, "w " * 200_000)]


def test_against_brute_force(spark):
    rows = rows_()
    out = fim.fill_in_middle(frame(spark, rows)).withColumn("back", fim.restored()).collect()
    assert sorted(map(repr, (tuple(r)[:6] for r in out))) == sorted(repr(brute(*r)) for r in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    texts = {}
    for doc, text in rows:
        texts.setdefault(doc, set()).add(text or "")
    assert all(r.back in texts[r.doc_id] for r in out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" \n\u000bab<>PSMé𝔸", max_size=14), max_size=8), st.integers(0, 3), st.integers(0, 2**32))
def test_kernel_on_slices(texts, skip, seed):
    """Batches may be slices of larger ones, and rows may be empty in any place."""
    rng = np.random.default_rng(seed)
    array = pa.array(["zz <P>"] * skip + texts + ["<S> q"], pa.string()).slice(skip, len(texts))
    h = rng.integers(0, 2**32, (len(texts), 4))
    got = fim.rearrange(array, h, share=90, spm_share=50)
    outputs = got["output"].to_pylist()
    for i, text in enumerate(texts):
        tokens = TOKENS.findall(text)
        a, b = sorted(int(x) % (len(tokens) + 1) for x in h[i, :2])
        p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
        form = "plain" if not text or re.search("<[PSM]>", text) or h[i, 2] % 100 >= 90 else "spm" if h[i, 3] % 100 < 50 else "psm"
        assert (int(got["n"][i]), got["form"][i].as_py()) == (len(tokens), form)
        assert outputs[i] == {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]


def test_long_outputs_are_gathered_in_parts(monkeypatch):
    texts = ["one two three", "", "a", "four  five six seven " * 3]
    h = np.array([[1, 2, 0, 99], [5, 5, 0, 0], [0, 1, 0, 0], [3, 9, 0, 90]])
    whole = fim.rearrange(pa.array(texts), h)["output"].to_pylist()
    monkeypatch.setattr(fim, "_GATHER", 7)
    assert fim.rearrange(pa.array(texts), h)["output"].to_pylist() == whole
    assert whole[:3] == ["<P>one<S> three<M> two", "", "<S><P><M>a"]


def test_empty_table(spark):
    assert fim.fill_in_middle(frame(spark, [])).collect() == []
