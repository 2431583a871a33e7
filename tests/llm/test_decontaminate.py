import hashlib
import re

import numpy as np
import pytest

from kohorta.llm import decontaminate
from kohorta.llm.decontaminate import FMIndex, WaveletMatrix, contamination, suffix_order, without_benchmark

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows, items, window):
    phrases = {}
    for item, text in items:
        w = WORD.findall((text or "").encode().lower())
        for a in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[a: a + window]), set()).add(item)
    out = []
    for doc, text in rows:
        w, hit, found = WORD.findall((text or "").encode().lower()), set(), set()
        for n in {len(p) for p in phrases}:
            for a in range(len(w) - n + 1):
                if tuple(w[a: a + n]) in phrases:
                    hit.update(range(a, a + n))
                    found |= phrases[tuple(w[a: a + n])]
        named = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(named.encode()).hexdigest(), bool(hit)))
    return sorted(map(str, out))


@pytest.mark.parametrize("window,shard", [(10, 8_000_000), (4, 3000), (1, 3000)])
def test_against_brute_force(spark, tricky, texts, monkeypatch, window, shard):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
    base = texts[0][1]
    items = [(1, " ".join(base.split()[5:30])), (2, "One, two"), (3, None), (4, "?!"), (5, "é Ü 中文"), (6, " ".join(base.split()[40:52])),
             (10, " ".join(base.split()[40:52])), (7, "never seen anywhere at all by anyone in these documents today")]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, words int")
    got = contamination(tricky, bench, window)
    assert sorted(str(tuple(r)[:6]) for r in got.collect()) == brute(texts, items, window)
    for r in got.collect():
        assert sum(s.stop - s.start for s in r.spans) == r.n_hit
        assert all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_passages_are_cut_out(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Ä start; ALPHA beta-gamma (delta) end.", "x"), (2, "clean", "y"), (3, None, "z")],
                                 "doc_id long, text string, lang string")
    got = {r.doc_id: (r.text, r.lang) for r in without_benchmark(docs, bench, 4).collect()}
    assert got == {1: ("Ä start; ) end.", "x"), 2: ("clean", "y"), 3: (None, "z")}


def test_empty_tables(spark, tricky, texts, nothing):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in contamination(tricky, bench).collect()] == [0] * len(texts)
    assert contamination(nothing, bench).collect() == []


def test_index_parts():
    rng = np.random.default_rng(1)
    for _ in range(15):
        x = rng.integers(0, 9, rng.integers(1, 300))
        tree = WaveletMatrix(x, 9)
        places = rng.integers(0, len(x), 50)
        symbol, before = tree.access(places)
        assert (symbol == x[places]).all() and (before == [(x[:p] == x[p]).sum() for p in places]).all()
        assert (tree.rank(np.full(50, 4), places) == [(x[:p] == 4).sum() for p in places]).all()
        order = suffix_order(x)
        assert order.tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())
        words, breaks = rng.integers(1, 5, 200).astype(np.uint64), rng.random(200) < 0.1
        breaks[0] = True
        index = FMIndex(words, breaks)
        phrases = [words[a: a + n].copy() for a, n in zip(rng.integers(0, 190, 20), rng.integers(1, 6, 20))]
        phrases.append(np.array([99], np.uint64))
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high):
            want = [i for i in range(201 - len(p)) if (words[i: i + len(p)] == p).all() and not breaks[i + 1: i + len(p)].any()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want
