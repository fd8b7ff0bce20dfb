import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from maskwright.llm import decontam


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, size):
    out = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for n, x in items:
            q = words(x)
            for lo in range(max(1, len(q) - size + 1) if q else 0):
                g = q[lo : lo + size]
                for p in range(len(w) - len(g) + 1):
                    if w[p : p + len(g)] == g:
                        hit |= set(range(p, p + len(g)))
                        names |= {n} - {None}
        out.append((i, len(w), len(hit), sorted(names, key=str)))
    return out


texts = st.one_of(st.none(), st.lists(st.sampled_from(["a", "B", "é", "d1"]), max_size=25).map(" ".join))


@settings(max_examples=80, deadline=None)
@given(st.lists(texts, min_size=1, max_size=6), st.lists(texts, max_size=5), st.integers(1, 6), st.integers(0, 4))
def test_intersected_lists(docs, items, size, reach):
    """All exact and proximity matches of a shard, from its posting lists alone."""
    b = decontam._posted(5, list(range(len(docs))), docs, 7)
    h, lists = b.column("h").to_pylist(), [np.frombuffer(x, "<i4") for x in b.column("places").to_pylist()]
    ends = np.cumsum(lists[-1].astype(np.int64))
    of = [decontam.words_of(t) for t in docs]
    run = [x for w in of for x in (*w, None)]
    assert {t: np.cumsum(x).tolist() for t, x in zip(b.column("term").to_pylist(), lists, strict=True) if t is not None} == {t: [i for i, x in enumerate(run) if x == t] for t in set(run) - {None}}
    count = {t: run.count(t) for t in run}
    named = dict(zip(b.column("term").to_pylist(), h, strict=True))
    found = sorted({tuple(w[lo : lo + size]) for t in items for w in [decontam.words_of(t)] if w for lo in range(max(1, len(w) - size + 1))})
    if not found:
        return
    ranked = [sorted(range(len(w)), key=lambda j: (count.get(w[j], 0), j)) for w in found]
    pad = lambda x, v: x + [v] * (size - len(x))
    terms = np.array([pad([named.get(w[j], 1) for j in r], 0) for w, r in zip(found, ranked, strict=True)], np.int64)
    offset = np.array([pad(list(r), -1) for r in ranked], np.int64)
    exact, start, near, place = (x.tolist() for x in decontam.intersect(np.array(h[:-1], np.int64), lists[:-1], ends, terms, offset, reach))
    assert sorted(zip(exact, start)) == [(n, p) for n, w in enumerate(found) for p in range(len(run)) if tuple(run[p : p + len(w)]) == w]
    want = []
    for n, (w, r) in enumerate(zip(found, ranked, strict=True)):
        for p, x in enumerate(run):
            if x == w[r[0]]:
                d = int(np.searchsorted(ends, p, "right"))
                about = run[max(p - reach, int(ends[d - 1]) if d else 0) : min(p + reach + 1, int(ends[d]))]
                want += [(n, p)] if set(w) <= set(about) else []
    assert sorted(zip(near, place)) == want


@pytest.mark.parametrize("block", [200_000, 2])
def test_frames(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "WINDOWS", block)
    monkeypatch.setattr(decontam, "SHARD_WORDS", 5)
    docs = [(1, "one two three four five"), (2, None), (None, "x two, THREE four"), (3, ""), (3, ""), (4, "z " * 3000 + "two three four"), (5, "a two three four b"), (5, "one")]
    items = [(10, "two three four"), (9, "two three four!"), (None, "one"), (7, None), (8, "five"), (11, "one two three four"), (12, "a two three four b")]
    frame = spark.createDataFrame([(9, t, i) for i, t in docs], "n_hit int, text string, doc_id long").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontam.decontaminate(frame, bench, 3).collect()]
    assert sorted(got, key=str) == sorted(brute(docs, items, 3), key=str)
    assert decontam.decontaminate(frame.limit(0), bench).count() == 0
    assert {r.n_hit for r in decontam.decontaminate(frame, bench.limit(0)).collect()} == {0}
    left = sorted(((r.doc_id, r.text) for r in decontam.clean(frame, bench, 3).collect()), key=str)
    assert left == sorted([d for d, r in zip(docs, brute(docs, items, 3), strict=True) if not r[2]], key=str)


def test_near_matches(spark):
    docs = [(1, "c b a x x"), (2, "a x x x x b c"), (3, None), (4, "b c"), (5, "a b"), (6, "c x a"), (None, "a b c")]
    items = [(7, "a b c"), (8, "A c"), (None, "a")]
    frame = spark.createDataFrame([(t, i, 0) for i, t in docs], "text string, doc_id long, word int").repartition(3)
    got = decontam.near_matches(frame, spark.createDataFrame(items, "item_id long, text string"), 3, 2)
    pairs = {(r.doc_id, r.item_id) for r in got.collect()}
    assert pairs == {(1, 7), (1, 8), (6, 8), (None, 7), (None, 8)}


def test_postings(spark):
    got = decontam.postings(spark.createDataFrame([(1, "É a, B a"), (2, None), (3, "b")], "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [("a", 1, [1, 3]), ("b", 1, [2]), ("b", 3, [0]), ("É", 1, [0])]
