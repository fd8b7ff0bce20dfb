import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from maskwright.llm import substrings


def brute(docs, length):
    seen = Counter(d[i : i + length] for d in docs for i in range(len(d) - length + 1))
    out = []
    for d in docs:
        mark = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        edge = np.flatnonzero(np.diff(np.frombuffer(b"\0" + bytes(mark) + b"\0", np.int8)))
        out.append((sum(mark), len(edge) // 2, sha256(bytes(c for c, m in zip(d, mark, strict=True) if not m)).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab" if seed % 2 else "abcdefé") for _ in range(rng.choice([100, 300, 900]))) for _ in range(4)]
    docs = []
    for _ in range(30):
        parts = [b[(s := rng.randrange(len(b))) : s + rng.randrange(1, 500)] for b in rng.choices(base, k=3)]
        text = list("".join(parts))
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = rng.choice("xyz")
        docs.append("".join(text))
    return [*docs, None, "", "a" * 700, "ab" * 60, docs[0], docs[0], base[0] * 3]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 3000)
    texts = corpus(seed)
    rows = [*enumerate(texts), (None, texts[3]), (3, texts[3])]
    df = spark.createDataFrame([(t, i, "b") for i, t in rows], "text string, doc_id long, bucket string").repartition(3)
    raw = [(t or "").encode() for _, t in rows]
    want = [(i, len(d), *x) for (i, _), d, x in zip(rows, raw, brute(raw, 64), strict=True)]
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(df, 64).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def shared_words(texts):
    words = [(t or "").encode().split() for t in texts]
    where = {}
    for d, w in enumerate(words):
        for i in range(len(w) - 50):
            where.setdefault(tuple(w[i : i + 51]), set()).add(d)
    out = []
    for w in words:
        hit = set()
        for i in range(len(w) - 50):
            if len(where[tuple(w[i : i + 51])]) > 1:
                hit |= set(range(i, i + 51))
        out.append(len(hit))
    return out


@pytest.mark.parametrize("bucket", [2000, 10**6])
def test_passages(spark, monkeypatch, bucket):
    """Passages of 50 words are none, of 51 are; a passage that repeats within a document alone is none; short words are under 400 bytes."""
    monkeypatch.setattr(substrings, "BUCKET_BYTES", bucket)
    rng = random.Random(7)
    own = lambda n: " ".join(f"{rng.choice('abcdef')}{rng.randrange(99)}" for _ in range(n))
    texts = []
    for n in (50, 51, 52, 75, 200):
        p = own(n)
        texts += [f"{own(rng.randrange(40))} {p}  {own(rng.randrange(40))}\n", f"{own(30)}\t{p}", f"{p} {own(5)} {p}"]
    twice = own(60)
    texts += [f"{twice} x {twice}", own(300), None, "", own(51), texts[4], texts[4]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_shared_words for r in substrings.remove_repeats(df, 400).collect()}
    want = shared_words(texts)
    assert [got[i] for i in range(len(texts))] == want and want[:3] == [0, 0, 0] and min(want[3:15]) > 50 and want[15] == 0


def test_many_buckets(spark, monkeypatch):
    """Real documents over more than a hundred buckets, strings of 400 bytes, against brute force."""
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 6000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    raw = [(t or "").encode() for _, t in rows]
    assert sum(map(len, raw)) > 450_000
    want = sorted((i, len(d), *x) for (i, _), d, x in zip(rows, raw, brute(raw, 400), strict=True))
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 400).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert {r.doc_id: r.n_shared_words for r in got} == dict(zip([i for i, _ in rows], shared_words([t for _, t in rows]), strict=True))


def test_empty(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_longest_previous_factor():
    rng = random.Random(3)
    for n in (0, 1, 2, 30, 60):
        for letters in (b"a", b"ab", b"abcd"):
            d = bytes(rng.choice(letters) for _ in range(n))
            want = [max([0] + [k for j in range(i) for k in range(1, n - i + 1) if d[j : j + k] == d[i : i + k]]) for i in range(n)]
            assert substrings.longest_previous_factor(d).tolist() == want
            assert substrings.suffix_array(d).tolist() == sorted(range(n), key=lambda i: d[i:])


def test_repeats_within(spark):
    rows = [(1, "0123456789 and 0123456789 end"), (2, None), (3, ""), (None, "é" * 5)]
    got = substrings.repeats_within(spark.createDataFrame(rows, "doc_id long, text string"), 10)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "0123456789 and end"), (2, None), (3, ""), (None, "é" * 5)], key=str)
