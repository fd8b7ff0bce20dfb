import numpy as np
import pytest

from maskwright.llm import jaccard, simhash

SMALL = "/root/testdata/sf0.001"


def sets_of(rows, k=5):
    out = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        out[i] = {b" ".join(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    return out


def brute(rows, similarity=0.8):
    """The least id of each document's component by true Jaccard similarity; wordless texts are equal."""
    sets = sets_of(rows)
    ids = sorted(sets)
    where = {}
    for n, i in enumerate(ids):
        for s in sets[i]:
            where.setdefault(s, []).append(n)
    comp = list(range(len(ids)))

    def root(n):
        while comp[n] != n:
            n = comp[n]
        return n

    empty = [n for n, i in enumerate(ids) if not sets[i]]
    for n, i in enumerate(ids):
        near = {m for s in sets[i] for m in where[s] if m < n}
        near |= {m for m in empty if m < n and not sets[i]}
        for m in near:
            a, b = sets[i], sets[ids[m]]
            if not a and not b or len(a & b) >= similarity * len(a | b):
                x, y = root(n), root(m)
                comp[max(x, y)] = min(x, y)
    return {i: ids[root(n)] for n, i in enumerate(ids)}


def test_components_are_those_of_true_jaccard(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("common", [2, 10**9])
def test_pairs_about_the_threshold(spark, monkeypatch, common):
    """Edited copies on both sides of 0.8, some far in bits, chains, a large group and a line that all share."""
    monkeypatch.setattr(jaccard, "COMMON", common)
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for base in range(30):
        t = [f"b{base}w{x}" for x in range(int(rng.integers(6, 200)))]
        for _ in range(6):
            u = list(t)
            for at in rng.choice(len(t), int(rng.integers(0, 2 + len(t) // 30)), replace=False):
                u[at] = f"e{rng.integers(1 << 30)}"
            rows.append((n := n + 1, " ".join(u) + (" this line is in all of the texts here" if base % 2 else "")))
    t = [f"big{x}" for x in range(100)]
    for _ in range(80):
        u = list(t)
        u[rng.integers(0, 100)] = f"e{rng.integers(1 << 30)}"
        rows.append((n := n + 1, " ".join(u)))
    rows += [(n + 1, None), (n + 2, " "), (n + 3, "a B"), (n + 4, "A  b")]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = brute(rows)
    assert got == want and 40 < len(set(want.values())) < len(rows) - 60


def test_short_texts_and_repeated_lines_are_not_linked(spark):
    """Texts near in bits but below the similarity stay; sets that are equal but for counts go."""
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for m in (8, 9, 10):
        for _ in range(20):
            words = [f"w{x}" for x in rng.integers(0, 1 << 30, m)]
            rows += [(n := n + 1, " ".join(words)), (n := n + 1, " ".join([*words[:-1], "other"]))]
    line = " ".join(f"line{x}" for x in range(9)) + " "
    rows += [(n := n + 1, line * 50 + " ".join(f"own{i}x{x}" for x in range(40))) for i in range(2)]
    rows += [(n := n + 1, "one two three " * 5), (n := n + 1, "one two three " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.simhash_dedup(df).collect()}
    assert kept == set(range(1, n))
