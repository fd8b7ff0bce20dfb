import numpy as np
import pytest

from maskwright.llm import embeddings


def brute(rows, threshold):
    n = len(rows)
    unit = []
    for _, x, label in rows:
        ok = label is not None and x and all(c is not None and np.isfinite(c) for c in x) and any(x)
        unit.append(np.array(x, float) / np.linalg.norm(np.array(x, float) / max(map(abs, x))) / max(map(abs, x)) if ok else None)
    near = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    comp = [r[0] for r in rows]
    for _ in range(n):
        new = [min([comp[i], *(comp[j] for j in near[i])]) for i in range(n)]
        if new == comp:
            break
        comp = new
    return [(rows[i][0], len(near[i]), comp[i], rows[i][0] == comp[i]) for i in range(n)]


@pytest.mark.parametrize("part", [8, 256])
def test_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(embeddings, "PART", part)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 8))
    rows = []
    for i in range(220):
        v = base[rng.integers(0, 12)] + rng.normal(size=8) * 0.22
        rows.append((i * 3, v.tolist(), int(rng.integers(0, 2)) if i % 20 else None))
    rows += [(1000 + i, base[0].tolist(), 1) for i in range(40)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 8, 1), (2003, [1.0, None] * 4, 1), (2004, [float("nan")] * 8, 1), (2005, [float("inf")] + [0.0] * 7, 1)]
    rows += [(2006, [1e300] * 8, 0), (2007, [1e-300] * 8, 0), (2008, [1.0, 1.0], 0), (2009, [2.0, 2.0], 0), (2010, [-0.0, 1.0], 0), (2011, [0.0, 1.0], 0)]
    df = spark.createDataFrame([(x, i, label, "c") for i, x, label in rows], "embedding array<double>, vec_id long, label int, n_links string").repartition(3)
    got = embeddings.near_vectors(df, 0.93, bits=3, tables=60)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, 0.93))


def test_planned_recall(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 32))
    rows = [(i, (base[i % 300] + rng.normal(size=32) * 0.2).tolist(), 1) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sum(r.n_links for r in embeddings.near_vectors(df, 0.93).collect())
    want = sum(r[1] for r in brute([(i, np.float32(x).tolist(), n) for i, x, n in rows], 0.93))
    assert 0.97 * want <= got <= want


def test_recall_at_scale(spark):
    """12,000 vectors in two labels, many pairs just above the threshold, against all cosines."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(3000, 64)).astype(np.float32)
    x = (base[np.arange(12000) % 3000] + rng.normal(size=(12000, 64)) * 0.24).astype(np.float32)
    label = (np.arange(12000) % 3000) % 2
    df = spark.createDataFrame([(i, v.tolist(), int(n)) for i, (v, n) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = 0
    for n in (0, 1):
        u = unit[label == n]
        want += int((u @ u.T >= 0.93).sum()) - len(u)
    got = sum(r.n_links for r in embeddings.near_vectors(df, 0.93).collect())
    assert want > 10_000 and 0.98 * want <= got <= want


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_vectors(df).count() == 0
    df = spark.createDataFrame([(None, [1.0], 1), (4, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, embeddings.near_vectors(df).collect()), key=str) == [(4, 1, 4, True), (None, 1, 4, False)]
