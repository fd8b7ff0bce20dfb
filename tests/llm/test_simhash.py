import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from maskwright.llm import simhash
from maskwright.llm.graph import components


def plain_fp(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB \t\n\x0bcé\x1c\xa0", max_size=60), st.integers(1, 5))
def test_fingerprint(text, k):
    assert int(simhash._fingerprints([text], k)[0]) == plain_fp(text, k)


def test_fingerprint_of_long_text():
    text = " ".join(str(i % 701) for i in range(3000))
    assert int(simhash._fingerprints([text], 4)[0]) == plain_fp(text, 4)


@pytest.mark.parametrize("width", [1, 3])
@pytest.mark.parametrize("radius", [0, 1, 4, 7, 14, 46])
def test_forest_is_exact(radius, width):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**64, (6, width), dtype=np.uint64)
    fps = base[rng.integers(0, 6, 300)]
    for _ in range(5):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, (300, width)).astype(np.uint64)) * rng.integers(0, 2, (300, width)).astype(np.uint64)
    group = np.sort(rng.integers(0, 4, 300))
    u, v = simhash._forest(fps, group, radius)
    near = (np.bitwise_count(fps[:, None] ^ fps[None, :]).sum(2) <= radius) & (group[:, None] == group[None, :])
    label = np.arange(300)
    for _ in range(300):
        label = np.where(near, label[None, :], 999).min(1)
    got = np.arange(300)
    got[u] = v
    assert (got == label).all()


def truth(rows, k, radius):
    fps = [plain_fp(t, k) for _, t in rows]
    comp = list(range(len(rows)))
    for _ in rows:
        comp = [min(comp[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= radius) for i in range(len(rows))]
    return [(rows[i][0], min((rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None), default=None)) for i in range(len(rows))]


@pytest.mark.parametrize("part", [8, 2048])
def test_similar_links(spark, part):
    """Of texts at several similarities, which pairs are in one group."""
    rng = np.random.default_rng(4)
    texts, wanted = [], {}
    for base in range(40):
        t = [f"b{base}w{x}" for x in range(300)]
        for edits in (0, 1, 3, 5, 40):
            u = list(t)
            for at in rng.choice(300, edits, replace=False):
                u[at] = f"e{rng.integers(1 << 30)}"
            wanted[len(texts)] = edits < 40
            texts.append(" ".join(u))
    fps = simhash._fingerprints(texts, 5, simhash.WIDTH)
    reps = spark.createDataFrame([(i, bytearray(f.tobytes())) for i, f in enumerate(fps)], "rep long, fp binary").repartition(3)
    got = {r.node: r.component for r in components(simhash.similar_links(reps, 0.8, part)).collect()}
    assert sum(got.get(i) == i // 5 * 5 for i, near in wanted.items() if near) >= 155
    assert not any(i in got for i, near in wanted.items() if not near)


@pytest.mark.parametrize("part", [4, 512])
def test_components_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(40)]
    rows = [(None, None), (5, None), (6, ""), (7, "A b"), (8, "a  B"), (8, "a  B")]
    for i in range(12):
        t = [words[x] for x in rng.integers(0, 40, 120)]
        for j in range(6):
            rows.append((100 * i + j + 10, " ".join(t)))
            t[rng.integers(0, 120)] = "x"
    df = spark.createDataFrame([(t, i, "z") for i, t in rows], "text string, doc_id long, fp string").repartition(3)
    for blocks in (None, 6):
        got = simhash.simhash_components(df, 3, 4, blocks=blocks).collect()
        assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(truth(rows, 3, 4), key=str)


def test_empty_and_dedup(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_components(df).count() == 0
    df = spark.createDataFrame([(2, "a b c", 1), (1, "a b c", 2), (3, "other words here", 3), (None, "a b c", 4)], "doc_id long, text string, rep int")
    assert sorted((r.doc_id or 0, r.rep) for r in simhash.simhash_dedup(df).collect()) == [(0, 4), (1, 2), (3, 3)]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
