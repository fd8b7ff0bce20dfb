import numpy as np
import pytest
from test_jaccard import brute

from maskwright.llm import jaccard


def _written(spark):
    """Bytes of shuffles written so far."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_sets_of_chance_pairs_are_not_sent(spark):
    """Long texts that share one passage, and are not similar, make pairs but send a few bits a shingle only."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 4000)) + " these words are in all of the texts here") for i in range(24)]
    rows.append((99, rows[3][1] + " and a few more"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = _written(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as tables of any size but these few rows
    try:
        got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {i: 3 if i == 99 else i for i, _ in rows}
    assert _written(spark) - before < 2 * 8 * 4000 * len(rows)  # the first shingles and what they carry; 276 pairs of sets are 18 MB


def test_what_rules_pairs_out_never_counts_too_much():
    rng = np.random.default_rng(2)
    for n in [1, 2, 31, 32, 33, 63, 65, 500, 1000, 1025, 30_000]:
        pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2)
        for share in (0, 0.5, 0.8, 0.9, 1):
            x = np.unique(pool[:n])
            y = np.unique(np.concatenate([pool[: int(share * n)], pool[n : n + max(1, n - int(share * n))], pool[-(n // 9) - 1 :]]))
            apart = len(np.setxor1d(x, y))
            assert jaccard._differ(jaccard._bits(x), jaccard._bits(y)) == jaccard._differ(jaccard._bits(y), jaccard._bits(x)) <= apart
            a, b = (np.frombuffer(jaccard._histogram(s), np.uint8)[None] for s in (x, y))
            exact = len(x) + len(y) - apart >= 2 * 0.8 / 1.8 * (len(x) + len(y)) - 1e-9
            assert not exact or jaccard._near(a, b, np.array([len(x) + len(y)]), 0.8)[0]
            assert not exact or apart <= jaccard._apart(len(x) + len(y), 0.8)
    empty = np.empty(0, np.uint64)
    assert jaccard._differ(jaccard._bits(empty), jaccard._bits(empty)) == 0
    x, y = (np.unique(rng.integers(0, 1 << 63, 2000, dtype=np.uint64)) for _ in range(2))
    assert jaccard._differ(jaccard._bits(x), jaccard._bits(y)) > jaccard._apart(4000, 0.8)


@pytest.mark.parametrize("most, group", [(150, 3), (10**6, 1)])
def test_slices_and_groups_lose_nothing(spark, monkeypatch, most, group):
    """The same components if pairs are verified in many slices and a set's partners in many groups; an id with two texts."""
    for name, value in (("MOST_PAIRS", most), ("GROUP", group), ("ROOM", 300_000), ("SHARE", 0)):
        monkeypatch.setattr(jaccard, name, value)
    monkeypatch.setattr(jaccard, "_free", lambda spark: None)  # which waits
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for base, size in [(0, 60), (1, 8), (2, 300), (3, 40)]:
        t = [f"b{base}w{x}" for x in range(size)]
        for _ in range(25):
            u = list(t)
            for at in rng.choice(size, int(rng.integers(0, 2 + size // 25)), replace=False):
                u[at] = f"e{rng.integers(1 << 30)}"
            rows.append((n := n + 1, " ".join(u)))
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = brute(rows)
    assert got == want and 4 < len(set(want.values())) < 60
    t = " ".join(f"x{i}" for i in range(50))
    rows = [(1, t), (1, t), (1, "another text of the same id"), (2, t + " more"), (3, "another text of the same id")]
    got = {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)}
