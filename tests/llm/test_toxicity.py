import random

import numpy as np
import pytest

from maskwright.llm import toxicity


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = []
    for i in range(900):
        words = ["".join(rng.choice("abcdeghm") for _ in range(4)) for _ in range(rng.randint(3, 60))]
        grade = rng.choice([0, 0, 0, 1, 2])
        words += rng.choices(["zorg", "zilt", "zunk"], k=2 * grade if grade else 0) + (["vyle"] if grade == 2 else [])
        rng.shuffle(words)
        out.append((i, " ".join(words), grade))
    return out


def test_held_out(rows):
    model = toxicity.train([(t, g) for _, t, g in rows[:600]], 3)
    assert (np.diff(model.cuts) > 0).all()
    got = [(model.exceed(t), g) for _, t, g in rows[600:]]
    assert sum((e[0] > 0.5) == (g > 0) for e, g in got) >= 0.98 * len(got)
    mean = [np.mean([e.sum() for e, g in got if g == k]) for k in range(3)]
    assert mean[0] < 0.3 < mean[1] < mean[2]


def test_frames(spark, rows):
    docs = spark.createDataFrame([(t, i, 9) for i, t, _ in rows], "text string, doc_id long, severity int").repartition(3)
    table = [(i, int(g > 0), int(g < 2)) for i, _, g in rows] + [(None, 1, 1), (0, None, None), (1, 0, None)]
    labels = spark.createDataFrame(table, "doc_id long, toxic int, quality int")
    grades = toxicity.grades_of(labels)
    truth = {r.doc_id: r.grade for r in grades.collect()}
    assert truth == {i: g for i, _, g in rows}
    taken = toxicity.training_rows(docs, grades, per_grade=150)
    assert 330 < len(taken) < 560
    odd = spark.createDataFrame([(None, None, 1), ("", 5000, 1), ("zorg zilt " * 9000, 5001, 1), ("zorg zilt", 5001, 1)], docs.schema)
    got = toxicity.severity(docs.unionByName(odd), toxicity.train(taken, 3)).collect()
    assert len(got) == len(rows) + 4
    own = {(r.doc_id, r.toxic) for r in got}
    assert {(None, False), (5000, False), (5001, True)} <= own
    assert sum(r.toxic == (truth.get(r.doc_id, 0) > 0) for r in got) >= 0.97 * len(got)
    assert all(0 <= r.expected_severity <= 2 and 0 <= r.severity <= 2 for r in got)
    none = toxicity.train(toxicity.training_rows(docs.limit(0), grades), 3)
    assert not any(r.toxic for r in toxicity.severity(docs, none).collect())
    assert toxicity.severity(docs.limit(0), none).count() == 0


def test_held_out_half_of_the_real_labels():
    """Learns from the labelled documents of even id, some 220 of them toxic, judges those of odd id: what it names is toxic, and it
    finds two in three, whose words it has seen."""
    import pyarrow.parquet as pq

    text = {r["doc_id"]: r["text"] for r in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    labels = [r for r in pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pylist() if r["doc_id"] in text and r["toxic"] is not None]
    grade = lambda r: 0 if not r["toxic"] else 2 if r["quality"] == 0 else 1
    model = toxicity.train([(text[r["doc_id"]], grade(r)) for r in labels if r["doc_id"] % 2 == 0][:2500], 3)
    judged = [(model.exceed(text[r["doc_id"]])[0] > 0.5, bool(r["toxic"])) for r in labels if r["doc_id"] % 2]
    found = sum(a and b for a, b in judged)
    toxic, named = sum(b for _, b in judged), sum(a for a, _ in judged)
    assert toxic > 20 and found >= 0.65 * toxic and found >= 0.95 * named
