import random

import pytest
from test_jaccard import brute

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from maskwright.llm import bpe, decontam, langid, secrets

SMALL = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark):
    """Each stage on what the one before it kept, by brute force from the operators' plain functions."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = langid.train(langid.training_rows(docs))
    kept = {i for i, r in rows.items() if (p := model.predict(r.text))[0] != "und" and p[1] >= model.threshold}
    one = pipeline.language(spark, docs, SMALL)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == kept and len(kept) > 0.98 * len(rows)

    groups = brute((i, rows[i].text) for i in sorted(kept))  # by true Jaccard similarity of five-word shingle sets
    two = pipeline.near_duplicates(spark, one, SMALL)
    kept = {i for i, least in groups.items() if i == least}
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == kept and len(kept) < len(rows)

    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    grams = {tuple(w[k : k + 10]) for _, t in items for w in [decontam.words_of(t)] for k in range(max(1, len(w) - 9))}
    def clean(t):
        w = decontam.words_of(t)
        return not any(tuple(w[k : k + len(g)]) == g for g in grams for k in range(len(w) - len(g) + 1))
    kept = {i for i in kept if clean(rows[i].text)}
    three = pipeline.benchmark_passages(spark, two, SMALL)
    assert three.columns == docs.columns and {r.doc_id for r in three.collect()} == kept

    four = pipeline.hide_secrets(spark, three, SMALL)
    out = {r.doc_id: r for r in four.collect()}
    assert four.columns == docs.columns and set(out) == kept
    found, _ = secrets.scan_paths(three)
    for r in found.collect():
        text, spans = rows[r.doc_id].text, r.spans
        assert (out[r.doc_id].text == text) == (not spans) and out[r.doc_id].n_chars == len(out[r.doc_id].text)
        assert not any(text[s.start : s.end] in out[r.doc_id].text for s in spans)

    c = bpe.codec(bpe.vocabulary())
    five = {r.doc_id: r.n_tokens for r in pipeline.tokens(spark, four, SMALL).collect()}
    assert five == {i: len(c.encode(r.text)) // 4 for i, r in out.items()}
    assert {r.doc_id: r.n_tokens for r in entry.queries()["pipeline"](spark, SMALL).collect()} == five


@pytest.mark.parametrize("n", [0, 3])
def test_odd_documents(spark, n):
    rng = random.Random(n)
    text = lambda: " ".join(rng.choice(["der", "das", "und", "nicht", "eine"]) for _ in range(30))
    rows = [(None, "", "de", 1), (1, None, "de", 1), (2, "123", None, 1), *[(10 + i, text(), "de", 7) for i in range(20)], (30, "token = abcdefgh1234 " + text(), "de", 9)][: None if n else 0]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == (21 if n else 0)
