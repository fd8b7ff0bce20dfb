import gc
import tracemalloc

import pyarrow as pa

from maskwright.llm import bpe, decontam, jaccard


def test_no_tokenizer_outlives_its_stage(spark):
    """Workers are used again: a stage after the tokens must not carry the compiled vocabulary and its words along."""
    docs = spark.range(16).selectExpr("id as doc_id", "'some words' as text").repartition(16)
    assert {len(r.ids) for r in bpe.encode(docs, bpe.vocabulary()).collect()} == {2}

    def held(cols):
        yield pa.RecordBatch.from_arrays([pa.array([bpe.codec.cache_info().currsize], pa.int64())], ["n"])

    found = jaccard._grouped(spark.range(64).select("id"), "id", held, "n long").collect()
    assert found and {r.n for r in found} == {0}


def test_a_shard_is_posted_without_all_its_words_at_once():
    """300,000 words of 3,000 documents: as objects, the words alone would be some 18 MB."""
    texts = [" ".join(f"word{(i * 31 + k * k) % 5000}" for k in range(100)) for i in range(3000)]
    tracemalloc.start()
    try:
        found = decontam._posted(0, list(range(len(texts))), texts, 7)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found.num_rows == len({w for t in texts for w in t.split()}) + 1 and sum(found.column(3).to_pylist()[:-1]) == 300_000
    print(f"{peak / 1e6:.1f} MB")
    assert peak < 20e6


def test_a_codec_keeps_no_tables_of_its_compilation():
    tracemalloc.start()
    try:
        codec = bpe.Codec(bpe.vocabulary())
        gc.collect()
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert len(codec.encode("some words")) == 8
    print(f"{held / 1e6:.1f} MB")
    assert held < 60e6
