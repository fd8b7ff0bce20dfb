import random
import zlib

from maskwright.llm.sharding import shard_by_bytes


def test_against_plain_prefix_sums(spark):
    rng = random.Random(3)
    rows = [(i, None if i % 17 == 0 else "é" * rng.randint(0, 400)) for i in range(500)] + [(7, "a"), (7, "a"), (900, "z" * 9000)] + [(None, "q")] * 3
    df = spark.createDataFrame([(t, i, 1) for i, t in rows], "text string, doc_id long, shard int").repartition(7)
    got = shard_by_bytes(df, 8).collect()
    raw = [(t or "").encode() for _, t in rows]
    want = sorted((-1 if i is None else i, zlib.crc32(b), len(b) + 1) for (i, _), b in zip(rows, raw, strict=True))
    total, upto, slots, out = sum(x[2] for x in want), 0, {}, []
    for i, crc, size in want:
        s = min(7, (2 * upto + size) * 8 // (2 * total))
        out.append((i, size, crc, s, slots.setdefault(s, 0)))
        slots[s] += 1
        upto += size
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got) == sorted(out)


def test_empty_and_one_row(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert shard_by_bytes(df).count() == 0
    assert [tuple(r) for r in shard_by_bytes(spark.createDataFrame([(1, "")], "doc_id long, text string"), 2).collect()] == [(1, 1, 0, 1, 0)]
