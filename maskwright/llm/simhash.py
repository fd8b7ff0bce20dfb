"""SimHash near-duplicates: fingerprints, exact search within a Hamming radius by bit-sliced comparison, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, ceil, comb, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import drop_table, lean_map, materialize, only
from maskwright.llm.graph import components

#: Fingerprints that are compared with each other in one group at most, about; larger buckets are dealt out in pairs of parts.
PART = 512
_ONES = np.uint64(0x0101010101010101)


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = h + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _majority(hashes: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the hashes."""
    n = len(hashes)
    counts = np.zeros((8, 8), np.int64)  # [byte lane, bit]
    for bit in range(8):  # eight byte-wide counters in a word; 255 rows can't overflow them
        sums = np.add.reduceat(hashes >> np.uint64(bit) & _ONES, np.arange(0, n, 255))
        counts[:, bit] = sums.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return np.packbits(2 * counts > n, axis=1, bitorder="little").reshape(8).view(np.uint64)[0]


def _fingerprints(texts: list[str | None], k: int, width: int = 1) -> np.ndarray:
    """The SimHash of each text over its k-word shingles, ``width`` words of 64 bits; 0 without words.

    The first word is of the shingles' hashes, the others of hashes of these.
    """
    h = xxhash.xxh64_intdigest
    out = np.zeros((len(texts), width), np.uint64)
    for at, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            continue
        buf = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        m = min(k, len(words))
        hashes = np.array([h(buf[a:e], 42) for a, e in zip(starts[: len(words) - m + 1].tolist(), ends[m - 1 :].tolist(), strict=True)], np.uint64)
        for w in range(width):
            out[at, w] = _majority(_mixed(hashes, w) if w else hashes)
    return out if width > 1 else out[:, 0]


def fingerprints(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id long, fp long``: the SimHash of each whole text, its 64 bits as a signed number.

    A-Z are lower-cased, words are runs of bytes other than ASCII white space, and each k-word shingle counts as often as it
    occurs, by XXH64 with seed 42. Fewer words make one shingle; null or wordless texts have 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                fps = _fingerprints(part.column(1).to_pylist(), k).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(fps)], ["doc_id", "fp"])

    return only(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of blocks of 64 fingerprints (rows of words): word [b, p] holds bit p of the 64 fingerprints of block b."""
    width = fps.shape[1]
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 64, 8 * width), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view(np.uint64)[:, :, 0]


def within(queries: np.ndarray, planes: np.ndarray, block: np.ndarray, dead: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Which lanes of block[i] are within ``radius`` bits of queries[i] (rows of words); dead[i] marks lanes that don't count.

    Three planes at a time go through a carry-save adder into vertical counters, which start so that they overflow just beyond the
    radius. Every few planes the comparisons of which all lanes have overflowed are abandoned.
    Returns the indices of comparisons with lanes left, and their lanes as words.
    """
    total = planes.shape[1]
    if not 0 <= radius < total:
        raise ValueError("the radius must be from 0 to less than the bits of a fingerprint")
    width = max(4, (radius + 1).bit_length())
    first = (1 << width) - 1 - radius
    at = np.arange(len(queries))
    q, full = queries, np.uint64(0xFFFFFFFFFFFFFFFF)
    over = dead.copy()
    c = [np.full(len(q), full if first >> i & 1 else 0, np.uint64) for i in range(width)]

    def differ(p: int) -> np.ndarray:
        return planes[block, p] ^ (np.uint64(0) - (q[:, p // 64] >> np.uint64(p % 64) & np.uint64(1)))

    def add(x: np.ndarray, weight: int) -> None:
        for i in range(weight, width):
            c[i], x = c[i] ^ x, c[i] & x
        np.bitwise_or(over, x, out=over)

    p = 0
    while p < total:
        if p + 2 < total:
            x, y, z = differ(p), differ(p + 1), differ(p + 2)
            xy = x ^ y
            add(xy ^ z, 0)
            add(x & y | xy & z, 1)
            p += 3
        else:
            add(differ(p), 0)
            p += 1
        if p % 9 == 0 and p > radius:
            left = np.flatnonzero(over != full)
            if len(left) < len(q):
                at, q, block, over, c = at[left], q[left], block[left], over[left], [x[left] for x in c]
                if not len(q):
                    return at, over
    left = np.flatnonzero(over != full)
    return at[left], ~over[left]


def _least(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least index of each item's component."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        if not (differ := a != b).any():
            return label
        u, v, m = u[differ], v[differ], np.minimum(a, b)[differ]
        np.minimum.at(label, a[differ], m)
        np.minimum.at(label, b[differ], m)
        while (label != (jumped := label[label])).any():
            label = jumped


def _forest(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of which ``group`` (sorted) is equal and the fingerprints are near, as links from each row to its component's first."""
    fps = fps.reshape(len(fps), -1)
    n = len(fps)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.append(starts, n))
    blocks = -(-sizes // 64)
    first_block = np.cumsum(blocks) - blocks
    which = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(n) - starts[which]
    lane = (first_block[which] + place // 64) * 64 + place % 64
    padded = np.zeros((blocks.sum() * 64, fps.shape[1]), np.uint64)
    padded[lane] = fps
    row = np.full(len(padded), -1)
    row[lane] = np.arange(n)
    planes = _planes(padded)
    empty = np.packbits((row < 0).reshape(-1, 64), axis=1, bitorder="little").view(np.uint64)[:, 0]
    todo = blocks[which] - place // 64  # a row meets its own block and the later ones
    us, vs = [], []
    bounds = np.concatenate(([0], np.cumsum(todo)))
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + 200_000, "right")) - 1)
        q = np.repeat(np.arange(lo, hi), todo[lo:hi])
        step = np.arange(len(q)) - np.repeat(bounds[lo:hi] - bounds[lo], todo[lo:hi])
        block = lane[q] // 64 + step
        own = np.where(step == 0, (np.uint64(2) << (lane[q] % 64).astype(np.uint64)) - np.uint64(1), np.uint64(0))
        hit, lanes = within(fps[q], planes, block, empty[block] | own, radius)
        for a in range(0, len(hit), 50_000):
            i, j = np.nonzero(np.unpackbits(lanes[a : a + 50_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            u, v = q[hit[a + i]], row[block[hit[a + i]] * 64 + j]
            us.append(u)
            vs.append(v)
        if sum(map(len, us)) > 2_000_000:  # keep a forest only, not the links
            label = _least(n, np.concatenate(us), np.concatenate(vs))
            us, vs = [np.flatnonzero(label != np.arange(n))], [label[label != np.arange(n)]]
        lo = hi
    if not us:
        return np.empty(0, int), np.empty(0, int)
    label = _least(n, np.concatenate(us), np.concatenate(vs))
    u = np.flatnonzero(label != np.arange(n))
    return u, label[u]


def plan_blocks(n: int, radius: int) -> int:
    """Into how many blocks of bits to cut fingerprints: fewest row copies and comparisons expected for n of them.

    With m blocks, fingerprints within the radius agree in m - radius blocks at least, so each choice of that many blocks is a
    table whose buckets hold n / 2^(64 (m - radius) / m) fingerprints. Every choice finds every pair.
    """
    return min(range(radius + 1, min(64, 2 * radius + 6) + 1), key=lambda m: comb(m, m - radius) * n * (20 + n / 2 ** (64 * (m - radius) / m) / 64))


def simhash_links(reps: DataFrame, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """``u long, v long``: links among ``reps(fp long, rep long)`` that join all of which the fingerprints are within the radius.

    Not every pair: in each bucket, or pair of parts of a large bucket, a spanning forest of the near pairs. A row goes to one
    bucket of each table; a bucket of over PART rows is split by hash into parts, and each two parts meet in a group of their own,
    so no task has to hold a bucket.
    """
    spark = reps.sparkSession
    if blocks is None:
        blocks = plan_blocks(max(1, reps.count()), radius)
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [sum(((1 << edge[b + 1]) - 1) ^ ((1 << edge[b]) - 1) for b in some) for some in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = reps.select("fp", "rep", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in enumerate(signed)])).alias("b")).select("fp", "rep", "b.t", "b.key")
    large = keyed.groupBy("t", "key").count().where(F.col("count") > PART).select("t", "key", F.ceil(F.col("count") / PART).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
    dealt = (
        keyed.join(large, ["t", "key"], "left")
        .withColumn("own", F.coalesce(own, F.lit(0)))
        .withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: i != F.col("own")))))
        .select("fp", "rep", F.xxhash64("t", "key", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def links() -> pa.RecordBatch:
            fp, rep, bucket = (np.concatenate(x) for x in zip(*held, strict=True))
            u, v = _forest(fp.view(np.uint64), bucket, radius)
            return pa.RecordBatch.from_arrays([pa.array(rep[u]), pa.array(rep[v])], ["u", "v"])

        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns]
            if not b.num_rows:
                continue
            cut = int(np.searchsorted(cols[2], cols[2][-1])) if b.num_rows else 0  # the last bucket may go on
            if cut:
                held.append([c[:cut] for c in cols])
                yield links()
                held = [[c[cut:] for c in cols]]
            else:
                held.append(cols)
        if held:
            yield links()

    return lean_map(dealt.repartition("bucket").sortWithinPartitions("bucket"), run, "u long, v long")


def simhash_components(docs: DataFrame, k: int = 5, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None) -> DataFrame:
    """``doc_id, fp, component_id`` for each row: all of which the fingerprints are linked by steps of at most ``radius`` bits.

    Equal fingerprints are one item in the search. component_id is the least id reachable. A null id gets a component but never
    names one (all ids null: null). Repeated rows, ties, other columns and an empty table need no special care.
    """
    spark = docs.sparkSession
    fps, _ = materialize(fingerprints(docs, k, id_col, text_col), "fps")
    reps, _ = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    found = components(simhash_links(reps.where("rep is not null"), radius, blocks))
    named = reps.join(found, reps.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


#: Words of 64 bits in the fingerprints that estimate a similarity.
WIDTH = 4
#: Share of the pairs just at the similarity that the tables of :func:`similar_links` bring together; nearer pairs meet more surely.
RECALL = 0.95


def _chance(similarity: float) -> float:
    """That a bit differs between sets of this Jaccard similarity and about equal size."""
    return acos(min(1.0, 2 * similarity / (1 + similarity))) / pi


def similarity_radius(similarity: float, bits: int = 64 * WIDTH) -> int:
    """The differing bits that sets just at the similarity stay within nine times in ten."""
    p = _chance(similarity)
    return round(bits * p + 1.28 * sqrt(bits * p * (1 - p)))


def similar_links(reps: DataFrame, similarity: float, part: int = 2048, seed: int = 5) -> DataFrame:
    """``u long, v long`` among ``reps(rep long, fp binary)``: links that join wide fingerprints within the similarity's radius.

    Candidates share all of a table's sampled bits, 16 or more as the number of fingerprints grows, in one of as many tables as
    RECALL asks for. In a bucket, or pair of parts of a large bucket, they are compared as in :func:`simhash_links`.
    """
    n = max(1, reps.count())
    bits = max(16, ceil(log2(n / 256)))
    tables = ceil(log(1 - RECALL) / log(1 - (1 - _chance(similarity)) ** bits))
    radius = similarity_radius(similarity)
    rng = np.random.default_rng(seed)
    chosen = np.array([rng.choice(64 * WIDTH, bits, replace=False) for _ in range(tables)])
    weights = np.uint64(1) << np.arange(bits, dtype=np.uint64)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                some = b.slice(lo, 1000)
                fps = np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint8).reshape(some.num_rows, -1)
                keys = (np.unpackbits(fps, axis=1, bitorder="little")[:, chosen] * weights).sum(2, dtype=np.uint64)
                keys = _mixed(keys + np.arange(tables, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03), 1)
                again = np.repeat(np.arange(some.num_rows), tables)
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(again)), some.column(1).take(pa.array(again)), pa.array(keys.reshape(-1).view(np.int64))], ["rep", "fp", "key"])

    rows = reps.select("rep", "fp").mapInArrow(keyed, "rep long, fp binary, key long")
    large = rows.groupBy("key").count().where(F.col("count") > part).select("key", F.ceil(F.col("count") / part).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("parts")).cast("int")
    dealt = (
        rows.join(large, "key", "left")
        .withColumn("own", F.coalesce(own, F.lit(0)))
        .withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: i != F.col("own")))))
        .select("rep", "fp", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def links() -> pa.RecordBatch:
            rep, bucket = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in (0, 2))
            fps = np.frombuffer(b"".join(x for b in held for x in b.column(1).to_pylist()), np.uint64).reshape(len(rep), -1)
            starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            sizes = np.diff(np.append(starts, len(rep)))
            some = np.repeat(sizes > 1, sizes)  # most are alone
            rep, fps, bucket = rep[some], fps[some], bucket[some]
            u, v = _forest(fps, bucket, radius) if len(rep) else (np.empty(0, int), np.empty(0, int))
            return pa.RecordBatch.from_arrays([pa.array(rep[u]), pa.array(rep[v])], ["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            bucket = b.column(2).to_numpy()
            cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
            if cut:
                held.append(b.slice(0, cut))
                yield links()
                held = [b.slice(cut)]
            else:
                held.append(b)
        if held:
            yield links()

    return lean_map(dealt.repartition("bucket").sortWithinPartitions("bucket"), run, "u long, v long")


def simhash_dedup(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is its group's least, with all their columns; groups are of distinct k-word shingle sets that
    are linked by Jaccard similarities of ``similarity`` or more.

    Fingerprints find most of the links, a complete search the rest, and each is verified on the whole sets: see
    :func:`~maskwright.llm.jaccard.jaccard_components`. Rows with a null id are kept and link nothing; rows of one id are one
    document; null and wordless texts are equal.
    """
    from maskwright.llm.jaccard import jaccard_components  # which builds on this module

    groups = jaccard_components(docs, k, similarity, id_col, text_col)
    drop = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_dropped")).distinct()
    return docs.join(drop, docs[id_col] == F.col("_dropped"), "left_anti")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by 4-word shingles and at most 4 differing bits."""
    out = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, radius=4)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
