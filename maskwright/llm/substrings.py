"""Removal of byte strings that repeat anywhere in a corpus, and longest-previous-factor arrays.

The arrays (:func:`longest_previous_factor`) need all suffixes of what they look at in one order. For a whole corpus that order
would take a shuffle of hundreds of bytes for each byte of text, so the corpus-wide operator answers the same question (does the
string of a given length that starts here also start elsewhere) with exact counts of string hashes, of which content-defined
anchors leave a small part to be counted. The arrays serve single documents (:func:`repeats_within`) and the tests.
"""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskwright.llm.common import drop_table, materialize, only, shared_dir

#: Bytes of text in a bucket, about; buckets are what tasks work on.
BUCKET_BYTES = 1_000_000
#: Buckets in a file, about.
FILE_BUCKETS = 128
#: Bytes hashed at once, but for longer documents.
SLAB = 2_000_000
#: An anchor is a place of which the hash of the next KMER bytes begins with RATE zero bits.
KMER, RATE = 24, 6
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for r in (_BASE, inverse):
        p = np.full(n, r, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = h + np.uint64(salt * 0xD1B54A32D192ED03 & _MASK)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


class Slab:
    """Some documents of at least ``length`` bytes, end to end, with hashes of any of their substrings."""

    def __init__(self, docs: list[bytes], length: int):
        self.length = length
        self.short = max(KMER, length // 8)  # bytes from an anchor on that a window it stands for must hold
        data = np.frombuffer(b"".join(docs), np.uint8)
        sizes = np.array([len(d) for d in docs], np.int64)
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        n = len(data)
        up, self.down = _powers(1 << max(20, (n + 1).bit_length()))
        table = np.random.default_rng(1).integers(0, 2**64, 256, dtype=np.uint64)
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * up[:n], out=self.sum[1:])
        kmers = (self.sum[KMER:] - self.sum[: n + 1 - KMER]) * self.down[: n + 1 - KMER]
        at = np.flatnonzero(kmers * np.uint64(0xC2B2AE3D27D4EB4F | 1) >> np.uint64(64 - RATE) == 0)
        doc = np.searchsorted(self.end, at, "right")
        ok = at + KMER <= self.end[doc]
        at, doc = at[ok], doc[ok]
        # windows from lo to hi have this as their next anchor, near enough to hold self.short bytes from it on
        before = np.concatenate(([-1], at[:-1]))
        lo = np.maximum(np.maximum(before + 1, self.start[doc]), at - (length - self.short))
        hi = np.minimum(at, self.end[doc] - length)
        ok = lo <= hi
        self.at, self.lo, self.hi = at[ok], lo[ok], hi[ok]
        mark = np.zeros(n + 1, np.int8)
        mark[self.start] += 1  # documents that meet cancel out
        last = self.end - length + 1
        np.subtract.at(mark, last, 1)
        np.subtract.at(mark, self.lo, 1)
        np.add.at(mark, self.hi + 1, 1)
        self.far = np.flatnonzero(np.cumsum(mark[:-1], dtype=np.int8) > 0)

    def hash(self, lo: np.ndarray, hi: np.ndarray, salt: int) -> np.ndarray:
        return _mixed((self.sum[hi] - self.sum[lo]) * self.down[lo] + (hi - lo).astype(np.uint64), salt)

    def near(self) -> np.ndarray:
        """For each anchor, what all its windows hold."""
        return self.hash(self.at, self.at + self.short, 1)

    def whole(self) -> np.ndarray:
        """For each anchor, all its windows together: if that repeats, they all do."""
        return self.hash(self.lo, self.hi + self.length, 2)

    def windows(self, starts: np.ndarray) -> np.ndarray:
        return self.hash(starts, starts + self.length, 3)

    def between(self, some: np.ndarray) -> np.ndarray:
        """The window starts of some anchors."""
        n = self.hi[some] - self.lo[some] + 1
        return np.repeat(self.lo[some] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
#: Words of a passage at least, and of the runs in it by which it is looked for first.
PASSAGE, GRAM = 51, 24


class Words:
    """The words of some documents, end to end, with hashes of any run of them. Words are runs of bytes other than white space."""

    def __init__(self, docs: list[bytes]):
        data = np.frombuffer(b" ".join([*docs, b""]), np.uint8)
        sizes = np.array([len(d) + 1 for d in docs], np.int64)
        up, self.down = _powers(1 << max(20, (len(data) + 1).bit_length()))
        table = np.random.default_rng(2).integers(0, 2**64, 256, dtype=np.uint64)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[: len(data)], out=total[1:])
        edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[data], [True])).astype(np.int8)))
        low, high = edge[::2], edge[1::2]
        word = _mixed((total[high] - total[low]) * self.down[low] + (high - low).astype(np.uint64), 4)
        self.doc = np.searchsorted(np.cumsum(sizes), low, "right")
        self.sum = np.zeros(len(word) + 1, np.uint64)
        np.cumsum(word * up[: len(word)], out=self.sum[1:])
        n = max(0, len(word) - PASSAGE + 1)
        self.start = np.flatnonzero(self.doc[:n] == self.doc[len(word) - n :]) if n else np.empty(0, np.int64)  # of passages within a document
        grams = self.hash(np.arange(max(0, len(word) - GRAM + 1)), GRAM, 5)
        # of the runs in a passage, the place of the least hash, the first of equals: equal passages have it at one place
        least, span = np.arange(len(grams)), 1
        want = PASSAGE - GRAM + 1
        while span < want:
            step = min(span, want - span)
            a, b = least[: len(least) - step], least[step:]
            least, span = np.where(grams[b] < grams[a], b, a), span + step
        self.lead = least[self.start] if len(self.start) else self.start
        self.gram = grams[self.lead]

    def hash(self, starts: np.ndarray, n: int, salt: int) -> np.ndarray:
        return _mixed((self.sum[starts + n] - self.sum[starts]) * self.down[starts], salt)

    def counted(self, kind: int, h: np.ndarray, doc: np.ndarray) -> Rows:
        """Hashes, each once, and whether several documents have it."""
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        new = np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1]))
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(h))[: len(at)] - 1
        return np.full(len(at), kind, np.int8), h[at].view(np.int64), np.zeros(len(at), np.int64), (doc[at] != doc[last]).astype(np.int64)

    def grams(self) -> Rows:
        some = np.unique(self.lead, return_index=True)[1]
        return self.counted(RUN, self.gram[some], self.doc[self.lead[some]])

    def open(self, known: Known) -> np.ndarray:
        """The passages that may stand in another document."""
        return self.start[known.has(known.run, self.gram)]

    def passages(self, known: Known) -> Rows:
        some = self.open(known)
        return self.counted(SHARED, self.hash(some, PASSAGE, 6), self.doc[some])

    def shared(self, known: Known, n: int) -> np.ndarray:
        """For each of n documents, the words inside a passage that stands in another one."""
        some = self.open(known)
        some = some[known.has(known.shared, self.hash(some, PASSAGE, 6))]
        mark = np.zeros(len(self.doc) + 1, np.int64)
        np.add.at(mark, some, 1)
        np.subtract.at(mark, some + PASSAGE, 1)
        return np.bincount(self.doc[np.cumsum(mark[:-1]) > 0], minlength=n)


def _slabs(docs: list[bytes], length: int) -> Iterator[tuple[list[int], Slab]]:
    """Slabs of the documents that are long enough, with their numbers."""
    which, held = [], 0
    for i, d in enumerate(docs):
        if len(d) >= length:
            which.append(i)
            held += len(d)
            if held >= SLAB:
                yield which, Slab([docs[j] for j in which], length)
                which, held = [], 0
    if which:
        yield which, Slab([docs[j] for j in which], length)


#: Kinds of hashes: a short string at an anchor, with the least and greatest stretch it stands in; a stretch, or a far window;
#: an open window; the last two come with whether they are in the bucket twice. A run of words, a passage: with whether several
#: documents of the bucket have them.
NEAR, WHOLE, WINDOW, RUN, SHARED = range(5)
Rows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # kind, hash, low, high


def _counted(kind: int, h: np.ndarray) -> Rows:
    x, n = np.unique(h, return_counts=True)
    return np.full(len(x), kind, np.int8), x.view(np.int64), np.zeros(len(x), np.int64), (n > 1).astype(np.int64)


def _first(docs: list[bytes], length: int) -> Rows:
    """The hashes to be compared first: of anchors, their stretches, and windows that have no anchor near."""
    slabs = [(s.near(), s.whole(), s.windows(s.far)) for _, s in _slabs(docs, length)]
    near, whole, far = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (zip(*slabs, strict=True) if slabs else ((), (), ())))
    order = np.lexsort((signed := whole.view(np.int64), near))
    near, signed = near[order], signed[order]
    cut = np.flatnonzero(np.concatenate((np.ones(min(1, len(near)), bool), near[1:] != near[:-1])))
    ends = np.append(cut[1:], len(near))[: len(cut)] - 1
    anchors = np.full(len(cut), NEAR, np.int8), near[cut].view(np.int64), signed[cut], signed[ends]
    return tuple(np.concatenate(x) for x in zip(anchors, _counted(WHOLE, np.concatenate([whole, far])), Words(docs).grams(), strict=True))


class Known:
    """What the comparison says of a bucket's hashes: (kind, hash, first), first if no earlier bucket has the hash.

    NEAR: it stands in different stretches. WHOLE and WINDOW: it repeats. RUN and SHARED: several documents have it.
    """

    def __init__(self, kind: np.ndarray, h: np.ndarray, first: np.ndarray):
        sets = [(kind == NEAR), (kind == WHOLE), (kind == WHOLE) & first, (kind == WINDOW), (kind == RUN), (kind == SHARED)]
        self.mixed, self.whole, self.lead, self.window, self.run, self.shared = (np.sort(h[x].view(np.uint64)) for x in sets)

    @staticmethod
    def has(known: np.ndarray, h: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(h), bool)
        return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _second(docs: list[bytes], length: int, known: Known) -> Rows:
    """The windows that stay open, and those they may be equal to.

    A stretch that does not repeat, around a short string that stands in other stretches too, may hold windows that repeat. They
    may do so in a stretch that itself repeats, whose windows are told by the first bucket that has it.
    """
    out = [np.empty(0, np.uint64)]
    for _, s in _slabs(docs, length):
        whole = s.whole()
        some = known.has(known.mixed, s.near()) & (~known.has(known.whole, whole) | known.has(known.lead, whole))
        out.append(s.windows(s.between(np.flatnonzero(some))))
    return tuple(np.concatenate(x) for x in zip(_counted(WINDOW, np.concatenate(out)), Words(docs).passages(known), strict=True))


def _removed(docs: list[bytes], length: int, known: Known) -> list[list[tuple[int, int]]]:
    """The maximal runs of each document to be removed."""
    runs: list[list[tuple[int, int]]] = [[] for _ in docs]
    for which, s in _slabs(docs, length):
        whole = known.has(known.whole, s.whole())
        open_ = s.between(np.flatnonzero(known.has(known.mixed, s.near()) & ~whole))
        far = s.far[known.has(known.whole, s.windows(s.far))]
        some = open_[known.has(known.window, s.windows(open_))]
        mark = np.zeros(int(s.end[-1]) + 1, np.int64)
        for lo, hi in ((s.lo[whole], s.hi[whole]), (far, far), (some, some)):
            np.add.at(mark, lo, 1)
            np.subtract.at(mark, hi + length, 1)
        cover = np.cumsum(mark[:-1]) > 0
        for i, a, b in zip(which, s.start.tolist(), s.end.tolist(), strict=True):
            part = cover[a:b]
            if part.any():
                edge = np.flatnonzero(np.diff(np.concatenate(([0], part.view(np.int8), [0]))))
                runs[i] = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
    return runs


def _texts(table: pa.Table) -> list[bytes]:
    return [x or b"" for x in table.column("raw").to_pylist()]


_SENT = "bucket int, kind byte, h long, low long, high long"


def _sent(bucket: int, rows: Rows) -> pa.Table:
    return pa.table({"bucket": pa.array(np.full(len(rows[0]), bucket, np.int32)), "kind": pa.array(rows[0]), "h": pa.array(rows[1]), "low": pa.array(rows[2]), "high": pa.array(rows[3])})


def _free(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of tables that are written and done.

    It does so when the driver's JVM finds them unused, which without this may be long after; a first collection only finds what
    holds them.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def _compared(hashes: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``bucket, kind, h, first`` of the hashes that :class:`Known` is about. A bucket has a hash of a kind once at most."""
    same = W.partitionBy("h", "kind")
    all_ = hashes.select("*", F.count("*").over(same).alias("n"), F.min("low").over(same).alias("least"), F.max("high").over(same).alias("most"), F.min("bucket").over(same).alias("lead"))
    repeats = F.when(F.col("kind") == NEAR, F.col("least") != F.col("most")).otherwise((F.col("n") > 1) | (F.col("most") > 0))
    return materialize(all_.where(repeats).select("bucket", "kind", "h", (F.col("bucket") == F.col("lead")).alias("first")), name)


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, n_shared_words`` for each row.

    Removes every byte covered by a ``length``-byte string that starts anywhere else too, in this or any other row. n_shared_words
    counts the words inside passages of over 50 words that another row has too; such passages are often shorter than 400 bytes, and
    nothing is removed for them alone. Null texts are empty; texts shorter than ``length`` lose nothing; repeated rows repeat each
    other's bytes; null ids, further columns and an empty table are no special case. Strings are told apart by 64-bit hashes.

    The texts are written once, bucketed by a hash, so later passes find them in place. Each pass sends hashes only, each at
    most once for a bucket: (1) of short strings at content-defined anchors, of the stretch of all windows that have an anchor as
    their next one, and of the few windows far from any; (2) of single windows, where one short string stands in different
    stretches. No group of copies meets in a task: a hash that repeats has a row for each bucket, not for each copy. Passages go
    the same way: (1) the run of words with the least hash in each; (2) the passages of which that run stands in another document.
    """
    if length < 2 * KMER:
        raise ValueError(f"length must be at least {2 * KMER}")
    spark = docs.sparkSession
    raw = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("raw"))
    total = raw.agg(F.sum(F.coalesce(F.octet_length("raw"), F.lit(0)).cast("long"))).first()[0] or 0
    buckets = max(1, ceil(total / BUCKET_BYTES))
    files = max(ceil(buckets / FILE_BUCKETS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # not by the row's place: that may change if a task is run again
    keyed = raw.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "raw", F.spark_partition_id()), F.lit(buckets)).cast("int"))
    name = f"texts_{uuid.uuid4().hex}"
    place = f"{shared_dir(spark)}/{name}"
    try:
        keyed.repartition(files, "bucket").write.bucketBy(files, "bucket").sortBy("bucket").option("compression", "zstd").option("path", place).saveAsTable(name)
        _free(spark)
        return _passes(spark, spark.table(name), length, dict(raw.dtypes)["doc_id"])
    finally:
        spark.sql(f"drop table if exists {name}")
        drop_table(spark, place)


def _passes(spark: SparkSession, texts: DataFrame, length: int, id_type: str) -> DataFrame:
    """The passes of :func:`remove_repeats` over the bucketed texts; the result is written."""

    def first(table: pa.Table) -> pa.Table:
        return _sent(table.column("bucket")[0].as_py(), _first(_texts(table), length))

    def told(known: pa.Table) -> Known:
        return Known(*(known.column(c).to_numpy() for c in ("kind", "h", "first")))

    def second(table: pa.Table, known: pa.Table) -> pa.Table:
        return _sent(table.column("bucket")[0].as_py(), _second(_texts(table), length, told(known)))

    def third(table: pa.Table, known: pa.Table) -> pa.Table:
        them = _texts(table)
        runs = _removed(them, length, told(known))
        kept = []
        for d, r in zip(them, runs, strict=True):
            sha, at = sha256(), 0
            for a, b in r:
                sha.update(d[at:a])
                at = b
            sha.update(d[at:])
            kept.append(sha.hexdigest())
        ints = lambda x: pa.array(x, pa.int64())
        return pa.table({
            "doc_id": table.column("doc_id"), "n_bytes": ints([len(d) for d in them]), "n_removed": ints([sum(b - a for a, b in r) for r in runs]), "n_spans": ints([len(r) for r in runs]),
            "kept_sha256": pa.array(kept, pa.string()), "n_shared_words": ints(Words(them).shared(told(known), len(them))), "spans": pa.array([[{"start": a, "end": b} for a, b in r] for r in runs], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        })

    one, one_at = _compared(texts.groupBy("bucket").applyInArrow(first, _SENT), "repeats")
    _free(spark)
    by = lambda df: df.groupBy("bucket")
    two, two_at = _compared(by(texts).cogroup(by(one)).applyInArrow(second, _SENT), "repeats")
    _free(spark)
    out = by(texts).cogroup(by(one.unionByName(two))).applyInArrow(third, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_words long, spans array<struct<start:long,end:long>>")
    out, _ = materialize(out, "kept")
    for path in (one_at, two_at):
        drop_table(spark, path)
    return out


def suffix_array(data: bytes) -> np.ndarray:
    """Starts of the suffixes in order, by prefix doubling."""
    n = len(data)
    rank = np.frombuffer(data, np.uint8).astype(np.int64)
    step = 1
    while True:
        second = np.full(n, -1, np.int64)
        second[: n - step] = rank[step:]
        order = np.lexsort((second, rank))
        new = np.concatenate(([0], np.cumsum((np.diff(rank[order]) != 0) | (np.diff(second[order]) != 0))))[:n]
        rank = np.empty(n, np.int64)
        rank[order] = new
        if n == 0 or new[-1] == n - 1:
            return order
        step *= 2


def longest_previous_factor(data: bytes) -> np.ndarray:
    """For each place the length of the longest string from it on that also starts earlier.

    Among earlier places the longest match is with a neighbour in suffix order: the previous or the next suffix that starts earlier
    (previous and next smaller positions). Those are found in one pass with a stack, on which the common prefix lengths between
    neighbours are kept as running minima.
    """
    n = len(data)
    order = suffix_array(data).tolist()
    place = [0] * n
    for i, p in enumerate(order):
        place[p] = i
    lcp, k = [0] * (n + 1), 0  # lcp[i]: of order[i - 1] and order[i]
    for p in range(n):
        if place[p]:
            q = order[place[p] - 1]
            while p + k < n and q + k < n and data[p + k] == data[q + k]:
                k += 1
            lcp[place[p]] = k
            k = max(0, k - 1)
        else:
            k = 0
    out = [0] * n
    stack: list[tuple[int, int]] = []  # (place in the text, common prefix with what lies below it)
    for i in range(n + 1):
        p, least = (order[i], lcp[i]) if i < n else (-1, 0)
        while stack and stack[-1][0] > p:
            q, below = stack.pop()
            out[q] = max(below, least)  # its previous and its next smaller position
            least = min(least, below)
        stack.append((p, least))
    return np.array(out, np.int64)


def repeats_within(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` with every string of ``length`` bytes or more that starts earlier in the same text removed; the first stays.

    Null stays null; bytes of a letter that is cut are dropped; each row is by itself, so copies in other rows do not matter.
    """

    def keep(text: str | None) -> str | None:
        if not text:
            return text
        data = text.encode("utf-8", "replace")
        if len(data) <= length:
            return text
        mark = np.zeros(len(data) + 1, np.int64)
        lpf = longest_previous_factor(data)
        at = np.flatnonzero(lpf >= length)
        np.add.at(mark, at, 1)
        np.subtract.at(mark, at + lpf[at], 1)
        return np.frombuffer(data, np.uint8)[np.cumsum(mark[:-1]) == 0].tobytes().decode("utf-8", "ignore")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([keep(t) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    plain = only(docs, id_col, text_col).withColumnRenamed(id_col, "doc_id")
    return plain.mapInArrow(run, f"doc_id {dict(plain.dtypes)['doc_id']}, text string")


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, strings of 400 bytes."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), 400)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_words")
