"""Near-duplicates by the Jaccard similarity of word shingle sets: SimHash links first, then complete candidates from rare shingles.

Every link is verified on the whole sets. SimHash finds almost all of the near pairs, and joins large groups by few links; what it
can't tell from bits alone (pairs further apart, and pairs near in bits that are not similar) the complete search settles.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import drop_table, lean_map, materialize, only
from maskwright.llm.graph import components
from maskwright.llm.simhash import _majority, simhash_links
from maskwright.llm.substrings import _free

#: Documents, about, from which the common shingles are learned, the least of them that hold one, and how many are kept.
SAMPLE, COMMON, MOST_COMMON = 16_000, 4, 100_000
#: Differing bits within which fingerprints of sets are compared first.
RADIUS = 4
#: With how many sets of each shingle the others are held in each later round; the last one takes all, so that no pair is left out.
PIVOTS = (8, None)
#: First bits of a shingle's hash by which a set's histogram counts.
BITS = 6
#: Pairs whose sets are looked up at a time, at most, the partners that one group of them holds, about, and the least bytes and the
#: share of all sets' bytes that are sent at a time.
MOST_PAIRS, GROUP, ROOM, SHARE = 250_000, 64, 64_000_000, 0.25
#: Rows of texts or sets that Python holds at once.
ROWS = 500


def shingles(text: str | None, k: int) -> np.ndarray:
    """The distinct k-word shingles of a text as sorted XXH64 hashes; fewer words make one, no words none.

    A-Z are lower-cased, words are runs of bytes other than ASCII white space.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h, buf, m = xxhash.xxh64_intdigest, b" ".join(words), min(k, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.unique(np.array([h(buf[a:e], 42) for a, e in zip(starts[: len(words) - m + 1].tolist(), ends[m - 1 :].tolist(), strict=True)], np.uint64))


def _node(tokens: np.ndarray) -> int:
    """A set's name: 64 bits over all its shingles, signed; equal sets are one item."""
    x = xxhash.xxh3_64_intdigest(tokens.tobytes())
    return x - (1 << 64) if x >> 63 else x


def needed(n: int | np.ndarray, similarity: float) -> np.ndarray:
    """The least size of a set that can be this similar to one of n."""
    return np.ceil(similarity * np.asarray(n) - 1e-9).astype(np.int64)


def _may(n: np.ndarray, pos: np.ndarray, m: np.ndarray, other: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of sizes n and m can be similar if the first shingle they share is at these positions."""
    return np.minimum(n - pos, m - other) >= np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9)


def _common(docs: DataFrame, k: int) -> np.ndarray:
    """Shingles of many documents, the most common first, from a sample of the ids. They only set an order, never a result."""
    step = max(1, docs.count() // SAMPLE)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                found = [shingles(t, k) for t in b.slice(lo, ROWS).column(1).to_pylist()]
                tokens, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(step)) == 0)
    many = lean_map(some, counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    return np.array([r.token for r in many.orderBy(F.desc("n"), "token").limit(MOST_COMMON).collect()], np.int64).view(np.uint64)


def _column(c: pa.Array) -> np.ndarray:
    """A column as integers; of binaries, which are of one length, as rows of bytes."""
    if pa.types.is_binary(c.type):
        return np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(c), -1)
    return c.to_numpy(zero_copy_only=False).astype(np.int64)


def _grouped(df: DataFrame, key: str, work, schema: str) -> DataFrame:
    """``work`` on the columns (see :func:`_column`) of whole groups of equal ``key``, which is the first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            cols = [_column(c) for c in b.columns]
            if cut := int(np.searchsorted(cols[0], cols[0][-1])):  # the last group may go on
                held.append([c[:cut] for c in cols])
                yield from work([np.concatenate(x) for x in zip(*held, strict=True)])
                held = [[c[cut:] for c in cols]]
            else:
                held.append(cols)
        if held:
            yield from work([np.concatenate(x) for x in zip(*held, strict=True)])

    return lean_map(df.repartition(key).sortWithinPartitions(key), run, schema)


def _batch(schema: str, *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in cols], [x.split()[0] for x in schema.split(", ")])


def _met(token: np.ndarray, n: np.ndarray, pos: np.ndarray, similarity: float) -> np.ndarray:
    """Which postings (sorted by token) have another of their shingle in the range of sizes that leaves them similar."""
    group = np.cumsum(np.concatenate(([0], token[1:] != token[:-1])))
    most = np.floor((n - pos) * (1 + similarity) / similarity + 1e-6).astype(np.int64) - n
    wide = int(n.max(initial=0)) + 2
    sizes = np.sort(group * wide + n)
    low, high = group * wide + needed(n, similarity), group * wide + np.minimum(most, wide - 1)
    others = np.searchsorted(sizes, high, "right") - np.searchsorted(sizes, low, "left") - (most >= n)
    return others > 0


def _shared(postings: DataFrame, similarity: float) -> DataFrame:
    """Postings, once for each set, of shingles that another set has with which it can be similar by size and position."""
    schema = "token long, node long, n long, pos long"

    def work(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((cols[1], cols[0]))
        token, node, n, pos = (c[order] for c in cols)
        first = np.concatenate(([True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])))
        token, node, n, pos = token[first], node[first], n[first], pos[first]
        for _ in range(2):  # what goes may leave others alone
            some = _met(token, n, pos, similarity)
            token, node, n, pos = token[some], node[some], n[some], pos[some]
        yield _batch(schema, token, node, n, pos)

    return _grouped(postings, "token", work, schema)


def _across(postings: DataFrame, similarity: float, pivots: int | None, seed: int) -> DataFrame:
    """``a, b``: pairs of sets of different components that share a shingle of ``postings`` and can be similar.

    All such pairs, or those with one of the ``pivots`` sets of each shingle that come first in a random order of all sets. Most
    pairs share a shingle by chance, and are the more the larger the input: histograms rule them out here, before anything is sent.
    """
    schema = "a long, b long"

    def work(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        mixed = (cols[1].view(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        order = np.lexsort((mixed ^ mixed >> np.uint64(31), cols[0]))
        token, node, n, pos, component, histogram = (c[order] for c in cols)
        starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        sizes = np.diff(np.append(starts, len(token)))
        at = np.arange(len(token))
        todo = np.repeat(starts + sizes, sizes) - at - 1  # each meets the later ones of its shingle
        if pivots is not None:
            todo[at - np.repeat(starts, sizes) >= pivots] = 0
        one = np.minimum.reduceat(component, starts) == np.maximum.reduceat(component, starts)
        todo[np.repeat(one, sizes)] = 0
        bounds = np.concatenate(([0], np.cumsum(todo)))
        lo = 0
        while lo < len(token):
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + 500_000, "right")) - 1)
            i = np.repeat(at[lo:hi], todo[lo:hi])
            j = i + 1 + np.arange(len(i)) - np.repeat(bounds[lo:hi] - bounds[lo], todo[lo:hi])
            ok = (component[i] != component[j]) & _may(n[i], pos[i], n[j], pos[j], similarity)
            i, j = i[ok], j[ok]
            parts = [(i[x : x + 50_000], j[x : x + 50_000]) for x in range(0, len(i), 50_000)]
            ok = np.concatenate([np.empty(0, bool), *(_near(histogram[x], histogram[y], n[x] + n[y], similarity) for x, y in parts)])
            i, j = i[ok], j[ok]
            a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            if len(a):
                yield _batch(schema, *np.unique(np.stack([a, b]), axis=1))
            lo = hi

    return _grouped(postings, "token", work, schema)


def _apart(n: int | np.ndarray, similarity: float) -> float | np.ndarray:
    """How many shingles sets of n together may have that are not in both."""
    return (1 - similarity) / (1 + similarity) * n + 1e-6


def _histogram(tokens: np.ndarray) -> bytes:
    """How many shingles of a set begin with each of the first bits of a hash, modulo 256."""
    return np.bincount((tokens >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS).astype(np.uint8).tobytes()


def _near(x: np.ndarray, y: np.ndarray, n: np.ndarray, similarity: float) -> np.ndarray:
    """Whether histograms (rows) leave sets of ``n`` shingles together similar: these differ by as many shingles, at least, as the counts do."""
    return np.abs((x - y).view(np.int8).astype(np.int16)).sum(1) <= _apart(n, similarity)


def _bits(tokens: np.ndarray) -> bytes:
    """Whether the shingles with the same last bits of a hash are odd in number, in two to four bits for each shingle."""
    m = max(64, 1 << (2 * len(tokens) - 1).bit_length()) if len(tokens) else 64
    return np.packbits(np.bincount((tokens & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1, bitorder="little").tobytes()


def _differ(x: bytes, y: bytes) -> int:
    """In how many of :func:`_bits` two sets differ, the longer folded: at least so many shingles are not in both."""
    if len(x) < len(y):
        x, y = y, x
    a, b, m = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * len(x)
    while m > 8 * len(y):
        m //= 2
        a = a >> m ^ a & (1 << m) - 1
    return (a ^ b).bit_count()


def _sliced(df: DataFrame, total: float | None, pairs: int, room: float, work, name: str) -> tuple[DataFrame, list[str]]:
    """``work`` on all of ``df(a, b)``, so much at a time that what it sends (``total`` bytes) takes no more room than given on disk."""
    spark, parts = df.sparkSession, max(1, ceil((total or 0) / room), ceil(pairs / MOST_PAIRS))
    out, used = None, []
    for i in range(parts):
        some = df.where(F.pmod(F.xxhash64("a", "b", F.lit(11)), F.lit(parts)) == i) if parts > 1 else df
        done, path = materialize(work(some), name)
        if parts > 1:
            _free(spark)
        out, used = out.unionByName(done) if out else done, [*used, path]
    return out, used


def _alike(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """The pairs of which the exact Jaccard similarity is ``similarity`` or more, from the texts.

    A set goes once to each group of pairs: up to GROUP partners, about, of one ``a``. No more than MOST_PAIRS pairs at a time, so
    that they can be sent to all tasks and no text moves but as a set that is compared.
    """
    large = pairs.groupBy("a").count().where(F.col("count") > GROUP).select("a", F.ceil(F.col("count") / GROUP).alias("parts"))
    dealt = pairs.join(large, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), "parts"), F.lit(0)).cast("int").alias("part"))
    ends = dealt.select(F.explode(F.array("a", "b")).alias("node"), "a", "part").distinct()
    wanted = ends.join(reps.select("node", F.col("rep").alias("doc_id")), "node").groupBy("doc_id", "node").agg(F.collect_list(F.struct("a", "part")).alias("groups"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                some = b.slice(lo, ROWS)
                found = [shingles(t, k) for t in some.column(1).to_pylist()]
                own = [_node(t) == node for t, node in zip(found, some.column(0).to_pylist(), strict=True)]  # an id may have several texts
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([t.tobytes() for t in found], pa.binary()), some.column(2)], ["node", "tokens", "groups"]).filter(pa.array(own, pa.bool_()))

    sets = lean_map(docs.join(F.broadcast(wanted), "doc_id").select("node", "text", "groups"), whole, "node long, tokens binary, groups array<struct<a:long,part:int>>")
    sent = sets.select(F.explode("groups").alias("g"), "node", "tokens").select("g.a", "g.part", "node", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, np.empty(0, np.uint64)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                a, b = [], []
                for *group, node, tokens in zip(*(c.to_pylist() for c in batch.slice(lo, ROWS).columns), strict=True):
                    tokens = np.frombuffer(tokens, np.uint64)
                    if node == group[0]:
                        now, own = group, tokens
                        continue
                    if now != group:
                        raise RuntimeError(f"no text has the set {group[0]}")
                    same = len(np.intersect1d(own, tokens, assume_unique=True))
                    if same >= similarity * (len(own) + len(tokens) - same) - 1e-9:
                        a.append(group[0])
                        b.append(node)
                yield _batch("a long, b long", a, b)

    return lean_map(sent.repartition("a", "part").sortWithinPartitions("a", "part", F.col("node") != F.col("a")), run, "a long, b long")


def _verified(pairs: DataFrame, maps: DataFrame, reps: DataFrame, docs: DataFrame, k: int, similarity: float, room: float) -> tuple[DataFrame, list[str]]:
    """The pairs of which the exact Jaccard similarity is ``similarity`` or more, and the paths they are written to.

    A few bits a shingle go to all pairs and rule out almost all of those that are not similar, never one that is; whole sets go to
    the others only.
    """

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            least = np.array([_differ(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)], np.int64)
            ok = least <= _apart(n, similarity)
            yield _batch("a long, b long, n long", batch.column(0).to_numpy()[ok], batch.column(1).to_numpy()[ok], n[ok])

    def mapped(some: DataFrame) -> DataFrame:
        side = lambda x: maps.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"of_{x}"))
        return lean_map(some.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "of_a", "of_b"), possible, "a long, b long, n long")

    weight = pairs.join(maps.select(F.col("node").alias("b"), "n"), "b").agg(F.sum(F.col("n") / 2 + 16).alias("w")).first().w
    left, left_at = _sliced(pairs, weight, 0, room, mapped, "possible")
    of = left.agg(F.sum(8 * F.col("n")).alias("w"), F.count("*").alias("c")).first()
    links, used = _sliced(left, of.w, of.c, room, lambda some: _alike(some, reps, docs, k, similarity), "links")
    for path in left_at:
        drop_table(pairs.sparkSession, path)
    return links, used


def jaccard_components(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id`` for each row with an id: all that are linked by steps of at least the similarity; the least id names them.

    First the sets' SimHash fingerprints are compared by bit planes (:func:`simhash_links`), whose links join large groups by a
    spanning forest. Then the search is made complete: sets this similar share one at least of the first n - ceil(similarity n) + 1
    of their n shingles in any common order; here the common shingles come last, so that few sets meet. Each set is held against a
    few of each such shingle (PIVOTS); at last every pair that shares one and is not joined yet is held against each other. A link
    of either kind is verified on the whole sets.
    """
    spark = docs.sparkSession
    docs = only(docs, id_col, text_col).where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    common = _common(docs, k)
    by_hash = np.argsort(common)
    common, rank = common[by_hash], (len(common) - by_hash).astype(np.int64)  # the most common has the highest rank

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                some = b.slice(lo, ROWS)
                nodes, sizes, heads, fps, histograms, bits = [], [], [], [], [], []
                for text in some.column(1).to_pylist():
                    tokens = shingles(text, k)
                    nodes.append(_node(tokens))
                    sizes.append(len(tokens))
                    fps.append(_majority(tokens) if len(tokens) else np.uint64(0))
                    histograms.append(_histogram(tokens))
                    bits.append(_bits(tokens))
                    if len(tokens) and len(common):
                        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
                        tokens = tokens[np.argsort(np.where(common[at] == tokens, rank[at], 0), kind="stable")]
                    heads.append(tokens[: len(tokens) - int(needed(len(tokens), similarity)) + 1].tobytes() if len(tokens) else b"")
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(heads, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(histograms, pa.binary()), pa.array(bits, pa.binary())], ["doc_id", "node", "n", "head", "fp", "histogram", "bits"])

    heads, heads_at = materialize(lean_map(docs, made, "doc_id long, node long, n long, head binary, fp long, histogram binary, bits binary"), "heads")
    _free(spark)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                some = b.slice(lo, ROWS)
                parts = some.column(2).to_pylist()
                sizes = np.array([len(x) // 8 for x in parts], np.int64)
                pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                node, n = (np.repeat(some.column(c).to_numpy(), sizes) for c in (0, 1))
                yield _batch("token, node, n, pos", np.frombuffer(b"".join(parts), np.int64), node, n, pos)

    reps, _ = materialize(heads.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("fp").alias("fp"), F.first("n").alias("n")), "reps")
    postings, postings_at = materialize(_shared(lean_map(heads.select("node", "n", "head"), dealt, "token long, node long, n long, pos long"), similarity), "postings")
    _free(spark)
    # whoever shares a shingle may have to be compared
    wanted = postings.select("node").distinct().join(reps, "node").select("node", F.col("rep").alias("doc_id"))
    maps, maps_at = materialize(heads.join(wanted, ["node", "doc_id"]).select("node", "n", "histogram", "bits").dropDuplicates(["node"]), "maps")
    ids, _ = materialize(heads.select("doc_id", "node"), "ids")
    drop_table(spark, heads_at)
    room = max(ROOM, SHARE * 8 * (reps.agg(F.sum("n").alias("n")).first().n or 0))

    # a pair that is similar shares a shingle, so both are among the sets
    near = simhash_links(reps.join(postings.select("node").distinct(), "node", "left_semi").select("fp", F.col("node").alias("rep")), RADIUS)
    pairs, pairs_at = materialize(near.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), "pairs")
    links, links_at = _verified(pairs, maps, reps, docs, k, similarity, room)
    tried, used = pairs, [pairs_at, *links_at]
    for seed, pivots in enumerate(PIVOTS):
        named = components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "_node")
        of = maps.join(named, maps.node == named._node, "left").select("node", F.coalesce("component", "node").alias("component"), "histogram")
        labelled = postings.join(of, "node").select("token", "node", "n", "pos", "component", "histogram")
        pairs, pairs_at = materialize(_across(labelled, similarity, pivots, seed).distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        _free(spark)
        found, found_at = _verified(pairs, maps, reps, docs, k, similarity, room)
        _free(spark)
        tried, links, used = tried.unionByName(pairs), links.unionByName(found), [*used, pairs_at, *found_at]
    for path in (maps_at, postings_at):
        drop_table(spark, path)
    named = reps.select("node", "rep")
    every = links.join(named.select(F.col("node").alias("a"), F.col("rep").alias("u")), "a").join(named.select(F.col("node").alias("b"), F.col("rep").alias("v")), "b")
    found = components(every.select("u", "v"))
    for path in used:
        drop_table(spark, path)
    groups = reps.join(found, reps.rep == found.node, "left").select(reps.node, F.coalesce("component", "rep").alias("component_id"))
    return ids.join(groups, "node").select("doc_id", "component_id")
