"""Benchmark decontamination by a stored positional inverted index of the documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import WORD_BYTES, drop_table, forget, lean_map, materialize, only, trim

#: Words of a shard of documents, about; a longer document is one by itself.
SHARD_WORDS = 1_000_000
#: Windows that a task looks for in a shard at once.
WINDOWS = 200_000
#: Terms of windows up to which their hashes are broadcast: a few MB.
FEW_TERMS = 300_000
#: Words on either side of a window's rarest one within which a proximity match has all its words.
REACH = 15


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


class _Terms(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


_POSTING = "shard long, term binary, h long, n int, places binary, docs array<struct<id:long,words:int,key1:long,key2:long>>"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _posted(shard: int, ids: list, texts: list[str | None], seed: int) -> pa.RecordBatch:
    """The index of a shard, which is one run of words with a gap after each document: a row for each term with its places, as
    steps from one to the next, and a row without a term for the documents, whose places are the gaps' after each."""
    terms = _Terms()
    each = [np.fromiter(map(terms.__getitem__, words_of(t)), np.int32) for t in texts]  # the words of one text at a time
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    run = np.concatenate(each)
    at = np.arange(len(run)) + np.repeat(np.arange(len(each)), sizes)
    del each
    order = np.argsort(run, kind="stable")
    count = np.bincount(run, minlength=len(terms))
    first = np.cumsum(count) - count
    at = at[order]
    steps = np.diff(at, prepend=0)
    steps[first] = at[first]
    # the documents come last
    steps = np.concatenate((steps, sizes + 1)).astype("<i4")
    offsets = np.concatenate((first, [len(at), len(steps)])).astype(np.int32) * 4
    places = pa.Array.from_buffers(pa.binary(), len(terms) + 1, [None, pa.py_buffer(offsets), pa.py_buffer(steps)])
    h = [_signed(xxhash.xxh64_intdigest(t, 42)) for t in terms]
    key = lambda s: [_signed(xxhash.xxh64_intdigest((t or "").encode("utf-8", "surrogatepass"), s)) for t in texts]
    docs = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes.astype(np.int32)), pa.array(key(42), pa.int64()), pa.array(key(seed), pa.int64())], ["id", "words", "key1", "key2"])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(terms) + 1, shard)), pa.array([*terms, None], pa.binary()), pa.array([*h, None], pa.int64()), pa.array([*count.tolist(), len(ids)], pa.int32()), places,
            pa.ListArray.from_arrays(pa.array([0] * (len(terms) + 1) + [len(ids)], pa.int32()), docs),
        ], ["shard", "term", "h", "n", "places", "docs"],
    )


@dataclass
class Index:
    """The stored postings of some documents. ``table`` has a row for each shard and term, and one for each shard's documents."""

    table: DataFrame
    path: str
    seed: int

    @property
    def postings(self) -> DataFrame:
        return self.table.where("term is not null")

    @property
    def shards(self) -> DataFrame:
        return self.table.where("term is null")

    def documents(self) -> DataFrame:
        """``shard, doc, doc_id, n_words, key1, key2`` for each document; the keys are two hashes of its text."""
        one = self.shards.select("shard", F.posexplode("docs").alias("doc", "d"))
        return one.select("shard", "doc", F.col("d.id").alias("doc_id"), F.col("d.words").cast("long").alias("n_words"), F.col("d.key1").alias("key1"), F.col("d.key2").alias("key2"))

    def drop(self) -> None:
        drop_table(self.table.sparkSession, self.path)


def _second_seed(spark: SparkSession) -> int:
    return spark.range(1).select(F.xxhash64(F.lit(7))).first()[0] & (1 << 64) - 1


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Writes the postings of all terms of ``docs`` to the shared folder, without a shuffle: each task has shards of about
    SHARD_WORDS words. A frequent term has a row for each shard, so no list is longer than a shard."""
    spark = docs.sparkSession
    seed = _second_seed(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list = []
        held = 0
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                for i, t in zip(*(c.to_pylist() for c in b.slice(lo, 500).columns), strict=True):
                    ids.append(i)
                    texts.append(t)
                    held += len(t or "") // 6 + 1
                    if held >= SHARD_WORDS:
                        yield _posted(shard, ids, texts, seed)
                        ids, texts, held, shard = [], [], 0, shard + 1
        if ids:
            yield _posted(shard, ids, texts, seed)

    plain = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return Index(*materialize(lean_map(plain, run, _POSTING), "postings", "zstd"), seed)


def windows(benchmark: DataFrame, size: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``window binary, terms array<binary>, item`` for each item and window of it: ``size`` words in a row, or a shorter item whole.

    The window is named by a hash of its words. Items without words have none.
    """
    plain = only(benchmark, item_col, text_col).select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, t in enumerate(b.column(1).to_pylist()):
                w = words_of(t)
                each = [w[lo : lo + size] for lo in range(max(1, len(w) - size + 1))] if w else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(b" ".join(x)) for x in each], pa.binary()), pa.array(each, pa.list_(pa.binary())), b.column(0).take(pa.array([n] * len(each), pa.int64()))],
                    ["window", "terms", "item"],
                )

    return lean_map(plain, run, f"window binary, terms array<binary>, item {dict(plain.dtypes)['item']}")


def _within(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of ``wanted`` are among ``keys``, which are in order."""
    if not len(keys):
        return np.zeros(len(wanted), bool)
    return keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted


def intersect(h: np.ndarray, steps: list[np.ndarray], ends: np.ndarray, terms: np.ndarray, offset: np.ndarray, reach: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window, start) of all exact matches and (window, place) of all proximity matches in a shard.

    ``h`` names the shard's terms and ``steps`` has their places. Rows of ``terms`` are the windows' terms from the rarest on, and
    ``offset`` their places in the window, -1 beyond its end. The list of the rarest, moved by its offset, gives the candidates; the
    moved lists of the others are intersected with it in turn. For proximity a list has to have a place within ``reach`` of the
    rarest's, in the same document.
    """
    none = np.empty(0, np.int64)
    order = np.argsort(h)
    h = h[order]
    count = np.array([len(steps[i]) for i in order.tolist()], np.int64)
    first = np.cumsum(count) - count
    flat = np.concatenate([steps[i] for i in order.tolist()]).astype(np.int64) if len(order) else none
    total = np.cumsum(flat)
    at = total - np.repeat(total[first] - flat[first], count)
    size = int(ends[-1]) + 1 if len(ends) else 1
    keys = np.repeat(np.arange(len(h)), count) * size + at
    number = np.minimum(np.searchsorted(h, terms), max(0, len(h) - 1))
    here = (offset < 0) | (h[number] == terms) if len(h) else offset < 0
    live = np.flatnonzero(here.all(1))
    if not len(live):
        return none, none, none, none
    number, offset = number[live], offset[live]
    rare = count[number[:, 0]]
    window = np.repeat(np.arange(len(live)), rare)
    nth = np.arange(len(window)) - np.repeat(np.cumsum(rare) - rare, rare)
    place = at[first[number[window, 0]] + nth]
    exact, start = window, place - offset[window, 0]
    for j in range(1, number.shape[1]):
        off, want = offset[exact, j], start + offset[exact, j]
        ok = (off < 0) | (want >= 0) & (want < size) & _within(keys, number[exact, j] * size + want)
        exact, start = exact[ok], start[ok]
    ok = start >= 0
    exact, start = exact[ok], start[ok]
    if reach is None:
        return live[exact], start, none, none
    for j in range(1, number.shape[1]):
        doc = np.searchsorted(ends, place, "right")
        begin = np.where(doc > 0, ends[np.maximum(doc - 1, 0)], 0)
        low, high = np.maximum(place - reach, begin), np.minimum(place + reach, ends[doc] - 1)
        term = number[window, j] * size
        found = np.searchsorted(keys, term + low)
        ok = (offset[window, j] < 0) | (np.append(keys, np.iinfo(np.int64).max)[found] <= term + high)
        window, place = window[ok], place[ok]
    return live[exact], start, live[window], place


def _looked_up(index_: Index, terms: DataFrame) -> tuple[DataFrame, str, bool]:
    """``shard, h, n, places``: the postings of the terms in ``terms(h)``, and each shard's documents; written. Also the path, and
    whether the terms are few.

    The terms are broadcast if they are few by count; else Spark has to send the whole index to them.
    """
    used, at = materialize(terms.distinct(), "terms")
    few = used.count() <= FEW_TERMS
    some = F.broadcast(used) if few else used
    found = index_.postings.select("shard", "h", "n", "places").join(some, "h", "left_semi").unionByName(index_.shards.select("shard", "h", "n", "places"))
    out, path = materialize(found, "lists")
    drop_table(terms.sparkSession, at)
    return out, path, few


def _ranked(each: DataFrame, lists: DataFrame, few: bool) -> DataFrame:
    """``window, h array<long>, place array<int>`` of the windows of which the documents have all terms, from the rarest on.

    Terms are counted over all documents; of equally rare ones the first in the window counts as the rarer.
    """
    counts = lists.where("h is not null").groupBy("h").agg(F.sum("n").alias("n"))
    all_ = each.join(F.broadcast(counts) if few else counts, "h", "left").groupBy("window").agg(F.array_sort(F.collect_list(F.struct("n", "place", "h"))).alias("t"))
    return all_.where(~F.exists("t", lambda x: x["n"].isNull())).select("window", F.col("t.h").alias("h"), F.col("t.place").alias("place"))


_MATCH = "shard long, doc int, start int, stop int, window binary, near boolean"


def matches(index_: Index, found: DataFrame, reach: int | None = None) -> tuple[DataFrame, str]:
    """``shard, doc, start, stop, window, near`` for ``found(window, terms)``: what of the windows the documents hold.

    Rows of three kinds: words from start to stop are hit (window is null); the document has the window (near is false), or its
    words close by (near is true; start is the place of the rarest word). A window is looked for in the shards that have its rarest
    term, whose posting lists for the windows' terms meet it there; neither documents nor windows go through the driver. Written;
    also returns the path. A term is told by a 64-bit hash here.
    """
    distinct = found.groupBy("window").agg(F.first("terms").alias("terms"))
    each, each_at = materialize(distinct.select("window", F.posexplode("terms").alias("place", "term")).select("window", "place", F.xxhash64("term").alias("h")), "each")
    lists, lists_at, few = _looked_up(index_, each.select("h"))
    ranked, ranked_at = materialize(_ranked(each, lists, few), "ranked")
    blocks = max(1, -(-ranked.count() // WINDOWS))
    ranked = ranked.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)).cast("int"))
    todo = ranked.withColumn("rarest", F.col("h")[0]).join(lists.where("h is not null").select(F.col("h").alias("rarest"), "shard"), "rarest").select("shard", "block", "window", "h", "place")
    met = lists.select(F.col("shard").alias("shard"), F.col("h").alias("h"), F.col("places").alias("places")).withColumn("block", F.explode(F.array(*map(F.lit, range(blocks)))) if blocks > 1 else F.lit(0))

    def run(windows_: pa.Table, lists_: pa.Table) -> pa.Table:
        schema = pa.schema([("shard", pa.int64()), ("doc", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("window", pa.binary()), ("near", pa.bool_())])
        if not windows_.num_rows or not lists_.num_rows:
            return schema.empty_table()
        named = windows_.column("window").to_pylist()
        sizes = windows_.column("h").combine_chunks().value_lengths().to_numpy()
        row = np.repeat(np.arange(len(sizes)), sizes)
        col = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        terms, offset = np.zeros((len(sizes), int(sizes.max())), np.int64), np.full((len(sizes), int(sizes.max())), -1, np.int64)
        terms[row, col] = windows_.column("h").combine_chunks().flatten().to_numpy()
        offset[row, col] = windows_.column("place").combine_chunks().flatten().to_numpy()
        h, steps, ends = [], [], np.empty(0, np.int64)
        for x, raw in zip(lists_.column("h").to_pylist(), lists_.column("places").to_pylist(), strict=True):
            if x is None:
                ends = np.cumsum(np.frombuffer(raw, "<i4").astype(np.int64))
            else:
                h.append(x)
                steps.append(np.frombuffer(raw, "<i4"))
        exact, start, close, place = intersect(np.array(h, np.int64), steps, ends, terms, offset, reach)
        total = int(ends[-1])
        stop = start + (offset[exact] >= 0).sum(1)
        hit = np.cumsum(np.bincount(start, minlength=total + 1) - np.bincount(stop, minlength=total + 1)) > 0
        edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
        low, high = edge[::2], edge[1::2]

        def of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            doc = np.searchsorted(ends, at, "right")
            return doc, at - np.where(doc > 0, ends[np.maximum(doc - 1, 0)], 0)

        pairs = np.unique(np.stack([of(start)[0], exact]), axis=1)
        (doc, begin), (near_doc, near_at) = of(low), of(place)
        empty = lambda n, kind: pa.nulls(n, kind)
        ints = lambda x: pa.array(np.asarray(x, np.int32))
        parts = [
            (doc, ints(begin), ints(begin + high - low), empty(len(doc), pa.binary()), False),
            (pairs[0], empty(pairs.shape[1], pa.int32()), empty(pairs.shape[1], pa.int32()), pa.array([named[x] for x in pairs[1].tolist()], pa.binary()), False),
            (near_doc, ints(near_at), empty(len(near_doc), pa.int32()), pa.array([named[x] for x in close.tolist()], pa.binary()), True),
        ]
        shard = lists_.column("shard")[0].as_py()
        return pa.concat_tables([pa.Table.from_arrays([pa.array(np.full(len(d), shard)), ints(d), a, b, w, pa.array(np.full(len(d), near))], schema=schema) for d, a, b, w, near in parts])

    def lean(windows_: pa.Table, lists_: pa.Table) -> pa.Table:
        forget()
        try:
            return run(windows_, lists_)
        finally:
            trim()

    out, at = materialize(todo.groupBy("shard", "block").cogroup(met.groupBy("shard", "block")).applyInArrow(lean, _MATCH), "matches")
    for path in (each_at, lists_at, ranked_at):
        drop_table(found.sparkSession, path)
    return out, at


def _hit(found: DataFrame) -> DataFrame:
    """``shard, doc, n_hit``: words inside any of a document's hit runs; those of several blocks may overlap."""
    runs = found.where("window is null").groupBy("shard", "doc").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("runs"))
    union = F.expr("aggregate(runs, named_struct('n', 0L, 'to', 0), (acc, r) -> named_struct('n', acc.n + greatest(0, r.stop - greatest(acc.to, r.start)), 'to', greatest(acc.to, r.stop)), acc -> acc.n)")
    return runs.select("shard", "doc", union.alias("n_hit"))


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit (see :func:`decontaminate`), with all their columns.

    Whether a row has one depends on its text alone, so rows are told by two 64-bit hashes of it.
    """
    spark = docs.sparkSession
    built = index(docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    found, at = matches(built, windows(benchmark, size, item_col, item_text_col))
    bad, _ = materialize(built.documents().join(found.where("window is null").select("shard", "doc").distinct(), ["shard", "doc"], "left_semi").select(F.col("key1").alias("_key1"), F.col("key2").alias("_key2")).distinct(), "hit")
    drop_table(spark, at)
    built.drop()
    text = F.col(f"`{text_col}`")
    keyed = docs.withColumn("_one", F.xxhash64(text)).withColumn("_two", F.xxhash64(F.lit(7), text))
    return keyed.join(bad, (F.col("_one") == F.col("_key1")) & (F.col("_two") == F.col("_key2")), "left_anti").drop("_one", "_two")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", reach: int | None = None) -> DataFrame:
    """``doc_id, n_words, n_hit, items, near`` for each row of ``docs``: exact and proximity occurrences of the items' windows.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A window is ``size`` consecutive words of an
    item, or a shorter item whole. n_hit counts document words inside any exact occurrence; items lists the items with one, and near
    those of which all words of a window stand within ``reach`` words of its rarest one (none without a reach), sorted as strings.
    Null or wordless texts hit nothing; items with a null id count in n_hit but are not listed; each repeated row gets a row; an
    empty benchmark hits nothing; other columns are not read.
    """
    spark = docs.sparkSession
    built = index(docs, id_col, text_col)
    given, given_at = materialize(windows(benchmark, size, item_col, item_text_col), "windows")
    found, found_at = matches(built, given, reach)
    of = given.where("item is not null").select("window", "item").distinct()
    named = found.where("window is not null").select("shard", "doc", "window", "near").distinct().join(of, "window")
    listed = lambda near: F.array_sort(F.collect_set(F.when(F.col("near") == near, F.struct(F.col("item").cast("string").alias("name"), "item"))))["item"]
    items = named.groupBy("shard", "doc").agg(listed(False).alias("items"), listed(True).alias("near"))
    out = built.documents().join(_hit(found), ["shard", "doc"], "left").join(items, ["shard", "doc"], "left")
    none = F.array().cast(dict(items.dtypes)["items"])
    out, _ = materialize(out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near", none).alias("near")), "decontaminated")
    for path in (given_at, found_at):
        drop_table(spark, path)
    built.drop()
    return out


def near_matches(docs: DataFrame, benchmark: DataFrame, size: int = 10, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, word``: where all words of a window of an item stand within ``reach`` words of its rarest one.

    The rarest word is that of all documents, the first of equals; a place is given once for each item. Nulls, empty tables and
    clashing names as in :func:`decontaminate`.
    """
    spark = docs.sparkSession
    built = index(docs, id_col, text_col)
    given, given_at = materialize(windows(benchmark, size, item_col, item_text_col), "windows")
    found, found_at = matches(built, given, reach)
    close = found.where("near").select("shard", "doc", F.col("start").cast("long").alias("word"), "window")
    items = given.where("item is not null").select("window", F.col("item").alias("item_id")).distinct()
    out, _ = materialize(close.join(items, "window").select("shard", "doc", "item_id", "word").distinct().join(built.documents(), ["shard", "doc"]).select("doc_id", "item_id", "word"), "near")
    for path in (given_at, found_at):
        drop_table(spark, path)
    built.drop()
    return out


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``term, doc_id, positions array<int>``: the index by document, as a table in plain columns.

    A list is of one document, so a frequent term has many rows and no long one.
    """
    plain = only(docs, id_col, text_col)
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    each = plain.select(F.col(id_col).alias("doc_id"), F.posexplode(words).alias("place", "term"))
    return each.groupBy("term", "doc_id").agg(F.array_sort(F.collect_list("place")).alias("positions"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, windows of 10 words, with proximity matches."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    found = decontaminate(read("documents"), read("benchmark"), 10, reach=REACH)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.transform("items", lambda x: x.cast("string"))), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near"),
    )


SQL = {
    "op5_decontamination": r"""
with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from documents),
b as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from benchmark),
windows as (select item_id, least(len(w), 10) as n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) as gram from b where len(w) > 0),
sizes as (select distinct n from windows),
grams as (select doc_id, n, unnest(range(1, len(w) - n + 2)) as i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) as gram from d, sizes where len(w) >= n),
found as (select doc_id, item_id, n, i from grams join windows using (n, gram)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from found) group by doc_id),
post as (select doc_id, unnest(w) as term, unnest(range(0, len(w))) as p from d),
named as (select item_id, gram, n, string_split(gram, ' ') as ts from windows),
wt as (select distinct gram, unnest(ts) as term, unnest(range(0, len(ts))) as place from (select distinct gram, ts from named)),
cnt as (select term, count(*) as c from post where term in (select term from wt) group by term),
rare as (select gram, arg_min(term, c * 1000 + place) as term, count(distinct term) as k from wt left join cnt using (term) group by gram having count(*) = count(c)),
cand as (select gram, k, post.doc_id, post.p from rare join post using (term)),
close as (select c.gram, c.doc_id, c.p from cand c join (select distinct gram, term from wt) t using (gram) join post q on q.doc_id = c.doc_id and q.term = t.term and q.p between c.p - 15 and c.p + 15
          group by c.gram, c.doc_id, c.p, c.k having count(distinct t.term) = c.k),
near as (select doc_id, count(distinct item_id) as n_near from close join named using (gram) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as names from (select distinct doc_id, cast(item_id as varchar) as s from found where item_id is not null) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, cast(coalesce(n_near, 0) as bigint) as n_near
from d left join hit using (doc_id) left join items using (doc_id) left join near using (doc_id)"""
}
