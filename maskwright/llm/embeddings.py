"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosines, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import drop_table, materialize, only
from maskwright.llm.graph import components

#: Vectors that are compared with each other in one group at most, about; larger buckets are dealt out in pairs of parts.
PART = 512
#: Vectors of a label in a bucket, about, for which the bits are planned.
BUCKET = 1024
#: Share of the pairs at the threshold itself that the tables find at least, in expectation; nearer pairs are found more surely.
RECALL = 0.99


def plan_tables(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables): buckets of about BUCKET of n vectors of a label, and as many tables as the recall asks for.

    Sending a vector to a bucket costs as much as a few hundred comparisons there, so few tables of large buckets are cheaper than
    many of small ones.
    """
    bits = max(4, min(24, round(log2(max(2, n) / BUCKET))))
    same = (1 - acos(threshold) / pi) ** bits
    return bits, max(1, ceil(log(1 - recall) / log(1 - same)))


def _flat(column: pa.ListArray, some: np.ndarray) -> np.ndarray:
    """Some lists, all of one length, as rows of doubles."""
    return column.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(some), -1)


def _units(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _fine(lists: pa.ListArray) -> np.ndarray:
    """Which vectors have a direction: not null or empty, all components finite, not all zero."""
    size = lists.value_lengths().fill_null(0).to_numpy()
    flat = lists.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
    end = np.cumsum(size)
    bad, big = (np.concatenate(([0], np.cumsum(m))) for m in (~np.isfinite(flat), flat != 0))
    return (size > 0) & (bad[end] == bad[end - size]) & (big[end] > big[end - size])


def _links(vectors: pa.ListArray, keys: np.ndarray, table: np.ndarray, group: np.ndarray, side: np.ndarray, first: np.ndarray, threshold: float):
    """Links within sorted groups, each in the first table only that has its two vectors in one bucket.

    side tells the part of a split bucket: a pair within one part is met with the first of the other parts only. Yields (u, v).
    """
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(group)], strict=True):
        if hi - lo < 2:
            continue
        x = _units(_flat(vectors, np.arange(lo, hi)))  # of one width in a bucket
        i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        if not len(i):
            continue
        i, j = i + lo, j + lo
        same = (side[i] == side[j]) & ~first[i]
        earlier = (keys[i] == keys[j]) & (np.arange(keys.shape[1]) < table[i][:, None])
        ok = ~same & ~earlier.any(1)
        yield i[ok], j[ok]


def _planes(width: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, width]).normal(size=(width, bits * tables))


def cosine_links(reps: DataFrame, threshold: float, bits: int, tables: int, seed: int = 17) -> tuple[DataFrame, str]:
    """``u long, v long, n long`` for ``reps(rep long, label, x array<float or double>, mult long)`` with vectors that have a direction.

    Two kinds of rows: (u, null, n): u is linked with vectors of multiplicity n in all, over several rows; (u, v, 0): links that
    join what is linked, a spanning forest of each group and not every pair. Pairs are never shuffled. A vector goes to one bucket
    of each table, as it came (floats stay floats). A bucket of n vectors over PART is dealt out as n / PART copies of each: that is
    what vectors cost that are near each other in thousands and yet differ. Also returns the path of a table that the links read.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits, dtype=np.int64)
        for b in batches:
            size = b.column(2).value_lengths().to_numpy()
            keys = np.zeros((b.num_rows, tables), np.int32)
            for width in np.unique(size).tolist():
                some = np.flatnonzero(size == width)
                keys[some] = (_units(_flat(b.column(2), some)) @ _planes(width, bits, tables, seed) > 0).reshape(len(some), tables, bits) @ weights
            at = pa.array(np.arange(0, b.num_rows * tables + 1, tables, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(at, pa.array(keys.reshape(-1)))], ["rep", "label", "x", "mult", "width", "keys"])

    schema = f"rep long, label {dict(reps.dtypes)['label']}, x {dict(reps.dtypes)['x']}, mult long, width int, keys array<int>"
    keyed, keyed_at = materialize(reps.select("rep", "label", "x", "mult").mapInArrow(hashed, schema), "keys")
    slim = keyed.select("label", "width", F.posexplode("keys").alias("t", "key"))
    large = slim.groupBy("label", "width", "t", "key").count().where(F.col("count") > PART).select("label", "width", "t", "key", F.ceil(F.col("count") / PART).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("rep", F.lit(3)), F.col("parts")).cast("int")
    dealt = (
        keyed.select("rep", "label", "width", "x", "mult", "keys", F.posexplode("keys").alias("t", "key"))
        .join(large, ["label", "width", "t", "key"], "left")
        .withColumn("own", F.coalesce(own, F.lit(0)))
        .withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: i != F.col("own")))))
        .select(
            "rep", "mult", "x", "keys", F.col("t").cast("short").alias("t"), F.col("own").cast("int").alias("own"),
            # within its own part a pair counts where the other part is the first besides
            (F.col("parts").isNull() | (F.col("other") == F.when(F.col("own") == 0, 1).otherwise(0))).alias("first"),
            F.xxhash64("label", "width", "t", "key", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"),
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def links() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            col = lambda n: t.column(n).combine_chunks()
            rep, mult, table, side, first, bucket = (col(n).to_numpy(zero_copy_only=False) for n in ("rep", "mult", "t", "own", "first", "bucket"))
            keys = col("keys").flatten().to_numpy(zero_copy_only=False).reshape(len(rep), -1)
            total = np.zeros(len(rep), np.int64)
            us, vs = [], []
            for i, j in _links(col("x"), keys, table, bucket, side, first, threshold):
                total += np.bincount(i, mult[j], len(rep)).astype(np.int64) + np.bincount(j, mult[i], len(rep)).astype(np.int64)
                u, v = _forest(i, j)
                us.append(u)
                vs.append(v)
            some = np.flatnonzero(total)
            u, v = (np.concatenate(x) if x else np.empty(0, int) for x in (us, vs))
            empty = pa.nulls(len(some), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([rep[some], rep[u]])), pa.concat_arrays([empty, pa.array(rep[v], pa.int64())]), pa.array(np.concatenate([total[some], np.zeros(len(u), np.int64)]))],
                ["u", "v", "n"],
            )

        for b in batches:
            if not b.num_rows:
                continue
            bucket = b.column(7).to_numpy()
            cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
            if cut:
                held.append(b.slice(0, cut))
                yield links()
                held = [b.slice(cut)]
            else:
                held.append(b)
        if held:
            yield links()

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "u long, v long, n long"), keyed_at


def _forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A link from each item to the least of its component."""
    items, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    u, v = at[: len(i)], at[len(i) :]
    label = np.arange(len(items))
    while (differ := label[u] != label[v]).any():
        u, v = u[differ], v[differ]
        a, b = label[u], label[v]
        m = np.minimum(a, b)
        np.minimum.at(label, a, m)
        np.minimum.at(label, b, m)
        while (label != (jumped := label[label])).any():
            label = jumped
    some = np.flatnonzero(label != np.arange(len(items)))
    return items[some], items[label[some]]


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", bits: int | None = None, tables: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row, by cosines of at least ``threshold`` within a label.

    n_links counts the other rows linked directly. Null labels, and vectors that are null, empty, zero or hold null or non-finite
    components, link with nothing; nor do vectors of different widths with each other. Equal vectors of a label are one item with
    a multiplicity. A null id is linked and counted but never names a component; rows of one id each count. Repeated rows link
    with each other. Pairs are found by ``tables`` hash tables of ``bits`` signs (planned from the number of items), and every
    link found is verified in double precision; a pair just at the threshold is missed with a chance of 1 - RECALL.
    """
    spark = vectors.sparkSession
    kind = "float" if dict(only(vectors, vec_col).dtypes)[vec_col] == "array<float>" else "double"
    plain = only(vectors, id_col, vec_col, label_col).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast(f"array<{kind}>").alias("x"), F.col(f"`{label_col}`").alias("label"))
    label_type = dict(plain.dtypes)["label"]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fine = _fine(b.column(1)) & b.column(2).is_valid().to_numpy(zero_copy_only=False)
            names: list[bytes | None] = [None] * b.num_rows
            for at in np.flatnonzero(fine).tolist():
                x = b.column(1)[at].values.to_numpy(zero_copy_only=False)
                names[at] = sha256(repr(b.column(2)[at].as_py()).encode() + b" " + (x + x.dtype.type(0)).tobytes()).digest()  # 0 for -0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.binary()), b.column(2), b.column(1)], ["vec_id", "same", "label", "x"])

    given = plain.mapInArrow(named, f"vec_id long, same binary, label {label_type}, x array<{kind}>")
    rows, _ = materialize(given, "vectors")
    good = rows.where("same is not null")
    reps, reps_at = materialize(good.groupBy("same").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("label").alias("label"), F.first("x").alias("x")).where("rep is not null"), "reps")
    # vectors of a label meet only each other: the size of the group that a vector is in, on average
    size = reps.groupBy("label").count().agg(F.sum(F.col("count") * F.col("count").cast("double")) / F.sum("count")).first()[0]
    planned = plan_tables(int(size or 1), threshold)
    found, keys_at = cosine_links(reps, threshold, bits or planned[0], tables or planned[1])
    links, links_at = materialize(found, "links")
    drop_table(spark, keys_at)
    total = links.where("v is null").groupBy("u").agg(F.sum("n").alias("n"))
    comp = components(links.where("v is not null").select("u", "v"))
    names = reps.select("same", "rep", "mult").join(total, F.col("rep") == total.u, "left").join(comp, F.col("rep") == comp.node, "left")
    names = names.select("same", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    names, _ = materialize(names, "names")
    for path in (reps_at, links_at):
        drop_table(spark, path)
    linked = rows.join(names, "same", "left").select("vec_id", "n_links", "component_id")  # of null same: with nothing
    out = linked.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors at a cosine of 0.93."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.93)


SQL: dict[str, str] = {}
