"""Connected components by alternating large and small stars, one written table a round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import drop_table, lean_map, materialize


#: Edges that one task contracts to stars at a time.
CHUNK = 1_000_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An edge from each node but the least to the least of its component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while (differ := label[a] != label[b]).any():
        a, b = a[differ], b[differ]
        x, y = label[a], label[b]
        least = np.minimum(x, y)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while (label != (jumped := label[label])).any():
            label = jumped
    some = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[some], nodes[label[some]]


def _contracted(edges: DataFrame) -> DataFrame:
    """The same components from fewer edges: each task makes stars of up to CHUNK edges at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def made() -> pa.RecordBatch:
            u, v = stars(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= CHUNK:
                yield made()
                held, n = [], 0
        if n:
            yield made()

    return lean_map(edges, run, "u long, v long")


def _round(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    large = both.join(least, both.u == least.w).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    below = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
    small = large.join(below, large.u == below.w).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(below.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """``node long, component long`` (the least node reachable) for every node of ``edges(u long, v long)``.

    Loops, repeated edges and nulls are ignored; no edges give an empty table. Each round joins the edges with the least
    neighbour of each node, which is aggregated before the shuffle; a node with very many neighbours only makes a skewed
    equi-join, which adaptive execution splits. Ends when a round changes nothing, normally after three to six. Edges are contracted
    by each task first; no more than CHUNK of them are contracted by a single one, which settles them.
    """
    spark = edges.sparkSession
    clean = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now, path = materialize(_contracted(clean), "edges")
    if (n := now.count()) <= CHUNK:
        new, at = materialize(_contracted(now.coalesce(1)) if n else now, "edges")
        drop_table(spark, path)
        return new.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    seen = None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("xxhash64(u, v) % 1000003"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        new, at = materialize(_round(now), "edges")
        drop_table(spark, path)
        now, path, seen = new, at, state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
