"""Injective mappings for unique columns, found in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.presets import PRESETS
from maskwright.functions.seed import Spark
from maskwright.plans.config import Rule
from maskwright.plans.shared import dropped, written_at

SPARK = Spark()
#: Rounds after which a pool of values counts as exhausted.
ATTEMPTS = 1000


class PoolExhausted(RuntimeError):
    """A unique column has more values than its preset can make."""


def candidates(values: DataFrame, rule: Rule, key: bytes, attempt: int, max_len: int | None) -> DataFrame:
    """``input, output``: what the preset makes of each input at an attempt, cut to the column's length."""
    preset = PRESETS[rule.value]
    seeds = preset.seeds(SPARK, "input", key, attempt)
    seeded = values.select("input", *[F.expr(sql).alias(f"_{label}") for label, sql in seeds.items()])
    made = F.expr(preset.build(SPARK, "input", {label: f"_{label}" for label in seeds}, dict(rule.params)))
    return seeded.select("input", F.left(made, F.lit(max_len)).alias("output") if max_len else made.alias("output"))


def unique_mapping(values: DataFrame, rule: Rule, key: bytes, max_len: int | None = None, attempts: int = ATTEMPTS) -> DataFrame:
    """``input, output, attempt`` for the distinct non-empty texts of ``values(input)``: different inputs get different outputs.

    In each round every open input makes a candidate; of those that make the same one, and if no earlier round gave it away, the
    first by a keyed hash takes it. The result depends neither on the order of rows nor on partitions. Equal inputs are one
    before the first shuffle, and candidates are dealt out by their value, so no task holds more than one value's claimants, which
    are compared by an aggregate and not gathered.
    """
    spark = values.sparkSession
    left, at = written_at(values.where("input is not null and input <> ''").distinct(), "unique")
    schema, paths = "input string, output string, attempt int", []  # of what each round gave away
    for attempt in range(attempts + 1):
        taken = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
        if left.isEmpty():
            dropped(spark, at)
            return taken
        made = candidates(left, rule, key, attempt, max_len).withColumn("turn", F.expr(SPARK.seed(key, "turn", "input")))
        free = made.join(taken.select("output"), "output", "left_anti") if paths else made
        won, path = written_at(free.groupBy("output").agg(F.min_by("input", "turn").alias("input")).select("input", "output", F.lit(attempt).alias("attempt")), "unique")
        paths.append(path)
        # who won now is all that leaves
        rest, new = written_at(left.join(won.select("input"), "input", "left_anti"), "unique")
        dropped(spark, at)
        left, at = rest, new
    dropped(spark, at, *paths)
    raise PoolExhausted(f"{rule.value} has too few values for a unique column")
