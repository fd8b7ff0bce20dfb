"""The first texts of a column: the same as a sort gives, without one."""

from pyspark.sql import functions as F

from maskwright.operators import classify


def test_first_texts(spark):
    """One column is full, one has its few texts late, one has none; no task ranks a column or makes values it does not need."""
    made = spark.sparkContext.accumulator(0)

    def counted(x):
        made.add(1)
        return x

    i = F.col("id")
    df = spark.range(0, 20000, 1, 8).select(
        (i * 7919 % 20000).alias("id"), F.concat(F.lit("u"), i.cast("string")).alias("a"), F.when(i * 7919 % 20000 > 19000, i.cast("string")).otherwise("").alias("b"), F.lit(None).cast("string").alias("c"),
    )
    got = classify.first_texts("t", df, "id", ["a", "b", "c"], "json", 50)
    long = df.select("id", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in "abc"])).alias("x"))
    want = classify.first_samples(long.select(F.lit("t").alias("table"), "x.column", F.lit("json").alias("sql_type"), F.col("id").alias("pos"), "x.value"), 50)
    rows = lambda some: sorted(map(tuple, some.select("table", "column", "sql_type", "value").collect()))
    assert rows(got) == rows(want) and len(rows(got)) == 100
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    slow = df.select("id", F.udf(counted, "string")("a").alias("a"))
    assert classify.first_texts("t", slow, "id", ["a"], limit=50).count() == 50
    assert made.value < 2000
