"""The persons are made by all cores, however few parts the file of customers has."""

from maskwright.plans import queries


def test_people_of_one_row_group(spark):
    from pyspark.sql import functions as F

    made = queries.people(spark, "/root/testdata/sf0.01").select(F.spark_partition_id().alias("p"), "id")
    sizes = [r["count"] for r in made.groupBy("p").count().collect()]
    assert len(sizes) == 4 * spark.sparkContext.defaultParallelism and max(sizes) < 2 * sum(sizes) / len(sizes)
