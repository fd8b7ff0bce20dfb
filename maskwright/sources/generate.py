"""Makes dumps: of any tables, or synthetic shops of a wanted size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.plans.shared import shared_path

_SQL = {T.LongType: "bigint", T.IntegerType: "int", T.DoubleType: "double", T.DateType: "date", T.TimestampNTZType: "datetime", T.TimestampType: "datetime"}


def _literal(df: DataFrame, name: str):
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        out = c
        for a, b in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\0", "\\0"), ("'", "\\'"), ('"', '\\"')):
            out = F.replace(out, F.lit(a), F.lit(b))
        out = F.concat(F.lit("'"), out, F.lit("'"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        out = F.concat(F.lit("'"), F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("'"))
    elif isinstance(kind, T.DateType):
        out = F.concat(F.lit("'"), c.cast("string"), F.lit("'"))
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit("NULL"))


def definition(name: str, df: DataFrame, lengths: dict[str, int] | None = None, unique: tuple[str, ...] = ()) -> str:
    lines = []
    for f in df.schema.fields:
        size = (lengths or {}).get(f.name)
        lines.append(f"  `{f.name}` " + (f"varchar({size})" if size else _SQL.get(type(f.dataType), "text")))
    lines += [f"  UNIQUE KEY `u_{c}` (`{c}`)" for c in unique]
    return f"DROP TABLE IF EXISTS `{name}`;\nCREATE TABLE `{name}` (\n" + ",\n".join(lines) + "\n);"


def dump_of(spark: SparkSession, tables: dict[str, tuple[DataFrame, str]], rows: int = 1000, lengths: dict[str, dict[str, int]] | None = None, unique: dict[str, tuple[str, ...]] | None = None) -> str:
    """The path of a dump of ``tables`` (name: DataFrame and its whole-number key), ``rows`` keys to an INSERT.

    Statements are made in parallel, a group of neighbouring keys each.
    """
    path = shared_path(spark, "dump")
    out = None
    for n, (name, (df, key)) in enumerate(tables.items()):
        head = spark.createDataFrame([(n, -1, definition(name, df, (lengths or {}).get(name), (unique or {}).get(name, ())))], "n int, g long, value string")
        row = F.concat(F.lit("("), F.concat_ws(",", *[_literal(df, c) for c in df.columns]), F.lit(")"))
        groups = df.select(F.floor(F.col(key) / rows).alias("g"), F.col(key).alias("k"), row.alias("r")).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("k", "r"))).alias("rs"))
        body = groups.select(F.lit(n).alias("n"), "g", F.concat(F.lit(f"INSERT INTO `{name}` VALUES "), F.array_join("rs.r", ","), F.lit(";")).alias("value"))
        both = head.unionByName(body)
        out = both if out is None else out.unionByName(both)
    out.repartitionByRange("n", "g").sortWithinPartitions("n", "g").select("value").write.text(path)
    return path


def shop(spark: SparkSession, scale: int, seed: int = 42) -> dict[str, tuple[DataFrame, str]]:
    """Customers, orders (twice as many, four lines each), payments and users (half as many), from hashes of their numbers."""
    h = lambda c, salt, n: F.pmod(F.xxhash64(F.col(c), F.lit(seed), F.lit(salt)), F.lit(n))
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    null = lambda c, salt, percent, x: F.when(h(c, salt, 100) >= percent, x)
    i = F.col("id")
    customers = spark.range(max(5, scale)).select("id", text("Client ", i).alias("name"), F.concat(F.lit("0"), (F.lit(600000000) + h("id", 1, 100000000)).cast("string")).alias("phone"), text("rue ", h("id", 2, 500)).alias("address"), h("id", 3, 10**6).alias("credit"))
    orders = spark.range(max(10, 2 * scale)).select("id", h("id", 4, max(5, scale)).alias("customer_id"), F.date_add(F.lit("2015-01-01").cast("date"), h("id", 5, 3000).cast("int")).alias("ordered"))
    lines = spark.range(max(40, 8 * scale)).select("id", F.floor(i / 4).alias("order_id"), (i % 4).alias("line"), h("id", 6, 50).alias("quantity"))
    payments = spark.range(max(10, 2 * scale)).select("id", h("id", 7, max(5, scale)).alias("customer_id"), (h("id", 8, 10**6) / 100).alias("amount"))
    users = spark.range(max(5, scale // 2)).select(
        "id", F.concat(F.lit("u"), i.cast("string"), F.lit("@shop.example.com")).alias("email"), text("Prenom", h("id", 9, 90)).alias("first_name"), text("Nom", h("id", 10, 90)).alias("last_name"),
        null("id", 11, 20, F.concat(F.lit("06"), F.lpad(h("id", 12, 10**8).cast("string"), 8, "0"))).alias("phone"), null("id", 13, 40, F.date_add(F.lit("1950-01-01").cast("date"), h("id", 14, 18000).cast("int"))).alias("birth_date"), null("id", 15, 60, text("nick", i)).alias("nickname"),
    )
    return {"customers": (customers, "id"), "orders": (orders, "id"), "orderdetails": (lines, "id"), "payments": (payments, "id"), "user": (users, "id")}


def shop_dump(spark: SparkSession, megabytes: float, seed: int = 42) -> str:
    """The path of a synthetic dump of about that size: sizes at two scales give the scale by a straight line."""
    size = lambda scale: sum(df.agg(F.sum(F.length(F.concat_ws(",", *[_literal(df, c) for c in df.columns])) + 3)).first()[0] for df, _ in shop(spark, scale, seed).values())
    small, large = size(200), size(2000)
    scale = max(5, round(200 + (megabytes * 1e6 - small) * 1800 / (large - small)))
    return dump_of(spark, shop(spark, scale, seed), unique={"user": ("email",)})
