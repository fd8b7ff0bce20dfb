import duckdb

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_every_person_is_held_against_the_sql(spark):
    name = "siren_siret_vat_linked_all"
    db = duckdb.connect()
    db.execute(f"create view customer as select * from '{SMALL}/customer.parquet'")
    want = sorted(db.execute(f"select id, siret_linked, vat_linked from ({entry.oracle_sql()[name]})").fetchall())
    got = sorted(tuple(r) for r in entry.queries()[name](spark, SMALL).select("id", "siret_linked", "vat_linked").collect())
    assert got == want and len(got) == spark.read.parquet(f"{SMALL}/customer.parquet").count()
    assert any(x[0] % 4 == 0 and x[1] and x[2] for x in got) and any(not x[1] for x in got)
