import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["anonymize_people", "report_counters", "content_ratios", "dump_anonymize", "stream_anonymize"])
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got = entry.queries()[name](spark, SMALL)
    want = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    rows = lambda some: sorted(tuple(map(str, r)) for r in some)
    assert set(names) == set(got.columns)
    assert rows(got.select(*[f"`{c}`" for c in names]).collect()) == rows(want.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
