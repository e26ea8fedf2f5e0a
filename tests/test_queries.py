"""Every registered query of the reference's operators against its SQL."""

import duckdb
import pytest

from veilspan.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(frame):
    columns = sorted(frame.columns)
    return frame[columns].astype(str).sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    mine = plain(registry.QUERIES[name](spark, SF).toPandas())
    theirs = plain(duck.execute(registry.ORACLE[name]).df())
    assert list(mine.columns) == list(theirs.columns)
    assert mine.equals(theirs), mine.merge(theirs, how="outer", indicator=True).query("_merge != 'both'").head()


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
