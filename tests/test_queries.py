"""Each registered query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from foldquery import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
#: One of each kind; the driver compares them all.
NAMES = [n for n in queries.SQL if not n.startswith(("search_", "enum_", "semi_", "list_", "roi_", "join_"))] + ["search_variable", "search_triple", "enum_helices_ext", "semi_join_up", "list_null_advance", "roi_emit"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rounded(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert rounded(got) == rounded(duck.sql(f"SELECT {quoted} FROM ({queries.SQL[name]})").fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
