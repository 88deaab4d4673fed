"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
CORE = sorted(n for n in entry.oracle_sql() if n.startswith("q"))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows(frame):
    def plain(v):
        return None if v is None or v != v else int(v) if isinstance(v, float) and v == int(v) else v

    return sorted((tuple(plain(v) for v in r) for r in frame), key=repr)


@pytest.mark.parametrize("name", CORE)
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in got.fetchall()]
    assert rows(df.select(*cols).collect()) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "new_text", "changed"]


@pytest.mark.parametrize("name", ["q32_pdf_glyph_names", "q34_pdf_gaps"])
def test_files_are_made_in_many_tasks(spark, name):
    """The table is one split, but a file a row is work for every core."""
    assert entry.queries()[name](spark, DATA).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
