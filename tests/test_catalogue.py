"""Every registered query runs, and where it has SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

from tabloom.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


#: Slow ones without SQL, whose operators tests/test_detection.py covers on smaller frames.
SLOW = {"dim_tsne", "dim_umap", "undersample_iht", "outliers_isolation_forest", "outliers_one_class_svm"}


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in SLOW])
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    data = [tuple(r) for r in df.collect()]
    if name in catalogue.SQL:
        got = duck.execute(catalogue.SQL[name])
        want = rows([c[0] for c in got.description], got.fetchall())
        assert rows(df.columns, data) == want
    else:
        assert data
