"""The corpus queries that have SQL, against what DuckDB gives."""

import math

import duckdb
import pytest

from tabloom.llm import queries

SF = "/root/testdata/sf0.01"


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(r[i] for i in order) for r in data), key=str)


def check(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'/*.parquet' if folder != SF else ''}')")
    df = queries.QUERIES[name](spark, folder)
    found = con.execute(queries.SQL[name])
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows([c[0] for c in found.description], found.fetchall())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    for g, w in zip(got[1], want[1]):
        assert all(math.isclose(a, b, rel_tol=1e-9) if isinstance(a, float) else a == b for a, b in zip(g, w)), (g, w)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query(spark, name):
    check(spark, SF, name)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_edges(spark, tmp_path, name):
    """Null and empty texts, blank lines, white space of all kinds, letters beyond ASCII, a null source, repeated texts."""
    words = "The cat sat on the mat and looked at nine more cats of the house next door".split()
    texts = [None, "", " \n\t ", " ".join(words), " ".join(words[:8]).upper(), "\n\n\nthe cat sat\n\nÉcole ünder 4\x0b5\n", "log 17 of user a b c d\nlog 18 of user a b c d", "log 9 of user a x c d\nÉcole ünder 5\x0b5",
             "\u00e9\u4e2d" * 70 + "\r\nx", "one two  three\tfour\x0cfive 6\nthe cat sat", " ".join(words * 40), "log 17 of user a b c d"]
    docs = [(i * 3 - 5, t, ("a", "b", None, "\u00e9")[i % 4]) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, " ".join(words[:12])), (2, "école"), (10, "the CAT sat"), (3, None), (4, "..."), (5, " ".join(words))]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    check(spark, str(tmp_path), name)
