import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from martloom.llm.codebook_sql import codebook_statement
from martloom.llm.codebooks import code_table, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_nearest(x, book):
    d = ((x[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


def test_nearest_equals_brute_force_with_ties():
    rng = np.random.default_rng(5)
    for k, m in ((1, 1), (2, 3), (8, 16), (4, 16)):
        book = rng.integers(-3, 4, size=(m, k))
        book[m // 2] = book[0]  # equal entries: the lower index wins
        x = rng.integers(-5, 6, size=(400, k))
        got_i, got_d = nearest(x.astype(np.int64), book.astype(np.int64))
        want_i, want_d = brute_nearest(x, book)
        assert (got_d == want_d).all()
        assert (got_i == want_i).all()


def oracle(rows, **kw):
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    if rows:
        con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    return sorted(con.sql(codebook_statement(**kw)).fetchall(), key=repr)


def spark_rows(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    got = code_table(df, **kw).collect()
    return sorted((tuple(r) for r in got), key=repr)


def test_equals_sql_with_nulls_ties_and_repeats(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        v = (rng.normal(size=16) * 0.3).astype(np.float32).tolist()
        rows.append((i % 50, v, int(i % 3) if i % 7 else None))
    rows += [(70, None, 1), (71, [1.0] * 15 + [None], 1), (72, [float("nan")] * 16, 2),
             (73, [float("inf")] + [0.0] * 15, 2), (None, [0.5] * 16, 1), (None, [-0.25] * 16, None),
             (74, [0.0] * 8, 1), (75, [], 1)]
    assert spark_rows(spark, rows) == oracle(rows)


def test_fewer_rows_than_entries_and_extra_columns(spark):
    rows = [(3, [0.1, -0.2, 0.3, 0.4, 0.5, 0.6, -0.7, 0.8], 1), (1, [0.0] * 8, None), (1, [0.0] * 8, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("q", F.lit(1)).withColumn("_label", F.lit("x"))
    got = sorted(tuple(r) for r in code_table(df).collect())
    want = sorted(tuple(r) for r in oracle(rows))
    assert got == want
    assert all(len(r[1]) == 16 for r in got)


def test_empty_table(spark):
    assert code_table(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    from martloom.llm.queries import ORACLES, QUERIES

    got = sorted(tuple(r) for r in QUERIES["op13_equal_average_codes"](spark, f"/root/testdata/{sf}").collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
    want = sorted(tuple(r) for r in con.sql(ORACLES["op13_equal_average_codes"]).fetchall())
    assert got == want
    assert math.isfinite(sum(r[2] for r in got))
