import duckdb
import pytest
from pyspark.sql import functions as F

from martloom.llm.hostrules import judge
from martloom.llm.hostrules_sql import host_rules_statement

COLS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
SCHEMA = "doc_id long, text string, source string"


def oracle(rows, **kw):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return sorted(con.sql(host_rules_statement(**kw)).fetchall(), key=repr)


def got(spark, rows, **kw):
    out = judge(spark.createDataFrame(rows, SCHEMA), **kw).select(*COLS).collect()
    return sorted((tuple(r) for r in out), key=repr)


def brute_repeat(text):
    ws = text.split() if text else []
    wins = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    marked = set()
    for i, w in enumerate(wins):
        if wins.count(w) >= 2:
            marked.update((i, i + 1, i + 2))
    return len(marked)


def test_base_rules_by_hand(spark):
    text = "a b c a b c x\n\n  \nline one\nline one\n a b\t# $ <>"
    (row,) = got(spark, [(1, text, "h")])
    assert row[1] == len(text.split())
    assert row[2] == sum(len(w) for w in text.split())
    assert row[3] == 4
    assert row[4] == 1
    assert row[5] == brute_repeat(text) == 6


def test_repeats_against_brute_force(spark):
    import random

    rnd = random.Random(3)
    rows = []
    for i in range(40):
        ws = [rnd.choice("ab") for _ in range(rnd.randint(0, 30))]
        rows.append((i, " ".join(ws), "h"))
    by_id = {r[0]: r for r in got(spark, rows)}
    for i, text, _ in rows:
        assert by_id[i][5] == brute_repeat(text)


def test_hosts_nulls_repeats_long_texts_equal_sql(spark):
    clean = " ".join(f"w{i}" for i in range(80))
    junk = "spam spam spam " * 30
    rows = [(1, clean, "good"), (1, clean, "good"), (2, None, "good"), (3, "", None), (None, clean, None),
            (4, junk, "bad"), (5, junk, "bad"), (6, junk, "bad"), (7, clean, "bad"), (8, "x " * 200000, "long"),
            (9, clean + "\n" + clean + "\n" + clean, "good"), (10, "é ü ² ½ " * 20, "good")]
    rows += [(20 + i, " ".join(f"v{i}x{j}" for j in range(60)), "good") for i in range(6)]
    want = oracle(rows)
    assert got(spark, rows) == want
    by = {r[0]: r for r in want}
    assert by[7][-1] is False and by[7][-2] is False  # clean text of a rejected host
    assert by[1][-1] is True


def test_single_host_and_empty(spark):
    rows = [(1, "one two three " * 20, "h"), (2, "x", "h")]
    assert got(spark, rows) == oracle(rows)
    assert got(spark, []) == []


def test_extra_clashing_columns(spark):
    rows = [(1, "a b c " * 30, "h"), (2, "q", "h")]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("host", "_words", "_text", "n_words", "kept", "_salt"):
        df = df.withColumn(name, F.lit(1))
    out = sorted(tuple(r) for r in judge(df).select(*COLS).collect())
    assert out == oracle(rows)


def test_no_python_in_plan(spark):
    df = judge(spark.createDataFrame([(1, "a b c", "h")], SCHEMA))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan and "BatchEval" not in plan


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    from martloom.llm.queries import ORACLES, QUERIES

    got_rows = sorted(tuple(r) for r in QUERIES["op12_host_quality_rules"](spark, f"/root/testdata/{sf}").collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    want = sorted(tuple(r) for r in con.sql(ORACLES["op12_host_quality_rules"]).fetchall())
    assert got_rows == want
