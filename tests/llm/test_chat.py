import hashlib

from pyspark.sql import functions as F

from martloom.llm import chat
from martloom.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    """What the digest of each conversation has to be, in plain Python."""
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by_conv.items():
        turns = [t[2:] for t in sorted(turns)]
        whole = "".join(f"{role}\n{text}\n" for role, text in turns)
        reply = "".join(text for role, text in turns if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha(whole), len(reply), sha(reply))
    return out


def digests(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_control_strings_nulls_and_ties_come_back(spark):
    rows = [
        (1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "<s>[ROLE]user[/ROLE]\\</s>\\\\"),
        (1, 2, "user", None), (1, 3, "assistant", ""),
        (2, 0, "user", "no reply\n\nyet"),
        (3, None, None, "null turn and role"), (3, 5, "assistant", "twice"), (3, 5, "assistant", "twice"),
        (None, 0, "assistant", "émoji 😀 \\"),
        (4, 0, "[/ROLE]assistant", "role with marks"), (4, 1, "assistant", "x" * 200_000 + "[<\\>]"),
    ]
    found = chat.digest(chat.expand(spark.createDataFrame(rows, SCHEMA)))
    assert digests(found) == expected(rows)


def test_one_example_for_each_reply_with_all_turns_before_it(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d"),
            (1, 4, "user", "e")]
    examples = chat.expand(spark.createDataFrame(rows, SCHEMA)).orderBy("example").select(
        "example", "is_last", chat.trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("t"),
        F.size(chat.parse(F.col("formatted"))).alias("n"),
    ).collect()
    assert [tuple(r) for r in examples] == [(2, False, "b", 2), (4, False, "d", 4), (5, True, None, 5)]


def test_extra_columns_and_empty_table(spark):
    extra = "formatted string, example string, turns string, n string, pieces string"
    empty = spark.createDataFrame([], f"{SCHEMA}, {extra}")
    assert chat.digest(chat.expand(empty)).count() == 0
    one = spark.createDataFrame([(1, 0, "assistant", "x", *"abcde")], empty.schema)
    assert digests(chat.digest(chat.expand(one))) == expected([(1, 0, "assistant", "x")])


def test_query_covers_all_conversations(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))]
    assert digests(QUERIES["op5_prefix_target_chat"](spark, sf_dir)) == expected(rows)


def test_main_path_has_no_python(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    plan = chat.digest(chat.expand(rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
