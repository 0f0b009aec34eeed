import re

from pyspark.sql import functions as F
import zlib

from martloom.llm import langid, mixing


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(got[r.doc_id].held_out for r in held)
    right = [got[r.doc_id].lang_pred == r.lang for r in held if r.text and r.lang]
    assert sum(right) / len(right) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 3!", None), (4, "the the", "en"), (5, "die der", "de"),
            (6, "日本語" * 9000, None), (None, "the", "en"), (4, "the the", "en"), (8, "the", "en"), (7, "die", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(docs).collect()]
    assert len(got) == len(rows)
    assert {(1, "und"), (2, "und"), (3, "und")} <= set(got)
    assert langid.identify(docs.limit(0)).collect() == []
    assert {r.lang_pred for r in langid.identify(docs.where("lang is null")).collect()} == {"und"}


def test_numbers_of_every_kind_are_not_letters(spark):
    rows = [(1, "²", None), (2, "½ ¾", None), (3, "① Ⅷ ٣ 12", None), (4, "the the the", "en"), (5, "die die", "de"),
            (6, "x²", None)] + [(10 + i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de")
                               for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[6][0] != "und"
    letters = {r.doc_id for r in docs.where(langid.has_letters()(F.col("text"))).collect()}
    assert letters == {4, 5, 6} | set(range(10, 22))


def check_mix(rows, docs):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums = {}
    for _, text, source in rows:
        sums[source] = sums.get(source, 0) + size(text)
    names = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sums.values()), set()
    while True:
        left = total - sum(3 * sums[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * sums[s] if s in full else left * weight[s] / open_weight for s in names}
        above = {s for s in names if s not in full and target[s] > 3 * sums[s]}
        if not above:
            break
        full |= above
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    taken, largest = {}, {}
    for r in got:
        assert r._size == size(r.text) and r._source_size == sums[r.source]
        assert abs(r._target - target[r.source]) <= 1e-6 * max(1, total)
        assert 0 <= r._copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r._size * r._copies
        largest[r.source] = max(largest.get(r.source, 0), r._size)
    for s in names:
        assert abs(taken[s] - target[s]) <= largest[s]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(docs.repartition(3)).collect()))


def test_mix_of_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    check_mix([tuple(r) for r in docs.collect()], docs)


def test_mix_edges(spark):
    rows = [(1, None, "a"), (2, "x " * 500, "a"), (3, "y", "b"), (3, "y", "b"), (None, "q w", None), (4, "", "c"),
            (5, "one two three", "d"), (6, " ", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check_mix(rows, docs)
    assert mixing.mix(docs.limit(0)).collect() == []
    assert len(mixing.copied(docs).columns) == 3


def test_documents_without_labels_stay(spark):
    rows = [(1, "die der"), (2, "日本語"), (3, "12 3!"), (4, None), (None, "the"), (5, "")]
    docs = spark.createDataFrame([(d, t, None) for d, t in rows], "doc_id long, text string, lang string")
    assert sorted((r.doc_id or 0) for r in langid.recognised(docs).collect()) == [0, 1, 2]
    assert langid.recognised(docs.limit(0)).collect() == []


def test_mix_moves_no_text_it_does_not_return(spark, monkeypatch):
    held = []
    keep = mixing.stored
    monkeypatch.setattr(mixing, "stored", lambda df, name: held.append(df.columns) or keep(df, name))
    rows = [(k % 700, "w " * (k % 7), "ab"[k % 2]) for k in range(1500)] + [(None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    narrow = mixing.mix(docs, keep=["doc_id"])
    assert not any("text" in columns for columns in held)
    assert "text" not in narrow._jdf.queryExecution().executedPlan().toString()
    whole = mixing.mix(docs)
    assert sum("text" in columns for columns in held) == 1
    assert sorted(map(str, narrow.collect())) == sorted(map(str, whole.select(narrow.columns).collect()))


def test_sizes_of_many_documents_are_dealt_into_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_BUCKET", 16)
    rows = [(k, f"a{k} b", "x" if k % 3 else "y") for k in range(300)] + [(k, "c d e", None) for k in range(40)]
    check_mix(rows, spark.createDataFrame(rows, "doc_id long, text string, source string"))
