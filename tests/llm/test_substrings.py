import re

import numpy as np

from martloom.llm.substrings import FMIndex, without_repeats


def brute(rows, size):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(words) - size + 1):
            w = tuple(words[i:i + size])
            if w in seen:
                gone.update(range(i, i + size))
            seen.add(w)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), kept))
    return out


def test_against_every_window(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()], 20)
    assert any(r[2] for r in want)
    assert sorted(map(tuple, without_repeats(docs).collect())) == want
    assert sorted(map(tuple, without_repeats(docs, shard_words=5000, heavy=60).collect())) == want


def test_edges(spark):
    loop = "a b a b a b a b a"
    rows = [(1, None), (2, ""), (3, loop), (4, "x " + loop + " y"), (5, "c d e"), (6, "c d e f"), (7, "q " * 3000), (8, "c d")]
    docs = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, key string")
    for size in (3, 4):
        assert sorted(map(tuple, without_repeats(docs, size=size, grain=2).collect())) == brute(rows, size)
    assert without_repeats(docs.limit(0)).collect() == []
    same = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_removed) for r in without_repeats(same, size=3, grain=2).collect()), key=str)
    assert got == [(1, 0), (1, 0), (None, 3)]


def test_index_counts():
    text = np.append(np.random.default_rng(2).integers(1, 4, 200), 0)
    index = FMIndex(text, 4)
    at = np.arange(197)
    low, high = index.intervals(text, at, 4)
    runs = [tuple(text[i:i + 4]) for i in at]
    assert [runs.index(r) for r in runs] == index.earliest(low, high).tolist()
    assert [runs.count(r) for r in runs] == (high - low).tolist()


def test_places_travel_before_words(spark, monkeypatch):
    from martloom.llm import substrings

    draw = np.random.default_rng(8)
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(d, " ".join(f"w{x}" for x in draw.integers(0, 10**9, 300)) + (f" {shared} e{d}" if d < 3 else "")) for d in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names, held = [], []

    def keep(df, name, real=substrings.stored):
        out = real(df, name)
        names.append(name)
        held.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(substrings, "stored", keep)
    assert sorted(map(tuple, without_repeats(docs).collect())) == brute(rows, 20)
    # About 30 segments of each text occur once; neither they nor any words are stored.
    assert names == ["places"] and "words" not in held[0][0] and 0 < held[0][1] < 60


def test_equal_rows_and_crowded_keys(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "x b c d e f y"), (3, "b c d e"), (None, "z c d e f g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [("1", 0), ("1", 0), ("2", 5), ("3", 4), ("None", 5)]
    for heavy in (0, 1 << 18):
        got = without_repeats(docs, size=3, grain=2, heavy=heavy).collect()
        assert sorted((str(r.doc_id), r.n_removed) for r in got) == want
