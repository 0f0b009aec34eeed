from collections import Counter

import numpy as np

from martloom.llm.suffixes import repeated_suffixes, without_repeats


def brute(rows, size):
    datas = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i:i + size] for _, b in datas for i in range(len(b) - size + 1))
    out = []
    for d, b in datas:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if seen[b[i:i + size]] > 1:
                gone[i:i + size] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((d, len(b), int(gone.sum()), runs, kept))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect()), key=str)


def test_transform_finds_repeats():
    draw = np.random.default_rng(4)
    for size in (2, 4, 7):
        strings = [bytes(draw.integers(97, 99, draw.integers(1, 40)).tolist()) for _ in range(12)]
        seen = Counter(s[i:i + size] for s in strings for i in range(len(s) - size + 1))
        want = {(k, i) for k, s in enumerate(strings) for i in range(len(s) - size + 1) if seen[s[i:i + size]] > 1}
        assert set(zip(*(x.tolist() for x in repeated_suffixes(strings, size)))) == want


def test_against_every_window(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want = brute(rows, 400)
    assert any(r[2] for r in want)
    assert rows_of(without_repeats(docs)) == want
    assert rows_of(without_repeats(docs, size=60, grain=16, shard_bytes=20000, heavy=400)) == brute(rows, 60)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "abababababab"), (4, "xyzéü123"), (5, "_xyzéü12"), (None, "q" * 300), (6, "same one"),
            (6, "same one"), (7, "short")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    assert rows_of(without_repeats(docs, size=8, grain=3)) == brute(rows, 8)
    assert rows_of(without_repeats(docs, size=8, grain=3, heavy=0)) == brute(rows, 8)
    assert without_repeats(docs.limit(0)).collect() == []


def test_places_travel_before_bytes(spark, monkeypatch):
    from martloom.llm import suffixes

    draw = np.random.default_rng(8)
    text = lambda n: bytes(draw.integers(33, 126, n).tolist()).decode()
    shared = text(900)
    rows = [(d, text(3000) + (shared + text(5) if d < 3 else "")) for d in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names, held = [], []

    def keep(df, name, real=suffixes.stored):
        out = real(df, name)
        names.append(name)
        held.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(suffixes, "stored", keep)
    assert rows_of(without_repeats(docs)) == brute(rows, 400)
    # Segments that occur once and all bytes stay out of the stored table.
    assert names == ["places"] and "part" not in held[0][0] and 0 < held[0][1] < 60


def test_only_runs_that_can_repeat_are_transformed(monkeypatch):
    from martloom.llm import suffixes

    seen = []
    monkeypatch.setattr(suffixes, "repeated_suffixes", lambda s, n, real=repeated_suffixes: seen.append(s) or real(s, n))
    strings = [b"0123456789abc", b"x123456789abz", b"y3456789aQQQQ", b"ppppqrstuvwxy", b"1ppqrstuvw_34"]
    row, start, stop = suffixes.repeated_runs(strings, 6, np.array([1, 1, 1, 2, 2]))
    got = {(r, i) for r, a, b in zip(row.tolist(), start.tolist(), stop.tolist()) for i in range(a, b - 5)}
    count = Counter(s[i:i + 6] for s in strings for i in range(len(s) - 5))
    assert got == {(k, i) for k, s in enumerate(strings) for i in range(len(s) - 5) if count[s[i:i + 6]] > 1}
    # Equal runs go in as one, a key with one run not at all.
    assert seen == [[b"3456789a", b"123456789ab"]] or [sorted(x) for x in seen] == [[b"123456789ab", b"3456789a"]]
