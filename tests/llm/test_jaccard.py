import random
import re

from martloom.llm import jaccard
from martloom.llm.jaccard import jaccard_groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size, percent):
    sets = []
    for doc_id, text in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        k = min(size, len(words))
        sets.append((doc_id, {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if words else set()))
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, t in sets[i + 1:]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(d), find(e)
                root[max(x, y)] = min(x, y)
    return sorted((d, len(s), find(d)) for d, s in sets)


def test_against_every_pair(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for size, percent in ((3, 90), (5, 80), (1, 60)):
        got = sorted(map(tuple, jaccard_groups(docs, size, percent).collect()))
        assert got == brute(rows, size, percent)


def test_edges(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(5, None), (3, ""), (9, " \n"), (7, base), (2, base.upper()), (8, base + " x"), (1, "a"),
            (4, "A"), (6, "a b"), (None, base), (10, base + " x y")]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, n int, id int")
    known = [r for r in rows if r[0] is not None]
    assert sorted(map(tuple, jaccard_groups(docs, 3, 90).collect())) == brute(known, 3, 90)
    assert jaccard_groups(docs.limit(0), 3, 90).collect() == []


def near_copies(n):
    base = [f"b{i}" for i in range(80)]
    return [" ".join(base[:40] + [f"e{k}"] * (k % 2) + base[40:]) + " tail" * (k % 3) for k in range(n)]


def test_a_group_of_near_copies_is_not_expanded_into_pairs(spark, monkeypatch):
    """Candidates stay below two per representative, and no table holds whole sets."""
    texts = near_copies(120) + [" ".join(f"o{k}x{i}" for i in range(30)) for k in range(30)]
    rows = list(enumerate(texts, 3)) + [(5, texts[7]), (500, texts[1])]
    sizes, widths, keep = {}, {}, jaccard.stored

    def held(df, name):
        out = keep(df, name)
        sizes.setdefault(name, []).append(out.count())
        widths[name] = max([0] + [len(r[c]) for c in out.columns if c in ("tokens", "lead") for r in out.collect()])
        return out

    monkeypatch.setattr(jaccard, "stored", held)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_groups(docs, 3, 80).collect())) == brute(rows, 3, 80)
    assert sum(sizes["stars"]) + sizes["rest"][0] <= 2 * sizes["reps"][0]
    assert max(widths.values()) <= 3 + 82 // 5


def test_chance_words_make_no_candidates(spark, monkeypatch):
    """Texts that share a few shingles at random are not compared."""
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice("abcdefghijklmnop") for _ in range(60))) for k in range(150)]
    rows += [(k + 150, t.replace(" a", " z", 1)) for k, t in rows[:20]]
    pairs, keep = [], jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df, name: (pairs.append((name, df.count())), keep(df, name))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_groups(docs, 3, 85).collect())) == brute(rows, 3, 85)
    assert sum(n for name, n in pairs if name in ("stars", "rest")) <= 80


def test_slot_counts_are_bounded(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c"), (None, "z z z"), (4, None)], "doc_id long, text string")
    counts = jaccard.slot_counts(docs, 3)
    assert len(counts) <= 1 << 18 and counts.sum() == 3


def test_slot_counts_reach_the_driver_as_columns(spark, monkeypatch):
    """2^18 row objects would take some 50 MB of the driver for a moment."""
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d")], "doc_id long, text string")
    for name in ("toPandas", "collect"):
        monkeypatch.setattr(type(docs), name, lambda *a: (_ for _ in ()).throw(AssertionError("row objects")))
    counts = jaccard.slot_counts(docs, 3)
    assert counts.sum() == 5 and counts.max() == 2
