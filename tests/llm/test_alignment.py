import hashlib
from collections import Counter

import pytest
import public_tokenizers
from pyspark.sql import functions as F

from martloom.llm.alignment import _Runs, align, byte_alphabet, counted_pairs

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"


def brute(rows):
    """Plain Python: per-character decoding, ends by running sums, counts by a dictionary."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    inverse = byte_alphabet()

    def a_bytes(i):
        return bytes(inverse[c] for c in a.id_to_token(i))

    def b_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    per_doc = []
    for doc_id, text in rows:
        if not text:
            per_doc.append((doc_id, None))
            continue
        ia = a.encode(" " + text, add_special_tokens=False).ids
        ib = b.encode(text)
        whole = (" " + text).encode()
        if b"".join(map(a_bytes, ia)) != whole or b"".join(map(b_bytes, ib)) != whole:
            per_doc.append((doc_id, None))
            continue
        ends_a, ends_b, pos = [], [], 0
        for i in ia:
            pos += len(a_bytes(i))
            ends_a.append(pos)
        pos = 0
        for i in ib:
            pos += len(b_bytes(i))
            ends_b.append(pos)
        common = sorted(set(ends_a) & set(ends_b))
        groups, ja, jb = [], 0, 0
        for cut in common:
            ga, gb = [], []
            while ends_a[ja] <= cut:
                ga.append(ia[ja]); ja += 1
                if ja == len(ia):
                    break
            while ends_b[jb] <= cut:
                gb.append(ib[jb]); jb += 1
                if jb == len(ib):
                    break
            groups.append((ga, gb))
        per_doc.append((doc_id, (len(ia), len(ib), groups)))
    counts = Counter((g[0][-1], g[1][-1]) for _, d in per_doc if d for g in d[2])
    top = {}
    for (x, y), c in counts.items():
        top[y] = max(top.get(y, 0), c)
    out = []
    for doc_id, d in per_doc:
        if d is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        na, nb, groups = d
        links = [(g[0][-1], g[1][-1]) for g in groups]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((doc_id, na, nb, len(groups), len(links), sum(counts[p] == top[p[1]] for p in links),
                    sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in align(df, A, B, **kw).collect()), key=repr)


ROWS = [
    (1, "Hello world, hello world."), (1, "Hello world, hello world."), (2, None), (3, ""),
    (4, "  double  spaces\nand lines\t tabs"), (5, "<s> </s> <|endoftext|> [INST] special strings"),
    (6, "é ü ² ½ ① 漢字 emoji \U0001F600 mixed"), (None, "no id here"), (7, "word " * 3000),
    (8, "Hello world"),
]


def test_equals_brute_force(spark):
    assert got(spark, ROWS) == brute(ROWS)


def test_runs_spill_to_files_and_merge(spark, tmp_path):
    import numpy as np

    runs = _Runs(str(tmp_path), memory=1000)
    rng = np.random.default_rng(0)
    want = Counter()
    for _ in range(20):
        pair = rng.integers(0, 4, size=50) << 32 | rng.integers(0, 6, size=50)
        n = rng.integers(1, 5, size=50)
        for p, c in zip(pair.tolist(), n.tolist()):
            want[p] += c
        runs.add(pair.astype(np.int64), n.astype(np.int64))
    assert runs.files and runs.mem_runs
    out = list(counted_pairs(runs.merged()))
    assert {p: c for p, c, _ in out} == dict(want)
    for p, c, best in out:
        assert best == (c == max(v for q, v in want.items() if q >> 32 == p >> 32))
    assert not list(tmp_path.iterdir())


def test_small_run_memory_gives_the_same(spark):
    assert got(spark, ROWS, run_memory=16, buckets=3) == brute(ROWS)


def test_empty_and_extra_columns(spark):
    assert got(spark, []) == []
    df = spark.createDataFrame(ROWS[:3], SCHEMA)
    for name in ("_row", "pairs", "mult", "pair", "count", "best", "_salt", "n_a"):
        df = df.withColumn(name, F.lit(1))
    assert sorted((tuple(r) for r in align(df, A, B).collect()), key=repr) == brute(ROWS[:3])


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_against_brute_force(spark, sf):
    from martloom.llm.queries import QUERIES

    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = [tuple(r) for r in docs]
    out = QUERIES["op11_cross_tokenizer_counts"](spark, f"/root/testdata/{sf}").collect()
    assert sorted((tuple(r) for r in out), key=repr) == brute(rows)


def test_a_ids_equal_the_tokenizers_library():
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    from martloom.llm.alignment import token_bytes

    enc = token_bytes(A, B)[0]
    lib = Tokenizer.from_file(A)
    lib.encode_special_tokens = True
    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist() if t]
    texts += [r[1] for r in ROWS if r[1]]
    for t in texts:
        assert enc.encode_ordinary(" " + t) == lib.encode(" " + t, add_special_tokens=False).ids
