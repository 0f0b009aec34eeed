import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from martloom.llm.token_files import EliasFano, read_tokens, write_tokens


def test_elias_fano_round_trip():
    draw = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 9), (50, 50), (3000, 10**9), (700, 3)):
        values = np.sort(draw.integers(0, top, n))
        packed = EliasFano.of(values).pack()
        got, end = EliasFano.unpack(packed, 0)
        assert end == len(packed) and got.all().tolist() == values.tolist()
        assert [got.select(i) for i in range(n)] == values.tolist()


def test_files_against_the_tokenizer(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(-5, None), (-4, ""), (-3, "  A\tb  "), (-2, "<|endoftext|> é日本 " * 3000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string")
    tokenizer, start, want = Tokenizer.from_file(path), 0, []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    write_tokens(docs, str(tmp_path / "a"), path)
    assert sorted(map(tuple, read_tokens(spark, str(tmp_path / "a"), ids="crc32").collect())) == want
    write_tokens(docs.limit(0), str(tmp_path / "b"), path)
    assert read_tokens(spark, str(tmp_path / "b")).collect() == []


def test_files_are_written_and_read_by_plain_tasks(spark, tmp_path, monkeypatch):
    """The data source would keep five Python processes beside the driver."""
    monkeypatch.setattr(type(spark.dataSource), "register", lambda *a: (_ for _ in ()).throw(AssertionError("data source")))
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(k, f"word {k}") for k in range(9)], "doc_id long, text string")
    write_tokens(docs, str(tmp_path / "a"), path, shards=3)
    got = sorted(map(tuple, read_tokens(spark, str(tmp_path / "a")).collect()))
    assert [r[0] for r in got] == list(range(9)) and [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist()


def test_stems_of_letters_are_merged_as_the_tokenizer_does():
    import random

    import pyarrow as pa

    from martloom.llm.token_files import Encoder

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, encoder = Tokenizer.from_file(path), Encoder(path, 2)
    library, learned = encoder._library, []
    encoder._library = lambda stems: learned.extend(stems) or library(stems)
    draw = random.Random(3)
    words = ["".join(draw.choices("etaonrishdlucéèàüßÿÀÞAE", k=draw.randint(1, 14))) + draw.choice(["", ".", ","]) for _ in range(4000)]
    words += ["a×b", "÷", "é.,", "ÿ.", "日本,", "e\u0301.", "İ.", "ǅ,", "don't", "aaaaaaaaaaaa.", "<|endoftext|>", "\xff\xfe"]
    for _ in range(2):
        ids, n = encoder.encode(pa.array([" ".join(words), *words]))
        want = [plain.encode(t, add_special_tokens=False).ids + [2] for t in [" ".join(words), *words]]
        assert ids.tolist() == [i for t in want for i in t] and n.tolist() == [len(t) for t in want]
    # Words of Latin-1 letters do not reach the library.
    assert len(learned) < 20
    small = Encoder(path, 2, kept=10)  # a store that is emptied again and again
    for k in range(0, 200, 20):
        text = " ".join(words[k:k + 20])
        assert small.encode(pa.array([text]))[0].tolist() == plain.encode(text, add_special_tokens=False).ids + [2]


def test_merges_that_ranks_cannot_state_are_refused():
    import json

    from martloom.llm.token_files import byte_merges

    model = json.loads(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).to_str())
    letters = [t for t in model["model"]["vocab"] if len(t.removesuffix("</w>")) == 1]

    def of(pairs):
        names = letters + [x + y for x, y in pairs]
        model["model"] |= {"vocab": {t: k for k, t in enumerate(names)}, "merges": pairs}
        model["added_tokens"] = []
        return byte_merges(Tokenizer.from_str(json.dumps(model)))

    assert of([["a", "b"], ["ab", "c</w>"]])[0][-1] == b"abc\xff"
    # "bc" is merged first, so the listed pair of "abc" never meets.
    assert of([["b", "c"], ["a", "b"], ["ab", "c"]]) is None
