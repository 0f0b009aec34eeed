import re

import pyarrow as pa
import pytest

from martloom.llm.decontam import plain_words
from martloom.llm.token_files import Encoder
from martloom.llm.words import split_words, text_batches, word_hashes

TEXTS = ["ÀÉ A b\x85C", None, "", " \t\n", "Straße ΑΒΓ 日本語 Ünï " * 40, "x" * 5000, "a\x1cB\x0bC", "ß À " * 300] * 9


def cut(limit):
    """The texts in batches that are slices of one array."""
    whole = pa.RecordBatch.from_pydict({"text": pa.array(TEXTS, pa.string())})
    return list(text_batches([whole], limit=limit))


@pytest.mark.parametrize("lower", [True, False])
@pytest.mark.parametrize("limit", [1, 3000, 1 << 20])
def test_words_of_sliced_batches(lower, limit):
    found, sizes = [], []
    for batch in cut(limit):
        words, counts = split_words(batch.column("text"), lower)
        words.validate(full=True)
        assert len(word_hashes(words)) == len(words)
        found += words.dictionary_decode().to_pylist()
        sizes += counts.tolist()
    fold = lambda w: re.sub("[A-Z]", lambda m: m[0].lower(), w) if lower else w
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in TEXTS]
    assert sizes == [len(w) for w in want]
    assert found == [fold(w) for ws in want for w in ws]


@pytest.mark.parametrize("limit", [1, 3000])
def test_plain_words_and_ids_of_sliced_batches(limit):
    import public_tokenizers

    encoder = Encoder(public_tokenizers.path("word_bpe_49k.json"), 2)
    for read in (plain_words, encoder.encode):
        whole, counts = read(pa.array(TEXTS))
        parts = [read(b.column("text")) for b in cut(limit)]
        assert [x for p, _ in parts for x in p.tolist()] == whole.tolist()
        assert [n for _, c in parts for n in c.tolist()] == counts.tolist()


def test_folded_pieces_have_the_tokenizers_ids_and_the_vocabulary_is_read_once():
    import public_tokenizers
    from tokenizers import Tokenizer

    from martloom.llm.token_files import encoder_of

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["A.", "B,,", "ẖ H̱ Ä.", "<|ENDOFTEXT|> <|endoftext|>.", "don't DON'T. it's,", ". , .,", "a1. 12, É. x Y.",
             None, "", "  Q.  ", "K. ſ İ.", "\x00. a\x00,"]
    plain = Tokenizer.from_file(path)
    want = [plain.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    encoder = encoder_of(path, 2)
    for _ in range(2):
        ids, n = encoder.encode(pa.array(texts))
        assert ids.tolist() == [i for t in want for i in t] and n.tolist() == [len(t) for t in want]
    assert encoder_of(path, 2) is encoder
    # Case and a closing mark make no new entry.
    before = len(encoder.known)
    encoder.encode(pa.array(["x. X, X x, X."]))
    assert len(encoder.known) == before


def test_text_batches_hold_two_megabytes():
    texts = pa.array(["x" * 100_000] * 60 + [None, "y" * 5_000_000])
    sizes = [sum(len(t or "") for t in b.column("text").to_pylist())
             for b in text_batches([pa.RecordBatch.from_arrays([texts], ["text"])])]
    assert sum(sizes) == 11_000_000 and max(sizes[:-1]) <= (2 << 20) + 100_000
