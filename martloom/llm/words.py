"""Words and word shingles of Arrow text columns, as numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers; another ``seed`` gives another order."""
    x = (x ^ np.uint64(seed)) * _MIX
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words between ASCII white space (dictionary encoded) and the number of each text's words.
    A null text has none. ``lower`` folds A-Z only."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(real)])
    words = flat.filter(pa.array(real))
    if lower:
        # ``ascii_lower`` misplaces texts of a sliced array, so it gets the newly built one.
        words = pc.ascii_lower(words)
    return words.dictionary_encode(), np.diff(before[ends])


def word_hashes(words: pa.DictionaryArray) -> np.ndarray:
    known = np.array([xxhash.xxh3_64_intdigest(w) for w in words.dictionary.to_pylist()], np.uint64)
    return known[words.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words; of all words where there are fewer."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = mixed(out + hashes[k:k + n], k + 1)
    return out


def text_batches(batches, column: str = "text", limit: int = 2 << 20):
    """The batches cut into runs of rows with about ``limit`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        groups = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
