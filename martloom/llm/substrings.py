"""Substring dedup: FM-indexes of shards, searched backward over wavelet matrices.

A window is ``size`` consecutive words. Its smallest hashed run of ``grain`` words (the leftmost of equal ones)
names the shard key, so equal windows meet under one key whatever surrounds them. Consecutive windows with
the same smallest run form one segment of less than ``2 * size`` words, and each window lies in one segment.

Segments are cut twice. First only places and content hashes are shuffled: keys that occur once are dropped, and
equal segments become one, the earliest; the words of the others are removed whole. Then the words of segments
that share a key with a different one are cut again from their texts. Segments of a key with more than ``heavy``
words left become single windows compared by two hashes; the rest are dealt by key into shards of about
``shard_words`` words. A shard's index is the Burrows-Wheeler transform of its segments in document order
(suffixes compared to the window's length, all that is asked for) as a wavelet matrix. Every segment is
streamed through: ``size`` backward steps give the interval of each window, and the smallest
position in the interval tells whether the window starts earlier.

Defined results: a null text has no words. Null doc_ids come last in the order. Rows equal in doc_id and text are
one document and get the same result; rows that share a doc_id alone are ordered by the hash of their text.
Empty tables give empty results. Words are equal when their 64-bit hashes are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.llm.places import SEGMENT, compared, matched, per_document, with_picks
from martloom.llm.shared import stored
from martloom.llm.words import mixed, shingles, split_words, text_batches, word_hashes


class WaveletMatrix:
    """Ranks of symbols below ``2^levels`` in a sequence; one bit vector a level with counts per 64."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.bits, self.before, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            bit = (symbols >> level & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(64 - self.n % 64, bool)]), bitorder="little")
            words = packed.view(np.uint64)
            self.bits.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
            self.zeros.append(int(self.n - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        # Where the range of each symbol begins at the last level, once a symbol instead of once a question.
        every = np.arange(int(symbols.max(initial=0)) + 1)
        self.begin = self._down(every, np.zeros_like(every))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.bits[level][word] & mask)

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            one = (symbol >> (self.levels - 1 - level) & 1).astype(bool)
            ones = self._ones(level, at)
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbol, at) - self.begin[symbol]


class FMIndex:
    """Index of ``text`` (whole numbers from 1; 0 parts segments) for patterns up to ``depth`` symbols."""

    def __init__(self, text: np.ndarray, depth: int):
        rank, width = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
        while width < depth:
            ahead = np.concatenate([rank[width:] + 1, np.zeros(min(width, len(rank)), np.int64)])[:len(rank)]
            rank = np.unique(rank * (len(text) + 2) + ahead, return_inverse=True)[1].astype(np.int64)
            width *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        self.tree = WaveletMatrix(text[self.suffixes - 1])
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text))])

    def intervals(self, text: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of the patterns ``text[at:at + size]``, by backward search. An interval of one suffix
        stays so: it is that of ``at`` itself, and the pattern is not searched further."""
        place = np.empty(len(self.suffixes), np.int64)
        place[self.suffixes] = np.arange(len(place))
        out_low, out_high = place[at], place[at] + 1
        open_, low, high = np.arange(len(at)), np.zeros(len(at), np.int64), np.full(len(at), len(self.suffixes), np.int64)
        for k in reversed(range(size)):
            c = text[at[open_] + k]
            low = self.first[c] + self.tree.rank(c, low)
            high = self.first[c] + self.tree.rank(c, high)
            several = high - low > 1
            if not several.all():
                open_, low, high = open_[several], low[several], high[several]
        out_low[open_], out_high[open_] = low, high
        return out_low, out_high

    def earliest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest text position in each interval; intervals are equal or apart."""
        starts, slot = np.unique(low, return_inverse=True)
        ends = np.zeros(len(starts), np.int64)
        ends[slot] = high
        bounds = np.stack([starts, ends], 1).ravel()
        padded = np.append(self.suffixes, len(self.suffixes))
        return np.minimum.reduceat(padded, bounds)[::2][slot] if len(bounds) else low


def segments(docs: DataFrame, size: int, grain: int) -> DataFrame:
    def cut(batches):
        for batch in text_batches(batches, limit=2 << 20):
            words, counts = split_words(batch.column("text"), lower=False)
            hashes = word_hashes(words)
            ends = np.cumsum(counts)
            keys, rows, starts, sizes, marks = [], [], [], [], []
            for row, (end, n) in enumerate(zip(ends, counts)):
                if n < size:
                    continue
                own = hashes[end - n:end]
                grains = mixed(shingles(own, grain), 11)
                spans = np.lib.stride_tricks.sliding_window_view(grains, size - grain + 1)
                place = spans.argmin(axis=1) + np.arange(len(spans))
                first = np.flatnonzero(np.diff(place, prepend=-1))
                last = np.append(first[1:], len(place)) + size - 1
                raw = memoryview(own).cast("B")
                keys.append(grains[place[first]].view(np.int64))
                rows.append(np.full(len(first), row))
                starts.append(first)
                sizes.append(last - first)
                marks += [xxhash.xxh3_64_intdigest(raw[8 * a:8 * b]) for a, b in zip(first.tolist(), last.tolist())]
            if keys:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(keys)), batch.column("doc_id").take(at), batch.column("text_hash").take(at),
                    pa.array(np.concatenate(starts).astype(np.int64)), pa.array(np.concatenate(sizes).astype(np.int32)),
                    pa.array(np.array(marks, np.uint64).view(np.int64)),
                ], ["key", "doc_id", "text_hash", "start", "n", "h"])

    return docs.mapInArrow(cut, SEGMENT)


def word_lists(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``key, doc_id, text_hash, start, words`` (their hashes) of the segments in ``places``, cut again from the texts."""
    def cut(batches):
        for batch in text_batches(batches, limit=2 << 20):
            words, counts = split_words(batch.column("text"), lower=False)
            hashes = word_hashes(words).view(np.int64)
            begins = np.cumsum(counts) - counts
            picks = [(row, p["key"], p["start"], hashes[begins[row] + p["start"]:][:p["n"]])
                     for row, found in enumerate(batch.column("picks").to_pylist()) for p in found]
            rows, keys, starts, lists = zip(*picks)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, pa.int64()), batch.column("doc_id").take(at), batch.column("text_hash").take(at),
                pa.array(starts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists))),
            ], ["key", "doc_id", "text_hash", "start", "words"])

    return with_picks(docs, places).mapInArrow(
        cut, "key long, doc_id long, text_hash long, start long, words array<long>")


def _order() -> F.Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "start")


def _later_windows(lists: DataFrame, size: int) -> DataFrame:
    """Spans of the windows in ``lists`` that start earlier elsewhere, compared by two 64-bit hashes."""
    def cut(batches):
        for batch in batches:
            for row, words in enumerate(batch.column("words")):
                own = words.values.to_numpy().view(np.uint64)
                w1, w2 = shingles(own, size), shingles(mixed(own, 29), size)
                at = pa.array([row] * len(w1))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(at), batch.column("text_hash").take(at),
                    pa.array(batch.column("start")[row].as_py() + np.arange(len(w1))),
                    pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)),
                ], ["doc_id", "text_hash", "start", "w1", "w2"])

    rows = stored(lists.mapInArrow(cut, "doc_id long, text_hash long, start long, w1 long, w2 long"), "windows")
    rows = rows.select("w1", "w2", _order().alias("here"))
    # Only windows with another place go on.
    best = rows.groupBy("w1", "w2").agg(F.min("here").alias("place"), F.max("here").alias("last")).where("place <> last")
    return rows.join(best, ["w1", "w2"]).where("here <> place").select(
        "here.doc_id", "here.text_hash", "here.start", (F.col("here.start") + size).alias("stop"))


def repeated_spans(docs: DataFrame, size: int, grain: int, shard_words: int, heavy: int) -> DataFrame:
    """``doc_id, text_hash, start, stop``: word ranges covered by windows that start earlier elsewhere."""
    marked = stored(compared(segments(docs, size, grain)).where("later OR first AND distinct > 1"), "places")
    copies = marked.where("later").select("doc_id", "text_hash", "start", (F.col("start") + F.col("n")).alias("stop"))
    several = marked.where("first AND distinct > 1")
    light, crowded = several.where(F.col("size") <= heavy), several.where(F.col("size") > heavy)
    if not crowded.isEmpty():
        copies = copies.unionAll(_later_windows(word_lists(docs, crowded), size))
    total = int(light.agg(F.sum("n")).first()[0] or 0)
    dealt = word_lists(docs, light).withColumn("shard", F.pmod("key", F.lit(1 + total // shard_words)))

    def look(frame: pd.DataFrame) -> pd.DataFrame:
        # Rows equal in doc_id and text bring the same segment.
        frame = frame.drop_duplicates(["none", "doc_id", "text_hash", "start"]).sort_values(
            ["none", "doc_id", "text_hash", "start"], kind="stable")
        lengths = frame["words"].map(len).to_numpy()
        flat = np.unique(np.concatenate(frame["words"].to_numpy()), return_inverse=True)[1] + 1
        ends = np.cumsum(lengths)
        text = np.insert(flat, ends, 0)
        index = FMIndex(text, size)
        begin = ends - lengths + np.arange(len(lengths))
        windows = lengths - size + 1
        row = np.repeat(np.arange(len(lengths)), windows)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = begin[row] + inside
        low, high = index.intervals(text, at, size)
        again = index.earliest(low, high) < at
        row, inside = row[again], inside[again]
        # Consecutive repeated windows of a segment are one span.
        head = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(inside, prepend=-9) != 1))
        tail = np.append(head[1:], len(row))[:len(head)] - 1
        start = frame["start"].to_numpy()[row[head]]
        return pd.DataFrame({
            "doc_id": frame["doc_id"].array[row[head]], "none": frame["none"].to_numpy()[row[head]],
            "text_hash": frame["text_hash"].to_numpy()[row[head]],
            "start": start + inside[head], "stop": start + inside[tail] + size,
        })

    # A null doc_id travels as 0 with a mark, as pandas would turn the column into floats.
    found = dealt.select(
        "shard", F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"),
        "text_hash", "start", "words",
    ).groupBy("shard").applyInPandas(look, "doc_id long, none boolean, text_hash long, start long, stop long")
    found = found.select(F.expr("if(none, null, doc_id)").alias("doc_id"), "text_hash", "start", "stop")
    return copies.unionAll(found)


def without_repeats(
    docs: DataFrame, size: int = 20, grain: int = 5, shard_words: int = 1 << 20, heavy: int = 1 << 18
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every row of ``docs``; ``kept`` is the remaining words joined
    by one space."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    spans = repeated_spans(rows, size, min(grain, size), shard_words, heavy)
    joined = matched(rows, per_document(spans), "left")

    def clean(batches):
        for batch in text_batches(batches, limit=2 << 20):
            words, counts = split_words(batch.column("text"), lower=False)
            begins = np.cumsum(counts) - counts
            edge = np.zeros(len(words) + 1, np.int64)
            for row, begin in enumerate(begins.tolist()):
                starts = batch.column("starts")[row].as_py()
                if starts:
                    np.add.at(edge, begin + np.array(starts), 1)
                    np.add.at(edge, begin + np.array(batch.column("stops")[row].as_py()), -1)
            keep = np.cumsum(edge)[:-1] == 0
            total = np.concatenate([[0], np.cumsum(keep)])
            offsets = total[np.append(begins, len(words))]
            lists = pa.ListArray.from_arrays(
                pa.array(offsets.astype(np.int32)), words.filter(pa.array(keep, pa.bool_())).dictionary_decode().cast(pa.string()))
            removed, kept = counts - np.diff(offsets), pc.binary_join(lists, " ")
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(removed, pa.int64()), kept,
            ], ["doc_id", "n_words", "n_removed", "kept"])

    return joined.select("doc_id", "text", "starts", "stops").mapInArrow(
        clean, "doc_id long, n_words long, n_removed long, kept string")
