"""Benchmark decontamination by a BM25 index of the test items with block-max skipping.

Items are indexed by their words (lower case letters and digits). A posting's impact is the BM25
weight of the word in the item, divided by the sum of the item's weights, so a passage that holds the
whole item scores 1. Items lie in blocks of eight; each word has the largest impact of each block.
Every passage of every text is a query. As in block-max WAND, a block is opened only when the sum of
its words' block maxima reaches the threshold; no item above the threshold can be in a skipped block.
This is done for many passages at once, so there is no pivot word: the block check stands in its
place.

Passages are twice as long as the longest item of the index shard with its allowed edits and overlap
by half, so any occurrence of an item lies whole in one. Retrieved items are verified on the passage,
by either of two rules:

* words: question and answer are each laid over their best place in the passage; the words changed,
  left out or put in (edit distance) are at most 20 % of the whole item's words, and at most half of
  each part's, or two words where the part is shorter than four. A changed word counts once, however
  short the part is.
* shingles: of the five-word shingles of the question and of the answer, each 80 % occur, in any order.

The answer is the last line of an item, or its last sentence if there is one line. An item's threshold
is ``least``, or the weight that is left when the heaviest words it may lose by the first rule are gone,
if that is smaller; so retrieval loses no item that verification by words would keep.

The index is cut into shards of about ``shard_words`` words, by hash of the item's text; each is small
enough to be broadcast, and the texts are read once for each. The number of shards grows with the
benchmark alone.

Defined results: null, empty or word-less texts and items are linked with nothing. Items without an item_id are
searched like all others and reported under a null item_id. Rows that share a doc_id or item_id (null too) are
taken together. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.llm.words import shingles, text_batches, word_hashes

_BLOCK = 8
_SHINGLE = 5
_K1, _B = 1.2, 0.75
_HIT = "doc_id long, text_hash long, item_id long, score double, question double, answer double"


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (letters and digits, lower case) and their number in each text."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.split_pattern_regex(texts, r"[^\pL\pN\pM]+")
    flat, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(real)])
    return word_hashes(flat.filter(pa.array(real)).dictionary_encode()), np.diff(before[ends])


def question_answer(text: str) -> tuple[str, str]:
    """The item before its last line, and that line; by sentences where there is one line."""
    text = text.strip()
    cut = max(text.rfind("\n"), text.rfind("\r"))
    if cut < 0:
        ends = [m.end() for m in re.finditer(r"[.?!]+(?=\s)", text)]
        cut = ends[-1] if ends else len(text)
    return text[:cut], text[cut:]


@dataclass
class Index:
    """One shard: sorted words; postings (item, impact) and block maxima (block, impact) by word."""

    items: list[int | None]
    words: np.ndarray
    post_at: np.ndarray
    post_item: np.ndarray
    post_impact: np.ndarray
    block_at: np.ndarray
    block: np.ndarray
    block_max: np.ndarray
    need: np.ndarray
    block_need: np.ndarray
    question: list[np.ndarray]
    answer: list[np.ndarray]
    window: int

    @classmethod
    def of(
        cls, ids: list[int | None], texts: list[str], df: dict[int, int], total: int, mean: float, least: float, share: float
    ) -> Index:
        hashes, counts = plain_words(pa.array(texts))
        item = np.repeat(np.arange(len(ids)), counts)
        words, code = np.unique(hashes, return_inverse=True)
        key, tf = np.unique(code * len(ids) + item, return_counts=True)
        code, item = key // len(ids), key % len(ids)
        seen = np.array([df[int(w)] for w in words.view(np.int64)], np.float64)
        idf = np.log1p((total - seen + 0.5) / (seen + 0.5))
        impact = idf[code] * tf * (_K1 + 1) / (tf + _K1 * (1 - _B + _B * counts[item] / mean))
        impact /= np.bincount(item, impact, len(ids))[item]
        edits = np.array([allowed(int(n), share) for n in counts], np.int64)
        # The heaviest words per occurrence go first, the last one in part: no edits take more weight.
        order = np.lexsort((-impact / tf, item))
        first = np.searchsorted(item[order], np.arange(len(ids)))
        before = np.cumsum(tf[order]) - tf[order]
        before -= before[first][item[order]]
        gone = np.clip((edits[item[order]] - before) / tf[order], 0, 1) * impact[order]
        need = np.minimum(least, 1 - np.bincount(item[order], gone, len(ids)))
        block_need = np.minimum.reduceat(need, np.arange(0, len(ids), _BLOCK))
        blocks = len(ids) // _BLOCK + 1
        pair, at = np.unique(code * blocks + item // _BLOCK, return_index=True)
        start = lambda c: np.searchsorted(c, np.arange(len(words) + 1))
        halves = [question_answer(t) for t in texts]
        parts = []
        for side in (0, 1):
            h, n = plain_words(pa.array([x[side] for x in halves], pa.string()))
            ends = np.cumsum(n)
            parts.append([h[e - k:e] for e, k in zip(ends, n)])
        return cls(
            ids, words, start(code), item, impact, start(pair // blocks), pair % blocks,
            np.maximum.reduceat(impact, at), need, np.resize(block_need, blocks), *parts,
            window=2 * max(int((counts + edits).max()), 16),
        )

    def retrieve(self, passage: np.ndarray, code: np.ndarray, n: int):
        """(passage, item, score) of all items that reach their threshold, for distinct (passage, word)."""
        blocks = len(self.items) // _BLOCK + 1
        owner, at = _spread(self.block_at, code)
        key = passage[owner] * blocks + self.block[at]
        bound = np.bincount(key, self.block_max[at], n * blocks)
        open_block = bound >= np.tile(self.block_need, n) - 1e-9
        owner, at = _spread(self.post_at, code)
        inside = open_block[passage[owner] * blocks + self.post_item[at] // _BLOCK]
        owner, at = owner[inside], at[inside]
        key, slot = np.unique(passage[owner] * len(self.items) + self.post_item[at], return_inverse=True)
        score = np.bincount(slot, self.post_impact[at], len(key))
        hit = score >= self.need[key % len(self.items)] - 1e-9
        return key[hit] // len(self.items), key[hit] % len(self.items), score[hit]


def _spread(starts: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each code, its own number once per entry, and the places of the entries."""
    sizes = starts[code + 1] - starts[code]
    owner = np.repeat(np.arange(len(code)), sizes)
    first = np.cumsum(sizes) - sizes
    return owner, np.arange(len(owner)) - first[owner] + starts[code][owner]


def _share(part: np.ndarray, passage: np.ndarray) -> float:
    """The share of a question's or answer's shingles in the passage; 1 for an empty part."""
    if not len(part):
        return 1.0
    size = min(_SHINGLE, len(part))
    if len(passage) < size:
        return 0.0
    return float(np.isin(np.unique(shingles(part, size)), shingles(passage, size)).mean())


def allowed(n: int, share: float) -> int:
    """The number of edits that leave at least ``share`` of ``n`` words."""
    return int((1 - share) * n + 1e-9)


def edits(part: np.ndarray, passage: list[int]) -> int:
    """The fewest words to change, leave out or put in so that ``part`` occurs in the passage: Myers'
    bit-parallel edit distance with free ends, one bit a word of the part."""
    if not len(part):
        return 0
    where: dict[int, int] = {}
    for k, w in enumerate(part.tolist()):
        where[w] = where.get(w, 0) | 1 << k
    full, top = (1 << len(part)) - 1, len(part) - 1
    up, down, now = full, 0, len(part)
    best = now
    for w in passage:
        same = where.get(w, 0)
        x = same | down
        across = (((same & up) + up) ^ up) | same
        plus, minus = down | (full & ~(across | up)), up & across
        now += (plus >> top & 1) - (minus >> top & 1)
        best = min(best, now)
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | (full & ~(x | plus)), plus & x
    return best


def verify(question: np.ndarray, answer: np.ndarray, window: np.ndarray, share: float) -> tuple[float, float] | None:
    """Shares of question and answer in the window by the rule that accepts the item, or None. By
    words, a part's share is that of its words without an edit."""
    q, a = _share(question, window), _share(answer, window)
    if min(q, a) >= share:
        return q, a
    n, room = len(question) + len(answer), allowed(len(question) + len(answer), share)
    if n - int(np.isin(question, window).sum()) - int(np.isin(answer, window).sum()) > room:
        return None
    words = window.tolist()
    lost = [edits(question, words), edits(answer, words)]
    if sum(lost) > room or any(k > max(2, len(p) // 2) for k, p in zip(lost, (question, answer))):
        return None
    q, a = (1 - k / len(p) if len(p) else 1.0 for k, p in zip(lost, (question, answer)))
    return q, a


def search(index: Index, hashes: np.ndarray, counts: np.ndarray, share: float):
    """(text number, item, score, question share, answer share) of each verified hit."""
    half = index.window // 2
    text = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    place = np.arange(len(hashes)) - begin[text]
    # Passage k of a text covers its half windows k and k + 1.
    halves = -(-counts // half)
    first = np.cumsum(halves) - halves
    spot = np.minimum(np.searchsorted(index.words, hashes), len(index.words) - 1)
    known = index.words[spot] == hashes
    own = (first[text] + place // half)[known]
    code = spot[known]
    before = own - 1
    valid = (place // half)[known] > 0
    owner = np.repeat(np.arange(len(counts)), halves)
    pairs = np.unique(np.concatenate([own, before[valid]]) * len(index.words) + np.concatenate([code, code[valid]]))
    passage, code = pairs // len(index.words), pairs % len(index.words)
    step = max(1, (1 << 21) // (len(index.items) // _BLOCK + 1))
    for low in range(0, int(halves.sum()), step):
        a, b = np.searchsorted(passage, [low, low + step])
        found = index.retrieve(passage[a:b] - low, code[a:b], step)
        for p, i, score in zip(*(x.tolist() for x in found)):
            t = int(owner[p + low])
            start = begin[t] + (p + low - first[t]) * half
            window = hashes[start:min(start + index.window, begin[t] + counts[t])]
            shares = verify(index.question[i], index.answer[i], window, share)
            if shares:
                yield t, index.items[i], score, *shares


def contaminated(
    docs: DataFrame, benchmark: DataFrame, least: float = 0.6, share: float = 0.8, shard_words: int = 1 << 20
) -> DataFrame:
    """Verified pairs: ``doc_id, text_hash, item_id, score`` (best of all passages) and the shares of
    question and answer by the rule that accepts them. ``text_hash`` is Spark's xxhash64 of the text."""
    spark = docs.sparkSession

    def item_words(batches):
        for batch in batches:
            hashes, counts = plain_words(batch.column("text"))
            yield pa.RecordBatch.from_arrays([
                batch.column("item_id"), pa.array(counts.astype(np.int64)),
                pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(hashes.view(np.int64))),
                batch.column("text"),
            ], ["item_id", "n", "words", "text"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(
        "text IS NOT NULL").distinct()
    items = items.mapInArrow(item_words, "item_id long, n long, words array<long>, text string").where("n > 0")
    total, words = items.agg(F.count("*"), F.sum("n")).first()
    if not total:
        return spark.createDataFrame([], _HIT)
    shards = 1 + words // shard_words
    items = items.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(shards)))
    seen = items.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").count()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    hits = []
    for shard in range(shards):
        mine = items.where(F.col("shard") == shard)
        here = mine.select("item_id", "text").sort("item_id", "text").collect()
        if not here:
            continue
        vocabulary = mine.select(F.explode("words").alias("word")).distinct()
        df = dict(map(tuple, seen.join(vocabulary, "word").toPandas().itertuples(index=False)))
        index = spark.sparkContext.broadcast(
            Index.of([r.item_id for r in here], [r.text for r in here], df, total, words / total, least, share))

        def scan(batches, index=index):
            for batch in text_batches(batches, limit=1 << 20):
                hashes, counts = plain_words(batch.column("text"))
                if not len(hashes):
                    continue
                found = list(search(index.value, hashes, counts, share))
                if found:
                    t, item, score, q, a = map(list, zip(*found))
                    yield pa.RecordBatch.from_arrays([
                        batch.column("doc_id").take(pa.array(t)), batch.column("text_hash").take(pa.array(t)),
                        pa.array(item, pa.int64()), pa.array(score), pa.array(q), pa.array(a),
                    ], ["doc_id", "text_hash", "item_id", "score", "question", "answer"])

        hits.append(rows.mapInArrow(scan, _HIT))
    every = hits[0]
    for more in hits[1:]:
        every = every.unionAll(more)
    return every.groupBy("doc_id", "text_hash", "item_id").agg(
        *[F.max(c).alias(c) for c in ("score", "question", "answer")])


def decontaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` whose text holds no test item."""
    bad = contaminated(docs, benchmark, **settings).select(F.col("text_hash").alias("_bad")).distinct()
    return docs.join(bad, F.xxhash64(docs["text"]) == bad["_bad"], "left_anti")
