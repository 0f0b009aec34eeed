"""Suffix-array dedup: column-wise construction of the Burrows-Wheeler transform of many strings.

A window is ``size`` consecutive bytes of one document. Its smallest hashed run of ``grain`` bytes (the
leftmost of equal ones) names the shard key, so equal windows meet under one key. Consecutive windows with the
same smallest run form one segment, shorter than ``2 * size`` bytes; each window lies in one segment.
Segments are cut twice. First only places and content hashes are shuffled: keys that occur once are dropped, and
equal segments become one after all their bytes are marked. Then the bytes of segments that share a key with a
different one are cut again from their texts.

The segments of a shard are the collection. Every round inserts one more symbol of each segment, from its
end: the place of the longer suffix follows from the rank of its first symbol in the transform so far, and
its common prefix with both neighbours from the minimum between equal symbols, plus one. There are fewer
than ``2 * size`` rounds whatever the documents' lengths. Transform and prefixes are rewritten in order each round; as a
shard has about ``shard_bytes`` bytes, they stay in the task's memory instead of external files.
A window is repeated when it shares ``size`` bytes with a neighbour in suffix order.

A key with more than ``heavy`` bytes of distinct segments is not dealt to a shard: its windows are compared by two
64-bit hashes, spread over all tasks, so no key gathers an unbounded group.

Defined results: a null text is empty. Rows that repeat are documents of their own. Null doc_ids are as any other.
Empty tables give empty results.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.llm.places import SEGMENT, compared, matched, per_document, with_picks
from martloom.llm.shared import stored
from martloom.llm.words import mixed, text_batches

_BLOCK = 32
_PLACE = ("doc_id", "text_hash", "start")


class Minima:
    """Minima of ranges of a sequence, many at once: block minima doubled, edges read directly."""

    def __init__(self, values: np.ndarray):
        self.values = values
        padded = np.append(values, np.full(-len(values) % _BLOCK, np.iinfo(values.dtype).max, values.dtype))
        self.levels = [padded.reshape(-1, _BLOCK).min(axis=1)]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            half = 1 << (len(self.levels) - 1)
            last = self.levels[-1]
            self.levels.append(np.minimum(last, np.append(last[half:], np.full(half, np.iinfo(last.dtype).max, last.dtype))[:len(last)]))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The minimum of places ``low`` to ``high``, both included."""
        step = np.arange(_BLOCK)
        out = np.minimum(
            self.values[np.minimum(low[:, None] + step, high[:, None])].min(axis=1),
            self.values[np.maximum(high[:, None] - step, low[:, None])].min(axis=1),
        )
        a, b = low // _BLOCK + 1, high // _BLOCK - 1
        for level in range(len(self.levels)):
            width = b - a + 1
            here = np.flatnonzero((width >= 1 << level) & (width < 2 << level))
            if len(here):
                table = self.levels[level]
                both = np.minimum(table[a[here]], table[b[here] - (1 << level) + 1])
                out[here] = np.minimum(out[here], both)
        return out


def repeated_suffixes(strings: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, place) of every ``size``-byte window that occurs more than once in the collection."""
    m = len(strings)
    lengths = np.array([len(s) for s in strings], np.int64)
    ends = np.cumsum(lengths)
    # Symbols by rank among those in use, so that most collections need one byte a symbol; 0 is the end mark.
    used, flat = np.unique(np.frombuffer(b"".join(strings), np.uint8), return_inverse=True)
    flat = flat.astype(np.int32) + 1
    symbols = np.uint8 if len(used) < 256 else np.uint16
    # Common prefix << 9 | symbol before, of the suffixes in order: minima of rows are minima of prefixes.
    # Round 0: the end marks, in the order of the strings. 0 stands before a whole string.
    rows = flat[ends - 1]
    at, owner = np.arange(m), np.arange(m)
    for done in range(1, int(lengths.max(initial=0)) + 1):
        n = len(rows)
        bwt = (rows & 511).astype(symbols)
        order = np.argsort(bwt, kind="stable")
        mine = np.zeros(n, bool)
        mine[at] = True
        # New places ascend with the order of (symbol, old place).
        spot = np.flatnonzero(mine[order])
        by_place = np.argsort(at)
        owner = owner[by_place][np.searchsorted(at[by_place], order[spot])]
        at = order[spot]
        place = spot + m - (n - np.count_nonzero(bwt))
        minima = Minima(rows)
        grown = np.zeros(n + len(at) + 1, np.int32)
        fresh = np.ones(n + len(at), bool)
        fresh[place] = False
        grown[:-1][fresh] = rows
        for side in (1, -1):
            near = spot + side
            inside = (near >= 0) & (near < n)
            inside[inside] = bwt[order[near[inside]]] == bwt[at[inside]]
            other, here = order[near[inside]], at[inside]
            low, high = np.minimum(other, here) + 1, np.maximum(other, here)
            target = place[inside] + (side == 1)
            grown[target] = (minima.of(low, high) >> 9) + 1 << 9 | grown[target] & 511
        left = lengths[owner] - done
        grown[place] |= np.where(left > 0, flat[np.maximum(ends[owner] - done - 1, 0)], 0).astype(np.int32)
        rows = grown[:-1]
        at, owner = place[left > 0], owner[left > 0]
    # Each string is walked from its end mark, the row of its number, to see which suffix a row is.
    n = len(rows)
    step = np.empty(n, np.int64)
    bwt = rows & 511
    step[np.argsort(bwt.astype(np.uint16), kind="stable")] = np.arange(n) + m - (n - np.count_nonzero(bwt))
    owner, length = np.arange(n), np.zeros(n, np.int64)
    at, who = np.arange(m), np.arange(m)
    for done in range(1, int(lengths.max(initial=0)) + 1):
        going = bwt[at] > 0
        at, who = step[at[going]], who[going]
        owner[at], length[at] = who, done
    long = np.append(rows >> 9 >= size, False)
    hit = np.flatnonzero((long[:-1] | long[1:]) & (length >= size))
    return owner[hit], lengths[owner[hit]] - length[hit]


def grain_hashes(data: np.ndarray, grain: int) -> np.ndarray:
    """The hash of each run of ``grain`` bytes, by doubling."""
    h, width = mixed(data.astype(np.uint64) + np.uint64(1), 3), 1
    while width * 2 <= grain:
        h = mixed(h[:-width] * np.uint64(0x9FB21C651E98DF25) + h[width:], width)
        width *= 2
    rest = grain - width
    return mixed(h[:-rest] * np.uint64(0x9FB21C651E98DF25) + h[rest:], 5) if rest else h


def smallest_places(hashes: np.ndarray, span: int) -> np.ndarray:
    """The place of the smallest of each ``span`` hashes (33 bits compared, leftmost first)."""
    low = (hashes & ~np.uint64((1 << 31) - 1)) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = span - width
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    return (low & np.uint64((1 << 31) - 1)).astype(np.int64)


def repeated_runs(strings: list[bytes], size: int, keys: np.ndarray, chunk: int = 1 << 17) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, stop) of the runs of repeated windows in the collection. Windows whose hash occurs once
    cannot repeat, so only runs of the others enter the transform, equal runs as one. Windows of different ``keys``
    are never equal: keys are transformed in chunks, those with short runs first, since a collection takes as many
    rounds as its longest run has bytes."""
    lengths = np.array([len(s) for s in strings], np.int64)
    ends = np.cumsum(lengths)
    flat = b"".join(strings)
    if len(flat) < size:
        return (np.zeros(0, np.int64),) * 3
    hashes = grain_hashes(np.frombuffer(flat, np.uint8), size)
    owner = np.repeat(np.arange(len(strings)), lengths)[:len(hashes)]
    inside = np.flatnonzero(np.arange(len(hashes)) + size <= ends[owner])
    _, slot, count = np.unique(hashes[inside], return_inverse=True, return_counts=True)
    at = inside[count[slot] > 1]
    head = np.flatnonzero((np.diff(at, prepend=-9) != 1) | (np.diff(owner[at], prepend=-1) != 0))
    begin, end = at[head], at[np.append(head[1:], len(at))[:len(head)] - 1] + size
    runs = [flat[a:b] for a, b in zip(begin.tolist(), end.tolist())]
    known = {}
    which = np.array([known.setdefault((key, run), len(known)) for key, run in zip(keys[owner[begin]].tolist(), runs)], np.int64)
    copies = np.bincount(which, minlength=len(known))
    longest, several = {}, Counter(key for key, _ in known)
    for key, run in known:
        longest[key] = max(longest.get(key, 0), len(run))
    # The windows of one run differ, as their key stands at another place in each: a key with one run is done.
    turn = sorted(((longest[key], key, k, run) for (key, run), k in known.items() if several[key] > 1), key=lambda x: x[:3])
    found_rows, found_places, part, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], 0
    for place, (_, key, k, run) in enumerate(turn):
        part.append((k, run))
        held += len(run)
        if place + 1 == len(turn) or held >= chunk and turn[place + 1][1] != key:
            row, at = repeated_suffixes([run for _, run in part], size)
            found_rows.append(np.array([k for k, _ in part], np.int64)[row])
            found_places.append(at)
            part, held = [], 0
    row, place = np.concatenate(found_rows), np.concatenate(found_places)
    order = np.lexsort((place, row))
    row, place = row[order], place[order]
    # Consecutive windows of a run are one span; a run that occurs twice is repeated as a whole.
    head = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(place, prepend=-9) != 1))
    last = place[np.append(head[1:], len(row))[:len(head)] - 1] + size
    row, first = row[head], place[head]
    once = copies[row] == 1
    whole = np.flatnonzero(copies > 1)
    row = np.concatenate([row[once], whole])
    first = np.concatenate([first[once], np.zeros_like(whole)])
    last = np.concatenate([last[once], np.array([len(run) for _, run in known], np.int64)[whole]])
    # Each span at every occurrence of its run.
    order = np.argsort(row, kind="stable")
    row, first, last = row[order], first[order], last[order]
    low, high = np.searchsorted(row, which), np.searchsorted(row, which, side="right")
    found = np.repeat(np.arange(len(which)), high - low)
    span = np.arange(len(found)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[found]
    string = owner[begin[found]]
    base = begin[found] - (ends - lengths)[string]
    return string, base + first[span], base + last[span]


def segments(docs: DataFrame, size: int, grain: int) -> DataFrame:
    def cut(batches):
        for batch in text_batches(batches, limit=2 << 20):
            keys, rows, starts, sizes, marks = [], [], [], [], []
            for row, text in enumerate(batch.column("text")):
                data = text.as_buffer()
                if data is None or data.size < size:
                    continue
                hashes = grain_hashes(np.frombuffer(data, np.uint8), grain)
                place = smallest_places(hashes, size - grain + 1)
                first = np.flatnonzero(np.diff(place, prepend=-1))
                last = np.append(first[1:], len(place)) + size - 1
                raw = memoryview(data)
                keys.append(hashes[place[first]].view(np.int64))
                rows.append(np.full(len(first), row))
                starts.append(first)
                sizes.append(last - first)
                marks += [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(first.tolist(), last.tolist())]
            if keys:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(keys)), batch.column("doc_id").take(at), batch.column("text_hash").take(at),
                    pa.array(np.concatenate(starts).astype(np.int64)), pa.array(np.concatenate(sizes).astype(np.int32)),
                    pa.array(np.array(marks, np.uint64).view(np.int64)),
                ], ["key", "doc_id", "text_hash", "start", "n", "h"])

    return docs.mapInArrow(cut, SEGMENT)


def parts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``key, doc_id, text_hash, start, part`` (the bytes) of the segments in ``places``, cut again from the texts."""
    def cut(batches):
        for batch in text_batches(batches, limit=2 << 20):
            for row, text in enumerate(batch.column("text")):
                raw = memoryview(text.as_buffer())
                picks = batch.column("picks")[row].as_py()
                at = pa.array([row] * len(picks))
                yield pa.RecordBatch.from_arrays([
                    pa.array([p["key"] for p in picks], pa.int64()), batch.column("doc_id").take(at),
                    batch.column("text_hash").take(at), pa.array([p["start"] for p in picks], pa.int64()),
                    pa.array([bytes(raw[p["start"]:p["start"] + p["n"]]) for p in picks], pa.binary()),
                ], ["key", "doc_id", "text_hash", "start", "part"])

    return with_picks(docs, places).mapInArrow(
        cut, "key long, doc_id long, text_hash long, start long, part binary")


def repeated_spans(docs: DataFrame, size: int, grain: int, shard_bytes: int, heavy: int) -> DataFrame:
    """``doc_id, text_hash, start, stop``: byte ranges covered by windows that start elsewhere too."""
    marked = stored(compared(segments(docs, size, grain)), "places")
    copies = marked.where("copied").select(*_PLACE, (F.col("start") + F.col("n")).alias("stop"))
    several = marked.where("first AND distinct > 1")
    light, crowded = several.where(F.col("size") <= heavy), several.where(F.col("size") > heavy)

    def windows(batches):
        for batch in batches:
            for row, part in enumerate(batch.column("part")):
                raw = memoryview(part.as_buffer())
                h = grain_hashes(np.frombuffer(raw, np.uint8), size)
                at = pa.array([row] * len(h))
                second = [xxhash.xxh3_64_intdigest(raw[i:i + size]) for i in range(len(h))]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(at), batch.column("text_hash").take(at),
                    pa.array(batch.column("start")[row].as_py() + np.arange(len(h))), pa.array(h.view(np.int64)),
                    pa.array(np.array(second, np.uint64).view(np.int64)),
                ], ["doc_id", "text_hash", "start", "w1", "w2"])

    if not crowded.isEmpty():
        single = stored(parts(docs, crowded).mapInArrow(
            windows, "doc_id long, text_hash long, start long, w1 long, w2 long"), "windows")
        twice = single.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2")
        copies = copies.unionAll(single.join(twice, ["w1", "w2"], "left_semi").select(
            *_PLACE, (F.col("start") + size).alias("stop")))
    total = int(light.agg(F.sum("n")).first()[0] or 0)
    dealt = parts(docs, light).select(
        F.pmod("key", F.lit(1 + total // shard_bytes)).alias("shard"), F.col("doc_id").isNull().alias("none"),
        F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "key", "text_hash", "start", "part")

    def look(frame: pd.DataFrame) -> pd.DataFrame:
        # Rows equal in doc_id and text bring the same segment; all of them are copies.
        frame = frame.drop_duplicates(["none", "doc_id", "text_hash", "start"])
        row, first, last = repeated_runs(frame["part"].tolist(), size, frame["key"].to_numpy())
        start = frame["start"].to_numpy()[row]
        return pd.DataFrame({
            "doc_id": frame["doc_id"].to_numpy()[row], "none": frame["none"].to_numpy()[row],
            "text_hash": frame["text_hash"].to_numpy()[row], "start": start + first, "stop": start + last,
        })

    found = dealt.groupBy("shard").applyInPandas(
        look, "doc_id long, none boolean, text_hash long, start long, stop long")
    found = found.select(F.expr("if(none, null, doc_id)").alias("doc_id"), "text_hash", "start", "stop")
    return copies.unionAll(found)


def without_repeats(
    docs: DataFrame, size: int = 400, grain: int = 64, shard_bytes: int = 1 << 18, heavy: int = 1 << 20
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes) of every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    spans = repeated_spans(rows, size, min(grain, size), shard_bytes, heavy)
    joined = matched(rows, per_document(spans), "left")

    def clean(batches):
        for batch in text_batches(batches, limit=2 << 20):
            texts = pc.fill_null(batch.column("text"), "")
            out = [[], [], [], []]
            for row, text in enumerate(texts):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                gone = np.zeros(len(data) + 1, bool)
                starts = batch.column("starts")[row].as_py()
                if starts:
                    edge = np.zeros(len(data) + 1, np.int64)
                    np.add.at(edge, np.array(starts), 1)
                    np.add.at(edge, np.array(batch.column("stops")[row].as_py()), -1)
                    gone = np.cumsum(edge) > 0
                out[0].append(len(data))
                out[1].append(int(gone.sum()))
                out[2].append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
                out[3].append(data[~gone[:len(data)]].tobytes())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.binary()),
            ], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.select("doc_id", "text", "starts", "stops").mapInArrow(
        clean, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
