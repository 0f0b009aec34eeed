"""Cross-tokenizer alignment with pair counts taken by external spill counting.

Each text is encoded by two tokenizers: A (a byte-level BPE over ``" " + text``) and B (a
sentencepiece model, which adds the leading space itself). Every token stands for bytes: A's entry
mapped back through the byte-level alphabet, B's piece in UTF-8 with U+2581 as a space and ``<0xHH>``
as byte HH. Where the joined bytes of both sides equal ``" " + text``, byte offsets at which an A and
a B token both end cut the text into groups; the last A and the last B token of each group end
together and form a link. A pair of ids is counted over all links of the corpus; a link is *best*
when its pair's count is the highest of its B id (ties included).

Counting follows the external method on Spark: every task of the tokenising pass already reduces its
links to distinct pairs with counts (so a pair that fills a third of the corpus is one record a
task). Those pair records are radix-partitioned by B id; a task of the counting pass sorts each
incoming batch into a run, compresses it with zstd and keeps it in memory up to ``run_memory`` bytes,
beyond which runs are written to the shared folder. A k-way heap merge of the runs adds up each pair;
since runs are ordered B id first, all pairs of one B id come out together, and the highest count of a
B id is known as soon as its last pair has passed (at most one vocabulary of A ids is held). The counts
then stream back to the documents' links by a size-checked join on the pair.

A is encoded by tiktoken over the ranks of A's own vocabulary file (the ids are those of the
tokenizers library; a test holds them equal), B by sentencepiece, both one thread a task, in slices of
about ``text_budget`` characters.

Defined results: texts that are null, empty, or whose joined A or B bytes differ from ``" " + text``
have no tokens: all counts are 0 and ``groups_sha256`` is ``''``. Repeated rows are aligned and
counted once each. Null doc_ids are kept. Extra columns are ignored. An empty table gives an empty
result. Tokenizers are files given by path and loaded once per Python worker.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.llm.shared import file_system, scratch, sized_join, stored

_LOADED: dict[tuple[str, str], tuple] = {}


def byte_alphabet() -> dict[str, int]:
    """Character of the byte-level alphabet -> byte. The printable bytes 0x21-0x7E,
    0xA1-0xAC and 0xAE-0xFF stand for themselves; every other byte b, in increasing order, is the
    character 256 + n, its rank n among those other bytes."""
    kept = list(range(0x21, 0x7F)) + list(range(0xA1, 0xAD)) + list(range(0xAE, 0x100))
    chars = {b: chr(b) for b in kept}
    n = 0
    for b in range(256):
        if b not in chars:
            chars[b] = chr(256 + n)
            n += 1
    return {c: b for b, c in chars.items()}


def token_bytes(a_path: str, b_path: str, pattern: str | None = None):
    """``(A encoder, B processor, A bytes by id, B bytes by id, A lengths, B lengths)``, once per
    Python worker.

    A's vocabulary is read from its tokenizers file: every entry is mapped back through the
    byte-level alphabet, and the entry's id is its merge rank. Texts are encoded with tiktoken over
    those ranks and the file's pre-tokenizer pattern (``pattern``, by default the one of the
    public byte-level vocabularies), which gives the same ids as the tokenizers library at about a
    quarter of its CPU time (a test holds the two equal)."""
    key = (a_path, b_path, pattern)
    if key not in _LOADED:
        import json

        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        vocab = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        a_bytes = [b""] * (max(vocab.values()) + 1)
        ranks = {}
        for piece, i in vocab.items():
            if piece in special or not all(c in alphabet for c in piece):
                a_bytes[i] = piece.encode()
                continue
            a_bytes[i] = bytes(alphabet[c] for c in piece)
            ranks[a_bytes[i]] = i
        a = tiktoken.Encoding("a", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks,
                              special_tokens={})
        b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        b_bytes = []
        for i in range(b.get_piece_size()):
            piece = b.id_to_piece(i)
            if b.is_byte(i):
                b_bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                b_bytes.append(piece.replace("▁", " ").encode())
        _LOADED[key] = (a, b, a_bytes, b_bytes,
                        np.array([len(x) for x in a_bytes], dtype=np.int64),
                        np.array([len(x) for x in b_bytes], dtype=np.int64))
    return _LOADED[key]


_DECIMALS: list[np.ndarray] = []


def _decimals(n: int) -> np.ndarray:
    """Decimal strings of 0 .. n-1 as an object array, built once per Python worker."""
    if not _DECIMALS or len(_DECIMALS[0]) < n:
        _DECIMALS[:] = [np.array([str(i) for i in range(n)], dtype=object)]
    return _DECIMALS[0]


def align_text(text, a_ids, b_ids, a_bytes, b_bytes, a_len, b_len):
    """``(groups text, last A id of each group, last B id of each group)`` of one text, or None
    when it has no tokens. The groups text is ``a1,a2|b1;a3|b2,b3``: decimal ids in order, A and B
    of a group split by ``|``, groups by ``;``."""
    if not text:
        return None
    whole = (" " + text).encode()
    if (b"".join(map(a_bytes.__getitem__, a_ids)) != whole
            or b"".join(map(b_bytes.__getitem__, b_ids)) != whole):
        return None
    a = np.asarray(a_ids, dtype=np.int64)
    b = np.asarray(b_ids, dtype=np.int64)
    a_end = np.cumsum(a_len[a])
    b_end = np.cumsum(b_len[b])
    cuts = np.intersect1d(a_end, b_end, assume_unique=True)
    a_last = np.searchsorted(a_end, cuts)          # place of each group's last A token
    b_last = np.searchsorted(b_end, cuts)
    a_group = np.searchsorted(cuts, a_end)         # group of every token
    b_group = np.searchsorted(cuts, b_end)
    # In the text, a group's A tokens come first, then its B tokens: a token's place is its own
    # place plus the tokens of the other side in the groups before (A) or up to its own (B).
    b_before = np.r_[0, b_last + 1][:-1]
    places_a = np.arange(len(a)) + b_before[a_group]
    places_b = np.arange(len(b)) + (a_last + 1)[b_group]
    words = np.empty(len(a) + len(b), dtype=object)
    seps = np.full(len(a) + len(b), ",", dtype=object)
    words[places_a] = _decimals(len(a_len))[a]
    words[places_b] = _decimals(len(b_len))[b]
    seps[places_a[a_last]] = "|"
    seps[places_b[b_last]] = ";"
    seps[-1] = ""
    joined = np.empty(2 * len(words), dtype=object)
    joined[0::2], joined[1::2] = words, seps
    return "".join(joined.tolist()), a[a_last], b[b_last]


def _slices(texts: list[str], budget: int):
    """Consecutive index ranges of ``texts`` holding about ``budget`` characters each (a longer
    text is a slice of its own), so that a tokenizer never holds more than that at once."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > budget:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def _tokenise(a_path: str, b_path: str, budget: int):
    def run(batches):
        a, b, a_bytes, b_bytes, a_len, b_len = token_bytes(a_path, b_path)
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            for lo, hi in _slices(texts, budget):
                part = texts[lo:hi]
                a_ids = [a.encode_ordinary(" " + t) for t in part]
                b_ids = b.encode(part, num_threads=1)
                cols = {k: [] for k in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "mult")}
                for t, ea, eb in zip(part, a_ids, b_ids):
                    found = align_text(t, ea, eb, a_bytes, b_bytes, a_len, b_len)
                    if found is None:
                        for k, v in (("n_a", 0), ("n_b", 0), ("n_groups", 0), ("n_links", 0), ("groups_sha256", "")):
                            cols[k].append(v)
                        cols["pairs"].append(np.zeros(0, dtype=np.int64))
                        cols["mult"].append(np.zeros(0, dtype=np.int64))
                        continue
                    groups, last_a, last_b = found
                    pairs, mult = np.unique((last_b << 32) | last_a, return_counts=True)
                    cols["n_a"].append(len(ea))
                    cols["n_b"].append(len(eb))
                    cols["n_groups"].append(len(last_a))
                    cols["n_links"].append(len(last_a))
                    cols["groups_sha256"].append(hashlib.sha256(groups.encode()).hexdigest())
                    cols["pairs"].append(pairs)
                    cols["mult"].append(mult.astype(np.int64))
                yield pd.DataFrame({"_row": pdf["_row"].iloc[lo:hi].to_numpy(),
                                    "doc_id": pdf["doc_id"].iloc[lo:hi].to_numpy(), **cols})
    return run


def _local_counts(batches):
    """Distinct pairs of a task's links with their counts, merged batch by batch: the map side of
    the count, bounded by the distinct pairs of a task."""
    held_k, held_c = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for pdf in batches:
        if not len(pdf):
            continue
        k = np.concatenate([held_k] + [np.asarray(p, dtype=np.int64) for p in pdf["pairs"]])
        c = np.concatenate([held_c] + [np.asarray(m, dtype=np.int64) for m in pdf["mult"]])
        held_k, inverse = np.unique(k, return_inverse=True)
        held_c = np.bincount(inverse, weights=c, minlength=len(held_k)).astype(np.int64)
    if len(held_k):
        yield pd.DataFrame({"pair": held_k, "n": held_c})


class _Runs:
    """Sorted runs of (pair, count) as zstd frames, in memory up to a bound, then in the shared folder."""

    def __init__(self, folder: str, memory: int):
        self.folder, self.memory, self.held, self.mem_runs, self.files = folder, memory, 0, [], []

    def add(self, pair: np.ndarray, n: np.ndarray) -> None:
        import zstandard

        order = np.argsort(pair, kind="stable")
        record = np.empty((len(pair), 2), dtype=np.int64)
        record[:, 0], record[:, 1] = pair[order], n[order]
        frame = zstandard.ZstdCompressor(level=1).compress(record.tobytes())
        if self.held + len(frame) > self.memory:
            fs, base = file_system(self.folder)
            path = f"{base}/run-{uuid.uuid4().hex}.zst"
            fs.create_dir(base, recursive=True)
            with fs.open_output_stream(path) as out:
                out.write(frame)
            self.files.append(path)
        else:
            self.mem_runs.append(frame)
            self.held += len(frame)

    @staticmethod
    def _records(source, chunk: int = 1 << 20):
        import zstandard

        reader = zstandard.ZstdDecompressor().stream_reader(source)
        rest = b""
        while True:
            block = reader.read(chunk)
            if not block:
                return
            block = rest + block
            cut = len(block) // 16 * 16
            rest = block[cut:]
            rows = np.frombuffer(block[:cut], dtype=np.int64).reshape(-1, 2)
            yield from zip(rows[:, 0].tolist(), rows[:, 1].tolist())

    def merged(self):
        fs, _ = file_system(self.folder)
        streams = [fs.open_input_stream(path) for path in self.files]
        sources = [self._records(f) for f in self.mem_runs] + [self._records(s) for s in streams]
        yield from heapq.merge(*sources)
        for stream, path in zip(streams, self.files):
            stream.close()
            fs.delete_file(path)


def counted_pairs(merged):
    """``(pair, count, best)`` from a merge in pair order: equal pairs are added up, and the pairs of
    one B id (the high half) are held until its highest count is known."""
    side, pairs, counts = None, [], []

    def flush():
        top = max(counts)
        return [(p, c, c == top) for p, c in zip(pairs, counts)]

    last, total = None, 0
    for pair, n in merged:
        if pair != last and last is not None:
            if last >> 32 != side:
                yield from flush() if pairs else ()
                side, pairs, counts = last >> 32, [], []
            pairs.append(last)
            counts.append(total)
            total = 0
        last = pair
        total += n
    if last is not None:
        if last >> 32 != side:
            yield from flush() if pairs else ()
            pairs, counts = [], []
        pairs.append(last)
        counts.append(total)
        yield from flush()


def _merge_counts(folder: str, memory: int):
    """Per radix bucket: runs, k-way merge, count per pair, and the best pairs of each B id."""
    def run(batches):
        runs = _Runs(folder, memory)
        for pdf in batches:
            if len(pdf):
                runs.add(pdf["pair"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64))
        block = []
        for row in counted_pairs(runs.merged()):
            block.append(row)
            if len(block) >= 1 << 16:
                yield pd.DataFrame(block, columns=["pair", "count", "best"])
                block = []
        if block:
            yield pd.DataFrame(block, columns=["pair", "count", "best"])
    return run


def align(docs: DataFrame, a_path: str, b_path: str, buckets: int | None = None,
          run_memory: int = 64 << 20, text_budget: int = 1 << 20) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.col("text").cast("string"))
    schema = ("_row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
              "pairs array<long>, mult array<long>")
    aligned = stored(rows.mapInPandas(_tokenise(a_path, b_path, text_budget), schema), "aligned")
    local = aligned.select("pairs", "mult").mapInPandas(_local_counts, "pair long, n long")
    parts = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    radix = local.repartition(parts, F.shiftright("pair", 32))
    counted = stored(radix.mapInPandas(_merge_counts(scratch(spark, "runs"), run_memory),
                                       "pair long, count long, best boolean"), "pair-counts")
    links = aligned.select("_row", F.explode(F.arrays_zip("pairs", "mult")).alias("z")).select(
        "_row", F.col("z.pairs").alias("pair"), F.col("z.mult").alias("mult"))
    joined = sized_join(links, counted, "pair")
    per_row = joined.groupBy("_row").agg(
        F.sum(F.col("mult") * F.col("count")).alias("count_sum"),
        F.sum(F.when(F.col("best"), F.col("mult")).otherwise(0)).alias("n_best"))
    return aligned.join(per_row, "_row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")
