"""Token files: concatenated ids with Elias-Fano coded document boundaries.

A file is one shard of documents in ascending ``doc_id`` order::

    ids (little-endian unsigned, 2 or 4 bytes), then the blocks boundaries and doc_ids, then
    place of the blocks u64, documents u64, ids u64, nulls u64, first doc_id i64, width u16,
    version u16, magic "TOKF"

Boundaries are the running totals of the documents' lengths, and doc_ids are kept as differences
from the first one. Both are Elias-Fano sequences: of a value below ``u`` the lower
``log2(u / n)`` bits are stored as they are, and the rest in unary in a bit vector. That is about
``2 + log2(u / n)`` bits a document. ``select`` finds the i-th set bit by a sampled count every 512
bits and a look at one stretch, so any offset is read without unpacking the others.

The rows are range partitioned by doc_id, each task streams one shard, and the manifest gets its
totals; the start of a shard is the sum of the totals before it. File names are new for every
attempt, and only committed tasks enter the manifest.

A null text is empty and gives only the end id. Null doc_ids come first. Rows that share a doc_id
are ordered by the hash of their text and the text. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import posixpath
import re
import struct
import uuid
import zlib
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage,
)

from martloom.llm.shared import file_system, shuffle_parts

_FOOT = struct.Struct("<QQQQqHH4s")
_BLOCK = struct.Struct("<QQBQ")
_SAMPLE = 512


# --- Elias-Fano ------------------------------------------------------------------------------

class EliasFano:
    """A non-decreasing sequence of unsigned numbers below 2^63."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        words = np.concatenate([high, np.zeros(-len(high) % 64, np.uint8)])
        ones = np.bitwise_count(words).reshape(-1, _SAMPLE // 8).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        high = np.zeros((n + (top >> low_bits) + 1 if n else 0), np.uint8)
        high[(values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
        return cls(n, low_bits, low, np.packbits(high, bitorder="little"))

    def select(self, i: int) -> int:
        """The i-th value, from one stretch of the bit vector and its own lower bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        block = int(np.searchsorted(self.before, i, side="right")) - 1
        start = block * _SAMPLE // 8
        bits = np.unpackbits(self.high[start:start + _SAMPLE // 8], bitorder="little")
        place = int(np.flatnonzero(bits)[i - self.before[block]]) + block * _SAMPLE
        first = i * self.low_bits
        low = int.from_bytes(self.low[first // 8:(first + self.low_bits) // 8 + 1].tobytes(), "little")
        low = low >> (first % 8) & ((1 << self.low_bits) - 1)
        return (place - i) << self.low_bits | low

    def all(self) -> np.ndarray:
        bits = np.unpackbits(self.high, bitorder="little")
        high = (np.flatnonzero(bits)[:self.n] - np.arange(self.n)).astype(np.uint64)
        if not self.low_bits:
            return high
        low = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little")
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        low = (low.reshape(self.n, self.low_bits).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
        return high << np.uint64(self.low_bits) | low

    def pack(self) -> bytes:
        head = _BLOCK.pack(self.n, len(self.low), self.low_bits, len(self.high))
        return head + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def unpack(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        n, lows, low_bits, highs = _BLOCK.unpack_from(data, at)
        at += _BLOCK.size
        low = np.frombuffer(data, np.uint8, lows, at)
        high = np.frombuffer(data, np.uint8, highs, at + lows)
        return cls(n, low_bits, low, high), at + lows + highs


# --- encoding --------------------------------------------------------------------------------

def _gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``pool`` with these starts and sizes, one after another."""
    first = np.cumsum(sizes) - sizes
    return pool[np.arange(sizes.sum()) + np.repeat(starts - first, sizes)]


def byte_merges(tokenizer) -> tuple[list[bytes], np.ndarray] | None:
    """The tokens of a byte-level BPE model with word ends, in the order of their merges, and their ids; None for
    another model, or where merging by the rank of the joined bytes could differ from merging the listed pairs.
    The end of a word is the byte 0xFF, which UTF-8 never holds; bytes with it come before all merges.

    The two agree where each token has one listed pair, made of earlier tokens, and its bytes, merged by earlier
    ranks alone, end as that pair: then no other two neighbours can join to it."""
    model = json.loads(tokenizer.to_str())["model"]
    plain = {"type": "BPE", "end_of_word_suffix": "</w>"}
    if any(model.get(k) != v for k, v in plain.items()) or any(
            model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        return None
    # The characters that stand for bytes, as byte-level tokenizers number them.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in set(shown))}

    def raw(token: str) -> bytes:
        stem = token.removesuffix("</w>")
        return bytes(chars[c] for c in stem) + b"\xff" * (stem != token)

    vocab = model["vocab"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    singles = [c + end for end in ("", "</w>") for c in sorted(chars, key=chars.get)]
    names = singles + [x + y for x, y in pairs]
    if any(n not in vocab for n in names) or any(x.endswith("</w>") for x, _ in pairs):
        return None
    tokens = [raw(n) for n in names]
    rank = {t: k for k, t in enumerate(tokens)}
    if len(rank) < len(tokens):
        return None
    for k, (x, y) in enumerate(pairs, len(singles)):
        x, y = raw(x), raw(y)
        parts = [bytes([c]) for c in x + y]
        if parts[-1] == b"\xff":
            parts[-2:] = [parts[-2] + parts[-1]]
        while len(parts) > 2:
            low, at = min((rank.get(u + v, k), i) for i, (u, v) in enumerate(zip(parts, parts[1:])))
            if low >= k:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        if parts != [x, y]:
            return None
    return tokens, np.array([vocab[n] for n in names], np.uint32)


class Encoder:
    """Ids of whole texts. The vocabulary drops white space and its merges never cross it, so each
    distinct piece between ASCII white space is encoded once and its ids are copied. Where the vocabulary
    folds case and parts letters from marks, pieces share their folded stem's ids, and stems of Latin-1
    letters are merged by tiktoken, which takes the same merges."""

    #: Pieces of Latin-1 letters with at most one closing mark: single code points that fold to one letter each.
    _PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"
    _LETTERS = re.compile("[a-zß-öø-ÿ]+")

    def __init__(self, path: str, end_id: int, kept: int = 1 << 18):
        # Tasks are the parallel unit: a pool of threads in each only adds time and memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.kept = Tokenizer.from_file(path), end_id, kept
        self.width = 2 if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        fold, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        letters = "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xDF)]))
        small = letters.lower() + "ßÿ"
        self.folds = bool(fold and cut) and fold.normalize_str("AZ" + letters + small) == "az" + letters.lower() + small and [
            at for _, at in cut.pre_tokenize_str(f"ab{small}.,")] == [(0, 2 + len(small)), (2 + len(small), 4 + len(small))]
        merges = byte_merges(self.tokenizer) if self.folds else None
        self.core = None
        if merges and len(cut.pre_tokenize_str("aÿ")[0][0]) == 3:  # one character a byte
            import tiktoken

            self.core = tiktoken.Encoding(
                "words", pat_str=r"[^\n]+", mergeable_ranks={t: k for k, t in enumerate(merges[0])}, special_tokens={})._core_bpe
            self.of_rank = merges[1]
        self._forget()

    def _forget(self) -> None:
        """Start the store of encoded stems; entry 0 is empty, then the closing marks."""
        marks = self._library([".", ","]) if self.folds else []
        self.known: dict[str, int] = {}
        self.pool = np.array([i for ids in marks for i in ids], np.uint32)
        self.sizes = np.array([0, *map(len, marks)], np.int64)

    def _library(self, stems: list[str]) -> list[list[int]]:
        out = []
        for start in range(0, len(stems), 1024):
            out += [e.ids for e in self.tokenizer.encode_batch_fast(stems[start:start + 1024], add_special_tokens=False)]
        return out

    def _learn(self, stems: list[str]) -> None:
        """Add the ids of new stems to the store."""
        if len(self.known) + len(stems) > self.kept:  # a bounded store of what was seen
            self._forget()
        quick = [s for s in stems if self.core is not None and self._LETTERS.fullmatch(s)]
        merge = self.core.encode_single_piece if quick else None
        ranks = [merge(s.encode() + b"\xff") for s in quick]
        others = set(quick)
        others = [s for s in stems if s not in others]
        ids = self._library(others)
        found = np.fromiter(itertools.chain.from_iterable(ranks), np.int64)
        pool = [self.pool, np.fromiter(itertools.chain.from_iterable(ids), np.uint32)]
        if quick:
            pool.insert(1, self.of_rank[found])
        self.known.update(zip(itertools.chain(quick, others), itertools.count(len(self.sizes))))
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, itertools.chain(ranks, ids)), np.int64)])
        self.pool = np.concatenate(pool)

    def _numbers(self, stems: list[str]) -> np.ndarray:
        """Entries of the stems in the store."""
        new = [s for s in stems if s not in self.known]
        if new:
            # A full store is emptied, and holds all stems of this batch afterwards.
            self._learn(new if len(self.known) + len(new) <= self.kept else stems)
        return np.fromiter(map(self.known.__getitem__, stems), np.int64, len(stems))

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after another, and the number of each."""
        if not self.folds:
            entries = self._numbers(pieces.to_pylist())
            sizes = self.sizes[entries]
            return _gathered(self.pool, (np.cumsum(self.sizes) - self.sizes)[entries], sizes), sizes
        plain = pc.match_substring_regex(pieces, self._PLAIN)
        # Strings of special tokens hold a ``<``.
        ascii_only = pc.and_(pc.string_is_ascii(pieces), pc.invert(pc.match_substring(pieces, "<")))
        lower = pc.if_else(pc.or_(plain, ascii_only), pc.utf8_lower(pieces), pieces)
        stems = pc.if_else(plain, pc.utf8_rtrim(lower, ".,"), lower).dictionary_encode()
        marks = np.zeros(len(pieces), np.int64)
        for entry, mark in enumerate(".,", 1):
            marks[pc.and_(plain, pc.ends_with(pieces, mark)).to_numpy(zero_copy_only=False)] = entry
        entries = np.stack([self._numbers(stems.dictionary.to_pylist())[stems.indices.to_numpy()], marks], 1).ravel()
        sizes = self.sizes[entries]
        starts = (np.cumsum(self.sizes) - self.sizes)[entries]
        return _gathered(self.pool, starts, sizes), sizes.reshape(-1, 2).sum(axis=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, end ids included, and the number of ids of each text."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        words = lists.flatten().dictionary_encode()
        per_text = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        pool, sizes = self._pieces(words.dictionary)
        starts = np.append(np.cumsum(sizes) - sizes, len(pool))
        pool, sizes = np.append(pool, np.uint32(self.end_id)), np.append(sizes, 1)
        # One extra piece after each text: the end id, last in the pool.
        ends = np.cumsum(per_text)
        codes = np.insert(words.indices.to_numpy().astype(np.int64), ends, len(sizes) - 1)
        lengths = sizes[codes]
        n = np.add.reduceat(lengths, ends - per_text + np.arange(len(ends))) if len(ends) else ends
        return _gathered(pool, starts[codes], lengths), n


@functools.lru_cache(maxsize=1)
def encoder_of(path: str, end_id: int) -> Encoder:
    """The process's encoder: the vocabulary is read once, not once a task."""
    return Encoder(path, end_id)


# --- files -----------------------------------------------------------------------------------

@dataclass
class Shard(WriterCommitMessage):
    part: int
    name: str
    documents: int
    ids: int


_SHARD = pa.schema([("part", pa.int32()), ("name", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())])


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.tokenizer = options["path"], options["tokenizer"]
        self.end_id = int(options["end_id"])

    def write(self, iterator) -> Shard:
        part = TaskContext.get().partitionId()
        encoder = encoder_of(self.tokenizer, self.end_id)
        kind = np.dtype(f"<u{encoder.width}")
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        name = f"part-{part:05d}-{uuid.uuid4().hex}.tok"
        lengths, doc_ids, nulls, out = [], [], 0, None
        for batch in iterator:
            for start, count in portions(batch.column("text"), 2 << 20):
                rows = batch.slice(start, count)
                ids, n = encoder.encode(rows.column("text"))
                if out is None:
                    out = system.open_output_stream(posixpath.join(root, name), compression=None)
                out.write(ids.astype(kind).tobytes())
                lengths.append(n)
                known = rows.column("doc_id").drop_null()
                nulls += count - len(known)
                doc_ids.append(known.to_numpy())
        if out is None:
            return Shard(part, "", 0, 0)
        lengths, known = np.concatenate(lengths), np.concatenate(doc_ids).astype(np.int64)
        total = int(lengths.sum())
        first = int(known[0]) if len(known) else 0
        out.write(EliasFano.of(np.cumsum(lengths)).pack())
        out.write(EliasFano.of(known.view(np.uint64) - np.array(first).view(np.uint64)).pack())
        place = total * encoder.width
        out.write(_FOOT.pack(place, len(lengths), total, nulls, first, encoder.width, 1, b"TOKF"))
        out.close()
        return Shard(part, name, len(lengths), total)

    def commit(self, messages) -> None:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        shards, start = [], 0
        for m in sorted((m for m in messages if m and m.name), key=lambda m: m.part):
            shards.append([m.name, m.documents, m.ids, start])
            start += m.ids
        with system.open_output_stream(posixpath.join(root, "manifest.json")) as out:
            out.write(json.dumps(shards).encode())

    def abort(self, messages) -> None:
        system, root = file_system(self.path)
        for m in messages:
            if m and m.name:
                system.delete_file(posixpath.join(root, m.name))


def portions(texts: pa.Array, limit: int):
    """(start, count) of runs of rows with about ``limit`` bytes; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, stop - start
        start = stop


class TokenFile:
    """One shard: the Elias-Fano blocks in memory, ids read as asked for."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2)
        file.seek(size - _FOOT.size)
        foot = _FOOT.unpack(file.read(_FOOT.size))
        place, self.n, self.total, self.nulls, self.first, self.width, version, magic = foot
        if (magic, version) != (b"TOKF", 1):
            raise ValueError("not a token file")
        file.seek(place)
        blocks = file.read(size - _FOOT.size - place)
        self.boundaries, at = EliasFano.unpack(blocks, 0)
        self.doc_ids, _ = EliasFano.unpack(blocks, at)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids from position ``start`` to ``stop``."""
        self.file.seek(start * self.width)
        return np.frombuffer(self.file.read((stop - start) * self.width), f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, its offsets taken by ``select``."""
        start = self.boundaries.select(i - 1) if i else 0
        return self.read(start, self.boundaries.select(i))


@dataclass
class Slice(InputPartition):
    name: str
    start: int


class TokenReader(DataSourceReader):
    """Rows ``doc_id, start, n_tokens, ids``; with the option ``ids`` = ``crc32`` the ids are
    reduced to the CRC of their 4-byte form while they are read."""

    def __init__(self, options: dict):
        self.path, self.crc = options["path"], options.get("ids") == "crc32"

    def partitions(self):
        system, root = file_system(self.path)
        with system.open_input_stream(posixpath.join(root, "manifest.json")) as f:
            return [Slice(name, start) for name, _, _, start in json.loads(f.read())] or [Slice("", 0)]

    def read(self, partition):
        if not partition.name:
            return
        system, root = file_system(self.path)
        with system.open_input_file(posixpath.join(root, partition.name)) as f:
            file = TokenFile(f)
            ends = file.boundaries.all().astype(np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            known = (file.doc_ids.all() + np.array(file.first).view(np.uint64)).view(np.int64)
            doc_ids = [None] * file.nulls + known.tolist()
            at = 0
            while at < file.n:
                stop = max(at + 1, int(np.searchsorted(ends, starts[at] + (1 << 20), side="right")))
                ids = file.read(int(starts[at]), int(ends[stop - 1])).astype("<u4")
                cut = ends[at:stop] - starts[at]
                lengths = ends[at:stop] - starts[at:stop]
                columns = [
                    pa.array(doc_ids[at:stop], pa.int64()),
                    pa.array(starts[at:stop] + partition.start), pa.array(lengths),
                ]
                if self.crc:
                    raw = memoryview(ids.tobytes())
                    columns.append(pa.array(
                        [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(cut.tolist(), lengths.tolist(), strict=True)],
                        pa.int64(),
                    ))
                else:
                    offsets = pa.array(np.concatenate([[0], cut]).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, self.names())
                at = stop

    def names(self) -> list[str]:
        return ["doc_id", "start", "n_tokens", "ids_crc32" if self.crc else "ids"]


class TokenSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        last = "ids_crc32 bigint" if self.options.get("ids") == "crc32" else "ids array<bigint>"
        return f"doc_id bigint, start bigint, n_tokens bigint, {last}"

    def reader(self, schema):
        return TokenReader(dict(self.options))

    def writer(self, schema, overwrite):
        return TokenWriter(dict(self.options))


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shards: int | None = None
) -> None:
    """``docs`` has ``doc_id`` and ``text``; ``path`` must be new and reachable by all tasks.
    ``shards`` defaults to the session's number of shuffle partitions."""
    spark = docs.sparkSession
    tie = F.xxhash64("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", tie.alias("_tie"))
    n = shards or shuffle_parts(spark)
    writer = TokenWriter({"path": path, "tokenizer": tokenizer, "end_id": end_id})

    def write(batches):
        shard = writer.write(batches)
        yield pa.RecordBatch.from_pylist([asdict(shard)], _SHARD)

    # Plain tasks instead of the data source, which keeps five Python processes beside the driver. Only
    # the rows of tasks that ended well enter the manifest.
    shards = (
        rows.repartitionByRange(n, "doc_id", "_tie")
        .sortWithinPartitions("doc_id", "_tie", "text")
        .select("doc_id", "text")
        .mapInArrow(write, "part int, name string, documents long, ids long")
    )
    writer.commit([Shard(**r.asDict()) for r in shards.collect()])


def read_tokens(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The rows of the files in the manifest, one task a file."""
    source = TokenSource({"path": path, **options})
    reader = source.reader(None)
    files = reader.partitions()

    def read(batches):
        for batch in batches:
            for place in batch.column("id").to_pylist():
                yield from reader.read(files[place])

    return spark.range(0, len(files), 1, len(files)).mapInArrow(read, source.schema())
