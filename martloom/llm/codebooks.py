"""Vector code compression: product quantisation whose nearest entries are found by equal-average search.

Every kept vector becomes whole numbers ``floor(4096 * x)`` and is cut into ``parts`` equal
consecutive parts. Each part position has its own codebook of at most ``entries`` entries, seeded by
that part of the vectors with the smallest vec_ids and refined by ``rounds`` rounds of Lloyd steps:
assign every part to its nearest entry, then replace each used entry by the componentwise
``floor(sum / count)`` of its parts (entries without parts stay). A last assignment gives the codes.

Nearest entries are found by equal-average search. For a part ``x`` and an entry ``c`` of ``k``
components, ``|x - c|^2 >= (sum(x) - sum(c))^2 / k``. Entries are sorted by their component sum; the
search starts at the entries whose sums lie next to the part's sum and walks outward in both
directions, stopping in a direction once ``gap^2 / k`` strictly exceeds the best distance found, so
entries at an equal distance are still seen and ties go to the lower entry index. All arithmetic is
on 64-bit whole numbers, so the test ``gap^2 > best * k`` is exact.

Spark does the work: the whole numbers are computed by SQL and stored once as Parquet; every round is
one pass of ``mapInPandas`` in which a task assigns its rows and returns one partial sum per (part,
entry, component), which ``groupBy`` adds up. Only the codebooks (``entries * dimension`` numbers)
reach the driver, and the seeds are 16 rows taken by ``orderBy().limit()``. Per-label error sums are
joined back by a size-checked join (broadcast below a bound, salted above it), so a label with a third
of all rows is not one task.

Defined results: rows whose vector is null, empty, holds a null or non-finite component, has a length
that is not a multiple of ``parts``, differs in length from the first seed, or has a component with
``|x| >= 2**15`` (beyond which 64-bit sums of squares could overflow) are dropped. Null vec_ids are kept
and sort after all others when seeds are chosen; rows with equal vec_ids are ordered by their whole
numbers. With fewer than ``entries`` kept rows the codebooks have as many entries as rows. Null labels
form one group for ``label_error``. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martloom.llm.shared import sized_join, stored

SCALE = 4096
LIMIT = 2.0 ** 15


def whole_numbers(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows with a sound vector as ``vec_id, label, q`` (``q`` = floor(4096 x) as longs)."""
    sound = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(LIMIT), F.lit(False)))
    return embeddings.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & sound).select(
        "vec_id", "label",
        F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("q"),
    )


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of ``book`` for every row of ``x`` (both whole
    numbers), by equal-average search; ties go to the lower index."""
    n, k = x.shape
    m = len(book)
    sums = book.sum(axis=1)
    order = np.lexsort((np.arange(m), sums))
    sorted_sums = sums[order]
    xs = x.sum(axis=1)
    best = np.full(n, np.iinfo(np.int64).max, dtype=np.int64)
    best_i = np.full(n, m, dtype=np.int64)
    right = np.searchsorted(sorted_sums, xs, side="left")
    left = right - 1
    for _ in range(m):
        moved = False
        for side, step in ((right, 1), (left, -1)):
            rows = np.nonzero((side >= 0) & (side < m))[0]
            if len(rows) == 0:
                continue
            place = side[rows]
            gap = xs[rows] - sorted_sums[place]
            open_ = ~((best[rows] != np.iinfo(np.int64).max) & (gap * gap > best[rows] * k))
            done = rows[~open_]
            side[done] = -1 if step < 0 else m
            rows, place = rows[open_], place[open_]
            if len(rows) == 0:
                continue
            moved = True
            entry = order[place]
            diff = x[rows] - book[entry]
            dist = np.einsum("ij,ij->i", diff, diff)
            better = (dist < best[rows]) | ((dist == best[rows]) & (entry < best_i[rows]))
            best[rows[better]] = dist[better]
            best_i[rows[better]] = entry[better]
            side[rows] += step
        if not moved:
            break
    return best_i, best


def _parts(q: pd.Series, parts: int) -> np.ndarray:
    return np.stack(q.to_numpy()).astype(np.int64).reshape(len(q), parts, -1)


def _partial_sums(books: np.ndarray, parts: int):
    """Per task: counts and component sums of the parts given to each entry."""
    def run(batches):
        entries, width = books.shape[1], books.shape[2]
        count = np.zeros((parts, entries), dtype=np.int64)
        total = np.zeros((parts, entries, width), dtype=np.int64)
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = _parts(pdf["q"], parts)
            for p in range(parts):
                idx, _ = nearest(x[:, p, :], books[p])
                count[p] += np.bincount(idx, minlength=entries)
                np.add.at(total[p], idx, x[:, p, :])
        used = np.argwhere(count > 0)
        if len(used):
            yield pd.DataFrame({
                "part": used[:, 0], "entry": used[:, 1], "n": count[used[:, 0], used[:, 1]],
                "sums": list(total[used[:, 0], used[:, 1]]),
            })
    return run


def _codes(books: np.ndarray, parts: int):
    def run(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = _parts(pdf["q"], parts)
            idx = np.empty((len(pdf), parts), dtype=np.int64)
            err = np.zeros(len(pdf), dtype=np.int64)
            for p in range(parts):
                idx[:, p], dist = nearest(x[:, p, :], books[p])
                err += dist
            yield pd.DataFrame({
                "vec_id": pdf["vec_id"], "label": pdf["label"],
                "code": ["".join(f"{i:02x}" for i in row) for row in idx.tolist()], "error": err,
            })
    return run


def compress(embeddings: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[DataFrame, np.ndarray]:
    """``(codes, codebooks)``: per kept row vec_id, label, code (two hex digits an entry, in part order)
    and error (squared distances summed over parts); codebooks as an array (part, entry, component)."""
    spark = embeddings.sparkSession
    rows = whole_numbers(embeddings)
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()
    if not seeds:
        empty = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", T.IntegerType()),
                              T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
        return spark.createDataFrame([], empty), np.zeros((parts, 0, 0), dtype=np.int64)
    dim = len(seeds[0].q)
    if dim % parts:
        raise ValueError(f"vectors of {dim} components cannot be cut into {parts} parts")
    points = stored(rows.where(F.size("q") == dim).select("vec_id", F.col("label").cast("int").alias("label"), "q"),
                    "codebook-points")
    books = np.array([s.q for s in seeds if len(s.q) == dim], dtype=np.int64)
    books = books.reshape(len(books), parts, dim // parts).transpose(1, 0, 2).copy()
    schema = "part int, entry int, n long, sums array<long>"
    for _ in range(rounds):
        partial = points.select("q").mapInPandas(_partial_sums(books, parts), schema)
        exploded = partial.select("part", "entry", "n", F.posexplode("sums").alias("pos", "s"))
        summed = exploded.groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        for r in summed.collect():
            books[r.part, r.entry, r.pos] = r.s // r.n
    schema = "vec_id long, label int, code string, error long"
    return points.mapInPandas(_codes(books.copy(), parts), schema), books


def codebook_digest(books: np.ndarray) -> str:
    """SHA-256 (lower-case hex) of all entries' components by part, entry, component, ``,``-joined."""
    return hashlib.sha256(",".join(str(int(v)) for v in books.reshape(-1)).encode()).hexdigest()


def code_table(embeddings: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """Codes with the error summed over equal labels (nulls together) and the codebooks' digest."""
    codes, books = compress(embeddings, parts, entries, rounds)
    codes = stored(codes.withColumn("_label", F.coalesce(F.col("label").cast("long"), F.lit(-(2 ** 63)))), "codes")
    by_label = codes.groupBy("_label").agg(F.sum("error").alias("label_error"))
    joined = sized_join(codes, by_label, "_label")
    return joined.select(
        "vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"),
    )
