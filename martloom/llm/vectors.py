"""Embedding near-duplicates by int8 tile products with error bounds.

A vector is brought to length 1 and split into ``scale * codes + rest`` with whole codes from -127 to
127; the length of ``rest`` is known. For two vectors ``u = u' + e`` and ``v = v' + f``::

    |u.v - u'.v'| = |e.v + u'.f| <= |e| + (1 + |e|) * |f|

so a pair whose code product lies below the threshold by more than that cannot be a link. All other
pairs are computed anew in double precision. Products of codes are taken by float32 matrix products
over at most 1024 dimensions, where every partial sum is a whole number below 2^24, so they are
exact.

Equal vectors of a label become one class first (with its number of copies), so groups of copies cost
nothing. The classes of a label are dealt by hash into tiles of about ``tile`` vectors, and every pair
of tiles of one label and one dimension is a group of its own: a hot label is spread over many tasks,
each of which holds two tiles. A task returns one row per linked vector (links and its smallest partner
chain), never all pairs.

Work is quadratic in a label's distinct vectors by the method; rows moved are ``n * n / tile``.

Defined results: a null vec_id is dropped (it names nothing). Null, empty and zero vectors, vectors
with null or non-finite components, and null labels link with nothing. Vectors of different dimension do not
link. Rows that share a vec_id are linked as any two vectors are and give one output row each. Extra
columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.llm.groups import components
from martloom.llm.shared import stored

_DIMS = 1024
_ROWS = 1024


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (as float32 whole numbers), scales, and the length of what the codes miss, rounded up."""
    scale = np.abs(unit).max(axis=1, keepdims=True) / 127
    codes = np.rint(unit / scale).astype(np.int8)
    rest = np.linalg.norm(unit - scale * codes, axis=1) * (1 + 1e-9) + 1e-12
    return codes.astype(np.float32), scale[:, 0], rest


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of code rows."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], _DIMS):
        out += a[:, k:k + _DIMS] @ b[:, k:k + _DIMS].T
    return out


def tile_links(x: np.ndarray, y: np.ndarray | None, least: float):
    """Blocks of linked places (i, j) of two tiles; of one tile with itself, both (i, j) and (j, i)
    without i = j, when ``y`` is None."""
    same = y is None
    y = x if same else y
    unit_x = x / np.linalg.norm(x, axis=1, keepdims=True)
    unit_y = unit_x if same else y / np.linalg.norm(y, axis=1, keepdims=True)
    a, scale_a, rest_a = quantised(unit_x)
    b, scale_b, rest_b = (a, scale_a, rest_a) if same else quantised(unit_y)
    for start in range(0, len(a), _ROWS):
        part = slice(start, start + _ROWS)
        near = code_products(a[part], b) * scale_a[part, None] * scale_b
        bound = rest_a[part, None] + (1 + rest_a[part, None]) * rest_b + 1e-9
        i, j = np.nonzero(near + bound >= least)
        i = i + start
        if same:
            i, j = i[i != j], j[i != j]
        for low in range(0, len(i), 1 << 17):
            p, q = i[low:low + (1 << 17)], j[low:low + (1 << 17)]
            hit = cosine(x[p], y[q]) >= least
            yield p[hit], q[hit]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    dot = np.einsum("ij,ij->i", a, b)
    return dot / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def near_groups(rows: DataFrame, least: float = 0.93, tile: int = 8192) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``rows`` (``vec_id, embedding,
    label``)."""
    vectors = stored(
        rows.where("vec_id IS NOT NULL").select(
            F.col("vec_id").cast("long").alias("vec_id"), F.col("label"),
            F.col("embedding").cast("array<double>").alias("v"),
        ), "vectors",
    )
    sound = F.coalesce(
        F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
        & F.exists("v", lambda c: c != 0), F.lit(False)) & F.col("label").isNotNull()
    # A vector is brought to the largest component 1, so that squares neither overflow nor vanish.
    largest = F.array_max(F.transform("v", F.abs))
    usable = vectors.where(sound).select("vec_id", "label", F.col("v").alias("given"), largest.alias("m"))
    usable = usable.select("vec_id", "label", F.transform("given", lambda c: c / F.col("m") + 0.0).alias("v"))
    members = stored(
        usable.select("vec_id", "label", "v", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2")), "members")
    classes = stored(
        members.groupBy("label", "h1", "h2", F.size("v").alias("dims")).agg(
            F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.min_by("v", "vec_id").alias("v")),
        "classes",
    )
    counts = classes.groupBy("label", "dims").agg(F.count("*").alias("n")).select(
        "label", "dims", F.expr(f"cast(1 + n div {tile} as int)").alias("tiles"))
    placed = classes.join(counts, ["label", "dims"]).withColumn("own", F.expr("cast(pmod(h1, tiles) as int)"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "label", "dims", F.least("own", "other").alias("ta"), F.greatest("own", "other").alias("tb"),
        "own", "h1", "h2", "id", "copies", "v",
    )

    def compare(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.reset_index(drop=True)
        first = np.flatnonzero(frame["own"] == key[2])
        second = np.flatnonzero(frame["own"] == key[3]) if key[2] != key[3] else None
        copies = frame["copies"].to_numpy()
        links = np.zeros(len(frame), np.int64)
        root = np.arange(len(frame))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        if len(first) and (second is None or len(second)):
            x = np.stack(frame["v"].iloc[first].to_numpy())
            y = None if second is None else np.stack(frame["v"].iloc[second].to_numpy())
            for i, j in tile_links(x, y, least):
                i, j = first[i], (first if second is None else second)[j]
                np.add.at(links, i, copies[j])
                if second is not None:
                    np.add.at(links, j, copies[i])
                # Links inside one group change nothing; what is left is few.
                while True:
                    flat = np.array([find(k) for k in range(len(frame))]) if len(i) else root
                    root[:] = flat
                    apart = flat[i] != flat[j]
                    if not apart.any():
                        break
                    i, j = i[apart], j[apart]
                    for p, q in np.unique(np.sort(np.stack([flat[i], flat[j]], 1), axis=1), axis=0).tolist():
                        p, q = find(p), find(q)
                        root[max(p, q)] = min(p, q)
        hit = np.flatnonzero(links)
        ends = frame.iloc[[find(k) for k in hit]]
        return pd.DataFrame({
            "label": frame["label"].iloc[hit].to_numpy(), "dims": frame["dims"].iloc[hit].to_numpy(),
            "h1": frame["h1"].iloc[hit].to_numpy(), "h2": frame["h2"].iloc[hit].to_numpy(),
            "id": frame["id"].iloc[hit].to_numpy(), "near": ends["id"].to_numpy(), "links": links[hit],
        })

    label = rows.schema["label"].dataType.simpleString()
    found = stored(
        dealt.groupBy("label", "dims", "ta", "tb").applyInPandas(
            compare, f"label {label}, dims int, h1 long, h2 int, id long, near long, links long"),
        "tile-links",
    )
    per_class = found.groupBy("label", "dims", "h1", "h2").agg(F.sum("links").alias("links"))
    chosen = classes.select("label", "dims", "h1", "h2", "id", "copies").join(
        per_class, ["label", "dims", "h1", "h2"], "left")
    joined = stored(
        members.select("vec_id", "label", F.size("v").alias("dims"), "h1", "h2").join(
            chosen, ["label", "dims", "h1", "h2"]).select(
            "vec_id", "id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "joined")
    groups = components(
        found.select(F.col("id").alias("a"), F.col("near").alias("b")).unionAll(
            joined.select(F.col("vec_id").alias("a"), F.col("id").alias("b"))))
    alone = vectors.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"))
    every = joined.select("vec_id", "n_links").unionAll(alone)
    return every.join(groups.withColumnRenamed("id", "vec_id"), "vec_id", "left").select(
        "vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
