import math

import numpy as np

from martloom.llm.vectors import near_groups, quantised


def brute(rows, least=0.93):
    def sound(v, label):
        return (label is not None and v is not None and len(v) > 0
                and all(x is not None and math.isfinite(x) for x in v) and any(v))

    n = len(rows)
    root = {r[0]: r[0] for r in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            (a, v, s), (b, w, t) = rows[i], rows[j]
            if s == t and sound(v, s) and sound(w, t) and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                x, y = x / abs(x).max(), y / abs(y).max()
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= least:
                    links[i] += 1
                    links[j] += 1
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return sorted((r[0], k, find(r[0]), find(r[0]) == r[0]) for r, k in zip(rows, links))


def test_against_every_pair(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [tuple(r) for r in table.select("vec_id", "embedding", "label").collect()]
    draw = np.random.default_rng(3)
    near = [(1000 + k, (np.array(v) + draw.normal(scale=0.04, size=len(v))).tolist(), s)
            for k, (_, v, s) in enumerate(rows[:60])]
    rows += near + [(2000 + k, v, s) for k, (_, v, s) in enumerate(near[:20])] + [(3000, *rows[0][1:]), (3001, *rows[0][1:])]
    wide = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute(rows)
    assert any(k for _, k, _, _ in want)
    assert sorted(map(tuple, near_groups(wide).collect())) == want
    assert sorted(map(tuple, near_groups(wide, tile=16).collect())) == want
    assert sorted(map(tuple, near_groups(wide, least=0.3).collect())) == brute(rows, 0.3)


def test_edges(spark):
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [1.0, float("nan")], 1),
            (6, [1.0, float("inf")], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 1), (9, [2.0, 0.0], 1),
            (10, [1.0, 0.1], 1), (11, [1.0, 0.0], 2), (12, [1.0], 1), (13, [-1.0, 0.0], 1), (14, [1e-30, 0.0], 1)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, id string")
    assert sorted(map(tuple, near_groups(table).collect())) == brute(rows)
    assert near_groups(table.limit(0)).collect() == []


def test_bound_holds():
    draw = np.random.default_rng(1).normal(size=(300, 48))
    unit = draw / np.linalg.norm(draw, axis=1, keepdims=True)
    codes, scale, rest = quantised(unit)
    near = (codes.astype(float) @ codes.T) * scale[:, None] * scale
    assert (abs(near - unit @ unit.T) <= rest[:, None] + (1 + rest[:, None]) * rest + 1e-12).all()
