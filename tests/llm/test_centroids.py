"""Clustering by tables against plain arithmetic on Python's integers."""

import hashlib
import math
from collections import defaultdict

import numpy as np

from reachloom.llm import centroids

LONG = 1 << 63


def plain(rows, k, rounds, dims, scale=1024, seed="3"):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [centroids.whole(float(x), scale) for x in v]))
    drawn = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    points = [v for _, v in drawn[:k]]

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(v, p)), c) for c, p in enumerate(points)) for _, v in kept]

    for _ in range(rounds):
        of = defaultdict(list)
        for (_, v), (_, c) in zip(kept, assign()):
            of[c].append(v)
        for c, vs in of.items():
            points[c] = [sum(x) // len(vs) for x in zip(*vs)]
    found = assign()
    fits = lambda x: x if x < LONG else None
    by = defaultdict(int)
    for d, c in found:
        by[c] += d
    digest = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return sorted(
        ((i, c, fits(d), fits(by[c]), fits(sum(by.values())), digest[c]) for (i, _), (d, c) in zip(kept, found)), key=str
    )


def run(df, **settings):
    rows = centroids.cluster_vectors(df, keep=["vec_id"], **settings).collect()
    names = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted((tuple(r[n] for n in names) for r in rows), key=str)


def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>")


def test_given_vectors(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert run(df) == plain(rows, 8, 10, 64)


def test_edges_ties_and_small_blocks(spark, monkeypatch):
    rng = np.random.RandomState(1)
    rows = [(i, [float(x) for x in rng.randint(-3, 4, 4) / 1024]) for i in range(60)]  # many ties and equal vectors
    rows += [(None, rows[0][1]), (None, [0.5, 0.0, 0.0, 0.0]), (7, rows[7][1]), (7, [1.0, 2.0, 3.0, 4.0])]
    rows += [(900, None), (901, []), (902, [1.0]), (903, [None, 0.0, 0.0, 0.0]), (904, [float("nan"), 0.0, 0.0, 0.0])]
    rows += [(905, [0.0, float("-inf"), 0.0, 0.0]), (906, [-0.0004, -1e-30, 1e-30, 0.0])]
    want = plain(rows, 8, 6, 4)
    for size in (8192, 5):
        monkeypatch.setattr(centroids, "BLOCK_ROWS", size)
        assert run(table(spark, rows), dims=4, rounds=6) == want
    few = [r for r in rows[:3]]
    assert run(table(spark, few), dims=4) == plain(few, 8, 10, 4)
    assert run(table(spark, rows).limit(0), dims=4) == []


def test_values_beyond_64_bits(spark):
    rows = [(1, [1e30, -1e30]), (2, [1e30, 5.0]), (3, [0.25, -0.25]), (4, [0.3, -0.2]), (5, [1e300, 1e306]), (6, [-1e306, 1e5])]
    for k in (2, 3, 5):
        assert run(table(spark, rows, "double"), dims=2, k=k, rounds=4) == plain(rows, k, 4, 2)
    rows = rows[2:4] * 3
    assert run(table(spark, rows, "double"), dims=2, k=2, rounds=4) == plain(rows, 2, 4, 2)


def test_columns_are_carried_and_replaced(spark):
    df = table(spark, [(1, [0.1, 0.2]), (2, [0.3, 0.4])]).selectExpr("*", "'x' AS cluster", "named_struct('a', vec_id) AS more")
    got = centroids.cluster_vectors(df, k=1, dims=2)
    assert got.columns == ["vec_id", "more", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((r["more"]["a"], r["cluster"]) for r in got.collect()) == [(1, 0), (2, 0)]
