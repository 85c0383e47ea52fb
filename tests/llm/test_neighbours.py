from unittest import mock

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import neighbours
from foliospark.llm.graph import Graph


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, 64))
    x = np.concatenate([np.repeat(centres, 3, 0) + 0.25 * rng.normal(size=(3 * len(centres), 64)), rng.normal(size=(n - 3 * len(centres), 64))])
    return (x * rng.uniform(0.2, 5, (len(x), 1))).astype(np.float32)


def truth(x, k, least=-1.0):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return {(min(i, int(j)), max(i, int(j))) for i in range(len(x)) for j in top[i] if s[i, j] >= least}, top


def test_graph_recall():
    x = clustered(3000)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph(u)
    _, top = truth(x, 5)
    found, _ = g.search(u[:300], 64)
    assert np.mean([len(set(found[i][1:6]) & set(top[i])) / 5 for i in range(300)]) > 0.9
    assert not (g.edges == np.arange(len(u))[:, None]).any()  # no node is its own neighbour


@pytest.fixture(scope="module")
def table(spark):
    x = clustered(2400)
    rows = [(k, [float(v) for v in r], "a") for k, r in enumerate(x)]
    rows += [(0, rows[0][1], "b"), (5000, None, ""), (5001, [0.0] * 64, ""), (5002, [1.0] * 3, ""), (5003, [float("nan")] * 64, ""), (None, rows[1][1], ""), (5004, [], "")]
    rows += [(6000 + k, rows[7][1], "copy") for k in range(9)]
    return x, spark.createDataFrame(rows, "chunk_id bigint, embedding array<float>, node string")


def test_close_pairs(table):
    x, df = table
    want, _ = truth(x, 5, 0.85)
    want = {(a, b) for a, b in want if 7 not in (a, b)}
    got = {(r[0], r[1]) for r in neighbours.found(df).collect()}
    assert len({p for p in got if p[1] < 5000} & want) / len(want) >= 0.99 and all(a < b for a, b in got)
    copies = {p for p in got if p[1] >= 6000}
    assert all((6000 + k, 6008) in copies or (7, 6000 + k) in copies for k in range(8))
    small = neighbours.close_pairs(neighbours.Vectors(df), shard=300)  # several shards
    near = {(r["a"], r["b"]) for r in small.collect()}
    assert len({p for p in near if p[1] < 5000} & want) / len(want) >= 0.95


def test_search(table):
    x, df = table
    _, top = truth(x, 10)
    got = neighbours.most_similar(neighbours.Vectors(df), df.select(F.col("chunk_id").alias("id")).where("id % 20 = 0"), 10, shard=500).toPandas()
    by = got.groupby("query_id")["neighbour_id"].apply(set)
    ids = [k for k in range(0, 2400, 20)]
    assert np.mean([len(by[k] & set(top[k])) / 10 for k in ids]) >= 0.9
    assert got.groupby("query_id")["rank"].max().max() == 10 and 5001 not in by.index


def test_centres_at_two_levels(table):
    x, df = table
    v = neighbours.Vectors(df, sample=400)
    c = v.centres(60)
    assert c.tops is not None and len(c) > len(c.tops) > 1
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    exact = np.argmax(u @ c.centres.T, axis=1)
    assert np.mean(c.nearest(u, 3)[:, 0] == exact) > 0.9
    want, _ = truth(x, 5, 0.85)
    near = {(r["a"], r["b"]) for r in neighbours.close_pairs(v, probes=4, shard=60).collect()}
    assert len({p for p in near if p[1] < 5000} & want) / len(want) >= 0.9


def test_shards_are_split(table):
    """All vectors under one centre: the shard is split into parts, and no pair is lost."""
    x, df = table
    v = neighbours.Vectors(df)
    one = neighbours.Centres(np.ones((1, 64), np.float32) / 8)
    first, parts = v.parts(one, 400)
    assert first.tolist() == [0] and parts.tolist() == [4]
    with mock.patch.object(v, "centres", lambda shard: one):
        near = {(r["a"], r["b"]) for r in neighbours.close_pairs(v, shard=400).collect()}
    want, _ = truth(x, 5, 0.85)
    assert len({p for p in near if p[1] < 5000} & want) / len(want) >= 0.99


def test_empty(table):
    _, df = table
    assert neighbours.found(df.limit(0)).count() == 0
    assert neighbours.most_similar(neighbours.Vectors(df.limit(0)), df.select(F.col("chunk_id").alias("id"))).count() == 0
