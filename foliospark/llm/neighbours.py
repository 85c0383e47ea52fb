"""Most similar vectors by cosine, through robust-pruned directed graphs over shards.

Bounded samples give the centres of the shards, at two levels where there are many. Every vector is indexed in the shard
of its nearest centre; shards are counted, and those over their bound are split. One task builds the graph of one part
and answers its queries by beam search: every query goes to all parts of the shards of its nearest centres.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.llm.graph import Graph
from foliospark.llm.identity import numbered
from foliospark.session import ship_package, stage

#: Vectors of the sample that centres are fitted on (at most twice as many are read), and of one shard.
SAMPLE, SHARD = 20_000, 24_000
#: Vectors of the sample that a centre is to have at least, on average; above that, centres are fitted at two levels.
PER_CENTRE = 16
#: Rounds of the fit of the centres.
_ROUNDS = 8


def _centres(sample: np.ndarray, total: int, shard: int, seed: int = 5) -> np.ndarray:
    """Centres of cells that hold about ``shard`` vectors each, by splitting of every cell that holds too many."""
    rng = np.random.default_rng(seed)
    per = total / max(1, len(sample))
    out: list[np.ndarray] = []
    todo = [(sample, True)]
    while todo:
        cell, first = todo.pop()
        parts = math.ceil(len(cell) * per / shard)
        if parts <= 1 or len(cell) < 4 or (not first and len(cell) * per <= 2 * shard):
            mean = cell.mean(0) if len(cell) else np.zeros(sample.shape[1], np.float32)
            out.append(mean / (np.linalg.norm(mean) or 1))
            continue
        parts = min(parts, 256, len(cell) // 2)
        centres = cell[rng.choice(len(cell), parts, replace=False)]
        for _ in range(_ROUNDS):
            own = np.argmax(cell @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, cell)
            norms = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centres)
        own = np.argmax(cell @ centres.T, axis=1)
        cells = [cell[own == j] for j in range(parts)]
        if max(map(len, cells)) == len(cell):  # all alike
            out.append(centres[own[0]])
            continue
        todo += [(c, False) for c in cells if len(c)]
    return np.array(out, np.float32)


def _unit(column: pd.Series) -> np.ndarray:
    x = np.array(column.to_list(), np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _matrix(column: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(-1, dim)


class Centres:
    """Centres of the shards; where there are many, grouped into the cells of centres of a higher level."""

    def __init__(self, centres: np.ndarray, tops: np.ndarray | None = None, cell: np.ndarray | None = None):
        self.centres, self.tops, self.cell = centres, tops, cell

    def __len__(self) -> int:
        return len(self.centres)

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest centres of each row, the nearest first; -1 where there are fewer."""
        n = min(n, len(self.centres))
        if self.tops is None:
            return self._best(x @ self.centres.T, np.arange(len(self.centres)), n)
        wide = min(max(4, n), len(self.tops))
        cells = np.argpartition(-(x @ self.tops.T), wide - 1, axis=1)[:, :wide]
        sims, found = np.full((len(x), wide * n), -2.0, np.float32), np.full((len(x), wide * n), -1, np.int64)
        for c in np.unique(cells):
            own = np.flatnonzero(self.cell == c)
            rows, turn = np.nonzero(cells == c)
            if not len(own):
                continue
            s = x[rows] @ self.centres[own].T
            m = min(n, len(own))
            best = self._best(s, np.arange(len(own)), m)
            at = turn[:, None] * n + np.arange(m)
            sims[rows[:, None], at], found[rows[:, None], at] = np.take_along_axis(s, best, 1), own[best]
        order = np.argsort(-sims, axis=1, kind="stable")[:, :n]
        return np.take_along_axis(found, order, 1)

    @staticmethod
    def _best(sims: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
        top = np.argpartition(-sims, n - 1, axis=1)[:, :n]
        order = np.argsort(-np.take_along_axis(sims, top, 1), axis=1, kind="stable")
        return ids[np.take_along_axis(top, order, 1)]


class Vectors:
    """Usable vectors of a table: not null, of the given dimension, with finite values and a norm above zero.

    Rows that repeat an id count once (which of different vectors of one id holds is not defined); ids that have the same
    vector share one node. Null ids are ignored, as are other columns, whatever their names.
    """

    def __init__(self, df: DataFrame, id_col: str = "chunk_id", vector_col: str = "embedding", dim: int = 64, sample: int = SAMPLE):
        ship_package(df.sparkSession)
        self.dim, self.sample = dim, sample
        v = F.col("v")
        norm = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(float("nan"))) * x.cast("double"))
        rows = df.select(df[id_col].alias("id"), df[vector_col].cast("array<float>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") == dim))
        rows = rows.withColumn("norm", norm).where((F.col("norm") > 0) & ~F.isnan("norm") & (F.col("norm") < float("inf"))).select("id", "v")
        rows = numbered(rows, F.col("v"), "node")
        self.members = rows.groupBy("id").agg(F.min("node").alias("node"))
        self.nodes = stage(rows.select("node", "v").dropDuplicates(["node"]), "vectors")
        self.total = self.nodes.count()

    def centres(self, shard: int) -> Centres:
        """Centres of shards of about ``shard`` vectors."""
        keep = min(1.0, self.sample / max(1, self.total))
        part = self.nodes.where(F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(1_000_000_007)) < int(keep * 1_000_000_007)).limit(2 * self.sample)
        found = part.orderBy("node").select("v").toPandas()["v"]
        if not len(found):
            return Centres(np.zeros((1, self.dim), np.float32))
        x, wanted = _unit(found), self.total / shard
        if wanted * PER_CENTRE <= len(x):
            return Centres(_centres(x, self.total, shard))
        return self._two_levels(_centres(x, self.total, int(self.total / math.sqrt(wanted))), shard)

    def _two_levels(self, tops: np.ndarray, shard: int) -> Centres:
        """Centres inside the cell of each top centre, each cell's on a bounded sample of its own."""
        route, sample = Centres(tops), self.sample

        def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    x = _unit(batch["v"])
                    yield pd.DataFrame({"cell": route.nearest(x, 1)[:, 0].astype(np.int32), "node": batch["node"], "x": [r.tobytes() for r in x]})

        def fit(cell: pd.DataFrame) -> pd.DataFrame:
            c = _centres(_matrix(list(cell["x"]), tops.shape[1]), int(cell["n"].iloc[0]), shard)
            return pd.DataFrame({"cell": np.full(len(c), cell["cell"].iloc[0], np.int32), "centre": [r.tobytes() for r in c]})

        rows = self.nodes.mapInPandas(cells, "cell int, node bigint, x binary")
        sizes = rows.groupBy("cell").agg(F.count("*").alias("n"))
        some = F.pmod(F.xxhash64(F.lit(4), "node"), F.lit(1_000_000_007)) < F.lit(1_000_000_007.0 * sample) / F.col("n")
        fitted = rows.join(F.broadcast(sizes), "cell").where(some).groupBy("cell").applyInPandas(fit, "cell int, centre binary")
        got = fitted.orderBy("cell").collect()  # a row a shard
        return Centres(_matrix([bytes(r["centre"]) for r in got], self.dim), tops, np.array([r["cell"] for r in got]))

    def parts(self, centres: Centres, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """The first part and the number of parts of each shard, so that none holds much more than ``shard`` vectors."""

        def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield pd.DataFrame({"shard": centres.nearest(_unit(batch["v"]), 1)[:, 0].astype(np.int32)})

        sizes = np.zeros(len(centres), np.int64)
        for r in self.nodes.mapInPandas(own, "shard int").groupBy("shard").count().collect():  # a row a shard
            sizes[r["shard"]] = r["count"]
        parts = np.maximum(1, np.ceil(sizes / (1.5 * shard)).astype(np.int64))
        return np.cumsum(parts) - parts, parts

    def smallest(self, n: int) -> DataFrame:
        """The n smallest ids of each node, ranked in parts first, since one vector may have many ids: node, id."""
        part = Window.partitionBy("node", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
        some = self.members.withColumn("r", F.row_number().over(part)).where(F.col("r") <= n)
        rank = F.row_number().over(Window.partitionBy("node").orderBy("id"))
        return some.withColumn("r", rank).where(F.col("r") <= n).select("node", "id")


def search(vectors: Vectors, k: int, queries: DataFrame | None = None, probes: int = 2, shard: int = SHARD, beam: int = 20, least: float = -2.0, degree: int = 20, building: int = 24) -> DataFrame:
    """The k most similar other nodes of every node (of those of ``queries``, with the column node): node, other, similarity.

    Beam search of all parts of the shards of the ``probes`` nearest centres (of all, if 0); similarities below ``least`` are left out.
    """
    dim = vectors.dim
    centres = vectors.centres(shard)
    first, parts = vectors.parts(centres, shard)
    asks_all, probes = queries is None, probes or len(centres)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = _unit(batch["v"])
            node, asks = batch["node"].to_numpy(), batch["asks"].to_numpy()
            near = centres.nearest(x, probes)
            own = first[near[:, 0]] + (node >> 7) % parts[near[:, 0]]
            row, part = [np.arange(len(x))], [own]  # the index; then the queries of every other part
            for c in near.T:
                for j in range(int(parts[c].max())):
                    to = first[c] + j
                    r = np.flatnonzero(asks & (c >= 0) & (j < parts[c]) & (to != own))
                    row.append(r)
                    part.append(to[r])
            late = np.concatenate([np.full(len(r), k > 0) for k, r in enumerate(row)])
            row, part = np.concatenate(row), np.concatenate(part)
            data = [r.tobytes() for r in x]
            yield pd.DataFrame({"part": part.astype(np.int32), "late": late, "asks": asks[row], "node": node[row], "x": [data[r] for r in row]})

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        graph: Graph | None = None
        nodes = np.zeros(0, np.int64)

        def asked(node: np.ndarray, x: np.ndarray) -> Iterator[pd.DataFrame]:
            for at in range(0, len(node), 512):
                found, sims = graph.search(x[at : at + 512], max(beam, k + 1))
                found, sims = found[:, : k + 1], sims[:, : k + 1]
                r, c = np.nonzero((found >= 0) & (sims >= least - 1e-6))
                one, other = node[at : at + 512][r], nodes[found[r, c]]
                yield pd.DataFrame({"node": one, "other": other, "similarity": sims[r, c].astype(np.float64)})[one != other]

        def build() -> Iterator[pd.DataFrame]:
            nonlocal graph, nodes
            rows = pd.concat(held)
            x, nodes = _matrix(list(rows["x"]), dim), rows["node"].to_numpy()
            graph = Graph(x, degree=degree, beam=building)
            some = np.flatnonzero(rows["asks"].to_numpy())
            yield from asked(nodes[some], x[some])

        for batch in batches:  # the index comes first
            late = batch["late"].to_numpy()
            if graph is None and not late.all():
                held.append(batch[~late])
            if not late.any():
                continue
            if graph is None:
                if not held:  # a part that hashing left empty
                    continue
                yield from build()
                held.clear()
            batch = batch[late]
            yield from asked(batch["node"].to_numpy(), _matrix(list(batch["x"]), dim))
        if graph is None and held:
            yield from build()

    if asks_all:
        nodes = vectors.nodes.withColumn("asks", F.lit(True))
    else:
        nodes = vectors.nodes.join(queries.select("node").distinct().withColumn("asks", F.lit(True)), "node", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    rows = nodes.mapInPandas(route, "part int, late boolean, asks boolean, node bigint, x binary")
    rows = rows.repartitionById(int(parts.sum()), "part").sortWithinPartitions("late")
    met = rows.mapInPandas(answer, "node bigint, other bigint, similarity double").where(F.col("similarity") >= least)
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("similarity"), "other"))  # probes * parts * k rows at most
    return met.withColumn("r", best).where(F.col("r") <= k).select("node", "other", "similarity")


def _of_ids(vectors: Vectors, met: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k most similar other ids of each id (column id, node) by the similar nodes: x, y, similarity, r. Ties go to the smaller id."""
    several = vectors.smallest(k + 1).toDF("other", "y")  # of ids with one vector, only these can be among anyone's k most similar
    own = several.select(F.col("other").alias("node"), "other", F.lit(1.0).alias("similarity")).distinct()
    rows = asked.withColumnRenamed("id", "x").join(met.unionByName(own), "node").join(several, "other").where("x != y")
    top = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("similarity"), "y"))
    return rows.select("x", "y", "similarity").withColumn("r", top).where(F.col("r") <= k)


def close_pairs(vectors: Vectors, least: float = 0.85, k: int = 5, probes: int = 2, shard: int = SHARD) -> DataFrame:
    """Pairs of ids with similarity of at least ``least`` where one is among the ``k`` most similar of the other: a, b, similarity.

    Ties go to the smaller id.
    """
    met = search(vectors, k + 1, probes=probes, shard=shard, least=least)
    rows = _of_ids(vectors, met, vectors.members, k)
    return rows.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("similarity").alias("similarity"))


def most_similar(vectors: Vectors, queries: DataFrame, k: int = 10, probes: int = 0, shard: int = SHARD, beam: int = 128) -> DataFrame:
    """The k most similar other ids of each query id: query_id, rank, neighbour_id, similarity.

    ``queries`` has the column id. Every query searches the shards of its ``probes`` nearest centres, all shards if 0: where
    vectors form no clusters, the nearest of a query lie in many shards. Ties go to the smaller id; a query whose vector is not usable has no rows.
    """
    asked = vectors.members.join(queries.select("id").distinct(), "id")
    met = search(vectors, k + 1, asked, probes, shard, beam, degree=32, building=40)
    out = _of_ids(vectors, met, asked, k)
    return out.select(F.col("x").alias("query_id"), F.col("r").alias("rank"), F.col("y").alias("neighbour_id"), "similarity")


def found(chunks: DataFrame) -> DataFrame:
    """chunk_id_a, chunk_id_b of close pairs."""
    return close_pairs(Vectors(chunks)).select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def neighbours_of_every_20th(chunks: DataFrame, k: int = 10) -> DataFrame:
    """The k most similar chunks of every chunk whose id is divisible by 20, against all chunks."""
    return most_similar(Vectors(chunks), chunks.select(F.col("chunk_id").alias("id")).where("id % 20 = 0"), k)
