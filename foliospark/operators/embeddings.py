"""Work on embeddings: normal length, pooling, similarity, and a hashed stand-in for a model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.session import ship_package

TINY = 1.1920929e-07


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def l2_normalize(v: Column) -> Column:
    """The vector at length 1; one of (nearly) no length stays, null stays null."""
    norm = F.sqrt(squared_norm(v))
    return F.when(norm <= TINY, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a side has no length."""
    size = F.sqrt(squared_norm(a)) * F.sqrt(squared_norm(b))
    return F.when(size > 0, dot(a, b) / size)


def mean_pool(states: Column, mask: Column) -> Column:
    """Mean of the token vectors that the mask (0 or 1 each) keeps; zeros where it keeps none."""
    kept = F.filter(F.zip_with(states, mask, lambda v, m: F.when(m > 0, v)), lambda v: v.isNotNull())
    n = F.greatest(F.size(kept), F.lit(1))
    zero = F.transform(states[0], lambda x: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda x: x / n)


def cls_pool(states: Column) -> Column:
    """The first token's vector."""
    return states[0]


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """Feature-hash stand-in for an embedding model: signed counts of lower-case words by hash, at length 1. Not a trained model."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(dim)).alias("k"), F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.aggregate(F.filter(slots, lambda x: x["k"] == k), F.lit(0.0), lambda a, x: a + x["s"]))
    return l2_normalize(raw)


def top_k_of_queries(df: DataFrame, id_col: str, vector_col: str, step: int = 20, k: int = 5, max_queries: int = 20_000) -> DataFrame:
    """Exact search: the k most similar rows of every row whose id is divisible by ``step``, against all rows.

    The query set is counted first and goes out in blocks of at most about ``max_queries`` vectors. Every task multiplies
    its rows with a block and keeps the k best of each query; the best of all tasks are ranked then. query_id, rank,
    neighbour_id, similarity (rounded to six places); ties go to the smaller id. Null and empty vectors take no part.
    """
    ship_package(df.sparkSession)
    rows = df.select(df[id_col].alias("id"), df[vector_col].cast("array<double>").alias("v")).where((F.size("v") > 0) & F.col("id").isNotNull())
    queries = rows.where(F.col("id") % step == 0)
    blocks = max(1, -(-queries.count() // max_queries))
    schema = "query_id bigint, neighbour_id bigint, similarity double"
    best = None
    for b in range(blocks):
        some = queries.where(F.pmod(F.hash("id"), F.lit(blocks)) == b).toPandas()
        part = rows.mapInPandas(_block_search(some["id"].to_numpy(np.int64), _at_length_one(some["v"]), k), schema)
        best = part if best is None else best.union(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbour_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "neighbour_id", "similarity")


def _at_length_one(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.to_list(), np.float64)
    if not len(x):
        return np.zeros((0, 1))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(norm <= TINY, x, x / np.maximum(norm, TINY))


def _block_search(ids: np.ndarray, q: np.ndarray, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame({"query_id": ids[:0], "neighbour_id": ids[:0], "similarity": np.zeros(0)})
        for batch in batches:
            for at in range(0, len(batch), 4096):
                other = batch["id"].iloc[at : at + 4096].to_numpy(np.int64)
                sims = np.round(q @ _at_length_one(batch["v"].iloc[at : at + 4096]).T, 6)
                sims[ids[:, None] == other[None, :]] = -9
                least = np.partition(sims, -min(k, len(other)), axis=1)[:, -min(k, len(other))]
                r, c = np.nonzero((sims >= least[:, None]) & (sims > -9))
                new = pd.DataFrame({"query_id": ids[r], "neighbour_id": other[c], "similarity": sims[r, c]})
                held = pd.concat((held, new)).sort_values(["query_id", "similarity", "neighbour_id"], ascending=[True, False, True]).groupby("query_id").head(k)
        yield held

    return run
