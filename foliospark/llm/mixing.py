"""Mixing of sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.llm import labels, tokens
from foliospark.session import ship_package, stage

#: Bound of the mixing table; it is planned on the driver.
MAX_SOURCES = 10_000


def sainte_lague(weights: dict, seats: int, limits: dict | None = None) -> dict:
    """Seats of each key by the highest quotients weight / (2 * seats + 1); ties go to the smaller key.

    A key gets no more seats than its limit. Seats that all limits together cannot take stay free.
    """
    limits = limits or {}
    out = dict.fromkeys(weights, 0)
    heap = [(-w, k) for k, w in weights.items() if w > 0 and limits.get(k, 1) > 0]
    heapq.heapify(heap)
    for _ in range(seats):
        if not heap:
            break
        _, key = heapq.heappop(heap)
        out[key] += 1
        if out[key] < limits.get(key, seats):
            heapq.heappush(heap, (-weights[key] / (2 * out[key] + 1), key))
    return out


def shard_seats(shards: dict[int, int], seats: int, block: int, max_repeats: int) -> dict[int, int]:
    """Tokens each shard of a source is to give: the source's blocks by Sainte-Laguë within max_repeats times each shard.

    A shard's limit is rounded down to whole blocks; blocks that no shard can take whole go, in order of the shards, to
    what is left of max_repeats times their sizes.
    """
    got = sainte_lague(shards, seats, {k: n * max_repeats // block for k, n in shards.items()})
    out = {k: n * block for k, n in got.items()}
    left = seats * block - sum(out.values())
    for k in sorted(out):
        more = min(left, shards[k] * max_repeats - out[k])
        out[k] += more
        left -= more
    return out


def unreachable(weights: dict[str, float], have: dict[str, int], repeats: dict[str, int], total: int, blocks: int) -> set[str]:
    """Sources that cannot reach their share of ``total``, from their seats without limits.

    A source is a candidate if its limit gives it no more blocks than the seats that it gets without limits (and one more
    for each source, as far as highest quotients can stray from a share); the sizes decide within the last blocks.
    """
    block = max(1, math.ceil(total / blocks))
    seats = sainte_lague(weights, math.ceil(total / block))
    near = {s for s in weights if have[s] * repeats[s] // block <= seats[s] + len(weights)}
    return {s for s in near if have[s] * repeats[s] < weights[s] * total}


@dataclass(frozen=True)
class Mix:
    """shares: one row a source; quotas: one row a shard of a source; blocks: one row a selected block; chosen: one row a chosen document with its repeats."""

    shares: DataFrame
    quotas: DataFrame
    blocks: DataFrame
    chosen: DataFrame


def mix(
    documents: DataFrame, targets: DataFrame, vocabulary: str = tokens.VOCABULARY, blocks: int = 10_000, shard_tokens: int = 4_000_000, seed: int = 7,
    total_tokens: int | None = None, size: Column | None = None,
) -> Mix:
    """Documents of several sources in target shares.

    The total (by default the size of all documents) is cut into ``blocks`` of equal tokens, which Sainte-Laguë deals to
    the sources within max_repeats times their sizes, and again to the shards of each source (a shard holds about
    ``shard_tokens``, so no task gets a whole large source). The documents of a shard, in a seeded order, are cut into
    blocks of the same size (a document is in the block that holds its middle); the shard's quota takes all of them as
    often as it fits, and then the first ones of the seeded order. A block is used at most max_repeats times.

    Sizes are tokens of ``vocabulary``, or those of the column ``size``. Null texts have no tokens and are never chosen.
    Documents of unknown or null sources count in the total only. Repeated doc_id rows count once. Sources of ``targets``
    without documents appear with size 0. Other columns are ignored.
    """
    spark = documents.sparkSession
    ship_package(spark)
    d = documents
    n_tokens = tokens.token_count(d["text"], vocabulary) if size is None else size
    sizes = d.select(d["doc_id"], labels.source_name(d["source"]).alias("source"), F.coalesce(n_tokens, F.lit(0)).cast("bigint").alias("n_tokens"))
    sizes = stage(sizes.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("r")).select("doc_id", "r.*"), "sizes")
    rows = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources to mix")
    plan = {r["source"]: r for r in rows if r["source"] is not None}
    total_all = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    by_source = dict(sizes.where(F.col("source").isin(list(plan))).groupBy("source").agg(F.sum("n_tokens")).limit(MAX_SOURCES).collect()) if plan else {}
    total = total_all if total_tokens is None else total_tokens
    block = max(1, math.ceil(total / blocks))
    have = {s: by_source.get(s) or 0 for s in plan}
    weights = {s: plan[s]["target_share"] or 0.0 for s in plan}
    repeats = {s: plan[s]["max_repeats"] or 0 for s in plan}
    quota = sainte_lague(weights, math.ceil(total / block), {s: have[s] * repeats[s] // block for s in plan})
    short = unreachable(weights, have, repeats, total_all, blocks)
    n_shards = {s: max(1, math.ceil(have[s] / shard_tokens)) for s in plan}
    planned_shards = spark.createDataFrame([(s, n) for s, n in n_shards.items()], "source string, shards int")
    shard = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), F.col("shards")).cast("int")
    sharded = sizes.where(F.col("n_tokens") > 0).join(planned_shards, "source").withColumn("shard", shard)
    held: dict[str, dict[int, int]] = {}  # a row a shard, about as many as there are shard_tokens in the input
    for r in sharded.groupBy("source", "shard").agg(F.sum("n_tokens").alias("n")).collect():
        held.setdefault(r["source"], {})[r["shard"]] = r["n"]
    dealt_to = [(s, k, of[k], n) for s, of in held.items() for k, n in shard_seats(of, quota[s], block, repeats[s]).items()]
    quotas = spark.createDataFrame(dealt_to, "source string, shard int, shard_tokens bigint, shard_quota bigint")

    planned = spark.createDataFrame(
        [(s, float(weights[s]), int(repeats[s]), int(have[s]), s not in short, int(quota[s] * block)) for s in plan],
        "source string, target_share double, max_repeats int, source_tokens bigint, reachable boolean, quota_tokens bigint",
    )
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    dealt = sharded.drop("shards").join(planned.select("source", "max_repeats"), "source").join(quotas, ["source", "shard"]).withColumn("order", order)
    running = Window.partitionBy("source", "shard").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.sum("n_tokens").over(running) - F.col("n_tokens") + F.floor(F.col("n_tokens") / 2)
    dealt = dealt.withColumn("block_no", F.floor(middle / block))
    whole = F.least(F.floor(F.col("shard_quota") / F.col("shard_tokens")), F.col("max_repeats").cast("bigint"))
    rest = F.round((F.col("shard_quota") - whole * F.col("shard_tokens")) / block)
    extra = F.when((whole < F.col("max_repeats")) & (F.col("block_no") < rest), 1).otherwise(0)
    picked = dealt.withColumn("repeats", (whole + extra).cast("int")).where("repeats > 0")
    taken = picked.groupBy("source", "shard", "block_no").agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("n_tokens"), F.max("repeats").alias("repeats"))
    chosen = picked.select("doc_id", "source", "n_tokens", "repeats")
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"))
    shares = planned.join(used, "source", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
    every = Window.partitionBy()  # one row a source
    shares = shares.withColumn("actual_share", F.col("used_tokens") / F.nullif(F.sum("used_tokens").over(every), F.lit(0)))
    return Mix(shares, quotas, taken, chosen)


def found(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Sources that cannot reach their share: their limit holds them below the seats that their share would get."""
    return mix(documents, targets).shares.where(~F.col("reachable")).select("source")


def planned_in_characters(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """The plan of a mix whose sizes are characters: source, size, quota in characters, and whether the share can be reached."""
    m = mix(documents, targets, size=F.length(documents["text"]))
    return m.shares.select("source", F.col("source_tokens").alias("n_chars"), F.col("quota_tokens").alias("quota_chars"), "reachable")
