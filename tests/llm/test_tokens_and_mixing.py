import base64
import random
from pathlib import Path

import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.llm import bpe, labels, mixing, tokens


def reference():
    lines = Path(tokens.VOCABULARY).read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


ENCODING = reference()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab e\n\t  '.1é中ж😀 "), st.characters(codec="utf-8")), max_size=80))
def test_counts_are_exact(text):
    assert bpe.load(tokens.VOCABULARY, tokens.PATTERN).count(text) == len(ENCODING.encode_ordinary(text))


def extractions(spark, rows):
    return spark.createDataFrame(
        rows, "extraction_id bigint, collection_id bigint, content string, mime_type string, metadata struct<language: string>, detected_languages array<string>, source string"
    )


def test_budget(spark):
    rows = [
        (1, 1, "two words", "Text/Plain; charset=x", ("de_AT",), None, "clash"), (1, 1, "two words", "Text/Plain; charset=x", ("de_AT",), None, "clash"),
        (2, None, None, None, (None,), ["eng"], ""), (3, 9, "x" * 50_000, "", ("??",), [], None), (None, 1, "a", "a/b", None, None, None),
    ]
    c = spark.createDataFrame([(1, "s", None), (1, "s", None)], "collection_id bigint, source string, domain string")
    out = tokens.token_budget(extractions(spark, rows), c).collect()
    total = [r for r in out if r["level"] == 15]
    assert len(total) == 1 and total[0]["n_records"] == 4
    assert total[0]["n_tokens"] == sum(len(ENCODING.encode_ordinary(t)) for t in ("two words", "x" * 50_000, "a"))
    leaf = {(r["source"], r["domain"], r["language"], r["mime_type"]): r["n_tokens"] for r in out if r["level"] == 0}
    assert leaf["s", "(missing)", "deu", "text/plain"] == 2 and leaf["(missing)", "(missing)", "eng", "(missing)"] == 0
    assert tokens.token_budget(extractions(spark, []), c).where("level = 0").count() == 0


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ("EN", "en-GB", "zh_Hans", "German", "und", "", None)], "l string")
    assert [r[0] for r in df.select(labels.language_code(F.col("l"))).collect()] == ["eng", "eng", "zho", "deu", None, None, None]
    df = spark.createDataFrame([(" Web  Capture",), ("web-capture ",)], "s string")
    assert {r[0] for r in df.select(labels.source_name(F.col("s"))).collect()} == {"web_capture"}


def test_sainte_lague():
    assert mixing.sainte_lague({"a": 53, "b": 24, "c": 23}, 7) == {"a": 3, "b": 2, "c": 2}
    assert mixing.sainte_lague({"a": 0.9, "b": 0.1}, 10, {"a": 2}) == {"a": 2, "b": 8}
    assert mixing.sainte_lague({"a": 1.0}, 5, {"a": 3}) == {"a": 3} and mixing.sainte_lague({}, 3) == {}


def test_mix(spark):
    docs = [(k, f"word {k} " * 20, "Big Source" if k % 3 else "small", "x") for k in range(300)] + [(0, "word 0 " * 20, "small", "y"), (900, None, "small", None), (901, "", None, None), (None, "abc", "small", None)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, n_tokens string")
    t = spark.createDataFrame([("big_source", 0.3, 1), ("small", 0.65, 3), ("none", 0.05, 9)], "source string, target_share double, max_repeats int")
    m = mixing.mix(d, t, blocks=500, shard_tokens=2000)
    shares = {r["source"]: r for r in m.shares.collect()}
    assert abs(shares["big_source"]["actual_share"] - 0.3 / 0.95) < 0.03 and shares["none"]["source_tokens"] == 0 and not shares["none"]["reachable"] and shares["small"]["reachable"]
    chosen = m.chosen.collect()
    assert len({r["doc_id"] for r in chosen}) == len(chosen) and max(r["repeats"] for r in chosen if r["source"] == "small") <= 3 and all(r["repeats"] == 1 for r in chosen if r["source"] == "big_source")
    assert [r[0] for r in mixing.found(d, t).collect()] == ["none"]
    assert mixing.mix(d.limit(0), t).shares.count() == 3


def test_blocks_of_shards():
    assert mixing.shard_seats({0: 53, 1: 24, 2: 23}, 7, 10, 2) == {0: 30, 1: 20, 2: 20}
    assert mixing.shard_seats({0: 15, 1: 15}, 3, 10, 1) == {0: 15, 1: 15}
    assert mixing.shard_seats({0: 5}, 9, 10, 1) == {0: 5} and mixing.shard_seats({}, 2, 10, 1) == {}


def test_whole_quota_is_dealt_to_shards(spark):
    d = spark.createDataFrame([(k, "word " * 3, "a") for k in range(400)], "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    one = mixing.mix(d, t, blocks=400, shard_tokens=10**9, total_tokens=600).shares.first()
    many = mixing.mix(d, t, blocks=400, shard_tokens=9, total_tokens=600).shares.first()
    assert one["quota_tokens"] == many["quota_tokens"] and abs(one["used_tokens"] - one["quota_tokens"]) <= 4
    assert mixing.mix(d, t, blocks=400, shard_tokens=9).chosen.count() == 400


def test_quotas_and_blocks(spark):
    d = spark.createDataFrame([(k, "word " * (k % 7), "a" if k % 4 else "b") for k in range(600)], "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    m = mixing.mix(d, t, blocks=60, shard_tokens=150, size=F.length("text"))
    shares = {r["source"]: r for r in m.shares.collect()}
    quotas = m.quotas.groupBy("source").agg(F.sum("shard_quota").alias("q"), F.count("*").alias("n")).collect()
    assert len(quotas) == 2 and all(r["q"] == shares[r["source"]]["quota_tokens"] and r["n"] > 1 for r in quotas)
    blocks = m.blocks.collect()
    assert {r["source"]: r["n"] for r in m.blocks.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("n")).collect()} == {s: r["used_tokens"] for s, r in shares.items()}
    assert all(r["repeats"] <= (1 if r["source"] == "a" else 3) for r in blocks) and sum(r["n_documents"] for r in blocks) == m.chosen.count()
    again = mixing.mix(d.repartition(7), t, blocks=60, shard_tokens=150, size=F.length("text")).chosen
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, m.chosen.collect()))


def test_unreachable_sources():
    rng = random.Random(4)
    for _ in range(200):
        names = "abcdefgh"[: rng.randint(1, 8)]
        w = [rng.random() ** 3 for _ in names]
        weights = {s: x / sum(w) for s, x in zip(names, w, strict=True)}
        have = {s: rng.choice([0, 3, 50, 1000, 20_000, rng.randint(0, 5000)]) for s in names}
        repeats = {s: rng.randint(0, 4) for s in names}
        total = sum(have.values()) + rng.randint(0, 99)
        assert mixing.unreachable(weights, have, repeats, total, rng.choice([1, 10, 1000])) == {s for s in names if have[s] * repeats[s] < weights[s] * total}
    assert mixing.unreachable({}, {}, {}, 0, 10) == set()
