import random
from unittest import mock

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import leakage, shared_spans
from foliospark.llm.identity import numbered
from foliospark.llm.rolling import Windows, anchors, sliding_min


def test_fm_index_against_scanning():
    rng = np.random.default_rng(0)
    for _ in range(150):
        seq = np.append(rng.integers(0, 4, rng.integers(1, 80)), 0)
        index = leakage.FmIndex(seq, 4)
        phrases = rng.integers(1, 4, (15, 3))
        for p, a, b in zip(phrases, *index.search(phrases), strict=True):
            assert sorted(index.locate(np.arange(a, b))) == [i for i in range(len(seq) - 2) if list(seq[i : i + 3]) == list(p)]


def test_leaks(spark):
    item = "One two three four five six seven eight nine ten eleven GRÖßE thirteen"
    docs = spark.createDataFrame(
        [
            (1, "Intro. " + item.upper().replace(" ", ", ") + " end", 5), (1, "Intro. " + item.upper().replace(" ", ", ") + " end", 6), (2, item.replace("seven", "7"), 5), (3, None, 5), (4, "", 5),
            (5, item.split(" ", 1)[1] + " x " + item, 5), (None, item, 5), (6, "w " * 200_000 + item, 5),
        ],
        "doc_id bigint, text string, item_id int",
    )
    items = spark.createDataFrame([(10, item, 1), (11, item + " more", 1), (12, "too short", 1), (13, None, 1), (10, item, 2)], "item_id bigint, text string, doc_id int")
    got = sorted(map(tuple, leakage.found(docs, items).collect()))
    assert got == [(d, i) for d in (1, 5, 6) for i in (10, 11)]
    spans = leakage.removal_spans(docs, items).where("doc_id = 1").collect()
    assert [(r["char_start"], list(r["item_ids"])) for r in spans] == [(7, [10, 11])]
    assert leakage.found(docs.limit(0), items).count() == 0 and leakage.found(docs, items.limit(0)).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(leakage, "MAX_WORDS", 13)
    texts = [" ".join(f"w{k}x{j}" for j in range(12)) for k in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(map(tuple, leakage.found(docs, docs.toDF("item_id", "text")).collect())) == [(0, 0), (1, 1), (2, 2)]


def test_windows():
    w = Windows(["abcdefgabc", "xabc", "", "ab"])
    h = w.hashes(3)
    assert h[0] == h[7] == h[11] and len(set(h[:7])) == 7
    assert list(w.inside(3)) == [True] * 8 + [False] * 2 + [True] * 2 + [False] * 2
    x = np.array([5, 3, 8, 1, 9, 2, 7], np.uint64)
    assert list(sliding_min(x, 3)) == [min(x[k : k + 3]) for k in range(5)]
    shared = "".join(random.Random(1).choices("abcdef ", k=300))
    a, b = Windows(["zz" + shared + "yy"]), Windows(["q" * 57 + shared])
    assert anchors(a, 128, 173)[0][2] - 2 == anchors(b, 128, 173)[0][57] - 57


def brute(texts, length):
    sets = {k: {t[p : p + length] for p in range(len(t) - length + 1)} for k, t in texts.items() if t}
    return sorted((a, b) for a in sets for b in sets if a < b and sets[a] & sets[b])


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_against_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choices("abcdefgh é中", k=n))
    pool = [word(n) for n in (299, 300, 301, 450, 900)]
    closing = word(250)
    texts = {}
    for k in range(40):
        parts = [word(rng.randint(0, 200)) for _ in range(2)] + rng.sample(pool, rng.randint(0, 2)) + ([closing] if rng.random() < 0.5 else [])
        rng.shuffle(parts)
        texts[k] = "".join(parts)
    texts |= {100: texts[3], 101: texts[3], 102: None, 103: "", 104: "x" * 299, 105: "ab" * 400, 106: "ab" * 300}
    rows = [(k, t, "c") for k, t in texts.items()] + [(3, texts[3], "d"), (None, texts[3], "d")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, key string")
    op = shared_spans.SharedSpans(df)
    assert sorted(map(tuple, op.pairs().collect())) == brute(texts, 300)
    cover = {r["doc_id"]: r for r in op.coverage().collect()}
    assert cover[100]["share"] == 1.0 and cover[100]["n_copies"] >= 3
    for k, t in texts.items():
        if not t or len(t) < 300:
            continue
        others = {o[p : p + 300] for j, o in texts.items() if o and j != k for p in range(len(o) - 299)}
        marked = set()
        for p in range(len(t) - 299):
            if t[p : p + 300] in others:
                marked |= set(range(p, p + 300))
        assert cover[k]["shared_chars"] == len(marked)
    spans = op.spans().collect()
    by_class = {}
    for r in spans:
        assert r["length"] >= 300
        by_class.setdefault(r["class_id"], []).append(texts[r["doc_id"]][r["start"] : r["start"] + r["length"]])
    assert all(len({t[:300] for t in of}) == 1 and len(of) > 1 for of in by_class.values())
    linked = {tuple(sorted((a["doc_id"], b["doc_id"]))) for a in spans for b in spans if a["class_id"] == b["class_id"] and texts[a["doc_id"]] != texts[b["doc_id"]]}
    assert linked == {p for p in brute(texts, 300) if texts[p[0]] != texts[p[1]]}


def test_numbers_of_values(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id int, text string")
    got = {r["id"]: r["n"] for r in numbered(df, F.col("text"), "n").collect()}
    assert got[1] == got[3] != got[2]
    one = F.lit(5).cast("bigint")  # all values meet in the first hash
    with mock.patch.object(F, "xxhash64", lambda *c: one if len(c) == 1 else F.hash(*c).cast("bigint")):
        got = {r["id"]: r["n"] for r in numbered(df, F.col("text"), "n").collect()}
    assert got[1] == got[3] != got[2]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert shared_spans.found(df).count() == 0


def test_coverage_has_every_record(spark):
    long = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(400))
    df = spark.createDataFrame([(1, long), (2, long), (3, "short"), (4, "short"), (5, None), (6, ""), (None, long), (3, "short")], "doc_id bigint, text string")
    got = sorted(tuple(r) for r in shared_spans.SharedSpans(df).coverage().collect())
    assert got == [(1, 2, 400, 400, 1.0), (2, 2, 400, 400, 1.0), (3, 2, 5, 0, 0.0), (4, 2, 5, 0, 0.0), (5, 1, 0, 0, None), (6, 1, 0, 0, None)]


def test_filter_before_the_join_loses_nothing(spark):
    docs = spark.range(-3000, 3000).select((F.col("id") * 7919 * 104729).alias("text_id"), F.lit("x").alias("text"))
    some = docs.where("text_id % 7 = 0")
    kept = shared_spans._may_be_in(docs, some)
    assert some.join(kept, "text_id", "left_anti").count() == 0 and kept.count() < 1.02 * some.count() and kept.columns == docs.columns
