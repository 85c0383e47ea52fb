"""Keywords of documents by kernels: RAKE and YAKE."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.stopwords import label_code, stopwords
from foliospark.functions.text import word_count
from foliospark.session import ship_package

#: Texts of fewer words have no keywords.
LEAST_WORDS = 10
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


#: Words and single other signs of a text in lower case.
RAKE_TOKEN = regex.compile(r"[\p{L}\p{N}]+|[^\p{L}\p{N} ]")


def phrase_scores(text: str, stop: frozenset[str], top: int, longest: int) -> list[tuple[str, float]]:
    """Phrases between stop words and other signs with their scores, degree over frequency of their words, 0 to 1; the best first."""
    phrases: list[list[str]] = [[]]
    for w in RAKE_TOKEN.findall(text):
        if w in stop or not w[0].isalnum() and not regex.match(r"[\p{L}\p{N}]", w):
            if phrases[-1]:
                phrases.append([])
        else:
            phrases[-1].append(w)
    if not phrases[-1]:
        phrases.pop()
    count, degree = Counter(), Counter()
    for p in phrases:
        for w in p:
            count[w] += 1
            degree[w] += len(p)
    raw = {" ".join(p): sum(degree[w] / count[w] for w in p) for p in phrases if len(p) <= longest}
    return _scaled(raw, top, 0.0)


def rake_phrases(df: DataFrame, id_col: str, text_col: str, language: Column | None = None, top: int = 10, longest: int = 3) -> DataFrame:
    """RAKE: phrases between stop words and punctuation, scored by degree over frequency of their words, 0 to 1 in each document.

    id, keyword, score, rank. Words are runs of letters and digits of any script; the stop words are those of ``language``
    (a label), English ones where it is null or has none. Ties go to the smaller phrase. Null texts and texts of fewer
    than ten words have none. Row by row, so nothing is shuffled.
    """
    ship_package(df.sparkSession)
    label = F.lit(None).cast("string") if language is None else language

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lists: dict[str | None, frozenset[str]] = {}
        for batch in batches:
            rows = []
            for doc, text, code in zip(batch["id"], batch["t"], batch["language"], strict=True):
                if code not in lists:
                    lists[code] = frozenset(stopwords(label_code(code)))
                rows += [(doc, k, round(s, 9), r) for r, (k, s) in enumerate(phrase_scores(text, lists[code], top, longest), 1)]
            yield pd.DataFrame(rows, columns=["id", "keyword", "score", "rank"])

    source = df.select(df[id_col].alias("id"), F.lower(df[text_col]).alias("t"), label.alias("language")).where(word_count(F.col("t")) >= LEAST_WORDS)
    return source.mapInPandas(run, "id bigint, keyword string, score double, rank int")


def rake(text: str, language: str = "en", top: int = 10, longest: int = 3, least: float = 0.0) -> list[tuple[str, float]]:
    """RAKE of one text; a text without phrases in another language is tried with the English stop words."""
    for code in dict.fromkeys((language, "en")):
        stop = set(stopwords(code))
        phrases: list[list[str]] = []
        for part in re.split(r"[^\w\s'’-]|\n", text.lower()):
            run: list[str] = []
            for w in [*_WORD.findall(part), None]:
                if w is None or w in stop:
                    if run:
                        phrases.append(run)
                    run = []
                else:
                    run.append(w)
        if phrases:
            break
    count, degree = Counter(), Counter()
    for p in phrases:
        for w in p:
            count[w] += 1
            degree[w] += len(p)
    raw = {" ".join(p): sum(degree[w] / count[w] for w in p) for p in phrases if len(p) <= longest}
    return _scaled(raw, top, least)


def _scaled(raw: dict[str, float], top: int, least: float) -> list[tuple[str, float]]:
    if not raw:
        return []
    low, high = min(raw.values()), max(raw.values())
    scores = {k: 1.0 if high == low else (v - low) / (high - low) for k, v in raw.items()}
    return sorted(((k, s) for k, s in scores.items() if s >= least), key=lambda x: (-x[1], x[0]))[:top]


def yake(text: str, language: str = "en", top: int = 10, longest: int = 3, window: int = 2, least: float = 0.0) -> list[tuple[str, float]]:
    """YAKE of one text: casing, position, frequency, relatedness and spread of terms; the score is 1 / (1 + raw), higher is better."""
    stop = set(stopwords(language))
    sentences = [_WORD.findall(s) for s in re.split(r"(?<=[.!?])\s+|\n+", text)]
    sentences = [s for s in sentences if s]
    count, upper, acronym = Counter(), Counter(), Counter()
    where: dict[str, set[int]] = defaultdict(set)
    left: dict[str, Counter] = defaultdict(Counter)
    right: dict[str, Counter] = defaultdict(Counter)
    for k, s in enumerate(sentences):
        for j, w in enumerate(s):
            t = w.lower()
            count[t] += 1
            where[t].add(k)
            acronym[t] += len(w) > 1 and w.isupper()
            upper[t] += w[:1].isupper() and j > 0
            for o in s[max(0, j - window) : j]:
                left[t][o.lower()] += 1
                right[o.lower()][t] += 1
    content = [count[t] for t in count if t not in stop]
    if not content:
        return []
    mean = sum(content) / len(content)
    sd = math.sqrt(sum((c - mean) ** 2 for c in content) / len(content))
    most = max(count.values())
    weight = {}
    for t, n in count.items():
        case = max(acronym[t], upper[t]) / (1 + math.log(n))
        spots = sorted(where[t])
        position = math.log(math.log(3 + spots[len(spots) // 2]))
        ways = [len(x[t]) / sum(x[t].values()) if x[t] else 0.0 for x in (left, right)]
        related = 1 + sum(ways) * n / most
        spread = len(where[t]) / len(sentences)
        weight[t] = related * position / (case + n / (mean + sd + 1e-9) / related + spread / related + 1e-9)
    raw: dict[str, float] = {}
    seen: Counter[str] = Counter()
    for s in sentences:
        low = [w.lower() for w in s]
        for j in range(len(low)):
            for n in range(1, longest + 1):
                part = low[j : j + n]
                if len(part) == n and part[0] not in stop and part[-1] not in stop and not all(p.isdigit() for p in part):
                    seen[" ".join(part)] += 1
    for phrase, n in seen.items():
        terms = [weight[w] for w in phrase.split() if w not in stop]
        raw[phrase] = math.prod(terms) / (n * (1 + sum(terms)))
    ranked = sorted(raw.items(), key=lambda x: (x[1], x[0]))[:top]
    return [(k, 1 / (1 + v)) for k, v in ranked if 1 / (1 + v) >= least]


def keywords(df: DataFrame, id_col: str, text_col: str, algorithm: str = "yake", language: str = "en", top: int = 10) -> DataFrame:
    """Keywords of every text by a kernel: id, keyword, score, rank. Null texts and texts of fewer than ten words have none."""
    ship_package(df.sparkSession)
    pick = {"yake": yake, "rake": rake}[algorithm]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["id"], batch["text"], strict=True):
                rows += [(doc, k, float(s), r) for r, (k, s) in enumerate(pick(text, language, top), 1)]
            yield pd.DataFrame(rows, columns=["id", "keyword", "score", "rank"])

    source = df.select(df[id_col].alias("id"), df[text_col].alias("text")).where(word_count(F.col("text")) >= LEAST_WORDS)
    return source.mapInPandas(run, "id bigint, keyword string, score double, rank int")


def relevance(extracted: list[str], truth: list[str]) -> tuple[float, float, float]:
    """Precision, recall and F1 of keywords: equal, contained, or at least half of the words in common."""

    def same(a: str, b: str) -> bool:
        a, b = a.lower(), b.lower()
        words = set(b.split())
        return a == b or a in b or b in a or len(set(a.split()) & words) * 2 >= len(words) > 0

    hit = sum(any(same(e, t) for t in truth) for e in extracted)
    met = sum(any(same(e, t) for e in extracted) for t in truth)
    p, r = hit / len(extracted) if extracted else 0.0, met / len(truth) if truth else 0.0
    return p, r, 2 * p * r / (p + r) if p + r else 0.0
