"""Repair of text from scanned pages: joins over line ends, misread words, running lines and page numbers.

Words that the corpus does not know get candidates through an inverted join over positional character q-grams with the
corpus vocabulary; gradient-boosted ranking, fitted on words misread on purpose, says which candidate (if any) replaces
the word. Classifiers over pairs of lines find running lines and words broken over line ends; another finds page numbers.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.boosting import Boosting
from foliospark.llm.scanlines import CONFUSIONS, HYPHENS, Page, fit_furniture, furniture, misread
from foliospark.session import ship_package, stage

#: Occurrences that make a word of the corpus known: so many at least, and this share of all words, since the larger the
#: corpus, the more often it has the same slip.
KNOWN, KNOWN_SHARE = 4, 2e-8
#: Bounds of the samples that the classifiers are fitted on.
SAMPLE_TEXTS, SAMPLE_WORDS = 250, 6000
_TOKEN = regex.compile(r"[^\s]+")
_OUTER = regex.compile(r"^[^\p{L}\p{N}@]+|[^\p{L}\p{N}@]+$")
_PLAIN = regex.compile(r"\p{L}+(?:['’]\p{L}+)*")
_MIXED = regex.compile(r"\p{Lu}{2,}\d\p{Lu}{2,}|\d\p{Ll}|\p{L}@|@\p{Ll}")
_HAN = regex.compile(r"\p{Han}")
_CODE = regex.compile(r"[\p{Lu}]{1,4}-?\d[\d.,/-]*|[\d.,:/%-]+")


def _core(token: str) -> str:
    return _OUTER.sub("", token)


def checked_words(token: str) -> list[str]:
    """The words of a token that may be misread, in lower case: none for codes, figures and Chinese.

    Of words in capitals only those that hold a figure between letters, and of words of two characters only those of a
    letter and a figure, since short forms and symbols have no other sign of a misreading.
    """
    core = _core(token)
    if len(core) < 2 or _CODE.fullmatch(core) or _HAN.search(core):
        return []
    parts = regex.split(r"[-‐‑/'’.,;:]", core)
    return [p.lower() for p in parts if any(c.isalpha() for c in p) and (len(p) >= 3 and not p[1:].isupper() and not core.isupper() or _MIXED.fullmatch(p))]


def _grams(word: str) -> list[str]:
    """Positional q-grams: of three characters, of two for short words."""
    w, q = f"^{word}$", 3 if len(word) > 4 else 2
    return [f"{w[k : k + q]}" for k in range(len(w) - q + 1)]


def _probe(word: str) -> set[str]:
    return {f"{g}{p}" for k, g in enumerate(_grams(word)) for p in range(max(0, k - 1), k + 2)}


def _index(word: str) -> set[str]:
    both = {f"{g}{k}" for k, g in enumerate(_grams(word))}
    if 4 <= len(word) <= 5:  # beside the limit of short words, under both lengths of gram
        w = f"^{word}$"
        both |= {f"{w[k : k + q]}{k}" for q in (2, 3) for k in range(len(w) - q + 1)}
    return both


_COST = {}
for _a, _b in CONFUSIONS:
    _COST[_a, _b] = 0.3


def reading_cost(word: str, seen: str) -> float:
    """Least cost of reading ``word`` as ``seen``: 0.3 for each usual misreading, 1 for any other change of a character."""
    n, m = len(word), len(seen)
    if abs(n - m) > 3:
        return 9.0
    a = 0
    while a < n and a < m and word[a] == seen[a]:
        a += 1
    a = max(0, a - 1)
    word, seen = word[a:], seen[a:]
    b = 0
    while b < len(word) and b < len(seen) and word[-1 - b] == seen[-1 - b]:
        b += 1
    b = max(0, b - 1)
    if b:
        word, seen = word[:-b], seen[:-b]
    n, m = len(word), len(seen)
    d = [[99.0] * (m + 1) for _ in range(n + 1)]
    d[0][0] = 0.0
    for i in range(n + 1):
        for j in range(max(0, i - 6), min(m, i + 6) + 1):  # farther off the diagonal, more than three characters differ
            here = d[i][j]
            if here >= 9:
                continue
            if i < n and j < m:
                d[i + 1][j + 1] = min(d[i + 1][j + 1], here + (word[i] != seen[j]))
            if i < n:
                d[i + 1][j] = min(d[i + 1][j], here + 1)
            if j < m:
                d[i][j + 1] = min(d[i][j + 1], here + 1)
            for p in (1, 2):
                for q in (1, 2):
                    c = _COST.get((word[i : i + p], seen[j : j + q])) if i + p <= n and j + q <= m else None
                    if c is not None and here + c < d[i + p][j + q]:
                        d[i + p][j + q] = here + c
    return d[n][m]


def _near(a: str, b: str) -> bool:
    """Whether two words differ within three characters only."""
    n, k = min(len(a), len(b)), 0
    while k < n and a[k] == b[k]:
        k += 1
    j = 0
    while j < n - k and a[-1 - j] == b[-1 - j]:
        j += 1
    return max(len(a), len(b)) - k - j <= 3


def pair_features(seen: str, word: str, count: float, shared: int, seen_count: float) -> list[float]:
    """Features of a candidate for a word that was seen."""
    odd = sum(not c.isalpha() for c in seen)
    return [
        reading_cost(word, seen), float(abs(len(word) - len(seen))), float(len(word)), float(np.log1p(count)), shared / max(1, len(_grams(seen))), float(odd),
        float(np.log1p(seen_count)), float(np.log1p(count) - np.log1p(seen_count)),
    ]


def fit_ranker(vocabulary: dict[str, int], seed: int = 3) -> Boosting:
    """Ranker fitted on words of the vocabulary: misread ones with their original (1) and other candidates (0), and words
    that are left out of the vocabulary, whose candidates are all wrong."""
    rng = random.Random(seed)
    words = sorted(vocabulary, key=lambda w: (-vocabulary[w], w))
    usual = [w for w in words[: SAMPLE_WORDS] if len(w) >= 3]
    index: dict[str, list[str]] = {}
    for w in usual:
        for g in _index(w):
            index.setdefault(g, []).append(w)

    def candidates(seen: str) -> dict[str, int]:
        hits: dict[str, int] = {}
        for g in _probe(seen):
            for w in index.get(g, ()):
                hits[w] = hits.get(w, 0) + 1
        return {w: n for w, n in hits.items() if w != seen and abs(len(w) - len(seen)) <= 2 and _near(w, seen)}

    x, y = [], []
    for k, w in enumerate(rng.sample(usual, min(len(usual), 2000))):
        if k % 2:
            seen = misread(w, rng)
            if seen == w or seen in vocabulary:
                continue
            if rng.random() < 0.15:
                seen = misread(seen, rng)
        else:  # a rare right word
            seen = w
        n = rng.choice([1, 1, 2, 3])
        for c, shared in candidates(seen).items():
            x.append(pair_features(seen, c, vocabulary[c], shared, n))
            y.append(k % 2 == 1 and c == w)
    if not x:
        x, y = [[9.0] + [0.0] * 7], [0]
    return Boosting(60).fit(np.array(x), np.array(y))


def join_features(left: str, right: str, joined: float, compound: float, c_left: float, c_right: float, soft: bool, known: float) -> list[float]:
    """Features of two lines' parts of a word."""
    return [
        float(np.log1p(joined)), float(np.log1p(compound)), float(np.log1p(c_left)), float(np.log1p(c_right)), float(soft), float(right[:1].islower()),
        float(len(left)), float(len(right)), known,
    ]


def fit_joiner(vocabulary: dict[str, int], compounds: dict[str, int], seed: int = 4) -> Boosting:
    """Classifier of line pairs, fitted on words broken on purpose (1) and on compounds broken at their hyphen (0)."""
    rng = random.Random(seed)
    x, y = [], []
    get = vocabulary.get
    usual = sorted((w for w in vocabulary if len(w) >= 6), key=lambda w: (-vocabulary[w], w))[:SAMPLE_WORDS]
    for w in usual[:3000]:
        k = rng.randint(2, len(w) - 2)
        a, b = w[:k], w[k:]
        unknown = rng.random() < 0.3  # broken words may be misread, or rare
        x.append(join_features(a, b, 0 if unknown else get(w, 0), compounds.get(f"{a}-{b}", 0), get(a, 0), get(b, 0), rng.random() < 0.4, 0.0))
        y.append(1)
    many = sorted(compounds, key=lambda w: (-compounds[w], w))[:1000]
    for w in many:
        a, _, b = w.partition("-")
        for _ in range(max(1, 1500 // len(many))):
            unknown = rng.random() < 0.1
            x.append(join_features(a, b, get(a + b, 0), 0 if unknown else compounds[w], get(a, 0), get(b, 0), False, 0.0))
            y.append(0)
    if len(set(y)) < 2:
        x += [[0.0] * 9, [5.0] + [0.0] * 8]
        y += [0, 1]
    return Boosting(40).fit(np.array(x), np.array(y))


def _parts(page: Page, skip: set[int]) -> tuple[list[int], list[tuple[int, int, str, str, bool]]]:
    """Text lines in order, and their breaks: line, next line, left and right part of the word, whether the hyphen is soft."""
    rows = [k for k in range(len(page.lines)) if page.lines[k] and k not in skip]
    breaks = []
    for a, b in zip(rows, rows[1:], strict=False):
        line = page.lines[a]
        if line[-1] in HYPHENS and len(line) > 1 and line[-2].isalpha():
            left = line.split()[-1].rstrip(HYPHENS)
            right = page.lines[b].split()[0]
            if left and right[:1].isalpha():
                breaks.append((a, b, left, right, line[-1] != "-"))
    return rows, breaks


class Scans:
    """The operator over a table of extractions.

    Null and empty contents give nothing; null ids are ignored; repeated rows count once; other columns are ignored. In
    an empty table, or without any clean text to learn from, nothing is found.
    """

    def __init__(self, df: DataFrame, is_scan: Column | None = None, id_col: str = "extraction_id", content_col: str = "content"):
        spark = df.sparkSession
        ship_package(spark)
        is_scan = F.coalesce(df["metadata"]["format_type"] == "ocr" if is_scan is None else is_scan, F.lit(False))
        rows = df.select(df[id_col].alias("id"), df[content_col].alias("content"), is_scan.alias("scan")).where(F.length("content") > 0)
        self.scans = stage(rows.where(F.col("scan") & F.col("id").isNotNull()).select("id", "content").dropDuplicates(["id"]), "scans")
        w = F.regexp_extract_all(F.lower("content"), F.lit(r"\p{L}+(?:-\p{L}+)?"), F.lit(0))
        clean = rows.where(~F.col("scan"))
        words = F.expr("concat(w, flatten(transform(filter(w, x -> contains(x, '-')), x -> split(x, '-'))))")  # compounds and their parts
        counts = stage(clean.select(w.alias("w")).select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "words")
        total = counts.agg(F.sum("n")).first()[0] or 0
        #: words of the clean texts (compounds with their hyphen) that are known
        self.known = counts.where(F.col("n") >= max(KNOWN, KNOWN_SHARE * total))
        top = self.known.orderBy(F.desc("n"), "word").limit(2 * SAMPLE_WORDS).collect()
        compounds = {r["word"]: r["n"] for r in top if "-" in r["word"]}
        vocabulary = {r["word"]: r["n"] for r in top if "-" not in r["word"]}
        sample = clean.where(F.length("content").between(400, 20_000)).orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(SAMPLE_TEXTS)
        self.models = (*fit_furniture([r["content"] for r in sample.select("content").collect()]), fit_ranker(vocabulary), fit_joiner(vocabulary, compounds))
        self._lines()
        self._candidates()

    def _lines(self) -> None:
        """Furniture, breaks and checked words of each scan."""
        pair_model, number_model, _, _ = self.models

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for doc, content in zip(batch["id"], batch["content"], strict=True):
                    page = Page(content)
                    running, numbers = furniture(page, pair_model, number_model)
                    out += [(doc, "running_line", k + 1, None, None, None, None) for k in running] + [(doc, "page_number", k + 1, None, None, None, None) for k in numbers]
                    rows, breaks = _parts(page, running | numbers)
                    left, right = {b[0]: b for b in breaks}, {b[1]: b for b in breaks}
                    for a, b, x, y, soft in breaks:
                        out.append((doc, "break", a + 1, b + 1, x, y, soft))
                        for w in checked_words(x + y):
                            out.append((doc, "word", a + 1, b + 1, w, x, None))
                    for k in rows:
                        tokens = page.lines[k].split()
                        tokens = tokens[k in right : len(tokens) - (k in left)]
                        for w in {w for t in tokens for w in checked_words(t)}:
                            out.append((doc, "word", k + 1, None, w, None, None))
                yield pd.DataFrame(out, columns=["id", "kind", "line", "next", "a", "b", "soft"]).astype({"next": "Int64"})

        # the work is in the kernel: as many tasks as there are shuffle partitions, however few files hold the scans
        parts = int(self.scans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.lines = stage(self.scans.repartition(parts, "id").mapInPandas(run, "id bigint, kind string, line bigint, next bigint, a string, b string, soft boolean"), "lines")

    def _candidates(self) -> None:
        """Misread words with their replacements, by the q-gram join and the ranker."""
        ranker = self.models[2]
        words = self.lines.where("kind = 'word'").groupBy(F.col("a").alias("seen")).agg(F.count("*").alias("seen_count"))
        plain = self.known.where(~F.col("word").contains("-"))
        unknown = words.join(plain.select(F.col("word").alias("seen")), "seen", "left_anti")

        @F.pandas_udf("array<string>")
        def probes(s: pd.Series) -> pd.Series:
            return s.map(lambda w: sorted(_probe(w)))

        @F.pandas_udf("array<string>")
        def entries(s: pd.Series) -> pd.Series:
            return s.map(lambda w: sorted(_index(w)))

        asked = unknown.select("seen", "seen_count", F.explode(probes("seen")).alias("gram"))
        listed = plain.where(F.length("word") >= 3).select("word", "n", F.explode(entries("word")).alias("gram"))
        near = asked.join(listed, "gram").where((F.abs(F.length("word") - F.length("seen")) <= 2) & (F.levenshtein("seen", "word", 3) >= 0))
        near = near.groupBy("seen", "word").agg(F.max("n").alias("n"), F.max("seen_count").alias("seen_count"), F.count("*").alias("shared"))

        def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = [pair_features(r.seen, r.word, r.n, r.shared, r.seen_count) for r in batch.itertuples()]
                yield pd.DataFrame({"seen": batch["seen"], "word": batch["word"], "score": ranker.predict(np.array(x).reshape(-1, 8))})

        scored = near.mapInPandas(rank, "seen string, word string, score double")
        best = scored.groupBy("seen").agg(F.max(F.struct("score", "word")).alias("best")).select("seen", "best.word", "best.score")
        #: seen, word, score of every misread word
        self.corrections = stage(best.where("score > 0.5"), "corrections")

    def breaks(self) -> DataFrame:
        """Line ends inside a word that has no hyphen there: id, line, next, left, right."""
        joiner = self.models[3]
        b = self.lines.where("kind = 'break'").select("id", "line", "next", F.col("a").alias("left"), F.regexp_extract("b", r"^[\p{L}\p{N}@]+", 0).alias("right"), "soft")
        b = b.withColumn("tail", F.lower(F.regexp_extract("left", r"[\p{L}\p{N}@]+$", 0))).withColumn("head", F.lower("right"))
        b = b.withColumn("joined", F.concat("tail", "head")).withColumn("compound", F.concat_ws("-", "tail", "head"))
        for c in ("joined", "compound", "tail", "head"):
            b = b.join(self.known.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}")), c, "left")

        def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                f = batch[["n_joined", "n_compound", "n_tail", "n_head"]].fillna(0.0)
                x = [
                    join_features(left, right, *counts, bool(soft), 0.0)
                    for left, right, soft, counts in zip(batch["left"], batch["right"], batch["soft"], f.itertuples(index=False, name=None), strict=True)
                ]
                yield batch.loc[joiner.predict(np.array(x).reshape(-1, 9)) > 0.5, ["id", "line", "next", "left", "right"]]

        return b.mapInPandas(judge, "id bigint, line bigint, next bigint, left string, right string")

    def defects(self) -> DataFrame:
        """id, line_no, defect of every line with a defect."""
        wrong = self.lines.where("kind = 'word'").join(self.corrections, F.col("a") == F.col("seen"))
        # of a broken word, the half that differs names the line
        second = F.col("next").isNotNull() & F.lower("word").startswith(F.lower(F.regexp_extract("b", r"[\p{L}\p{N}@]+$", 0)))
        wrong = wrong.select("id", F.when(second, F.col("next")).otherwise(F.col("line")).alias("line_no"), F.lit("misread_word").alias("defect"))
        other = self.lines.where("kind IN ('running_line', 'page_number')").select("id", F.col("line").alias("line_no"), F.col("kind").alias("defect"))
        breaks = self.breaks().select("id", F.col("line").alias("line_no"), F.lit("hyphen_break").alias("defect"))
        return wrong.union(other).union(breaks).distinct()

    def repaired(self) -> DataFrame:
        """Every scan as continuous paragraphs: id, content, n_joins, n_replaced, n_removed."""
        words = self.lines.where("kind = 'word'").join(self.corrections, F.col("a") == F.col("seen")).groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("seen", "word"))).alias("words"))
        joins = self.breaks().groupBy("id").agg(F.collect_set("line").alias("joins"))
        gone = self.lines.where("kind IN ('running_line', 'page_number')").groupBy("id").agg(F.collect_set("line").alias("gone"))
        docs = self.scans.join(words, "id", "left").join(joins, "id", "left").join(gone, "id", "left")

        def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for r in batch.itertuples():
                    gone = {int(k) for k in r.gone} if r.gone is not None else set()
                    joins = {int(k) for k in r.joins} if r.joins is not None else set()
                    table = dict(r.words) if r.words is not None else {}
                    lines = [x.replace("\f", "").strip() for x in r.content.split("\n")]
                    text, blank, cut = "", False, False
                    for no, line in enumerate(lines, 1):
                        if no in gone or not line:
                            blank = blank or (not line and not cut)
                            continue
                        if cut:
                            text = text[: len(text.rstrip(HYPHENS))] + line
                        elif text:
                            new = blank and text[-1] in ".!?:。！？"
                            glue = "" if text[-1] in HYPHENS and not new and len(text) > 1 and text[-2].isalnum() else "\n\n" if new else " "
                            text += glue + line
                        else:
                            text = line
                        blank, cut = False, no in joins
                    n = 0

                    def swap(m, table=table):
                        nonlocal n
                        word = table.get(m.group().lower())
                        if word is None:
                            return m.group()
                        n += 1
                        return word[:1].upper() + word[1:] if m.group()[:1].isupper() else word

                    text = regex.sub(r"[\p{L}\p{N}@]+", swap, text)
                    out.append((r.id, text, len(joins), n, len(gone)))
                yield pd.DataFrame(out, columns=["id", "content", "n_joins", "n_replaced", "n_removed"])

        return docs.mapInPandas(fix, "id bigint, content string, n_joins bigint, n_replaced bigint, n_removed bigint")


def found(df: DataFrame) -> DataFrame:
    """extraction_id, line_no (from 1), defect."""
    return Scans(df).defects().select(F.col("id").alias("extraction_id"), "line_no", "defect")
