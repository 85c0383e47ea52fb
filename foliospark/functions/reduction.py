"""Token reduction of texts in levels: off, light, moderate, aggressive, maximum.

Light and moderate are Column expressions; the two upper levels run an Arrow batch kernel, since their word and sentence
selection depends on counts over the whole text.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.quality import collapse_punctuation
from foliospark.functions.stopwords import stopwords
from foliospark.functions.text import trimmed
from foliospark.session import ship_package

LEVELS = ["off", "light", "moderate", "aggressive", "maximum"]
# Weights of words and more general terms of the two upper levels.
IMPORTANCE = {
    "result": 0.8, "conclusion": 0.8, "important": 0.7, "significant": 0.7, "analysis": 0.7, "method": 0.6, "data": 0.6, "system": 0.6, "performance": 0.6, "improvement": 0.6,
    "process": 0.5, "algorithm": 0.5, "function": 0.5, "model": 0.5, "implementation": 0.5,
}
GENERAL_TERMS = {
    "car": "vehicle", "dog": "animal", "apple": "fruit", "chair": "furniture", "book": "publication", "computer": "device", "algorithm": "method", "implementation": "approach",
    "optimization": "improvement", "analysis": "study",
}
CJK_TERMS = "学智能技术法算理科研究发展系统模型方式过程结构功效应分析计数据信息处语言文生成产用作为变化转换提高网络神经机器人工自然复"
THRESHOLD = 0.3


def level_of(name: str | None) -> str:
    """The level a name means; unknown names mean moderate."""
    low = (name or "").lower()
    return low if low in LEVELS else "moderate"


def collapse_same(c: Column) -> Column:
    """Runs of one and the same of ``! ? ,`` to a single one; mixed runs stay."""
    return F.regexp_replace(c, r"([!?,])\1+", "$1")


def light(c: Column) -> Column:
    """Punctuation runs, HTML comments within a line, runs of spaces and of line ends."""
    out = F.regexp_replace(collapse_punctuation(c), "<!--[^\n]*?-->", "")
    return trimmed(F.regexp_replace(F.regexp_replace(out, " {2,}", " "), "\n{3,}", "\n\n"))


def remove_stopwords(c: Column, language: str = "en") -> Column:
    """Words of the text without stop words, joined by single spaces.

    Words in capitals, with digits, without letters, or of one letter stay.
    """
    words = F.filter(F.split(c, r"[ \t\n\r\f\x0B]+"), lambda w: w != "")
    core = lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}]", ""))
    capitals = lambda w: (F.octet_length(w) > 1) & w.rlike(r"^[\x00-\x60\x7B-\x7F]+$") & ~w.rlike("[a-z]")
    stop = stopwords(language)
    keep = lambda w: capitals(w) | w.rlike("[0-9]") | (F.octet_length(core(w)) <= 1) | ~core(w).isin(stop)
    return F.array_join(F.filter(words, keep), " ")


def moderate(c: Column, language: str = "en") -> Column:
    """Light, then without stop words; lines that are headers, list items or table rows, and all code, stay as they are."""
    ship_package()

    @F.pandas_udf("string")
    def with_code(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else reduce_around_code(t, language) if "`" in t else t)

    text = light(c)
    protected = lambda x: x.rlike(r"^\s*(#{1,6}\s|[-*+]\s|\d+\.\s|\|)")
    by_line = F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(protected(x), x).otherwise(remove_stopwords(x, language))), "\n")
    plain = remove_stopwords(text, language)
    code = text.contains("`")
    marked = text.rlike(r"(?m)^\s*(#{1,6}\s|[-*+]\s|\|)")
    return F.when(code, with_code(text)).when(marked, by_line).otherwise(plain)


def reduce_around_code(text: str, language: str = "en") -> str:
    """Without stop words outside code fences and inline code."""
    stop = set(stopwords(language))
    parts = re.split(r"(```.*?```|`[^`\n]+`)", text, flags=re.DOTALL)
    done = [p if k % 2 else " ".join(w for w in p.split() if _stays(w, stop)) for k, p in enumerate(parts)]
    return " ".join(d for d in done if d)


def _stays(word: str, stop: set[str]) -> bool:
    if len(word.encode()) > 1 and word.isascii() and not re.search("[a-z]", word) or re.search("[0-9]", word):
        return True
    core = "".join(c for c in word if c.isalpha()).lower()
    return len(core.encode()) <= 1 or core not in stop


def _has_cjk(text: str) -> bool:
    return any("一" <= c <= "鿿" for c in text)


def important(word: str) -> bool:
    """Capitals, a digit, more than ten bytes, mixed case, or a Chinese technical sign."""
    if len(word) > 1 and all(c.isupper() for c in word) or any(c.isnumeric() for c in word) or len(word.encode()) > 10:
        return True
    upper = sum(c.isupper() for c in word)
    if 1 < upper < len(word.encode()):
        return True
    if not _has_cjk(word):
        return False
    ranges = ((0x4E00, 0x51FF), (0x6700, 0x68FF), (0x7500, 0x76FF))
    return any(c in CJK_TERMS for c in word) or (len(word) == 2 and any(a <= ord(c) <= b for c in word for a, b in ranges))


def tokens(text: str) -> list[str]:
    """Words between white space; words with Chinese characters in pieces of two."""
    out = []
    for w in text.split():
        out += [w[k : k + 2] for k in range(0, len(w), 2)] if _has_cjk(w) else [w]
    return out


def _letters(word: str) -> str:
    return "".join(c for c in word if c.isalpha()).lower()


def drop_common_words(text: str) -> str:
    """Keeps important, rare and long words; if too few stay, all words of three letters and more."""
    words = tokens(text)
    if len(words) < 4:
        return text
    cores = [_letters(w) for w in words]
    lengths = [len(c) for c in cores if c]
    mean = sum(lengths) / len(lengths) if lengths else 5.0
    counts = Counter(c for c in cores if c)
    kept = [w for w, c in zip(words, cores, strict=True) if not c or important(w) or (counts[c] <= 2 and len(c) >= mean * 0.8) or len(c) >= mean * 1.5]
    cjk = _has_cjk(text)
    if len(kept) < len(words) // (5 if cjk else 3):
        kept = [w for w, c in zip(words, cores, strict=True) if not c or len(c) >= 3 or important(w)]
    return " ".join(kept)


def entropy(text: str) -> float:
    """Entropy of the characters without case, in bits, at most 5."""
    counts, n = Counter(c.lower()[0] for c in text), len(text)
    return min(5.0, -sum(k / n * math.log2(k / n) for k in counts.values())) if n else 0.0


def sentence_score(sentence: str, position: int, total: int) -> float:
    """How much a sentence tells, from its place, length, figures, capitals, long words, punctuation and variety."""
    score = 0.3 if position in (0, total - 1) else 0.0
    words = sentence.split()
    n = len(words)
    if not n:
        return score
    score += 0.2 if 3 <= n <= 25 else 0.0
    score += 0.3 * sum(any(c.isnumeric() for c in w) for w in words) / n
    score += 0.25 * sum(len(w.encode()) > 1 and all(c.isupper() for c in w) for w in words) / n
    score += 0.2 * sum(len(w.encode()) > 8 for w in words) / n
    punctuation = sum(c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for w in words for c in w)
    score += 0.15 * punctuation / len(sentence.encode())
    limit, unique = math.ceil(n * 0.6), set()
    for w in words:
        unique.add(_letters(w))
        if len(unique) >= limit:
            break
    return score + 0.15 * len(unique) / n + 0.1 * entropy(sentence)


def select_sentences(text: str) -> str:
    """The two fifths of the sentences that tell most, in their order; up to two sentences stay as they are."""
    sentences = [s.strip() for s in re.split("[.!?]", text) if s.strip()]
    n = len(sentences)
    if n <= 2:
        return text
    scored = sorted(range(n), key=lambda k: (-sentence_score(sentences[k], k, n), k))
    return ". ".join(sentences[k] for k in sorted(scored[: max(1, math.ceil(n * 0.4))]))


def _technical(word: str) -> bool:
    return len(word) > 6 and ("_" in word or sum(c.isupper() for c in word) > 1 or word.endswith(("tion", "ment", "ing")))


def token_scores(words: list[str]) -> list[float]:
    """Importance of each word: its own, that of two words on both sides, and its frequency."""
    clean = ["".join(c for c in w if c.isalnum()).lower() for w in words]
    counts, n = Counter(clean), len(words)
    out = []
    for k, w in enumerate(clean):
        base = IMPORTANCE.get(w)
        if base is None:
            base = min(1.0, 0.3 + min(0.2, 0.02 * len(w.encode())) + 0.15 * any(c.isnumeric() for c in w) + 0.25 * _technical(w))
        near = 0.1 if k in (0, n - 1) else 0.0
        for other in words[max(0, k - 2) : k + 3]:
            if other != w:
                near += 0.05 if _technical(w) and _technical(other) else 0.02 if other[:1].isupper() else 0.0
        out.append(base + min(near, 0.3) + 0.1 * (math.log(counts[w] / n) + 1))
    return out


def filter_tokens(text: str, threshold: float = THRESHOLD) -> str:
    words = text.split()
    return " ".join(w for w, s in zip(words, token_scores(words), strict=True) if s >= threshold)


def generalise(text: str, target: float | None = None) -> str:
    """Unimportant words by more general terms; with a target, only the most important part stays."""
    words = text.split()
    scores = token_scores(words)
    term = lambda w: GENERAL_TERMS.get("".join(c for c in w if c.isalnum()).lower(), w)
    if target is None:
        return " ".join(term(w) if s < 0.5 else w for w, s in zip(words, scores, strict=True))
    keep = max(1, int((1 - target) * len(words)))
    best = sorted(range(len(words)), key=lambda k: (-scores[k], k))[:keep]
    return " ".join(words[k] for k in sorted(best))


def reduce_upper(text: str, level: str, target: float | None = None) -> str:
    """The steps of the two upper levels, on a text that is moderately reduced."""
    out = filter_tokens(select_sentences(drop_common_words(text)))
    return generalise(out, target) if level == "maximum" else out


def reduce_text(c: Column, level: str = "moderate", language: str = "en", target: float | None = None) -> Column:
    """A text reduced to a level; null stays null, the empty text stays empty."""
    ship_package()
    level = level_of(level)
    if level == "off":
        return c
    if level == "light":
        return light(c)
    text = moderate(c, language)
    if level == "moderate":
        return text

    @F.pandas_udf("string")
    def upper(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else reduce_upper(unicodedata.normalize("NFC", t), level, target))

    return upper(text)
