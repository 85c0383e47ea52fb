"""Text that was decoded with a wrong character set: finding the records, and their original text.

Every distinct word of the corpus that has other than ASCII characters is garbled under all chains of encodings; the
words of the documents are hash-joined against these forms, and forms whose original is the commoner word count as
verified. Words that are themselves garbled forms of known words or characters are no originals. A chain that is verified for a record also restores its words that stand nowhere else in the corpus.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from html.entities import codepoint2name, name2codepoint

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import ship_package, stage

#: Pairs of the encoding a text was written in and the one it was read in.
SINGLE = [
    ("cp1251", "cp1252"), ("cp1251", "latin-1"), ("cp1251", "koi8-r"), ("cp1251", "mac_roman"), ("koi8-r", "cp1251"), ("koi8-r", "cp1252"), ("koi8-r", "latin-1"),
    ("cp866", "cp1251"), ("cp866", "cp1252"), ("cp1250", "cp1252"), ("cp1250", "latin-1"), ("iso8859-2", "cp1252"), ("iso8859-2", "latin-1"),
    ("cp1252", "cp1250"), ("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp850", "cp1252"), ("cp437", "cp1252"),
    ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("gb18030", "cp1252"), ("gb18030", "latin-1"), ("gb18030", "cp1251"),
]
READ_UTF8 = ["cp1252", "latin-1", "cp437", "cp850", "cp1251", "cp1250", "mac_roman", "koi8-r", "cp866", "iso8859-2"]
LOSSY = ["cp1252", "cp1250", "cp1251", "koi8-r", "gb18030", "mac_roman"]
#: name of each chain to its steps (written in, read in)
CHAINS: dict[str, list[tuple[str, str]]] = {f"{a}>{b}": [(a, b)] for a, b in [*(("utf-8", b) for b in READ_UTF8), *SINGLE]}
CHAINS |= {f"utf-8>{b}>utf-8>{b}": [("utf-8", b)] * 2 for b in ("cp1252", "latin-1", "cp850", "mac_roman")}
#: chains whose wrong characters then were written as references (of numbers, or of names where there are any): markup that was built from misread bytes
REFERENCES = {f"utf-8>{b}>{r}": r for b in ("latin-1", "cp1252") for r in ("&#;", "&;")}
CHAINS |= {c: [("utf-8", c.split(">")[1])] for c in REFERENCES}
#: the chains, those of most steps first
DEEPEST = sorted(CHAINS, key=lambda c: -len(CHAINS[c]))
#: A form may be this many times as common as its original before it counts as a word of its own.
COMMONER = 3
#: a character reference
_REFERENCE = r"&(?:#[0-9]{2,7}|#[xX][0-9A-Fa-f]{2,6}|[A-Za-z]{2,8}[0-9]{0,2});"
_TOKEN = rf"[A-Za-z]*+(?:[^\x00-\x7F]|{_REFERENCE})(?:[A-Za-z\x{{80}}-\x{{10FFFF}}]|{_REFERENCE})*"
_ASCII_LETTER = regex.compile("[A-Za-z]")
_MIXED = regex.compile(r"[A-Za-z]\p{Cyrillic}|\p{Cyrillic}[A-Za-z]")
_LONE_HAN = regex.compile(r"[A-Za-z]\p{Han}(?!\p{Han})|(?<!\p{Han})\p{Han}[A-Za-z]")
_FIND = regex.compile(rf"[A-Za-z]*+(?:[^\x00-\x7F]|{_REFERENCE})(?:[A-Za-z\u0080-\U0010FFFF]|{_REFERENCE})*")


def _charset(name: str) -> tuple[dict[int, str], dict[str, int]]:
    """The characters of the 256 bytes; bytes without one stand for the control character of their number."""
    chars = {}
    for b in range(256):
        try:
            chars[b] = bytes([b]).decode(name)
        except UnicodeDecodeError:
            chars[b] = chr(b)
    return chars, {c: b for b, c in chars.items()}


_CHARSETS = {n: _charset(n) for n in {b for steps in CHAINS.values() for _, b in steps}}


class _References(dict):
    """Code points to their references; ASCII stays."""

    def __init__(self, names: dict[int, str]):
        self.names = names

    def __missing__(self, code: int) -> str:
        self[code] = out = chr(code) if code < 128 else f"&{self.names.get(code) or f'#{code}'};"
        return out


_WRITTEN = {"&#;": _References({}), "&;": _References(codepoint2name)}


def garble(text: str, chain: str) -> str | None:
    """What a chain makes of a text; None where the text cannot be written in the chain's encoding."""
    for written, read in CHAINS[chain]:
        try:
            data = text.encode(written)
        except UnicodeEncodeError:
            return None
        text = data.decode("latin-1").translate(_CHARSETS[read][0])
    return text.translate(_WRITTEN[REFERENCES[chain]]) if chain in REFERENCES else text


def plain(text: str) -> str:
    """The text with the characters that its references name; the numbers 128 to 159 are taken as they stand."""
    return regex.sub(_REFERENCE, _character, text) if "&" in text else text


def _character(m) -> str:
    name = m.group()[1:-1]
    if name[0] != "#":
        return chr(name2codepoint[name]) if name in name2codepoint else m.group()
    number = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
    return chr(number) if number < 0x110000 and not 0xD800 <= number < 0xE000 else m.group()


def restore(text: str, chain: str) -> str | None:
    """The text that a chain garbled; None if it cannot have been this chain."""
    if chain in REFERENCES:
        if "&" not in text:
            return None
        text = plain(text)
    for written, read in reversed(CHAINS[chain]):
        codes = _CHARSETS[read][1]
        try:
            text = bytes([codes[c] for c in text]).decode(written)
        except (KeyError, UnicodeDecodeError):
            return None
    return text


def forms(word: str) -> dict[str, str]:
    """All garbled forms of a word that differ from it, with the chain of each (the first, where chains agree).

    Lossy chains, in which bytes became U+FFFD, are named ``lossy``.
    """
    out: dict[str, str] = {}
    for chain in CHAINS:
        form = garble(word, chain)
        if form is not None and form != word:
            out.setdefault(form, chain)
    for written in LOSSY:
        try:
            form = word.encode(written).decode("utf-8", "replace")
        except UnicodeEncodeError:
            continue
        if "�" in form:  # without it nothing was lost; the form of a garbled word would be the right one
            out.setdefault(form, "lossy")
    widths = [(c, 0 if c < "\x80" else len(c.encode("utf-8"))) for c in word]
    for n in (1, 2, 3):
        out.setdefault("".join(["�" * min(n, w) if w else c for c, w in widths]), "lossy")
    return {f: c for f, c in out.items() if f != word and (not f.isascii() or "&" in f)}


def _weight(word: str, form: str, chain: str) -> float:
    """How far one verified word alone speaks for a garbled record: 1 is enough."""
    if chain == "lossy":  # U+FFFD is what a failed decoding leaves
        return 1.0
    if chain in REFERENCES:
        return 1.0
    if len(form) > len(word):  # several bytes a character
        return 1.0 if not form.isalpha() or len(word) > 2 else 0.25
    return 0.5 if len(word) > 3 else 0.1


#: Characters of forms that are handed on at once.
BATCH_CHARS = 4_000_000
_FORMS = ["token", "word", "chain", "word_records", "weight"]


def _rank(word: str, ranks: dict[str, int]) -> float:
    """How rare the characters of a word are in the corpus: mean logarithm of their places in order of commonness."""
    places = [math.log(1 + ranks.get(c, len(ranks))) for c in word if c >= "\x80"]
    return sum(places) / max(1, len(places))


def _forms_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The forms of words; a word of one record counts half, and under single-byte chains only if its characters are commoner than those of the form."""
    for batch in batches:
        rows, size = [], 0
        ranks = {c: k for k, c in enumerate(batch["known"].iloc[0])} if len(batch) else {}
        for word, records in zip(batch["token"], batch["records"], strict=True):
            if "�" in word:
                continue
            for form, chain in forms(word).items():
                weight = _weight(word, form, chain)
                if records == 1 and chain != "lossy" and len(form) <= len(word):
                    if _rank(form, ranks) <= _rank(word, ranks):
                        continue
                    weight /= 2
                rows.append((form, word, chain, records, weight))
                size += len(form) + len(word)
            if size > BATCH_CHARS:
                yield pd.DataFrame(rows, columns=_FORMS)
                rows, size = [], 0
        yield pd.DataFrame(rows, columns=_FORMS)


def _plausible(word: str, token: str, chain: str, alphabet: set[str]) -> bool:
    """Whether a restored word has known characters only and keeps to what words look like.

    ASCII letters are always known. Chance readings of clean accented words, which mix Cyrillic into Latin letters or take
    ASCII letters for the second byte of a Chinese character, do not count.
    """
    if not {c for c in word if c >= "\x80"} <= alphabet or _MIXED.search(word):
        return False
    if not chain.startswith("gb18030") or not _ASCII_LETTER.search(word):
        return True
    return _ASCII_LETTER.findall(word) == _ASCII_LETTER.findall(token) and not _LONE_HAN.search(word)


def _restored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tokens with the shorter words that chains restore them to; known tells whether the characters alone speak for it.

    Of the chains that give known characters the one with most steps is named first. Tokens with U+FFFD stay without an original.
    """
    for batch in batches:
        rows = []
        alphabet = set(batch["known"].iloc[0]) if len(batch) else set()
        for token, records in zip(batch["token"], batch["records"], strict=True):
            if "�" in token:
                rows.append((token, records, None, "lossy", 0, True, 1.0))
                continue
            seen = plain(token)
            for chain in DEEPEST if seen == token else REFERENCES:
                word = restore(token, chain)
                if word and word != seen and len(seen) > len(word) and not word.isascii():
                    weight = 1.0 if len(seen) - len(word) > 1 else _weight(word, seen, chain)
                    rows.append((token, records, word, chain, len(rows), _plausible(word, seen, chain, alphabet), weight))
        yield pd.DataFrame(rows, columns=["token", "records", "word", "chain", "turn", "known", "weight"])


class Garbled:
    """The operator over one table of records.

    Null contents, and those of ASCII characters without character references, are never affected. Null ids are ignored, repeated rows count once, other columns are
    ignored. An empty table gives empty results.
    """

    def __init__(self, df: DataFrame, id_col: str = "extraction_id", content_col: str = "content"):
        ship_package(df.sparkSession)
        self.source = df.select(df[id_col].alias("id"), df[content_col].alias("content")).where(F.col("id").isNotNull())
        words = F.array_distinct(F.regexp_extract_all("content", F.lit(_TOKEN), F.lit(0)))
        #: the distinct words with other than ASCII characters of each record
        self.tokens = stage(self.source.select("id", F.explode(words).alias("token")).distinct(), "tokens")
        vocabulary = stage(self.tokens.groupBy("token").agg(F.count("*").alias("records")), "vocabulary")
        # characters of the corpus (at most all of Unicode) that several words have
        chars = vocabulary.select(F.explode(F.array_distinct(F.split("token", ""))).alias("c"), "records").groupBy("c").agg(F.sum("records").alias("n"))
        known = chars.where((F.col("n") >= 3) & (F.col("c") >= "\x80") & (F.col("c") != "�")).agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(-F.col("n"), "c"))), lambda x: x["c"])).alias("known"))
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the work is in the kernel, however few bytes the words have
        long = vocabulary.where((F.length("token") >= 2) | (F.col("token") == "�")).repartition(parts, "token").crossJoin(F.broadcast(known))
        restored = stage(long.mapInPandas(_restored, "token string, records bigint, word string, chain string, turn int, known boolean, weight double"), "restored")
        # tokens that are garbled themselves are no originals
        stands = F.col("known") | (F.col("word_records") * COMMONER >= F.col("records"))
        seen = restored.join(vocabulary.select(F.col("token").alias("word"), F.col("records").alias("word_records")), "word", "left")
        garbled = seen.where((F.col("weight") >= 1) & stands).select("token").distinct()
        clean = vocabulary.join(garbled, "token", "left_anti").repartition(parts, "token").crossJoin(F.broadcast(known))
        made = clean.mapInPandas(_forms_of, "token string, word string, chain string, word_records bigint, weight double")
        # long words have long forms: both go through the joins as 64-bit hashes
        made = stage(made.select(F.xxhash64("token").alias("key"), F.xxhash64("word").alias("word_key"), "chain", "word_records", "weight"), "made")
        keyed = vocabulary.withColumn("key", F.xxhash64("token"))
        joined = keyed.join(made, "key").where(F.col("word_records") * COMMONER >= F.col("records"))
        verified = joined.join(keyed.select(F.col("key").alias("word_key"), F.col("token").alias("word")), "word_key").select("token", "word", "chain", "word_records", "weight")
        first = restored.where("known").groupBy("token").agg(F.min(F.struct("turn", "word", "chain", "weight")).alias("r")).select("token", "r.word", "r.chain", F.lit(0).cast("bigint"), "r.weight")
        by_char = first.join(verified.where("weight >= 1").select("token").distinct(), "token", "left_anti")
        #: garbled words with their originals
        self.table = stage(verified.union(by_char), "forms")

    def evidence(self) -> DataFrame:
        """Records with verified garbled words: id, weight, words (token, word, chain, word_records)."""
        hit = self.tokens.join(self.table, "token")
        best = hit.groupBy("id", "token").agg(F.max("weight").alias("weight"), F.collect_list(F.struct("word", "chain", "word_records")).alias("words"))
        return best.groupBy("id").agg(F.sum("weight").alias("weight"), F.collect_list(F.struct("token", "words")).alias("words")).where("weight >= 1")

    def affected(self) -> DataFrame:
        """Ids of the records that hold garbled text."""
        hit = self.tokens.join(self.table.groupBy("token").agg(F.max("weight").alias("weight")), "token")
        return hit.groupBy("id").agg(F.sum("weight").alias("weight")).where("weight >= 1").select("id")

    def repaired(self) -> DataFrame:
        """Affected records with chain, original text as far as it can be had, and how many garbled words are left: id, chain, content, n_replaced, n_left."""

        def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for record, content, words in zip(batch["id"], batch["content"], batch["words"], strict=True):
                    votes: Counter[str] = Counter()
                    for w in words:
                        votes.update({o["chain"] for o in w["words"]})
                    chain = max(votes, key=lambda c: (votes[c], c))
                    table = {}
                    for w in words:
                        options = [o for o in w["words"] if o["chain"] == chain] or list(w["words"])
                        table[w["token"]] = max(options, key=lambda o: (o["word_records"], o["word"]))["word"]
                    n = left = 0

                    def swap(m, table=table, chain=chain):
                        nonlocal n, left
                        token = m.group()
                        word = table.get(token)
                        if word is None and chain != "lossy":
                            word = restore(token, chain)
                        if word is None:
                            left += "�" in token
                            return token
                        n += word != token
                        return word

                    rows.append((record, chain, _FIND.sub(swap, content), n, left))
                yield pd.DataFrame(rows, columns=["id", "chain", "content", "n_replaced", "n_left"])

        return self.source.join(self.evidence(), "id").dropDuplicates(["id"]).mapInPandas(fix, "id bigint, chain string, content string, n_replaced bigint, n_left bigint")


def found(df: DataFrame) -> DataFrame:
    """extraction_id of every record with garbled text."""
    return Garbled(df).affected().select(F.col("id").alias("extraction_id")).distinct()
