"""Passages of held-out items inside corpus documents, by an FM-index over the words of each corpus shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.session import ship_package

#: Consecutive words that make a leak.
PHRASE = 12
#: Bound of the item words that one pass over the corpus searches for; more items are searched in more passes.
MAX_WORDS = 2_000_000
#: Words of one shard, and the distance of sampled suffix positions.
SHARD_WORDS, SAMPLE = 1_500_000, 16
_WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """The maximal runs of letters and digits in lower case, ß as ss, which is what its upper case becomes."""
    return F.regexp_extract_all(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit(_WORD), F.lit(0))


class WaveletMatrix:
    """Rank queries over a sequence of symbols, answered for whole arrays of queries."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.zeros, self.ones_before = [], []
        seq = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones_before.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(int(len(seq) - self.ones_before[-1][-1]))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low, high = np.zeros_like(upto), upto.copy()
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            ones, one = self.ones_before[k], ((symbol >> level) & 1).astype(bool)
            a, b = ones[low], ones[high]
            low, high = np.where(one, self.zeros[k] + a, low - a), np.where(one, self.zeros[k] + b, high - b)
        return high - low


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Places of ``seq`` in the order of their suffixes, by prefix doubling of the places still tied.

    Symbol 0 separates: each separator counts as a symbol of its own, in the order of their places.
    """
    n = len(seq)
    rank = np.empty(n, np.int64)
    separators = np.flatnonzero(seq == 0)
    rank[separators] = np.arange(len(separators))
    others = np.flatnonzero(seq)
    order = others[np.argsort(seq[others], kind="stable")]
    values = seq[order]
    starts = np.concatenate(([True], values[1:] != values[:-1])) if len(order) else np.zeros(0, bool)
    rank[order] = len(separators) + np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0))
    sa = np.concatenate((separators, order))
    tied = len(separators) + np.flatnonzero(~starts | np.concatenate((~starts[1:], [False])))  # places in sa
    h = 1
    while len(tied):
        at = sa[tied]
        key = rank[at] * (n + 1) + np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        sa[tied] = at = at[by]
        key = key[by]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[~new | np.concatenate((~new[1:], [False]))]
        h *= 2
    return sa


class FmIndex:
    """FM-index of a sequence of word numbers; 0 separates and is never searched for."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        sa = suffix_array(seq)
        bwt = seq[sa - 1]  # before the first place stands the last one, a separator
        self.before = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=n_symbols))))
        self.tree = WaveletMatrix(bwt, n_symbols)
        self.bwt = bwt
        known = (sa % SAMPLE == 0) | (bwt == 0)  # places after a separator are known, so no walk crosses one
        self.known = known
        self.known_before = np.concatenate(([0], np.cumsum(known)))
        self.places = sa[known]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffixes that begin with each row of ``phrases``, by backward search."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.bwt), np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, k]
            low, high = self.before[c] + self.tree.rank(c, low), self.before[c] + self.tree.rank(c, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of the suffixes with the given ranks."""
        out, at, steps = np.zeros(len(rows), np.int64), rows.copy(), 0
        left = np.arange(len(rows))
        while len(left):
            r = at[left]
            hit = self.known[r]
            out[left[hit]] = self.places[self.known_before[r[hit]]] + steps
            left, r = left[~hit], r[~hit]
            c = self.bwt[r]
            at[left] = self.before[c] + self.tree.rank(c, r)
            steps += 1
        return out


class Phrases:
    """The phrases of a block of items as word numbers, and the items and places each stands at."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.vocabulary: dict[str, int] = {}
        rows, owner = [], []
        for item, ws in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws]
            for k in range(len(ids) - PHRASE + 1):
                rows.append(ids[k : k + PHRASE])
                owner.append((item, k))
        self.n_symbols = len(self.vocabulary) + 1
        table, inverse = np.unique(np.array(rows, np.int64).reshape(-1, PHRASE), axis=0, return_inverse=True)
        self.table = table
        order = np.argsort(inverse.ravel(), kind="stable")
        self.owners = np.array([o[0] for o in owner], np.int64)[order]
        self.owner_from = np.searchsorted(inverse.ravel()[order], np.arange(len(table) + 1))


def _shard_hits(phrases: Phrases, ids: np.ndarray, doc_of: np.ndarray, no_of: np.ndarray) -> pd.DataFrame:
    """Occurrences of item phrases in one shard: doc, item, number of the first word.

    Words that no item has, and runs too short for a phrase, cannot be part of a hit and leave the sequence.
    """
    empty = pd.DataFrame({"doc_id": np.zeros(0, np.int64), "item_id": np.zeros(0, np.int64), "word_no": np.zeros(0, np.int64)})
    edge = np.flatnonzero((ids == 0) | np.concatenate(([False], doc_of[1:] != doc_of[:-1])))
    starts = np.concatenate(([0], edge))
    starts = starts + (ids[starts] == 0) if len(ids) else starts
    ends = np.concatenate((edge, [len(ids)]))
    long = ends - starts >= PHRASE
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return empty
    lengths = ends - starts
    first = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    origin = np.repeat(starts, lengths) + place
    seq = np.zeros(int((lengths + 1).sum()), np.int64)
    back = np.full(len(seq), -1, np.int64)
    seq[np.repeat(first, lengths) + place] = ids[origin]
    back[np.repeat(first, lengths) + place] = origin
    index = FmIndex(seq, phrases.n_symbols)
    low, high = index.search(phrases.table)
    hit = np.flatnonzero(high > low)
    if not len(hit):
        return empty
    counts = (high - low)[hit]
    rows = np.repeat(low[hit], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    phrase = np.repeat(hit, counts)
    at = back[index.locate(rows)]
    n = phrases.owner_from[phrase + 1] - phrases.owner_from[phrase]
    owners = np.repeat(phrases.owner_from[phrase], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(at, n)
    return pd.DataFrame({"doc_id": doc_of[at], "item_id": phrases.owners[owners], "word_no": no_of[at]})


def _merge(hits: pd.DataFrame) -> pd.DataFrame:
    """Overlapping or adjoining occurrences of one item in one document become one span of words."""
    hits = hits.drop_duplicates().sort_values(["doc_id", "item_id", "word_no"], ignore_index=True)
    new = (hits["doc_id"].diff() != 0) | (hits["item_id"].diff() != 0) | (hits["word_no"].diff() > PHRASE)
    out = hits.groupby(new.cumsum(), sort=False).agg(doc_id=("doc_id", "first"), item_id=("item_id", "first"), word_start=("word_no", "first"), word_end=("word_no", "last"))
    return out.assign(word_end=out["word_end"] + PHRASE)


def _searcher(items: list[tuple[int, list[str]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(items)
        values = pa.array(list(phrases.vocabulary), pa.string())

        def shard(parts):
            ids, docs, nos = (np.concatenate(x) for x in zip(*parts, strict=True))
            merged = _merge(_shard_hits(phrases, ids, docs, nos))
            return pa.RecordBatch.from_pandas(merged[["doc_id", "item_id", "word_start", "word_end"]].astype("int64"), preserve_index=False)

        parts, size = [], 0
        for batch in batches:
            column = batch.column(1)
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column.flatten()
            ids = pc.fill_null(pc.add(pc.index_in(flat, value_set=values), 1), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            docs = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), lengths)
            nos = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            if len(ids):
                parts.append((ids, docs, nos))
                size += len(ids)
            if size >= SHARD_WORDS:
                yield shard(parts)
                parts, size = [], 0
        if parts:
            yield shard(parts)

    return run


def leak_spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Spans of words that documents share with items: doc_id, item_id, word_start, word_end (exclusive), from 0.

    Every run of at least 12 consecutive words of an item counts, whatever case and other characters stand between.
    Null and empty texts, null ids and items of fewer than 12 words have no spans. Repeated rows give their spans once.
    Other columns of either table are ignored. Item words are held in blocks of a bounded size; each block searches the
    whole corpus.
    """
    ship_package(documents.sparkSession)
    docs = documents.select(documents["doc_id"], words(documents["text"]).alias("words")).where(F.col("doc_id").isNotNull() & (F.size("words") >= PHRASE))
    rows = items.select(items["item_id"], words(items["text"]).alias("words")).where(F.col("item_id").isNotNull() & (F.size("words") >= PHRASE)).distinct()
    out, block, size = None, [], 0

    def search(block):
        part = docs.mapInArrow(_searcher(block), "doc_id bigint, item_id bigint, word_start bigint, word_end bigint")
        return part if out is None else out.union(part)

    for r in rows.toLocalIterator():
        block.append((r["item_id"], list(r["words"])))
        size += len(r["words"])
        if size >= MAX_WORDS:
            out, block, size = search(block), [], 0
    if block or out is None:
        out = search(block)
    return out.distinct()


def removal_spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The character spans of each document that leaked words cover: doc_id, char_start, char_end, item_ids."""
    spans = leak_spans(documents, items).groupBy("doc_id").agg(F.collect_set(F.struct("word_start", "word_end", "item_id")).alias("spans"))
    text = documents.select("doc_id", "text").dropDuplicates(["doc_id"])
    find = regex.compile(_WORD).finditer

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, found in zip(batch["doc_id"], batch["text"], batch["spans"], strict=True):
                at = [m.span() for m in find(text)]
                merged: list[list] = []
                for s in sorted((s["word_start"], s["word_end"], s["item_id"]) for s in found):
                    if s[1] > len(at):
                        continue
                    a, b = at[s[0]][0], at[s[1] - 1][1]
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                        merged[-1][2].add(s[2])
                    else:
                        merged.append([a, b, {s[2]}])
                rows += [(doc, a, b, sorted(i)) for a, b, i in merged]
            yield pd.DataFrame(rows, columns=["doc_id", "char_start", "char_end", "item_ids"])

    return text.join(spans, "doc_id").mapInPandas(cut, "doc_id bigint, char_start bigint, char_end bigint, item_ids array<bigint>")


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id of every leak."""
    return leak_spans(documents, items).select("doc_id", "item_id").distinct()
