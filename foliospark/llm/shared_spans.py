"""Long exact spans that different records share.

Two routing steps keep the work near what is really shared, without losing a span of the least length: a window
whose minimum-hash anchor no other text has is ruled out, and of the windows left only those whose hash another
text has too are kept. Then fixed-length reference blocks (the first of each run of windows that the same texts share)
are indexed, every rolling window probes them, and hits are extended over the windows that follow to maximal exact
repeats. Windows are told apart by 128 bits. Exact copies are one text throughout; their records are joined in at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.llm.identity import numbered
from foliospark.llm.rolling import Windows, anchors
from foliospark.session import ship_package, stage

#: Least length of a span, in code points.
LENGTH = 300
#: Anchors are hashes of this many characters; each window has one.
GRAM = 160
#: Bits of the filter that goes before the join of texts with their shared anchors: 1 MB, however many texts there are.
FILTER_BITS = 1 << 23
#: Characters hashed at once.
BATCH_CHARS = 400_000


def _groups(texts: pd.Series) -> Iterator[slice]:
    """Slices of a batch with a bounded number of characters (or a single text)."""
    begin, size = 0, 0
    for k, n in enumerate(texts.str.len()):
        if size and size + n > BATCH_CHARS:
            yield slice(begin, k)
            begin, size = k, 0
        size += n
    if begin < len(texts):
        yield slice(begin, len(texts))


def _anchored(part: pd.DataFrame, length: int) -> tuple[Windows, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of a batch; the places at which a window of ``length`` lies within its text, their anchors' hashes, their texts."""
    w = Windows(list(part["text"]))
    places, hashes = anchors(w, GRAM, length - GRAM + 1)
    at = np.flatnonzero(w.inside(length))
    return w, at, hashes[places[at]].view(np.int64), w.text_of(at)


def _anchor_rows(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in _groups(batch["text"]):
                part = batch.iloc[s]
                _, _, keys, text = _anchored(part, length)
                if len(keys):
                    new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])))
                    yield pd.DataFrame({"key": keys[new], "text_id": part["text_id"].to_numpy()[text[new]]})

    return run


def _window_rows(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in _groups(batch["text"]):
                part = batch.iloc[s]
                w, at, keys, text = _anchored(part, length)
                shared = np.zeros(len(at), bool)
                for k, known in enumerate(part["keys"]):
                    own = slice(*np.searchsorted(text, [k, k + 1]))
                    shared[own] = np.isin(keys[own], np.asarray(known, np.int64))
                at, text = at[shared], text[shared]
                # equal windows have equal hashes of their first halves too: the two numbers tell windows apart by 128 bits
                yield pd.DataFrame({"key": w.at(at, length).view(np.int64), "half": w.at(at, length // 2).view(np.int64), "text_id": part["text_id"].to_numpy()[text], "pos": (at - w.starts[text]).astype(np.int32)})

    return run


def _may_be_in(docs: DataFrame, some: DataFrame) -> DataFrame:
    """The rows whose text_id may be among those of ``some``, by a bitmap of fixed size, so that few others are shuffled.

    With far more texts than bits the filter lets nearly all through; it never loses one.
    """
    spot = F.pmod("text_id", F.lit(FILTER_BITS))
    bits = some.groupBy(F.bitmap_bucket_number(spot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits"))
    at = F.bitmap_bit_position(spot)
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = docs.withColumn("bucket", F.bitmap_bucket_number(spot)).join(F.broadcast(bits), "bucket")
    return near.where(F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(at, F.lit(8)))), F.lit(2)) == 1).select(*docs.columns)


class SharedSpans:
    """The operator over one table of texts.

    Null texts and texts shorter than ``length`` have no spans; null ids are ignored; repeated (id, text) rows count
    once; other columns are ignored. An empty table gives empty results.
    """

    def __init__(self, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH):
        if length <= GRAM:
            raise ValueError(f"the least length must be more than {GRAM}")
        ship_package(documents.sparkSession)
        self.length = length
        text = documents[text_col]
        docs = numbered(documents.select(documents[id_col].alias("doc_id"), text.alias("text"), F.length(text).alias("n_chars")), F.col("text"), "text_id")
        #: every record, those without spans too
        self.records = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce("n_chars", F.lit(0))).alias("n_chars"))
        #: which records have which text, whatever its length
        self.holders = docs.where("doc_id IS NOT NULL AND n_chars > 0").select("doc_id", "text_id", "n_chars").distinct()
        docs = docs.where((F.length("text") >= length) & F.col("doc_id").isNotNull())
        self.members = docs.select("doc_id", "text_id", "n_chars").distinct()
        many = F.min("text_id") != F.max("text_id")
        rows = stage(docs.select("text_id", "text").mapInPandas(_anchor_rows(length), "key bigint, text_id bigint"), "anchors")
        keys = rows.groupBy("key").agg(many.alias("many")).where("many").select("key")
        lists = stage(rows.join(keys, "key").groupBy("text_id").agg(F.collect_set("key").alias("keys")), "lists")
        #: texts that share an anchor, once each
        self.texts = _may_be_in(docs.select("text_id", "text"), lists).join(lists, "text_id").dropDuplicates(["text_id"])
        wins = stage(self.texts.mapInPandas(_window_rows(length), "key bigint, half bigint, text_id bigint, pos int"), "windows")
        mark = F.xxhash64(F.lit(1), "text_id")  # sums of its halves, which cannot overflow
        sets = wins.groupBy("key", "half").agg(many.alias("many"), F.count("*").alias("n"), F.sum(F.shiftrightunsigned(mark, 32)).alias("x"), F.sum(mark.bitwiseAND(0xFFFFFFFF)).alias("y"))
        sets = sets.where("many").select("key", "half", F.xxhash64("n", "x", "y").alias("who"), "n")
        #: every window that another text has too; who: the same number where the same texts share it; n: how many windows are equal
        self.windows = stage(wins.join(sets, ["key", "half"]), "shared")

    def _blocks(self) -> DataFrame:
        """The windows, with first: whether one begins a run of windows that the same texts share."""
        run = Window.partitionBy("text_id").orderBy("pos")
        first = F.coalesce((F.lag("who").over(run) != F.col("who")) | (F.lag("pos").over(run) != F.col("pos") - 1), F.lit(True))
        return self.windows.withColumn("first", first)

    def spans(self) -> DataFrame:
        """Maximal exact repeats, a row for each place of each record: class_id, doc_id, start, length, n_places.

        A class is a passage with the texts that share it; a longer repeat of fewer texts is a row of classes one after
        another. So a passage that n texts share takes n rows, not n² pairs. n_places counts its places in different texts
        and within them. Copies of a whole text share its rows; texts that have copies only have none (see ``coverage``).
        """
        blocks = self._blocks()
        begins = blocks.where("first").select("key", "half").distinct().withColumn("begins", F.lit(True))  # in any of the texts
        marked = blocks.join(begins, ["key", "half"], "left")
        run = Window.partitionBy("text_id").orderBy("pos")
        marked = marked.withColumn("run", F.count(F.when(F.col("begins") | F.col("first"), 1)).over(run))
        head = F.min(F.struct("pos", "key", "half", "n")).alias("h")
        runs = marked.groupBy("text_id", "run").agg(head, F.count("*").alias("windows"))
        class_id = F.xxhash64("h.key", "h.half").alias("class_id")
        runs = runs.select(class_id, "text_id", F.col("h.pos").alias("start"), (F.col("windows") + self.length - 1).cast("int").alias("length"), F.col("h.n").alias("n_places"))
        return runs.join(self.members.select("doc_id", "text_id"), "text_id").select("class_id", "doc_id", "start", "length", "n_places")

    def links(self) -> DataFrame:
        """Pairs of different texts that share a span: text_a, text_b."""
        index = self._blocks().where("first").select("key", "half", F.col("text_id").alias("a"))
        # every text of a set has a first window of it, so one direction finds each pair
        hits = index.join(self.windows.select("key", "half", F.col("text_id").alias("b")), ["key", "half"]).where("a < b")
        return hits.select(F.col("a").alias("text_a"), F.col("b").alias("text_b")).distinct()

    def pairs(self) -> DataFrame:
        """Pairs of records that share a span, the smaller id first: doc_id_a, doc_id_b."""
        m = self.members.select("doc_id", "text_id")
        links = self.links()
        a, b = m.toDF("x", "text_a"), m.toDF("y", "text_b")
        across = links.join(a, "text_a").join(b, "text_b").select("x", "y")
        copies = a.join(b, F.col("text_a") == F.col("text_b")).where("x < y").select("x", "y")
        return across.union(copies).where("x != y").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()

    def coverage(self) -> DataFrame:
        """Every record with how much of it stands in other records too: doc_id, n_copies, n_chars, shared_chars, share.

        Null and empty texts, and texts shorter than a span, share nothing (n_copies counts the records with the same text
        all the same); share is null where there are no characters.
        """
        order = Window.partitionBy("text_id").orderBy("pos")
        new = F.least(F.lit(self.length), F.coalesce(F.col("pos") - F.lag("pos").over(order), F.lit(self.length)))
        covered = self.windows.select("text_id", "pos").distinct().withColumn("new", new).groupBy("text_id").agg(F.sum("new").alias("covered"))
        copies = self.holders.groupBy("text_id").agg(F.countDistinct("doc_id").alias("n_copies"))
        out = self.holders.join(copies, "text_id").join(covered, "text_id", "left")
        whole = (F.col("n_copies") > 1) & (F.col("n_chars") >= self.length)
        out = out.withColumn("shared_chars", F.when(whole, F.col("n_chars").cast("bigint")).otherwise(F.coalesce("covered", F.lit(0))))
        none = self.records.join(out.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit(1).cast("bigint").alias("n_copies"), "n_chars", F.lit(0).cast("bigint").alias("shared_chars"))
        out = out.select("doc_id", "n_copies", "n_chars", "shared_chars").unionByName(none)
        return out.withColumn("share", F.col("shared_chars") / F.nullif(F.col("n_chars"), F.lit(0)))


def found(documents: DataFrame) -> DataFrame:
    """doc_id_a, doc_id_b of records with a span of at least 300 characters in common."""
    return SharedSpans(documents).pairs()
