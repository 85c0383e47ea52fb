"""Languages of records and of the segments of mixed records, by a byte network over fixed-length windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.bytecnn import CLASSES, WINDOW, ByteCnn
from foliospark.llm.labels import CODES, language_code
from foliospark.session import ship_package

#: Bound of the labelled sample that the network is fitted on: records and windows of each language.
SAMPLE_RECORDS, SAMPLE_WINDOWS = 60, 1500
#: Records shorter than this are no cases; what a further language needs to count.
LEAST_CHARS, RUN_SENTENCES, RUN_CHARS = 50, 2, 60
#: Cost of a change of language between sentences, and the evidence of one sentence against the main language that
#: makes a record worth a search for segments; both in nats.
CHANGE, SUSPECT = 8.0, 4.0
#: Bytes that are read at once.
BATCH_BYTES = 4_000_000

_IS_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_IS_LETTER = np.array([chr(b).isalpha() or b >= 128 for b in range(256)])


class Units:
    """Sentences and lines of a batch of texts, as places in their joined bytes."""

    def __init__(self, texts: list[str]):
        coded = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.bytes = np.frombuffer(b"\n".join(coded) + b"\n\n\n", np.uint8)
        lengths = np.array([len(c) + 1 for c in coded], np.int64)
        self.doc_start = np.cumsum(lengths) - lengths
        b, n = self.bytes, int(lengths.sum())
        line = (b[:n] == 10) | (b[:n] == 12) | (b[:n] == 13)
        stop = np.isin(b[:n], (33, 46, 63)) & _IS_BLANK[b[1 : n + 1]]
        stop[2:] |= (b[2:n] == 0x82) & (b[1 : n - 1] == 0x80) & (b[: n - 2] == 0xE3)
        stop[2:] |= ((b[2:n] == 0x81) | (b[2:n] == 0x9F)) & (b[1 : n - 1] == 0xBC) & (b[: n - 2] == 0xEF)
        end = np.flatnonzero(line | stop) + 1
        start = np.concatenate(([0], end[:-1]))
        letters = np.concatenate(([0], np.cumsum(_IS_LETTER[b[:n]])))
        chars = np.concatenate(([0], np.cumsum((b[:n] & 0xC0) != 0x80)))
        blanks = np.concatenate(([0], np.cumsum(_IS_BLANK[b[:n]] | (b[:n] >= 128))))
        full = letters[end] - letters[start] >= 2
        full &= (end - start < 60) | ((blanks[end] - blanks[start]) * 30 >= end - start)  # else coded data, no text
        self.start, self.end, self.is_sentence = start[full], end[full], stop[end[full] - 1]
        self.doc = np.searchsorted(self.doc_start, self.start, side="right") - 1
        self.n_chars = (chars[self.end] - chars[self.start]).astype(np.int64)
        self.char_start = chars[self.start] - chars[self.doc_start[self.doc]]
        self.char_end = chars[self.end] - chars[self.doc_start[self.doc]]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Byte classes of the windows of every unit, padded at the unit's end, and the first window of each unit."""
        count = -(-(self.end - self.start) // WINDOW)
        first = np.cumsum(count) - count
        unit = np.repeat(np.arange(len(count)), count)
        at = self.start[unit] + WINDOW * (np.arange(len(unit)) - first[unit])
        place = at[:, None] + np.arange(WINDOW)
        classes = CLASSES[self.bytes[np.minimum(place, len(self.bytes) - 1)]].astype(np.uint8)
        classes[place >= self.end[unit][:, None]] = 0
        return classes, first


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first, axis=0) if len(first) else np.zeros((0, values.shape[1]), values.dtype)


def _best_path(scores: np.ndarray) -> np.ndarray:
    """Most likely language of each unit, where every change costs."""
    total, back = scores[0], np.zeros(scores.shape, np.int64)
    for k in range(1, len(scores)):
        best = int(total.argmax())
        moved = total[best] - CHANGE
        back[k] = np.where(total >= moved, np.arange(len(total)), best)
        total = np.maximum(total, moved) + scores[k]
    path = np.empty(len(scores), np.int64)
    path[-1] = total.argmax()
    for k in range(len(scores) - 1, 0, -1):
        path[k - 1] = back[k, path[k]]
    return path


def segments_of(model: ByteCnn, texts: list[str]) -> pd.DataFrame:
    """Segments of each text: doc, char_start, char_end, lang, confidence, sentences, chars, main, counts."""
    units = Units(texts)
    columns = ["doc", "char_start", "char_end", "lang", "confidence", "sentences", "chars", "main", "counts"]
    if not len(units.start):
        return pd.DataFrame({c: [] for c in columns})
    windows, first = units.windows()
    score = np.maximum(_sums(model.log_probabilities(windows).astype(np.float64), first), -60)
    new_doc = np.concatenate(([True], units.doc[1:] != units.doc[:-1]))
    doc_first = np.flatnonzero(new_doc)
    total = _sums(score, doc_first)
    main = total.argmax(1)
    of_doc = np.cumsum(new_doc) - 1
    path = main[of_doc].copy()
    suspect = np.zeros(len(doc_first), bool)
    against = score.max(1) - score[np.arange(len(score)), path] > SUSPECT
    suspect[of_doc[against]] = True
    ends = np.concatenate((doc_first[1:], [len(score)]))
    for d in np.flatnonzero(suspect):
        own = slice(doc_first[d], ends[d])
        path[own] = _best_path(score[own])
    new = new_doc | np.concatenate(([True], path[1:] != path[:-1]))
    seg_first = np.flatnonzero(new)
    seg_doc, seg_lang = of_doc[seg_first], path[seg_first]
    sentences = np.add.reduceat(units.is_sentence.astype(np.int64), seg_first)
    chars = np.add.reduceat(units.n_chars, seg_first)
    seg_score = _sums(score, seg_first)
    n_units = np.diff(np.concatenate((seg_first, [len(score)])))
    seg_score = (seg_score - seg_score.max(1, keepdims=True)) / np.sqrt(n_units)[:, None]
    confidence = np.exp(seg_score[np.arange(len(seg_lang)), seg_lang]) / np.exp(seg_score).sum(1)
    # main language: the one with the most characters
    by = np.zeros((len(doc_first), total.shape[1]), np.int64)
    np.add.at(by, (seg_doc, seg_lang), chars)
    is_main = by.argmax(1)[seg_doc] == seg_lang
    seg_end = np.concatenate((seg_first[1:], [len(score)])) - 1
    return pd.DataFrame(
        {
            "doc": units.doc[seg_first], "char_start": units.char_start[seg_first], "char_end": units.char_end[seg_end], "lang": np.array(CODES)[seg_lang],
            "confidence": confidence, "sentences": sentences, "chars": chars, "main": is_main,
            "counts": is_main | ((sentences >= RUN_SENTENCES) & (chars >= RUN_CHARS)),
        }
    )


def fit(df: DataFrame, content: Column, label: Column, id_col: Column) -> ByteCnn:
    """Network fitted on a bounded sample of labelled records, as many of each language, chosen by a hash of their id.

    Labels may be wrong and texts mixed: a first network drops the windows that contradict their label, and the second is
    fitted on the rest. Part of the windows is garbled the way wrongly decoded text is, so that such text keeps its language.
    """
    rows = df.select(id_col.alias("id"), content.alias("content"), language_code(label).alias("code"))
    rows = rows.where(F.col("code").isNotNull() & F.length("content").between(150, 20_000))
    counts = {r["code"]: r["n"] for r in rows.groupBy("code").agg(F.count("*").alias("n")).collect()}
    wanted = F.lit(False)
    for code, n in counts.items():
        limit = int(1_000_000 * min(1.0, SAMPLE_RECORDS / n))
        wanted = wanted | ((F.col("code") == code) & (F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1_000_000)) < limit))
    sample = rows.where(wanted).orderBy("id").limit(4 * SAMPLE_RECORDS * len(CODES)).toPandas() if counts else pd.DataFrame({"content": [], "code": []})
    rng = np.random.default_rng(2)
    parts, labels = [], []
    for code, group in sample.groupby("code"):
        texts = list(group["content"])
        texts += [t.encode("utf-8").decode("cp1252", "replace") for t in texts[::12]]
        windows, _ = Units(texts).windows()
        windows = windows[(windows != 0).sum(1) >= 12]
        keep = rng.permutation(len(windows))[:SAMPLE_WINDOWS]
        parts.append(windows[keep])
        labels.append(np.full(len(keep), CODES.index(code)))
    model = ByteCnn(len(CODES))
    if not parts:
        return model
    x, y = np.concatenate(parts), np.concatenate(labels)
    model.fit(x, y, epochs=3)
    sure = model.log_probabilities(x)[np.arange(len(y)), y] > np.log(0.2)
    return ByteCnn(len(CODES)).fit(x[sure], y[sure], epochs=8)


def language_segments(df: DataFrame, id_col: str = "extraction_id", content_col: str = "content", label: Column | None = None, model: ByteCnn | None = None) -> DataFrame:
    """Segments of every record with their languages.

    Columns: id, n_chars, label (the language its label names, or null), segment_no, char_start, char_end, lang,
    confidence, sentences, chars, main (the record's main language, which has the most characters), counts (main, or a
    run of at least two sentences and 60 characters). Null and blank contents, and those without letters, have no
    segments; a null id is kept; repeated rows count once; other columns are ignored.
    """
    ship_package(df.sparkSession)
    label = df["metadata"]["language"] if label is None else label
    if model is None:
        model = fit(df, df[content_col], label, df[id_col])
    source = df.select(df[id_col].alias("id"), language_code(label).alias("label"), df[content_col].alias("content")).where(F.length("content") > 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["content"].str.len().to_numpy()
            cut = np.cumsum(sizes) // BATCH_BYTES
            for _, part in batch.groupby(cut):
                texts = list(part["content"])
                seg = segments_of(model, texts)
                doc = seg["doc"].to_numpy(np.int64)
                out = seg.drop(columns="doc")
                out.insert(0, "id", part["id"].to_numpy()[doc])
                out.insert(1, "label", part["label"].to_numpy()[doc])
                out.insert(2, "n_chars", part["content"].str.len().to_numpy()[doc])
                out["segment_no"] = seg.groupby("doc").cumcount()
                yield out[["id", "label", "n_chars", "segment_no", "char_start", "char_end", "lang", "confidence", "sentences", "chars", "main", "counts"]]

    schema = "id bigint, label string, n_chars bigint, segment_no bigint, char_start bigint, char_end bigint, lang string, confidence double, sentences bigint, chars bigint, main boolean, counts boolean"
    return source.mapInPandas(run, schema).distinct()  # of the segments, so that no text is shuffled


def record_languages(df: DataFrame, model: ByteCnn | None = None) -> DataFrame:
    """One row a record: extraction_id, label, main language, its confidence, all languages that count."""
    seg = language_segments(df, model=model)
    weight = F.sum(F.when(F.col("main"), F.col("confidence") * F.col("chars"))) / F.sum(F.when(F.col("main"), F.col("chars")))
    return seg.groupBy(F.col("id").alias("extraction_id")).agg(
        F.max("label").alias("label"), F.max("n_chars").alias("n_chars"), F.max(F.when(F.col("main"), F.col("lang"))).alias("lang"),
        weight.alias("confidence"), F.sort_array(F.collect_set(F.when(F.col("counts"), F.col("lang")))).alias("langs"),
    )


def found(df: DataFrame) -> DataFrame:
    """extraction_id, lang: the languages of records whose label is missing or wrong or which hold several languages."""
    r = record_languages(df).where(F.col("n_chars") >= LEAST_CHARS)
    case = F.col("label").isNull() | (F.col("label") != F.col("lang")) | (F.size("langs") > 1)
    return r.where(case).select("extraction_id", F.explode("langs").alias("lang")).distinct()
