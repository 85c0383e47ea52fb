"""Language of a text by its function words and script, a light detector for the pipeline."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.stopwords import SHORT_CODES, STOPWORDS
from foliospark.functions.text import bound


def language_scores(text: Column) -> Column:
    """Array of (score, code), the best first: share of words that are function words of a language, or of a script's letters."""
    def scores(r: Column) -> Column:
        n = F.greatest(F.size(r["words"]), F.lit(1))
        rows = []
        for code, short in SHORT_CODES.items():
            known = STOPWORDS[short].split()
            hits = F.size(F.filter(r["words"], lambda w: w.isin(known)))  # noqa: B023
            rows.append(F.struct((hits / n).alias("score"), F.lit(code).alias("code")))
        letters = F.greatest(F.regexp_count(r["text"], F.lit(r"\p{L}")), F.lit(1))
        for code, block in (("rus", "[Ѐ-ӿ]"), ("zho", "[一-鿿]")):
            rows.append(F.struct((F.regexp_count(r["text"], F.lit(block)) / letters).alias("score"), F.lit(code).alias("code")))
        return F.sort_array(F.array(*rows), asc=False)

    return bound(scores, text=text, words=F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != ""))


def detect_languages(text: Column, min_confidence: float = 0.8, multiple: bool = False, segment: int = 200) -> Column:
    """ISO 639-3 codes of a text: one, or none below the confidence; with ``multiple``, of all its segments by frequency.

    The confidence is the best score's part of the sum of the two best. Null and blank texts have none.
    """

    def best(t: Column) -> Column:
        def pick(r: Column) -> Column:
            first, second = r["s"][0], r["s"][1]
            return F.when((first["score"] > 0.02) & (first["score"] / (first["score"] + second["score"]) >= min_confidence - 0.3), first["code"])

        return bound(pick, s=language_scores(t))

    if not multiple:
        code = best(text)
        return F.when(code.isNull(), F.array().cast("array<string>")).otherwise(F.array(code))
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / segment).cast("int") - 1, F.lit(0)))
    codes = F.filter(F.transform(starts, lambda k: best(F.substring(text, k * segment + 1, F.lit(segment)))), lambda c: c.isNotNull())
    distinct = F.array_distinct(codes)
    counted = F.transform(distinct, lambda c: F.struct((-F.size(F.filter(codes, lambda x: x == c))).alias("n"), c.alias("c")))
    return F.coalesce(F.transform(F.sort_array(counted), lambda x: x["c"]), F.array().cast("array<string>"))
