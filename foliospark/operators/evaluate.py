"""How near an extracted text is to the truth, by its tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluation_tokens(text: Column) -> Column:
    """Lower-case tokens of letters, digits, dots and commas, links without their targets; whole numbers without leading zeros."""
    plain = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\[([^\]]*)\]\([^)]*\)", "$1"))
    parts = F.split(F.regexp_replace(plain, r"[^\p{L}\p{N}.,]+", " "), " ")
    trimmed = F.transform(parts, lambda x: F.regexp_replace(F.regexp_replace(x, "^[.,]+", ""), "[.,]+$", ""))
    number = lambda x: x.rlike("^[0-9]{1,15}$")
    return F.transform(F.filter(trimmed, lambda x: x != ""), lambda x: F.when(number(x), x.cast("bigint").cast("string")).otherwise(x))


def token_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, token, n."""
    return df.select(df[id_col].alias("id"), F.explode(evaluation_tokens(df[text_col])).alias("token")).groupBy("id", "token").agg(F.count("*").alias("n"))


def token_f1(extracted: DataFrame, truth: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Precision, recall and F1 of the token multisets, and of those of numbers: id, precision, recall, f1, numeric_f1, quality.

    quality: 0.6 of the text's and 0.4 of the numbers' F1; the text's alone where neither side has numbers. Two empty
    texts agree. Ids of one side only have the other side empty.
    """
    a, b = token_counts(extracted, id_col, text_col), token_counts(truth, id_col, text_col)
    both = a.withColumnRenamed("n", "x").join(b.withColumnRenamed("n", "y"), ["id", "token"], "full").fillna(0, ["x", "y"])
    number = F.col("token").rlike("^[0-9][0-9.,]*$").cast("int")
    same = F.least("x", "y")
    sums = both.groupBy("id").agg(
        F.sum(same).alias("s"), F.sum("x").alias("x"), F.sum("y").alias("y"),
        F.sum(same * number).alias("sn"), F.sum(F.col("x") * number).alias("xn"), F.sum(F.col("y") * number).alias("yn"),
    )
    ids = extracted.select(F.col(id_col).alias("id")).union(truth.select(F.col(id_col).alias("id"))).distinct()
    out = ids.join(sums, "id", "left").fillna(0)

    def f1(s: str, x: str, y: str) -> Column:
        return F.when(F.col(x) + F.col(y) == 0, 1.0).otherwise(2 * F.col(s) / (F.col(x) + F.col(y)))

    part = lambda s, n: F.when(F.col(n) == 0, F.when(F.col("x") + F.col("y") == 0, 1.0).otherwise(0.0)).otherwise(F.col(s) / F.col(n))
    text, numeric = f1("s", "x", "y"), f1("sn", "xn", "yn")
    quality = F.when(F.col("xn") + F.col("yn") == 0, text).otherwise(0.6 * text + 0.4 * numeric)
    return out.select("id", part("s", "x").alias("precision"), part("s", "y").alias("recall"), text.alias("f1"), numeric.alias("numeric_f1"), quality.alias("quality"))


def token_difference(extracted: DataFrame, truth: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Tokens that one side has more often: id, token, side (missing or extra), n."""
    a, b = token_counts(extracted, id_col, text_col), token_counts(truth, id_col, text_col)
    both = a.withColumnRenamed("n", "x").join(b.withColumnRenamed("n", "y"), ["id", "token"], "full").fillna(0, ["x", "y"])
    side = F.when(F.col("y") > F.col("x"), "missing").otherwise("extra")
    return both.where("x != y").select("id", "token", side.alias("side"), F.abs(F.col("x") - F.col("y")).alias("n"))
