"""64-bit numbers of texts and vectors under which only equal values meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numbered(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with a number for ``value`` in the column ``name``: the same for equal values, another for different ones.

    The number is a 64-bit hash. Values are told apart by a second one, 128 bits in all; where two different values meet
    in the first (about n² / 2⁶⁵ of them: three among ten thousand million values, which bounds the broadcast), the second
    gives the number.
    """
    first, second = F.xxhash64(value), F.xxhash64(F.lit(17), value)
    twice = df.select(first.alias("_first"), second.alias("_second")).groupBy("_first").agg((F.min("_second") != F.max("_second")).alias("_twice")).where("_twice")
    marked = df.withColumn("_first", first).withColumn("_second", second).join(F.broadcast(twice), "_first", "left")
    return marked.withColumn(name, F.when(F.col("_twice"), F.col("_second")).otherwise(F.col("_first"))).drop("_first", "_second", "_twice")
