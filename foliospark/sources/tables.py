"""Reading of the Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of the data folder; columns are pruned by the scan as later steps need them."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where the files give fewer partitions than that (a file of one row group gives one).

    Larger inputs have partitions enough and are left as they are, so that no text is shuffled for it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
