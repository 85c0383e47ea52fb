"""The pipeline over streams: the same row-wise plan, written as it comes or handed out batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliospark.plans.pipeline import ExtractionConfig, run_pipeline


def stream_documents(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def start(stream: DataFrame, config: ExtractionConfig, sink: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text"):
    """Starts the pipeline over a stream into Parquet files; each file of the source counts once, also after a restart."""
    out = run_pipeline(stream, config, id_col, text_col)
    return out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def for_each_result(stream: DataFrame, config: ExtractionConfig, handle: Callable[[DataFrame, int], None], checkpoint: str, id_col: str = "doc_id", text_col: str = "text"):
    """Starts the pipeline over a stream and hands every micro-batch of results to a function."""
    out = run_pipeline(stream, config, id_col, text_col)
    return out.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
