"""Streaming batch scoring (M17 on arriving data).

New order-feature files land in a folder; a Structured Streaming query applies
the saved PipelineModel to each micro-batch and appends the scored rows to a
parquet sink.  The file source and sink plus the checkpoint make the output
exactly-once: a lost executor or a restarted query re-reads only unfinished
batches.  The checkpoint folder is named by the caller and belongs to the sink:
every run of the query, in whatever application, must pass the same one.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from mercato.ml import pipeline as M


def score_stream(spark: SparkSession, model_path: str, source_dir: str, sink_dir: str, checkpoint: str,
                 schema: StructType, threshold: float = 0.5, name: str = "late_delivery_scoring", available_now: bool = True,
                 max_files_per_trigger: int | None = None) -> StreamingQuery:
    model = PipelineModel.load(model_path)
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    scored = M.score(model, reader.parquet(source_dir), threshold)
    w = (scored.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", checkpoint)
         .outputMode("append").queryName(name))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
