"""The same rules on streams: rewriting keeps no state, so a stream of rows or files runs the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.rewrite import rewrite
from ..sources.pdf import extract_text, rewrite_pdf

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_pdf(spark: SparkSession, folder: str, per_trigger: int = 64) -> DataFrame:
    """(path, content) of PDF files as they arrive in a folder."""
    source = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.[pP][dD][fF]").option("maxFilesPerTrigger", per_trigger)
    return source.load(folder).select("path", "content")


def start(df: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes a stream as Parquet, exactly once for each input row."""
    writer = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


__all__ = ["extract_text", "rewrite", "rewrite_pdf", "start", "stream_pdf"]
