"""Analysis of archives as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.graph import written
from ..plans.analysis import analyze_files
from ..sources.archive import unpack


def watch(spark: SparkSession, folder: str, sink: Callable[[dict[str, DataFrame], int], None], most_files: int = 1000) -> DataStreamWriter:
    """A stream writer that analyses each batch of new archives in a folder and gives its tables to sink, with the
    batch's number; a sink that writes by that number is not misled by a batch that comes again."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    arriving = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.zip").option("maxFilesPerTrigger", most_files).load(folder)

    def batch(df: DataFrame, number: int) -> None:
        sink(analyze_files(written(unpack(df.select(F.col("path").alias("project_id"), "content")))), number)

    return arriving.writeStream.foreachBatch(batch)
