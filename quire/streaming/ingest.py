"""A folder where documents land, as a stream that translates each file once.

The stream's checkpoint notes which files were taken; writes to the memory and to the
output are the same if a batch runs again, so a restart neither skips nor doubles a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators import memory
from quire.plans import pipeline


def landed(spark: SparkSession, folder: str, glob: str = "*", per_batch: int = 1000) -> DataFrame:
    """path, modificationTime, length, content of files as they land."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(folder)


def texts(files: DataFrame) -> DataFrame:
    """Text files as documents: doc_id by path, text in UTF-8."""
    return files.select(F.xxhash64("path").alias("doc_id"), "path", F.decode("content", "UTF-8").alias("text"))


def translate_stream(documents: DataFrame, engine: memory.Engine, store_path: str, output: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts the stream; each batch writes a folder of its own, replaced if it runs again."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        done = pipeline.plain(rows, engine, memory.Memory(spark, store_path))
        done.select("doc_id", "para_idx", "text", "result", "status").write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def distinct_texts(documents: DataFrame, delay: str = "1 hour", text: str = "text") -> DataFrame:
    """Each text once within the watermark, whatever batches it comes in."""
    return documents.withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark([text])
