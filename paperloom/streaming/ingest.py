"""Files as a stream: new files of a directory are extracted as they arrive (an extension, 2.11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom.functions.text import extension
from paperloom.operators import extract
from paperloom.options import Options
from paperloom.sources import files

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """The supported files of `path` as a stream."""
    stream = spark.readStream.format("binaryFile").schema(_BINARY).option("maxFilesPerTrigger", per_batch).load(path)
    return stream.where(extension(F.col("path")).isin(*files.SUPPORTED))


def once_per_content(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Drops files whose bytes came before within the watermark."""
    return stream.withColumn("sha256", F.sha2("content", 256)).withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["sha256"]).drop("sha256")


def start(spark: SparkSession, path: str, target: str, checkpoint: str, options: Options = Options(), dedupe: bool = False) -> StreamingQuery:  # noqa: B008
    """Appends the found rows of arriving files to `target`, partitioned by relation; rejects are rows too.

    Every file is a document of its own; with `dedupe`, files whose bytes came before are left out.
    """
    stream = arriving(spark, path)
    stream = once_per_content(stream) if dedupe else stream

    def write(batch: DataFrame, batch_id: int) -> None:
        good, rejected = files.guard(files.detect(batch, options), options)
        found = extract.found_rows(good, options)
        lost = rejected.select(F.lit("rejects").alias("relation"), F.col("path").alias("doc_id"), F.to_json(F.struct("path", "error_type", "error")).alias("row"))
        # a batch has a directory of its own, so that a repeated batch replaces itself
        found.unionByName(lost).write.mode("overwrite").partitionBy("relation").parquet(f"{target}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
