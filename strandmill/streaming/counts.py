"""Running counts over arriving files of reads. Counts are sums, so a stream keeps them as it goes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandmill.operators import counts as C
from strandmill.sources.readers import VALID


def stream_lines(spark: SparkSession, folder: str, files_each: int = 16) -> DataFrame:
    """Reads of the files that arrive in a folder, one a line; the id is a hash of file and sequence."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_each).text(folder)
    seq = F.upper(F.rtrim(F.regexp_replace("value", "\r$", "")))
    return lines.select(seq.alias("seq")).where(F.col("seq").rlike(VALID)).select(F.xxhash64("seq").alias("read_id"), "seq")


def running_kmer_counts(reads: DataFrame, k: int, two_strands: bool = True) -> DataFrame:
    return C.kmer_counts(reads, k, two_strands)


def running_background(reads: DataFrame) -> DataFrame:
    """(base, n) so far."""
    return C.character_counts(reads).select(F.col("char").alias("base"), "n")


def write_counts(counts: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keeps the full counts in ``path``: each batch replaces them, so a batch that is done again changes nothing."""

    def save(df: DataFrame, _: int) -> None:
        df.write.mode("overwrite").parquet(path)

    out = counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(save)
    return (out.trigger(availableNow=True) if once else out).start()
