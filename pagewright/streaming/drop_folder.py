"""Checks over files as they arrive in a folder. A document arrives whole, so no state is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..plans.run import run_checks
from ..sources import corpus_of, extracted


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, structure: dict | None = None, styles: dict | None = None) -> StreamingQuery:
    """Append the issues of each batch of new files to out (Parquet); stops when all present files are done."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)

    def batch(rows: DataFrame, number: int) -> None:
        kept: list[DataFrame] = []
        try:
            kept.append(extracted(rows.select("path", "content"), styles, kept).persist())
            run_checks(corpus_of(kept[-1]), structure, styles).write.mode("overwrite").parquet(f"{out}/batch={number}")
        finally:
            for frame in kept:
                frame.unpersist()

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
