"""Rows on as many cores as there are."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt_out(rows: DataFrame) -> DataFrame:
    """rows, on all cores: a scan of fewer row groups is dealt out before costly Python.

    Scans of more partitions than cores, and rows that were shuffled anyhow, stay as they are.
    """
    plan, cores = rows._jdf.queryExecution().executedPlan(), rows.sparkSession.sparkContext.defaultParallelism
    if plan.nodeName() == "AdaptiveSparkPlan" or plan.execute().getNumPartitions() >= cores:
        return rows
    return rows.repartition(cores)
