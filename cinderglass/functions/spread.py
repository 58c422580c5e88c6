"""Work for all cores where the input comes in fewer parts, as one small file does."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out anew if a plain scan of it has fewer parts than the cluster has cores.

    Streams and plans that shuffle already stay as they are; so does any input large
    enough to have a part a core, so that nothing is moved at scale.
    """
    if df.isStreaming or "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().getClass().getSimpleName():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)
