"""Rows over all cores of one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """df in as many parts as there are cores if Spark runs on one machine, for steps that compute much on each row: there a
    file of one or two row groups would keep most cores idle. On a cluster df is left as it is, so that no text is
    shuffled; there the splits of the scan (spark.sql.files.maxPartitionBytes) say how many tasks there are."""
    spark = df.sparkSession
    local = spark.conf.get("spark.master", "").split("[")[0] == "local"
    return df.repartition(spark.sparkContext.defaultParallelism) if local else df
