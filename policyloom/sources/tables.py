"""Reading text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Give a small scan at least one partition per core.

    A file of one row group is one task however many cores there are.  Only a
    scan with fewer splits than cores is dealt out again; a large table has far
    more splits and is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
