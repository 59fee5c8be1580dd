"""Table scans.

``load`` is a plain Parquet scan, so filters and columns reach the files. ``spread`` gives a scan of few, small files
enough partitions for Python work that costs far more than moving the rows once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``: one file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str, factor: int = 2) -> DataFrame:
    """Hash-partition by ``keys`` (unique ids) if the scan yields fewer partitions than ``factor`` per core, else unchanged.

    On inputs of many splits, so on any large one, this adds no shuffle. What shuffles already, whose number of partitions
    only running it would tell, is partitioned by ``keys`` in any case.
    """
    want = factor * df.sparkSession.sparkContext.defaultParallelism
    shuffles = "Exchange" in df._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    return df if not shuffles and df.rdd.getNumPartitions() >= want else df.repartition(want, *keys)
