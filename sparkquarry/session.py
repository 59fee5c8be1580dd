"""Session defaults and lineage cuts, shared by tests, bench and jobs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, shuffle_partitions: int = 8, memory: str = "8g", app: str = "sparkquarry") -> SparkSession:
    """A session for one machine. A cluster brings its own; nothing else in the package sets configuration."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_base(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors share and which outlives any of them.

    A session whose executors are threads of the driver (tests, one machine) may do without the setting and gets a
    temporary folder; on a cluster, where each executor would write a disk of its own, that is an error.
    """
    sc = spark.sparkContext
    if (known := sc._jsc.sc().getCheckpointDir()).isDefined():
        return known.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sparkquarry-")
    sc.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage into the shared folder, so that a lost executor takes nothing with it."""
    shared_base(df.sparkSession)
    return df.checkpoint()
