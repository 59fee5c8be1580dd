"""Streams of call metrics."""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkquarry.session import shared_base


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_base(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, keys: list[str] | None = None, mode: str = "append") -> DataFrame:
    """What a stream gives on the files that are there: written to the shared folder and read back.

    In update mode each batch appends, and of rows with equal ``keys`` the last batch's counts.
    """
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession)
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", f"{folder}/out").outputMode("append").start()
    else:
        q = writer.outputMode("update").foreachBatch(lambda df, n: df.withColumn("_batch", F.lit(n)).write.mode("append").parquet(f"{folder}/out")).start()
    q.awaitTermination()
    out = spark.read.schema(stream.schema if mode == "append" else T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])).parquet(f"{folder}/out")
    if mode == "append":
        return out
    rest = [c for c in stream.columns if c not in keys]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*")


def read_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's files as a stream; the schema is the files'."""
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    is_dir = fs.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(fs).isDirectory()
    reader = spark.readStream.schema(schema)
    return reader.parquet(path) if is_dir else reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def windowed_latency(stream: DataFrame, time: str, kind: str, value: str, width: str = "1 hour", late: str = "7 days") -> DataFrame:
    """Count, sum and greatest value of each kind and window; rows later than ``late`` behind the newest are left out."""
    return (
        stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind)
        .agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.max(value).alias("greatest")).select(F.col("w.start").alias("window_start"), kind, "n", "total", "greatest")
    )


def once_within(stream: DataFrame, id_col: str, time: str, late: str = "30 days") -> DataFrame:
    """Each id once, remembered until the watermark passes it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([id_col])


def admission(stream: DataFrame, server: str, order: str, service_ms: str, capacity: int = 5, late: str = "10 minutes") -> DataFrame:
    """A queue for each server, one request at a time in the order of arrival (``order``, a timestamp): admitted rows with their start and end, others rejected while ``capacity`` wait.

    Requests are held back until the watermark, ``late`` behind the newest, has passed them, and then taken in their order,
    however they came in batches; those later than that are left out, and those newer wait for the stream to go on. State
    is the end of the running request and those of the waiting ones, at most ``capacity`` + 1, and the requests held back.
    """
    fields = f"{server} string, arrival double, started double, ended double, admitted boolean"

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ends, times, work = (list(x) for x in state.get) if state.exists else ([], [], [])
        for pdf in batches:
            times += pdf["_t"].tolist()
            work += pdf["_ms"].tolist()
        passed = state.getCurrentWatermarkMs() / 1000
        held = sorted(zip(times, work))
        rows, n = [], bisect_left(held, (passed,))
        for t, ms in held[:n]:
            ends = [e for e in ends if e > t]
            if len(ends) > capacity:
                rows.append((key[0], t, None, None, False))
                continue
            begin = max(t, ends[-1]) if ends else t
            ends.append(begin + ms / 1000)
            rows.append((key[0], t, begin, ends[-1], True))
        held = held[n:]
        state.update((ends, [t for t, _ in held], [m for _, m in held]))
        if held:
            state.setTimeoutTimestamp(max(int(held[0][0] * 1000) + 1, int(passed * 1000) + 1))
        out = pd.DataFrame(rows, columns=[server, "arrival", "started", "ended", "admitted"])
        yield out.astype({"arrival": "float64", "started": "float64", "ended": "float64"})

    src = stream.withWatermark(order, late).select(F.col(server).cast("string").alias(server), F.col(order), (F.unix_micros(order).cast("double") / 1e6).alias("_t"), F.col(service_ms).cast("double").alias("_ms"))
    src = src.where(F.col("_t").isNotNull() & (F.col("_ms") >= 0))
    return src.groupBy(server).applyInPandasWithState(step, fields, "ends array<double>, times array<double>, work array<double>", "append", GroupStateTimeout.EventTimeTimeout)
