"""Latency, usage and evaluation figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.session import checkpoint


def ranked(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by``, value, ``_c`` (how often it occurs), ``_upto`` (values up to it) and ``n`` (values of the group), exact.

    Equal values are counted first, then spread by ranges of group and value over all tasks; each task adds up its own
    range, and only the ranges' sums are added up by group. So a group of any size is in no task as a whole. Null values
    don't count; null keys make groups.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    parts = checkpoint(counts.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy("_part", *by).agg(F.sum("_c").alias("_own"))
    group = Window.partitionBy(*by)
    sums = sums.select(F.col("_part").alias("_p"), *(F.col(b).alias(f"_{b}") for b in by), (F.sum("_own").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_own")).alias("_before"), F.sum("_own").over(group).alias("n"))
    same = F.col("_part") == F.col("_p")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    here = F.sum("_c").over(Window.partitionBy("_part", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("_here", here).join(sums, same).select(*by, value, "_c", (F.col("_before") + F.col("_here")).alias("_upto"), "n")


def value_at(rank: Column, value: str) -> Column:
    """An aggregate over :func:`ranked`: the value that has the rank, from 1."""
    return F.max(F.when((rank <= F.col("_upto")) & (rank > F.col("_upto") - F.col("_c")), F.col(value)))


def nearest_rank(df: DataFrame, by: list[str], value: str, fraction: float) -> DataFrame:
    """``by, n, value`` at rank bround((n - 1) * fraction)."""
    r = ranked(df, by, value)
    return r.groupBy(*by).agg(F.max("n").alias("n"), value_at(F.bround((F.col("n") - 1) * fraction) + 1, value).alias(value))


def interpolated(fraction: float, value: str) -> Column:
    """An aggregate over :func:`ranked`: the quantile between its two nearest ranks."""
    at = (F.col("n") - 1) * fraction
    low, high = value_at(F.floor(at) + 1, value), value_at(F.ceil(at) + 1, value)
    part = F.max(at) - F.floor(F.max(at))
    return low + (high - low) * part


def quantile(df: DataFrame, by: list[str], value: str, fraction: float) -> DataFrame:
    """``by, n, value``: the interpolated quantile."""
    return ranked(df, by, value).groupBy(*by).agg(F.max("n").alias("n"), interpolated(fraction, value).alias(value))


def latency_summary(df: DataFrame, by: list[str], value: str, failed: Column) -> DataFrame:
    """Count, errors, median, nearest-rank 95th percentile, least and greatest value of each group."""
    base = df.groupBy(*by).agg(F.count(value).alias("n"), F.count_if(failed).alias("errors"), F.min(value).alias("least"), F.max(value).alias("greatest"))
    ranks = ranked(df, by, value).groupBy(*(F.col(b).alias(f"_{b}") for b in by)).agg(F.round(interpolated(0.5, value), 1).alias("median"), value_at(F.bround((F.col("n") - 1) * 0.95) + 1, value).alias("p95"))
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    return base.join(ranks, same, "left").drop(*(f"_{b}" for b in by))


def rollup(df: DataFrame, by: list[str], status: Column, severity: list[str], time: str, **sums: str) -> DataFrame:
    """Members of a group as one: the worst status (``severity``, the worst first, others below all), sums, first and last time, and the least time of a member of that status."""
    worst = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, severity)), status), F.lit(0)), F.lit(len(severity) + 1))
    rows = df.withColumns({"_worst": worst, "_status": status})
    of = rows.groupBy(*by).agg(F.min(F.struct("_worst", "_status", F.col(time).alias("_t"))).alias("_s"), F.count("*").alias("members"), F.min(time).alias("created"), F.max(time).alias("updated"), *(F.sum(c).alias(k) for k, c in sums.items()))
    return of.select(*by, F.col("_s._status").alias("status"), F.col("_s._t").alias("status_since"), "members", "created", "updated", *sums)


def all_or_null(value: Column) -> Column:
    """A sum that is null if any value is or there are none."""
    return F.when((F.count(value) == F.count(F.lit(1))) & (F.count(F.lit(1)) > 0), F.sum(value))


def rate(amount: Column, milliseconds: Column) -> Column:
    return F.bround(F.try_divide(amount * 1000, milliseconds), 2)


def fifo(df: DataFrame, server: list[str], arrival: str, service: str, order: str) -> DataFrame:
    """Rows with start and end (seconds) at servers that take one request at a time, first come first served.

    A request ends when all before it have: the greatest of arrival minus the work before, plus the work up to it, so two
    running aggregates replace the recursion.
    """
    w = Window.partitionBy(*server).orderBy(arrival, order).rowsBetween(Window.unboundedPreceding, 0)
    work = F.sum(service).over(w)
    out = df.withColumn("_work", work)
    out = out.withColumn("end", F.col("_work") + F.max(F.col(arrival) - (F.col("_work") - F.col(service))).over(w))
    return out.withColumn("start", F.col("end") - F.col(service)).drop("_work")


def positions(served: DataFrame, server: list[str], arrival: str, end: str, order: str) -> DataFrame:
    """``order, position``: how many requests of its server each finds unfinished as it arrives; one that ends at that very time is finished."""
    both = served.select(*server, F.col(order), F.explode(F.array(F.struct(F.round(arrival, 6).alias("at"), F.lit(1).alias("delta")), F.struct(F.round(end, 6).alias("at"), F.lit(-1).alias("delta")))).alias("x")).select(*server, order, "x.*")
    held = F.sum("delta").over(Window.partitionBy(*server).orderBy("at", "delta", order).rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("position", held - 1).where("delta = 1").select(order, "position")


def last_run(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """Of each key the row that comes last."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
