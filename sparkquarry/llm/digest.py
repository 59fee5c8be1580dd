"""Problem 1: percentiles of large numeric columns by mergeable digests over dyadic trees (q-digests).

Values are quantised to a bounded ordered universe: a positive double's bits, read as an integer, are in its order, so
their upper part (exponent and ``MANTISSA`` bits) between 2^-20 and 2^44 makes 64 * 2^14 = 2^20 leaves. Leaf values are
within 2^-14 (0.0061 %) of the value; 0 and lesser values than 2^-20 are in the first leaf, greater than 2^44 in the last.

A digest is a set of nodes of the binary tree over the leaves, with counts. Compression moves the counts of two siblings
to their parent while the three together have no more than n / k. Digests are merged by adding counts of equal nodes,
whatever their partitions, days or order, and compressed again. At most ``DEPTH`` ancestors of a leaf hold counts of
values that may lie on the other side of it, each at most n / k, so the rank of an answer differs from the wanted rank
by no more than DEPTH * n / k = ``rank_error`` * n: deterministic, for any data and any order of merging.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.session import checkpoint

MANTISSA, LOWEST, OCTAVES = 14, -20, 64
#: Levels below the root; the universe has 2^DEPTH leaves.
DEPTH = 20
LEAVES = 1 << DEPTH
RANK_ERROR = 0.0005


def leaf_of(value: Column) -> Column:
    """The leaf of a value of 0 or more, inside the JVM."""
    x = F.least(F.greatest(value, F.lit(2.0**LOWEST)), F.lit(2.0 ** (LOWEST + OCTAVES) * (1 - 2.0**-53)))
    exponent = F.floor(F.log2(x)).cast("int")
    # log2 may round across a power of two
    exponent = exponent + F.when(F.pow(F.lit(2.0), exponent) > x, -1).when(F.pow(F.lit(2.0), exponent + 1) <= x, 1).otherwise(0)
    part = F.floor((x / F.pow(F.lit(2.0), exponent) - 1) * (1 << MANTISSA)).cast("int")
    return (exponent - LOWEST) * (1 << MANTISSA) + part


def leaf_value(leaf: Column) -> Column:
    """The middle of a leaf."""
    return F.pow(F.lit(2.0), F.shiftright(leaf, MANTISSA) + LOWEST) * (1 + (leaf.bitwiseAND((1 << MANTISSA) - 1) + 0.5) / (1 << MANTISSA))


def compress(nodes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes are numbered as in a heap: the root is 1, the leaves LEAVES to 2 LEAVES - 1. One pass from the leaves up."""
    limit = int(counts.sum()) // k
    if limit < 1:
        return nodes, counts
    kept_n, kept_c = [], []
    up_n, up_c = np.empty(0, np.int64), np.empty(0, np.int64)
    level = np.frexp(nodes.astype(float))[1] - 1
    for depth in range(DEPTH, 0, -1):
        here = level == depth
        n, inverse = np.unique(np.concatenate((nodes[here], up_n)), return_inverse=True)
        c = np.bincount(inverse, np.concatenate((counts[here], up_c)), len(n)).astype(np.int64)
        above = level == depth - 1
        parents, at = np.unique(n >> 1, return_inverse=True)
        total = np.bincount(at, c, len(parents)).astype(np.int64)
        own_n, own_c = nodes[above], counts[above]
        order = np.argsort(own_n)
        own_n, own_c = own_n[order], own_c[order]
        place = np.searchsorted(own_n, parents)
        hit = (place < len(own_n)) & (own_n[np.minimum(place, max(len(own_n) - 1, 0))] == parents) if len(own_n) else np.zeros(len(parents), bool)
        with_parent = total.copy()
        with_parent[hit] += own_c[place[hit]]
        moves = with_parent <= limit
        stays = ~moves[at]
        kept_n.append(n[stays])
        kept_c.append(c[stays])
        up_n, up_c = parents[moves], total[moves]
    root = level == 0
    if root.any() or len(up_n):
        kept_n.append(np.array([1]))
        kept_c.append(np.array([counts[root].sum() + up_c.sum()]))
    return np.concatenate(kept_n), np.concatenate(kept_c).astype(np.int64)


def _k(rank_error: float) -> int:
    return int(np.ceil(DEPTH / rank_error))


def _compressed(by: list[str], nodes: DataFrame, rank_error: float) -> DataFrame:
    """``nodes``: by, node, count, each node of a digest once.

    With less than k values nothing can move, so such digests stay in the JVM. The others go to numpy one by one; a digest
    has no more nodes than the universe, so it fits a task.
    """
    k = _k(rank_error)
    nodes = checkpoint(nodes.select(*by, "node", "count", F.sum("count").over(Window.partitionBy(*by)).alias("_n")))
    fields = nodes.select(*by, "node", "count").schema

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        n, c = compress(pdf["node"].to_numpy(np.int64), pdf["count"].to_numpy(np.int64), k)
        return pd.DataFrame({b: [pdf[b].iloc[0]] * len(n) for b in by} | {"node": n, "count": c})[[*by, "node", "count"]]

    few = nodes.where(F.col("_n") < k).drop("_n")
    return few.unionByName(nodes.where(F.col("_n") >= k).drop("_n").groupBy(*by).applyInPandas(one, fields))


def build(df: DataFrame, by: list[str], value: str, rank_error: float = RANK_ERROR) -> DataFrame:
    """Digests of ``value`` for each group ``by``, one row for each node: ``by``, node, count.

    Null, NaN and negative values don't count. Null keys make groups of their own. Counting per leaf happens in the JVM
    before the shuffle, so a group of any size reaches a task as no more than 2^20 leaves. No rows, no digests.
    """
    number = F.col(value).cast("double")
    ok = df.where(number.isNotNull() & ~F.isnan(number) & (number >= 0))
    leaves = ok.groupBy(*by, (leaf_of(number) + LEAVES).cast("bigint").alias("node")).agg(F.count("*").alias("count"))
    return _compressed(by, leaves, rank_error)


def merge(digests: DataFrame, by: list[str], rank_error: float = RANK_ERROR) -> DataFrame:
    """Digests over fewer keys (days, partitions, files) by node addition; built with the same ``rank_error``."""
    return _compressed(by, digests.groupBy(*by, "node").agg(F.sum("count").alias("count")), rank_error)


def estimate(digests: DataFrame, by: list[str], wanted: Sequence[float], rank_error: float = RANK_ERROR) -> DataFrame:
    """``by``, quantile, value, n, and max_rank_error: how many ranks of n the value may be off (0 up to n < k).

    Counts add up in postorder (by the node's last leaf, children before parents); a quantile is the last leaf of the node
    in which its rank, ceil(q * n), is reached.
    """
    level = F.length(F.bin("node")) - 1
    nodes = digests.select(*by, "count", (F.expr(f"shiftleft(node + 1, {DEPTH} - (length(bin(node)) - 1))") - 1 - LEAVES).alias("_last"), level.alias("_level"))
    group = Window.partitionBy(*by)
    upto = F.sum("count").over(group.orderBy("_last", F.desc("_level")).rowsBetween(Window.unboundedPreceding, 0))
    nodes = nodes.select(*by, "count", "_last", upto.alias("_upto"), F.sum("count").over(group).alias("n"))

    def here(q: Column) -> Column:
        rank = F.greatest(F.lit(1), F.ceil(q * F.col("n") - F.col("n") * 1e-9))
        return (rank <= F.col("_upto")) & (rank > F.col("_upto") - F.col("count"))

    quantile = F.explode(F.filter(F.array(*(F.lit(float(q)) for q in sorted(set(wanted)))), here))
    return nodes.select(*by, quantile.alias("quantile"), leaf_value(F.col("_last")).alias("value"), "n", (F.floor(F.col("n") / _k(rank_error)) * DEPTH).cast("bigint").alias("max_rank_error"))


def once(df: DataFrame, id_col: str, *columns: str) -> DataFrame:
    """``columns`` of each id once, however often it was delivered; should copies differ, the least counts. Rows with a null id are all kept."""
    apart = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    return df.groupBy(F.col(id_col).alias("_id"), apart.alias("_apart")).agg(F.min(F.struct(*columns)).alias("_row")).select("_row.*")


def metric_rows(spark, sf_dir: str) -> DataFrame:
    """The measured times of the project: record_table, metric, the groups' keys as strings, day and value; each id once."""
    from sparkquarry.sources import load

    answers = once(load(spark, sf_dir, "eval_results"), "result_id", "query_model", "query_mode", "started_at", "ttft_ms", "total_ms")
    answers = answers.select(
        F.lit("eval_results").alias("record_table"), F.col("query_model").alias("key1"), F.col("query_mode").alias("key2"), F.lit(None).cast("string").alias("key3"), F.to_date("started_at").alias("day"),
        F.explode(F.create_map(F.lit("ttft_ms"), "ttft_ms", F.lit("total_ms"), "total_ms")).alias("metric", "value"),
    )
    points = once(load(spark, sf_dir, "vector_perf"), "perf_id", "kind", "profile", "batch_size", "started_at", "internal_ms_p95")
    points = points.select(F.lit("vector_perf").alias("record_table"), F.col("kind").alias("key1"), F.col("profile").alias("key2"), F.col("batch_size").cast("string").alias("key3"), F.to_date("started_at").alias("day"), F.lit("internal_ms_p95").alias("metric"), F.col("internal_ms_p95").alias("value"))
    return answers.unionByName(points)


KEYS = ["record_table", "metric", "key1", "key2", "key3"]
