"""Vector search: a stated query set against all rows, in blocks, through BLAS."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.operators.lexical import in_blocks, top_k
from sparkquarry.session import checkpoint

#: Query vectors that go to the executors at once.
BLOCK = 4096


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, threshold: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, id_col, similarity, rank`` of the ``k`` nearest rows by cosine; ties by id. ``queries``: query_id and ``vector_col``.

    Queries are sent in blocks of at most ``BLOCK`` vectors, one block after another, so what the driver holds and sends
    stays bounded; each task keeps ``k`` rows of a batch for each query before anything is shuffled. Null and zero vectors match nothing.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    qkind = queries.schema["query_id"].dataType.simpleString()

    def search(block: list) -> DataFrame:
        ids = [r[0] for r in block]
        q = np.array([r[1] for r in block], float)
        norm = np.linalg.norm(q, axis=1, keepdims=True)
        shared = vectors.sparkSession.sparkContext.broadcast((ids, q / np.where(norm > 0, norm, 1), norm[:, 0] > 0))

        def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q, ok = shared.value
            for pdf in pdfs:
                x = np.stack(pdf[vector_col].to_numpy()).astype(float) if len(pdf) else np.zeros((0, q.shape[1]))
                n = np.linalg.norm(x, axis=1)
                keep = n > 0
                x, own = x[keep] / n[keep, None], pdf[id_col].to_numpy()[keep]
                if not len(own):
                    continue
                s = q @ x.T
                rows = []
                for i in np.flatnonzero(ok):
                    cut = np.partition(s[i], -k)[-k] if len(own) > k else -2.0  # ties at the cut all stay
                    for j in np.flatnonzero(s[i] >= max(cut - 1e-12, threshold if threshold is not None else -2.0)):
                        rows.append((ids[i], own[j], s[i, j]))
                yield pd.DataFrame(rows, columns=["query_id", id_col, "similarity"])

        found = vectors.select(id_col, vector_col).where(F.col(vector_col).isNotNull()).mapInPandas(run, f"query_id {qkind}, `{id_col}` {kind}, similarity double")
        found = found.withColumn("similarity", F.round("similarity", 9))
        return checkpoint(top_k(found, k, ["query_id"], F.desc("similarity"), F.col(id_col)))

    out = in_blocks(queries.where(F.col(vector_col).isNotNull()).select("query_id", vector_col), search, BLOCK)
    if out is None:
        out = vectors.limit(0).select(F.lit(None).cast(qkind).alias("query_id"), id_col, F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("int").alias("rank"))
    return out


#: The bound of the sample that an index's centres are fitted on, rounds of fitting, and lists that a query looks into as a share of all: vectors without clusters, as the test data's, need so many for a recall of 0.9; clustered ones far fewer.
SAMPLE, ROUNDS, PROBED = 20_000, 12, 0.7


class Index:
    """An inverted index of vectors: ``centres`` (unit vectors, about the square root of the number of rows, 4,096 at most) and ``rows``, every row with the list of its nearest centre."""

    def __init__(self, centres: np.ndarray, rows: DataFrame, id_col: str, vector_col: str):
        self.centres, self.rows, self.id_col, self.vector_col = centres, rows, id_col, vector_col


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> Index:
    """Centres by spherical k-means over at most ``sample`` vectors, taken by a hash of their ids; then every row in a list, written sorted by list.

    Null and zero vectors are in no list. The centres' number and the sample are bounded, the lists are not: a list of
    however many alike vectors is spread over the files as it came.
    """
    ok = vectors.where(F.col(vector_col).isNotNull()).select(id_col, vector_col)
    n = ok.count()
    share = min(1.0, 1.2 * sample / max(n, 1))
    taken = ok.where(F.shiftrightunsigned(F.xxhash64(id_col), 1) <= F.lit(min(int(share * 2**63), 2**63 - 1))).limit(sample)
    x = [r[0] for r in taken.select(vector_col).collect()]  # the sample
    x = _unit(np.array(x, float)) if x else np.zeros((0, 1))
    x = x[np.linalg.norm(x, axis=1) > 0]
    k = max(1, min(4096, len(x), round(n**0.5)))
    centres = x[np.random.default_rng(0).permutation(len(x))[:k]] if len(x) else np.zeros((1, 1))
    for _ in range(ROUNDS if len(x) else 0):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        empty = np.bincount(near, minlength=len(centres)) == 0
        centres = np.where(empty[:, None], centres, _unit(sums))
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    kind = ok.schema[vector_col].dataType.simpleString()

    def assign(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            if len(pdf):
                v = np.stack(pdf[vector_col].to_numpy()).astype(float)
                pdf = pdf.assign(list=(v @ shared.value.T).argmax(1).astype(np.int32))[np.linalg.norm(v, axis=1) > 0]
                yield pdf

    rows = ok.mapInPandas(assign, f"`{id_col}` {ok.schema[id_col].dataType.simpleString()}, `{vector_col}` {kind}, list int")
    return Index(centres, checkpoint(rows.sortWithinPartitions("list")), id_col, vector_col)


def indexed_top_k(index: Index, queries: DataFrame, k: int = 10, probed: float = PROBED) -> DataFrame:
    """``query_id, id_col, similarity, rank`` of the nearest rows by cosine in the lists that lie nearest to each query (``probed`` of all); ties by id. Not every near row may be found; those that are come with their exact similarity.

    Queries go in blocks, as in :func:`cosine_top_k`; a task multiplies the rows of a list with those queries alone that look into it.
    """
    id_col, vector_col, rows = index.id_col, index.vector_col, index.rows
    kind, qkind = rows.schema[id_col].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    most = max(1, round(probed * len(index.centres)))

    def search(block: list) -> DataFrame:
        q = _unit(np.array([r[1] for r in block], float))
        looks = np.argsort(-(q @ index.centres.T), axis=1, kind="stable")[:, :most]
        by_list: dict[int, list[int]] = {}
        for n in np.flatnonzero(np.linalg.norm(q, axis=1) > 0):
            for c in looks[n].tolist():
                by_list.setdefault(c, []).append(int(n))
        shared = rows.sparkSession.sparkContext.broadcast(([r[0] for r in block], q, by_list))

        def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q, by_list = shared.value
            held = []

            def cut() -> pd.DataFrame:
                whole = pd.concat(held, ignore_index=True).sort_values(["n", "similarity", id_col], ascending=[True, False, True])
                return whole[whole.groupby("n").cumcount() < k]

            for pdf in pdfs:
                for c, part in pdf.groupby("list"):
                    if (ns := by_list.get(int(c))) is None:
                        continue
                    x = _unit(np.stack(part[vector_col].to_numpy()).astype(float))
                    s = np.round(q[ns] @ x.T, 9)
                    floor = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(ns), -2.0)
                    i, j = np.nonzero(s >= floor[:, None])
                    held.append(pd.DataFrame({"n": np.array(ns)[i], id_col: part[id_col].to_numpy()[j], "similarity": s[i, j]}))
                if sum(map(len, held)) > 4 * k * len(ids) + 10_000:
                    held = [cut()]
            if held:
                out = cut()
                yield pd.DataFrame({"query_id": [ids[n] for n in out["n"]], id_col: out[id_col].to_numpy(), "similarity": out["similarity"].to_numpy()})

        wanted = rows.where(F.col("list").isin(sorted(by_list))) if len(by_list) < len(index.centres) else rows
        found = wanted.mapInPandas(run, f"query_id {qkind}, `{id_col}` {kind}, similarity double")
        return checkpoint(top_k(found, k, ["query_id"], F.desc("similarity"), F.col(id_col)))

    asked = queries.where(F.col(vector_col).isNotNull()).select("query_id", vector_col)
    out = in_blocks(asked, search, BLOCK) if index.centres.any() else None
    if out is None:
        out = rows.limit(0).select(F.lit(None).cast(qkind).alias("query_id"), id_col, F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("int").alias("rank"))
    return out
