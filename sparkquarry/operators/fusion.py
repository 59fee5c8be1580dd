"""Ranked lists fused and rearranged: all by windows and aggregates over ``query_id``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.functions import text as T

RRF_K = 60.0
# Weights of vector and lexical ranks by profile.
WEIGHTS = [("table", 0.85, 2.75), ("exact", 0.75, 2.5), ("semantic", 1.5, 1.0), ("document_fact", 1.5, 1.5), ("relation_fact", 1.0, 1.75), ("balanced", 1.0, 1.5)]
WIDE = ["exact", "table", "document_fact"]
SPECIAL = [*WIDE, "relation_fact"]


def profiled(queries: DataFrame) -> DataFrame:
    """Queries with profile, w_vector and w_lexical."""
    profile = T.retrieval_profile(F.col("query"))
    pick = lambda i: F.element_at(F.create_map(*(F.lit(x) for w in WEIGHTS for x in (w[0], w[i]))), F.col("profile"))
    return queries.withColumn("profile", profile).withColumns({"w_vector": pick(1), "w_lexical": pick(2)})


def candidate_k(profile, requested: int, usual: int = 6, wide: int = 12):
    return F.greatest(F.lit(requested), F.when(profile.isin(*WIDE), wide).otherwise(usual))


def rerank_n(profile, candidates, requested: int, most: int = 12):
    return F.when(profile.isin(*SPECIAL), F.least(candidates, F.greatest(F.lit(requested), F.lit(most)))).otherwise(F.lit(requested))


#: Lexical rows that are looked through for one that states a relation.
RELATION_SCAN = 64


def fuse(vector: DataFrame, lexical: DataFrame, queries: DataFrame, requested: int = 3) -> DataFrame:
    """``query_id, chunk_id, vector_rank, lexical_rank, score, rank`` by weighted reciprocal ranks; ties by chunk_id.

    ``vector`` and ``lexical``: query_id, chunk_id, rank. As many lexical rows take part, and as many rows come out, as the
    query's profile asks for; for relations ``RELATION_SCAN`` lexical rows take part. A chunk in one list alone has a null
    rank in the other.
    """
    p = profiled(queries).select("query_id", "w_vector", "w_lexical", "profile", candidate_k(F.col("profile"), requested).alias("_k"))
    scan = F.when(F.col("profile") == "relation_fact", F.greatest(F.col("_k"), F.lit(RELATION_SCAN))).otherwise(F.col("_k"))
    lexical = lexical.select("query_id", "chunk_id", F.col("rank").alias("lexical_rank")).join(p.select("query_id", scan.alias("_scan")), "query_id").where("lexical_rank <= _scan").drop("_scan")
    both = vector.select("query_id", "chunk_id", F.col("rank").alias("vector_rank")).join(lexical, ["query_id", "chunk_id"], "full_outer")
    term = lambda w, r: F.coalesce(F.col(w) / (RRF_K + F.col(r)), F.lit(0.0))
    scored = both.join(p, "query_id").withColumn("score", term("w_vector", "vector_rank") + term("w_lexical", "lexical_rank"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))
    return ranked.where("rank <= _k").select("query_id", "chunk_id", "vector_rank", "lexical_rank", "score", "rank")


def direct_relation(lexical: DataFrame, queries: DataFrame, most: int = 480) -> DataFrame:
    """``query_id, chunk_id``: of each query for a relation the first lexical row (query_id, chunk_id, rank, content) that holds both its anchors no more than ``most`` characters apart."""
    q = queries.select("query_id", T.relation_anchors(F.col("query")).alias("a"), T.retrieval_profile(F.col("query")).alias("p")).where("p = 'relation_fact'")
    rows = lexical.join(q, "query_id").where(F.size(T.coverage(F.col("a"), F.col("content"))) == 2)
    rows = rows.withColumn("_span", T.tightest_span(F.get("a", F.lit(0)), F.get("a", F.lit(1)), "content")).where(F.col("_span") <= most)
    return rows.groupBy("query_id").agg(F.min_by("chunk_id", "rank").alias("chunk_id"))


def fuse_after_rerank(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """``ranked`` (query_id, chunk_id, rerank_rank, retrieval_rank, lexical_rank) with score and final_rank: of the special profiles three reciprocal ranks, else as reranked."""
    p = queries.select("query_id", T.retrieval_profile(F.col("query")).alias("profile"))
    score = 1.0 / (RRF_K + F.col("rerank_rank")) + 0.7 / (RRF_K + F.coalesce("retrieval_rank", "rerank_rank")) + F.coalesce(1.5 / (RRF_K + F.col("lexical_rank")), F.lit(0.0))
    out = ranked.join(p, "query_id").withColumn("score", F.when(F.col("profile").isin(*SPECIAL), score))
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), F.when(F.col("score").isNotNull(), F.coalesce("retrieval_rank", F.lit(1_000_000_000))).otherwise(F.col("rerank_rank")), "chunk_id")
    return out.withColumn("final_rank", F.row_number().over(w))


def round_robin(*lists: DataFrame) -> DataFrame:
    """Lists (query_id, chunk_id, rank) merged in turn, each chunk where it comes first: with list_no and position."""
    parts = [d.select("query_id", "chunk_id", "rank", F.lit(i).alias("list_no")) for i, d in enumerate(lists)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    first = whole.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("rank", "list_no"))).where("n = 1").drop("n")
    return first.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "list_no")))


def limit_graph(rows: DataFrame, mode: str, most: int = 6) -> DataFrame:
    """In mixed mode only the first rows of each kind (query_id, kind, rank)."""
    return rows.where(F.lit(mode != "mix") | (F.col("rank") <= most))


def overwrite(rows: DataFrame, focused: DataFrame) -> DataFrame:
    """``rows`` (query_id, chunk_id, content) with the focused content where there is one, and whether it changed."""
    f = focused.select("query_id", "chunk_id", F.col("content").alias("_new"))
    out = rows.join(f, ["query_id", "chunk_id"], "left")
    return out.withColumn("changed", F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("content"))).withColumn("content", F.coalesce("_new", "content")).drop("_new")


def protect(ranked: DataFrame, protected: DataFrame) -> DataFrame:
    """``ranked`` (query_id, chunk_id, rank) whose last row gives way to the protected chunk (query_id, chunk_id), if that is not in it."""
    missing = protected.join(ranked.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    last = ranked.withColumn("_last", F.max("rank").over(Window.partitionBy("query_id")))
    kept = last.join(missing.select("query_id", F.lit(True).alias("_gives")), "query_id", "left").where(~(F.coalesce("_gives", F.lit(False)) & (F.col("rank") == F.col("_last"))))
    ends = ranked.groupBy("query_id").agg(F.max("rank").alias("rank"))
    return kept.select("query_id", "chunk_id", "rank", F.lit(False).alias("protected")).unionByName(missing.join(ends, "query_id").select("query_id", "chunk_id", "rank", F.lit(True).alias("protected")))
