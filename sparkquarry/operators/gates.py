"""Gates over a query's candidates: flags on rows, and what the query's rows have of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.functions import text as T


def keep_if_any(rows: DataFrame, flag: str, by: str = "query_id") -> DataFrame:
    """The flagged rows of each query that has some; all rows of the others. Null flags are false."""
    f = F.coalesce(flag, F.lit(False))
    return rows.withColumn("_f", f).withColumn("_any", F.max("_f").over(Window.partitionBy(by))).where(F.col("_f") | ~F.col("_any")).drop("_f", "_any")


def coverage_gate(rows: DataFrame, typed: str, passed: str, by: str = "query_id") -> DataFrame:
    """Of queries with typed rows that passed only those; of the others the rows without the typed ones that failed."""
    t, p = F.coalesce(typed, F.lit(False)), F.coalesce(passed, F.lit(False))
    return rows.withColumn("_ok", t & p).withColumn("_any", F.max("_ok").over(Window.partitionBy(by))).where(F.when(F.col("_any"), F.col("_ok")).otherwise(~(t & ~p))).drop("_ok", "_any")


def protected_evidence(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, chunk_id, why``: the candidate (query_id, chunk_id, rank, lexical_rank, content) that must not be lost.

    For facts of documents the first substantive one; for questions with identifiers the one that holds most of them, then
    the first by lexical rank; else the first substantive one by lexical rank; none for general questions.
    """
    q = queries.select("query_id", T.retrieval_profile(F.col("query")).alias("profile"), T.direct_identifiers(F.col("query")).alias("ids"))
    c = candidates.join(q, "query_id").withColumn("covered", F.size(T.coverage(F.col("ids"), F.col("content")))).withColumn("solid", T.substantive(F.col("content")))
    last = F.lit(1_000_000_000)
    lex, rank = F.coalesce("lexical_rank", last), F.coalesce("rank", last)
    g = c.where(F.col("profile").isin("document_fact", "exact", "table", "relation_fact")).groupBy("query_id", "profile").agg(
        F.min(F.when(F.col("solid"), F.struct(rank.alias("a"), "chunk_id"))).alias("fact"),
        F.min(F.when(F.col("covered") > 0, F.struct((-F.col("covered")).alias("n"), lex.alias("a"), rank.alias("b"), "chunk_id"))).alias("named"),
        F.min(F.when(F.col("solid") & F.col("lexical_rank").isNotNull(), F.struct("lexical_rank", "chunk_id"))).alias("lexical"),
    )
    pick = F.when(F.col("profile") == "document_fact", F.struct(F.col("fact.chunk_id").alias("chunk_id"), F.lit("fact").alias("why"))).when(F.col("named").isNotNull(), F.struct(F.col("named.chunk_id").alias("chunk_id"), F.lit("named").alias("why"))).otherwise(F.struct(F.col("lexical.chunk_id").alias("chunk_id"), F.lit("lexical").alias("why")))
    return g.select("query_id", pick.alias("p")).select("query_id", "p.*").where("chunk_id is not null")
