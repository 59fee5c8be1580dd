"""Evidence selection: gates, floors, units and budgets, as windows over ``query_id``."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.operators.lexical import in_blocks
from sparkquarry.session import checkpoint


def anchor_gate(rows: DataFrame) -> DataFrame:
    """Candidates (query_id, chunk_id, query, content) that hold a name of the query. If none does: none for queries with capitals or digits, else all."""
    names = F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_replace("query", r"[^\x00-\x7f]", " ")), F.lit(r"\b[a-z][a-z0-9._:+/-]{3,}\b"), F.lit(0)))
    rows = rows.withColumn("_names", names).withColumn("_hit", F.exists("_names", lambda a: F.contains(F.lower("content"), a)))
    any_hit = F.max("_hit").over(Window.partitionBy("query_id"))
    strict = F.col("query").rlike("[A-Z]{5}|[0-9]")
    return rows.withColumn("_any", any_hit).where((F.size("_names") == 0) | F.col("_hit") | (~F.col("_any") & ~strict)).drop("_names", "_hit", "_any")


def relative_floor(rows: DataFrame, least_top: float, share: float, most: int) -> DataFrame:
    """Rows (query_id, chunk_id, score): where the best score is ``least_top`` or more, those with ``share`` of it; then the best ``most``."""
    w = Window.partitionBy("query_id")
    rows = rows.withColumn("_top", F.max("score").over(w)).where((F.col("_top") < least_top) | (F.col("score") >= share * F.col("_top")))
    return rows.withColumn("_n", F.row_number().over(w.orderBy(F.desc("score"), "chunk_id"))).where(F.col("_n") <= most).drop("_top", "_n")


def authority_factor(content: Column, path: Column, derived_pattern: str) -> Column:
    """0.2 for derived sources, 0.25 for thin passages without commands or paths, both together multiplied."""
    thin = (F.char_length(content) < 160) & ~F.contains(content, F.lit("--")) & ~F.contains(content, F.lit("/"))
    return F.when(path.like(derived_pattern), 0.2).otherwise(1.0) * F.when(thin, 0.25).otherwise(1.0)


def exact_boost(score: Column, hits: Column) -> Column:
    return F.when(hits >= 2, score * (1 + 0.4 * F.least(hits, F.lit(3)))).otherwise(score)


def unit_score(query: Column, text: Column, is_row: Column) -> Column:
    """12 for each composite name of the query in the text, 3 for each ASCII term, 1 for each bigram of its ideographs (repeats count), 2 more for a table row that has any."""
    low, q = F.lower(text), F.lower(query)
    names = F.array_distinct(F.regexp_extract_all(q, F.lit(r"[a-z][a-z0-9]*(?:[._/:+-][a-z0-9]+)+"), F.lit(0)))
    terms = F.array_distinct(F.regexp_extract_all(q, F.lit(r"[a-z][a-z0-9_-]+"), F.lit(0)))
    han = F.array_join(F.regexp_extract_all(query, F.lit(r"[\x{3400}-\x{9fff}]"), F.lit(0)), "")
    pairs = F.when(F.char_length(han) > 1, F.transform(F.sequence(F.lit(1), F.char_length(han) - 1), lambda i: F.substring(han, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    count = lambda a: F.size(F.filter(a, lambda t: F.contains(low, t)))
    score = 12 * count(names) + 3 * count(terms) + count(pairs)
    return score + F.when(is_row & (score > 0), 2).otherwise(0)


def candidate_units(units: DataFrame, per_chunk: int = 8, most: int = 24) -> DataFrame:
    """Units (query_id, chunk_rank, unit_index, direct): the best of each chunk, taken from the chunks in turn up to ``most`` of a query, with their position."""
    w = Window.partitionBy("query_id", "chunk_rank").orderBy(F.desc("direct"), "unit_index")
    deep = units.withColumn("depth", F.row_number().over(w)).where(F.col("depth") <= per_chunk)
    return deep.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("depth", "chunk_rank"))).where(F.col("position") <= most)


def admit(units: DataFrame, share: float = 0.5, neighbour: float = 0.35, most: int = 12, budget: int = 6000) -> DataFrame:
    """Units (query_id, chunk_rank, unit_index, section, score, size) over the floor, their neighbours in the section with a lower one, the best ``most``, as far as they fit the budget.

    In the order of their scores each unit is taken if it fits what is left, the first always; bounded by ``most`` a query.
    """
    w, near = Window.partitionBy("query_id"), Window.partitionBy("query_id", "chunk_rank", "section").orderBy("unit_index")
    u = units.withColumn("best", F.max("score").over(w)).withColumn("core", F.col("score") >= F.greatest(F.lit(0.1), F.col("best") * share))
    adjacent = lambda f: F.coalesce(f("core").over(near) & (F.abs(f("unit_index").over(near) - F.col("unit_index")) == 1), F.lit(False))
    u = u.where(F.col("core") | F.col("score").isNotNull()).withColumn("beside", adjacent(F.lag) | adjacent(F.lead))
    u = u.where(F.col("core") | (F.col("beside") & (F.col("score") >= F.greatest(F.lit(0.1), F.col("best") * neighbour))))
    u = u.withColumn("n", F.row_number().over(w.orderBy(F.desc("score"), "chunk_rank", "unit_index"))).where(F.col("n") <= most)
    packed = u.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", "size", "chunk_rank", "unit_index", "score"))).alias("us"))
    start = F.named_struct(F.lit("used"), F.lit(0).cast("bigint"), F.lit("taken"), F.array().cast("array<int>"))
    fits = lambda a, x: (F.size(a["taken"]) == 0) | (a["used"] + x["size"] <= budget)
    state = F.aggregate("us", start, lambda a, x: F.when(fits(a, x), F.named_struct(F.lit("used"), a["used"] + x["size"], F.lit("taken"), F.array_append(a["taken"], x["n"]))).otherwise(a))
    return packed.select("query_id", F.explode("us").alias("u"), state["taken"].alias("taken")).where(F.array_contains("taken", F.col("u.n"))).select("query_id", "u.chunk_rank", "u.unit_index", "u.score", "u.n")


#: What a self-contained table of measured values counts more for.
TABLE_BOOST = 1.5


def authority(rows: DataFrame, derived_pattern: str) -> DataFrame:
    """``query_id, chunk_id, score, final_rank``: what the policy of sources leaves of a query's candidates, by adjusted scores.

    ``rows``: query_id, chunk_id, rank, score, file_path, family, content, relation (of the query), diagnostic (of the query),
    parent (a table of the type asked for), named (matches of the query's names), protected, hits (of expansions), table
    (a self-contained table that matches). Derived and thin sources count less, hits and tables more; null scores stay and
    sort as 0; scores that are alike to nine digits keep their order. Then, the first that a query has rows for: tables of the type asked for; else, unless the query is for a
    relation, those with most named matches (and protected ones with two hits), of these the protected ones if there are;
    of what is left the self-contained tables if there are; else for diagnostic queries no derived summary (``.kg.md``)
    beside its source text and none under 0.3 of a best score of 0.5 or more, two at most.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    by = Window.partitionBy("query_id")
    boost = F.when(F.col("hits") >= 2, 1 + 0.4 * F.least(F.col("hits"), F.lit(3))).otherwise(1.0) * F.when(flag("table"), TABLE_BOOST).otherwise(1.0)
    r = rows.withColumn("score", F.col("score") * authority_factor(F.col("content"), F.col("file_path"), derived_pattern) * boost).drop("content")
    r = r.withColumn("_n", F.row_number().over(by.orderBy(F.desc(F.round(F.coalesce("score", F.lit(0.0)), 9)), "rank")))

    def only(df: DataFrame, keep: Column) -> DataFrame:
        """Of each query the rows to keep, if there are any, else all."""
        return df.withColumn("_k", keep).withColumn("_any", F.max("_k").over(by)).where(F.col("_k") | ~F.col("_any")).drop("_k", "_any")

    r = only(r, flag("parent")).withColumn("_done", F.max(flag("parent")).over(by))
    free = ~F.col("_done") & ~flag("relation")
    most = F.max("named").over(by)
    r = r.withColumn("_most", most).where(~free | (F.col("_most") < 1) | (F.col("named") == F.col("_most")) | (flag("protected") & (F.col("hits") >= 2))).drop("_most")
    r = only(r, ~F.col("_done") & ~flag("relation") & flag("protected"))
    r = only(r, ~F.col("_done") & flag("table"))
    r = r.withColumn("_done", F.col("_done") | F.max(flag("table")).over(by))
    # a summary goes if the text it was made of is there
    asked = ~F.col("_done") & flag("diagnostic")
    text = F.max(F.col("file_path").like("%.text.md")).over(Window.partitionBy("query_id", "family"))
    r = only(r.withColumn("_beside", F.coalesce(F.col("file_path").like("%.kg.md") & text, F.lit(False))), asked & ~F.col("_beside")).drop("_beside")
    score = F.coalesce("score", F.lit(0.0))
    r = r.withColumn("_top", F.first(score).over(by.orderBy("_n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    r = r.where(~asked | (F.col("_top") < 0.5) | (score >= 0.3 * F.col("_top"))).withColumn("_m", F.row_number().over(by.orderBy("_n")))
    r = r.where(~asked | (F.col("_top") < 0.5) | (F.col("_m") <= 2))
    return r.select("query_id", "chunk_id", "score", F.col("_m").alias("final_rank"))


def quotes_in_sources(quotes: DataFrame, documents: DataFrame, most: int = 50_000) -> DataFrame:
    """``source, quote`` of those quotes (source, quote) that some text of their source (source, text) holds, without regard to case.

    Distinct quotes go in blocks against all texts; a task looks up a block's quotes at once and gives each source and
    quote once, so neither texts nor pairs of quotes and texts are shuffled, however many of either a source has. Null and
    empty quotes are in no text.
    """
    want = quotes.where("source is not null and quote <> ''").select("source", F.lower("quote").alias("quote")).distinct()

    def search(rows: list) -> DataFrame:
        shared = documents.sparkSession.sparkContext.broadcast([r[0] for r in rows])  # one block

        def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import ahocorasick

            holds = ahocorasick.Automaton()
            for q in shared.value:
                holds.add_word(q, q)
            holds.make_automaton()
            for pdf in pdfs:
                found = {(s, q) for s, t in zip(pdf["source"], pdf["low"]) for _, q in holds.iter(t)}
                yield pd.DataFrame(list(found), columns=["source", "quote"])

        texts = documents.where("source is not null and text is not null").select("source", F.lower("text").alias("low"))
        return checkpoint(texts.mapInPandas(run, "source string, quote string").join(want, ["source", "quote"], "left_semi").distinct())

    found = in_blocks(want.select("quote").distinct(), search, most)
    return found if found is not None else want


def count_holding(literals: DataFrame, texts: DataFrame, most: int = 50_000) -> DataFrame:
    """``literal, n``: how many texts (text) hold each literal (literal, in lower case), without regard to case; those that none holds are left out. Blocks of literals go against all texts, counted where they are."""
    want = literals.where("literal <> ''").select("literal").distinct()

    def search(rows: list) -> DataFrame:
        shared = texts.sparkSession.sparkContext.broadcast([r[0] for r in rows])  # one block

        def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import ahocorasick

            holds = ahocorasick.Automaton()
            for q in shared.value:
                holds.add_word(q, q)
            holds.make_automaton()
            n: Counter = Counter()
            for pdf in pdfs:
                for t in pdf["low"]:
                    n.update({q for _, q in holds.iter(t)})
            yield pd.DataFrame(list(n.items()), columns=["literal", "n"])

        found = texts.where("text is not null").select(F.lower("text").alias("low")).mapInPandas(run, "literal string, n bigint")
        return checkpoint(found.groupBy("literal").agg(F.sum("n").alias("n")))

    found = in_blocks(want, search, most)
    return found if found is not None else want.select("literal", F.lit(0).cast("bigint").alias("n"))
