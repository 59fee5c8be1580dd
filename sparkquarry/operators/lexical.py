"""Inverted statistics and BM25 for many queries at once.

Statistics are counted with partial aggregation. A search takes its queries in blocks against all chunks: one pass over
the texts keeps of each chunk the counts of the block's terms, a second over these scores every chunk where it is, so
neither postings nor pairs of queries and chunks are shuffled, only each task's best for each query.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.functions import text as T
from sparkquarry.session import checkpoint

K1, B, EXACT_BOOST = 1.5, 0.75, 2.0


def _exploded(df: DataFrame, terms: Column, *keep: str) -> DataFrame:
    """A row for each term. ``explode`` alone would have the optimizer test ``size(terms) > 0`` beforehand, and so build the terms twice."""
    return df.select(*keep, F.explode_outer(terms).alias("term")).where("term is not null")


def postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """``id_col, term, tf``."""
    return _exploded(chunks, T.terms(F.col(text_col)), id_col).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def lengths(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """``id_col, length`` in terms, without shuffling."""
    return chunks.select(id_col, T.n_terms(F.col(text_col)).alias("length"))


def corpus_stats(chunks: DataFrame, text_col: str = "content") -> DataFrame:
    """One row: n, total and avgdl of the chunks, 0 for none."""
    return chunks.select(T.n_terms(F.col(text_col)).alias("length")).agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avgdl"))


def top_k(df: DataFrame, k: int, partition: list[str], *order: Column, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each partition, with their rank from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col(rank) <= k)


#: Queries that are searched for at once. What goes to the tasks is of one block: its terms and weights.
BLOCK = 2048
#: Scores that a task holds at once, chunks times queries of the block.
CELLS = 4_000_000
#: Terms whose postings and queries are multiplied as a dense matrix, those with the most pairs; the others one by one.
DENSE = 256


@lru_cache(200_000)
def index_terms_of(term: str) -> tuple[str, ...]:
    """What :func:`functions.text.terms` makes of one term, the same rules in Python."""
    if term >= T.FIRST_IDEOGRAPH:
        return (*term, *(term[i : i + 2] for i in range(len(term) - 1)))
    parts = _SEPARATORS.split(term)
    if len(parts) == 1:
        return (term,)
    return (term, *parts, "".join(parts)) if _DIGIT.search(term) else (term, *parts)


@lru_cache(200_000)
def passage_terms_of(term: str) -> tuple[str, ...]:
    return tuple(term[i : i + 2] for i in range(len(term) - 1)) if term >= T.FIRST_IDEOGRAPH else (term,)


_SPACED, _PUNCTUATION = re.compile(rf"\b{T.SPACED}"), re.compile("[^a-z0-9]+")


def with_aliases(low: str) -> str:
    """A text in lower case as :func:`functions.text.index_text` has it, by the same rules in Python."""
    found = {_PUNCTUATION.sub("", m) for m in _SPACED.findall(low) if _DIGIT.search(m)}
    return low + "\n" + " ".join(sorted(found)) if found else low


TERM = re.compile(T.TERM.replace(r"\x{3400}-\x{9fff}", "\u3400-\u9fff"))
_SEPARATORS, _DIGIT = re.compile(T.SEPARATORS), re.compile("[0-9]")
_POSTS = "size double, terms array<int>, tfs array<int>"


def in_blocks(queries: DataFrame, search: Callable[[list], DataFrame], most: int = BLOCK) -> DataFrame | None:
    """What ``search`` gives of the queries' rows, ``most`` at a time, put together; None without rows. ``search`` must end with a checkpoint, so that one block is held at a time."""
    out, rows = None, []
    for row in queries.toLocalIterator():
        rows.append(row)
        if len(rows) == most:
            out, rows = search(rows) if out is None else out.unionByName(search(rows)), []
    if rows:
        out = search(rows) if out is None else out.unionByName(search(rows))
    return out


def _weights_bm25(tf: np.ndarray, size: np.ndarray, mean: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / max(mean, 1.0)))


def _weights_cosine(tf: np.ndarray, size: np.ndarray, mean: float) -> np.ndarray:
    return (1 + np.log(tf)) / size


def _postings_of(texts: DataFrame, vocabulary: dict[str, int], exact: list[str], passage: bool) -> DataFrame:
    """``chunk_id, size, terms, tfs`` of texts (chunk_id, low): each chunk's counts of the block's terms. Exact terms that the text holds follow with a count of 0. Index terms are of index texts, passage terms of texts as they are. Size is the number of terms or, of passage terms, the length of the vector of them all."""
    kind = texts.schema["chunk_id"].dataType.simpleString()
    shared = texts.sparkSession.sparkContext.broadcast((vocabulary, exact))  # of one block of queries
    of = passage_terms_of if passage else index_terms_of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        known, literal = shared.value
        holds = ahocorasick.Automaton()
        for n, e in enumerate(literal):
            holds.add_word(e, len(known) + n)
        if literal:
            holds.make_automaton()
        seen: dict[str, tuple[int, tuple[int, ...]]] = {}
        for batch in batches:
            sizes, terms, counts = [], [], []
            for low in batch.column(1).to_pylist():
                if not passage:
                    low = with_aliases(low)
                tf: dict[int, int] = {}
                total, others = 0, Counter()
                for term, n in Counter(TERM.findall(low)).items():
                    if (x := seen.get(term)) is None:
                        every = of(term)
                        x = seen[term] = (len(every), tuple(known[e] for e in every if e in known), every if passage else ())
                    total += n * x[0]
                    for t in x[1]:
                        tf[t] = tf.get(t, 0) + n
                    if passage:
                        for e in x[2]:
                            others[e] += n
                sizes.append(math.sqrt(sum((1 + math.log(n)) ** 2 for n in others.values())) if passage else total)
                found = {t for _, t in holds.iter(low)} if literal else ()
                terms.append([*tf, *found])
                counts.append([*tf.values(), *[0] * len(found)])
            if len(seen) > 300_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.float64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["chunk_id", "size", "terms", "tfs"])

    return texts.select("chunk_id", "low").mapInArrow(run, f"chunk_id {kind}, {_POSTS}")


def _frequencies(posts: DataFrame, n_terms: int) -> tuple[np.ndarray, int, float]:
    """In how many chunks each term of the block occurs, the number of chunks and the sum of their sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(n_terms, np.int64), 0, 0.0
        for batch in batches:
            df += np.bincount(batch.column(1).flatten().to_numpy(), minlength=n_terms)
            n, total = n + batch.num_rows, total + float(np.sum(batch.column(0).to_numpy()))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1, -2], pa.int32()), pa.array([*df[at].astype(float).tolist(), float(n), total])], names=["term", "n"])

    rows = posts.select("size", "terms").mapInArrow(run, "term int, n double").groupBy("term").agg(F.sum("n").alias("n")).toPandas()  # terms of the block at most
    df = np.zeros(n_terms)
    real = rows[rows["term"] >= 0]
    df[real["term"].to_numpy(int)] = real["n"]
    one = dict(zip(rows["term"], rows["n"]))
    return df, int(one.get(-1, 0)), float(one.get(-2, 0.0))


def _best(posts: DataFrame, ids: list, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], df: np.ndarray, n_terms: int, mean: float, weigh, k: int, qkind: str) -> DataFrame:
    """``query_id, chunk_id, score`` of each task's best ``k`` for each query of the block; ``pairs``: query, term (exact ones from ``n_terms`` on), weight."""
    q, t, w = pairs
    order = np.argsort(t, kind="stable")
    q, t, w = q[order], t[order], w[order]
    start = np.searchsorted(t, np.arange(len(df) + 1))
    cost = df * np.diff(start)
    dense = np.flatnonzero(cost > 0)
    dense = dense[np.argsort(-cost[dense], kind="stable")[:DENSE]]
    table = np.zeros((len(dense), len(ids)))
    for row, term in enumerate(dense):
        table[row, q[start[term] : start[term + 1]]] = w[start[term] : start[term + 1]]
    place = np.full(len(df), -1)
    place[dense] = np.arange(len(dense))
    kind = posts.schema["chunk_id"].dataType.simpleString()
    shared = posts.sparkSession.sparkContext.broadcast((ids, q, w, start, table, place))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        ids, q, w, start, table, place = shared.value
        rows = max(1, CELLS // max(len(ids), 1))
        held: list[pd.DataFrame] = []

        def cut() -> pd.DataFrame:
            whole = pd.concat(held, ignore_index=True).sort_values(["q", "score", "chunk_id"], ascending=[True, False, True])
            return whole[whole.groupby("q").cumcount() < k]

        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                part = batch.slice(a, rows)
                own = part.column(0).to_pandas()
                size, lists = part.column(1).to_numpy(), part.column(2)
                term, tf = lists.flatten().to_numpy(), part.column(3).flatten().to_numpy()
                of = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                value = np.full(len(term), EXACT_BOOST)
                real = tf > 0
                value[real] = weigh(tf[real].astype(float), size[of[real]], mean)
                score = np.zeros((part.num_rows, len(ids)))
                where = place[term]
                if (d := where >= 0).any():
                    left = np.zeros((part.num_rows, len(table)))
                    left[of[d], where[d]] = value[d]
                    score += left @ table
                rest = np.flatnonzero(~d)
                rest = rest[np.argsort(term[rest], kind="stable")]
                cuts = np.flatnonzero(np.r_[True, np.diff(term[rest]) != 0]) if len(rest) else []
                for b, e in zip(cuts, [*cuts[1:], len(rest)]):
                    at = rest[b:e]
                    x = slice(start[term[at[0]]], start[term[at[0]] + 1])
                    score[np.ix_(of[at], q[x])] += value[at][:, None] * w[x]
                score = np.round(score, 9)
                floor = np.partition(score, -k, axis=0)[-k] if part.num_rows > k else np.zeros(len(ids))
                c, x = np.nonzero((score > 0) & (score >= floor))
                held.append(pd.DataFrame({"q": x, "chunk_id": own.to_numpy()[c], "score": score[c, x]}))
                if sum(map(len, held)) > 4 * k * len(ids) + 10_000:
                    held = [cut()]
        if held:
            out = cut()
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"query_id": [ids[i] for i in out["q"]], "chunk_id": out["chunk_id"].to_numpy(), "score": out["score"].to_numpy(float)}), schema=schema, preserve_index=False)

    from pyspark.sql.pandas.types import to_arrow_schema

    empty = posts.sparkSession.createDataFrame([], f"query_id {qkind}, chunk_id {kind}, score double")
    schema = to_arrow_schema(empty.schema)
    return posts.mapInArrow(run, empty.schema)


def _search(texts: DataFrame, queries: DataFrame, k: int, passage: bool) -> DataFrame:
    """``query_id, chunk_id, score, rank`` for texts (chunk_id, low) and queries (query_id, terms, exact), block by block.

    Each block reads the texts once; a chunk is scored where it is, so what is shuffled is each task's best ``k`` for each
    query. The driver holds one block of queries at a time.
    """
    qkind = queries.schema["query_id"].dataType.simpleString()
    texts = texts.where(F.length("low") > 0)

    def block(rows: list) -> DataFrame:
        vocabulary: dict[str, int] = {}
        counts = [Counter(vocabulary.setdefault(t, len(vocabulary)) for t in r[1] or ()) for r in rows]
        exact: dict[str, int] = {}
        wanted = [[exact.setdefault(e, len(exact)) for e in r[2] or ()] for r in rows]
        posts = checkpoint(_postings_of(texts, vocabulary, list(exact), passage))
        df, n, total = _frequencies(posts, len(vocabulary) + len(exact))
        q = np.array([i for i, c in enumerate(counts) for _ in c], np.int64)
        t = np.array([x for c in counts for x in c], np.int64)
        f = np.array([x for c in counts for x in c.values()], float)
        here = df[t] > 0 if len(t) else np.zeros(0, bool)
        q, t, f = q[here], t[here], f[here]
        if passage:
            w = (1 + np.log(f)) * np.log(1 + n / df[t])
            w = w / np.sqrt(np.bincount(q, w * w, len(rows)))[q]
        else:
            w = f * np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
        eq = np.array([i for i, x in enumerate(wanted) for _ in x], np.int64)
        et = np.array([e + len(vocabulary) for x in wanted for e in x], np.int64)
        pairs = np.r_[q, eq], np.r_[t, et], np.r_[w, np.ones(len(eq))]
        found = _best(posts, [r[0] for r in rows], pairs, df, len(vocabulary), total / max(n, 1), _weights_cosine if passage else _weights_bm25, k, qkind)
        return checkpoint(top_k(found, k, ["query_id"], F.desc("score"), F.col("chunk_id")))

    out = in_blocks(queries, block)
    return out if out is not None else block([])


def bm25(chunks: DataFrame, queries: DataFrame, k: int = 12) -> DataFrame:
    """``query_id, chunk_id, score, rank``: BM25 over the index texts of all chunks, with 2 more for each of the query's exact terms that an index text holds, be it inside a word; scores above 0, ties by chunk_id.

    ``chunks``: chunk_id, content. ``queries``: query_id, query and, if there is such a column, ``expanded``, which is
    searched for instead. Null queries and texts match nothing; empty texts are no chunks.
    """
    text = F.col("expanded" if "expanded" in queries.columns else "query")
    q = queries.select("query_id", T.terms(text).alias("terms"), T.exact_terms(text).alias("exact")).where("terms is not null")
    return _search(chunks.select("chunk_id", F.lower("content").alias("low")), q, k, passage=False)


def cosine(chunks: DataFrame, queries: DataFrame, k: int = 12) -> DataFrame:
    """``query_id, chunk_id, score, rank``: cosine of vectors over passage terms of all chunks; ties by chunk_id.

    A term weighs 1 + ln(count) in a chunk, and in a query that times ln(1 + n / df); a query's terms that no chunk has are
    not in its vector. Null queries and texts match nothing; empty texts are no chunks.
    """
    q = queries.select("query_id", T.passage_terms(F.col("query")).alias("terms"), F.lit(None).cast("array<string>").alias("exact")).where("terms is not null")
    return _search(chunks.select("chunk_id", F.lower("content").alias("low")), q, k, passage=True)


def line_scores(lines: DataFrame, queries: DataFrame, passage: bool = False) -> DataFrame:
    """``query_id, line_id, score``: how many of the query's terms a line has, repeats counted as often as in both. ``lines``: query_id, line_id, line."""
    f = T.passage_terms if passage else T.terms
    a = _exploded(lines, f(F.col("line")), "query_id", "line_id").groupBy("query_id", "line_id", "term").agg(F.count("*").alias("n"))
    b = _exploded(queries, f(F.col("query")), "query_id").groupBy("query_id", "term").agg(F.count("*").alias("m"))
    return a.join(b, ["query_id", "term"]).groupBy("query_id", "line_id").agg(F.sum(F.least("n", "m")).alias("score"))
