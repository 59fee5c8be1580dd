"""Problem 5: items over a size limit cut into overlapping pieces at natural boundaries.

Agglomerative: a text begins as atomic segments between its candidate boundaries, each boundary with a strength. A heap
holds the adjacent pairs; the weakest boundary goes first (of equals, the pair with the smaller union) and its segments
become one, as long as that and the overlap fit the limit. What boundaries are left are the cuts.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.llm.frames import integers
from sparkquarry.sources import spread

#: The strengths of boundaries, by index.
BOUNDARIES = ["none", "space", "clause", "sentence", "line", "paragraph"]

# Marks that end sentences and clauses, and what may close a quotation or bracket behind them.
_END, _CLAUSE, _CLOSE = "!.?…؟۔।。．！？", ",:;،؛、，：；", "\"')]’”»›）】」』》"
_CANDIDATE = re.compile(rf"([{re.escape(_END)}]+[{re.escape(_CLOSE)}]*|[{_CLAUSE}]+)?(\s+)|([。！？…]+[{re.escape(_CLOSE)}]*|[、，：；])")
_BLANK_LINE = re.compile(r"\n[^\S\n]*\n")


def candidates(text: str) -> tuple[list[int], list[int]]:
    """Ends of atomic segments within the text, and the strength of the boundary at each."""
    at, strength = [], []
    n = len(text)
    for m in _CANDIDATE.finditer(text):
        e = m.end()
        if e >= n:
            break
        mark, space = m[1] or m[3], m[2]
        if space and "\n" in space:
            s = 5 if _BLANK_LINE.search(space) else 4
        elif mark:
            s = 2 if mark[0] in _CLAUSE or text[e].islower() else 3
        else:
            s = 1
        at.append(e)
        strength.append(s)
    return at, strength


def _hard_cuts(text: str, start: int, end: int, room: int) -> list[int]:
    """Cuts of a segment without boundaries into equal parts of at most ``room``, not before a combining mark if there is a way."""
    parts = -(-(end - start) // room)
    cuts, begin = [], start
    for i in range(1, parts):
        cut = min(start + (end - start) * i // parts, begin + room)
        best = cut
        while best > begin + 1 and (unicodedata.combining(text[best]) or text[best] in "‍️" or text[best - 1] == "‍"):
            best -= 1
        best = best if best > begin + 1 else cut
        cuts.append(best)
        begin = best
    while end - begin > room:
        begin += room
        cuts.append(begin)
    return cuts


def fitting(limit: int, overlap: int) -> int:
    return limit // 2 if overlap >= limit else max(overlap, 0)


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces as start, end and strength of the boundary at the end (5 at the text's end). An overlap that leaves no room under the limit is taken as half the limit, one below 0 as none."""
    n = len(text)
    if n <= limit:
        return [(0, n, 5)]
    overlap = fitting(limit, overlap)
    room = limit - overlap
    bounds = [(a, s) for a, s in zip(*candidates(text)) if a > overlap]  # the first piece holds the overlap
    ends, strengths, begin = [], [], 0
    for a, s in [*bounds, (n, 5)]:
        if a - begin > (room if begin else limit):
            if not begin:  # the first segment may fill the limit
                first = _hard_cuts(text, 0, limit, limit) + [limit]
                hard = [first[0], *_hard_cuts(text, first[0], a, room)]
            else:
                hard = _hard_cuts(text, begin, a, room)
            ends += hard
            strengths += [0] * len(hard)
        ends.append(a)
        strengths.append(s)
        begin = a
    starts = [0, *ends[:-1]]
    m = len(ends)
    following, before, alive = list(range(1, m)) + [-1], list(range(-1, m - 1)), [True] * m
    heap = [(strengths[i], ends[i + 1] - starts[i], i, ends[i + 1]) for i in range(m - 1)]
    heapq.heapify(heap)
    while heap:
        s, size, i, end = heapq.heappop(heap)
        j = following[i] if alive[i] else -1
        if j < 0 or ends[j] != end or end - starts[i] != size or size > (room if starts[i] else limit):
            continue
        ends[i], strengths[i], alive[j] = ends[j], strengths[j], False
        following[i] = k = following[j]
        if k >= 0:
            before[k] = i
            heapq.heappush(heap, (strengths[i], ends[k] - starts[i], i, ends[k]))
        if (h := before[i]) >= 0:
            heapq.heappush(heap, (strengths[h], ends[i] - starts[h], h, ends[i]))
    pieces, i = [], 0
    while i >= 0:
        pieces.append((max(0, starts[i] - overlap) if starts[i] else 0, ends[i], strengths[i]))
        i = following[i]
    return pieces


_SCHEMA = "record_table string, record_id bigint, piece_no int, start_offset int, end_offset int, boundary string, text string"


def split_items(items: DataFrame) -> DataFrame:
    """``record_table, record_id, piece_no, start_offset, end_offset, boundary, text`` for items ``record_table, record_id, text, max_chars, overlap_chars``.

    Offsets are in code points; a piece begins ``overlap_chars`` before the end of the one before it. A text within its
    limit is one piece and doesn't leave the JVM; null texts and items without a limit give no piece; an empty text is one
    empty piece. An overlap not below the limit is taken as half of it, a negative or null one as none. Repeated ids keep their pieces each. Other columns are left out.
    """
    items = items.select("record_table", F.col("record_id").cast("bigint").alias("record_id"), "text", F.col("max_chars").cast("int").alias("max_chars"), F.col("overlap_chars").cast("int").alias("overlap_chars")).where("text is not null and max_chars >= 1")
    length = F.char_length("text")
    short = items.where(length <= F.col("max_chars")).select("record_table", "record_id", F.lit(0).alias("piece_no"), F.lit(0).alias("start_offset"), length.cast("int").alias("end_offset"), F.lit(BOUNDARIES[5]).alias("boundary"), "text")

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = []
            for table, rid, text, limit, overlap in pdf.itertuples(index=False):
                for no, (a, b, s) in enumerate(cut(text, int(limit), int(overlap))):
                    rows.append((table, rid, no, a, b, BOUNDARIES[s], text[a:b]))
            yield integers(pd.DataFrame(rows, columns=[c.split()[0] for c in _SCHEMA.split(", ")]), "record_id")

    long = items.where(length > F.col("max_chars")).withColumn("overlap_chars", F.coalesce("overlap_chars", F.lit(0)))
    return short.unionByName(spread(long, "record_id").mapInPandas(run, _SCHEMA))


def sized_items(spark, sf_dir: str) -> DataFrame:
    """The project's texts with their limits."""
    from sparkquarry.sources import load

    texts = None
    for table, key, field in (("parsed_pages", "page_uid", "native_text"), ("blocks", "block_id", "text"), ("ir_blocks", "ir_block_id", "content_template")):
        t = load(spark, sf_dir, table).select(F.lit(table).alias("record_table"), F.lit(field).alias("field_name"), F.col(key).alias("record_id"), F.col(field).alias("text"))
        texts = t if texts is None else texts.unionByName(t)
    limits = load(spark, sf_dir, "size_limits").select("record_table", "field_name", "max_chars", "overlap_chars")
    return texts.join(F.broadcast(limits), ["record_table", "field_name"])  # a few rows at any scale
