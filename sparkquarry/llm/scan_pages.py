"""Pages of scanned text for problem 2: put together from three sources, their running lines and page numbers found.

A page is one record of its source, so its lines are taken together; documents, which may be of any length, never are.
One shuffle by page brings a page's own text, its read lines and its glyphs to one place, sorted, and each source becomes
one row with its lines and a few facts on those near the page's edges. What recurs over a document is then counted over
these facts alone, by document and key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.session import checkpoint

# What scanners confuse, each glyph as the strokes it shares with others (so rn is m, cl is d, li is h, ii is u, ri is n); Latin glyphs within Cyrillic words.
_GLYPHS = str.maketrans({
    "d": "cl", "h": "ll", "u": "ll", "ü": "ll", "n": "rl", "m": "rrl", "w": "vv", "i": "l", "í": "l", "ì": "l", "1": "l", "|": "l", "!": "l", "e": "c", "¢": "c", "€": "c",
    "0": "o", "5": "s", "$": "s", "9": "g", "6": "b", "8": "b", "ſ": "f", "†": "t", "2": "z", "4": "a", "@": "a",
})
_CYRILLIC = str.maketrans({"m": "т", "k": "к", "u": "и", "n": "п", "p": "р", "c": "с", "a": "а", "o": "о", "e": "е", "x": "х", "y": "у", "b": "ь", "h": "н", "r": "г", "3": "з", "6": "б", "0": "о", "i": "і"})
_CYR = re.compile(r"[Ѐ-ӿ]")

_ROMAN = re.compile(r"^(?=[ivxlcdm])m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")
_DIGITS = str.maketrans({"l": "1", "I": "1", "|": "1", "!": "1", "i": "1", "O": "0", "o": "0", "Q": "0", "S": "5", "s": "5", "Z": "2", "z": "2", "B": "8", "g": "9", "q": "9", "b": "6", "G": "6", "A": "4"})
_PAGE_WORD = re.compile(r"^[^\w]*(?:page|pg|seite|página|pagina|pág|pag|стр|страница|сторінка|стор|ページ|頁|第|쪽|หน้า|पृष्ठ|صفحة)?[\s.:№#]*(?P<n>[\w|!�]{1,9}?)\s*(?:页|頁|ページ|쪽)?(?:\s*(?:/|of|von|de|di|sur|из|з|／)\s*(?P<total>[\w|!�]{1,9}))?\s*(?:页|頁|ページ|쪽)?[^\w]*$", re.I)
_KEY_WORD, _HIDDEN, _DIGIT = re.compile(r"[^\W_]+"), re.compile(r"[­�]"), re.compile(r"\d")
_FILLED = re.compile(r"[^\s\x00-\x1f\x7f-\x9f]")
#: A line that ends in one goes on, so it is not of a block of running lines.
_HYPHENS = ("-", "\xad", "¬", "‐")
#: Lines from either edge whose facts are kept in any case; further in, as long as lines are left short.
NEAR = 3


@lru_cache(200_000)
def skeleton(word: str) -> str:
    """The same for all words that confusable glyphs can turn into each other."""
    s = word.lower()
    if _CYR.search(s):
        return s.translate(_CYRILLIC)
    return s.translate(_GLYPHS)


def roman(s: str) -> int | None:
    if not _ROMAN.match(s):
        return None
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    v = [value[c] for c in s]
    return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0]))


def page_number(text: str) -> tuple[int | None, bool]:
    """The number that is all a line holds, as far as it can be read, and whether words or marks around say that it numbers a page."""
    t = text.strip()
    if not t or len(t) > 24:  # longer than any line that its pattern matches
        return None, False
    m = _PAGE_WORD.match(t)
    if not m:
        return None, False
    n = m["n"]
    marked = t != n
    if (r := roman(n.lower())) is not None and n in (n.lower(), n.upper()):
        return r, marked
    read = n.translate(_DIGITS)
    if read.isdigit() and sum(c.isdigit() for c in n) * 2 >= len(n) and len(read) < 7:
        return int(read), marked
    return None, False


def _is_misread(word: str) -> bool:
    """Whether digits in a word stand for letters, as they are few among many."""
    digits = len(_DIGIT.findall(word))
    return len(word) >= 4 and digits * 3 <= len(word) and word[-1].isalpha() and word[0].isalpha()


def running_key(text: str) -> str:
    """A line with numbers masked and confusable glyphs alike, to be compared over pages."""
    words = [w for w in _KEY_WORD.findall(_HIDDEN.sub("", text)) if not _DIGIT.search(w) or _is_misread(w)]
    words = [w for i, w in enumerate(words) if not (i in (0, len(words) - 1) and len(words) > 1 and roman(w.lower()) is not None)]
    key = "".join(skeleton(w) for w in words)
    if len(key) >= 4:
        return key
    return key if len(key) >= 2 and not key.isascii() and text.rstrip()[-1:].isalnum() else ""  # two ideographs may be a title, not the end of a sentence


_ROW = pa.schema([
    ("key", pa.int64()), ("source", pa.string()), ("page_uid", pa.int64()), ("document_id", pa.string()), ("page", pa.int32()), ("text", pa.string()),
    ("ids", pa.list_(pa.int64())), ("glyphs", pa.list_(pa.int64())),
    ("near", pa.list_(pa.struct([("i", pa.int32()), ("top", pa.int32()), ("bottom", pa.int32()), ("line", pa.string()), ("key", pa.string()), ("outer", pa.string()), ("number", pa.int32()), ("marked", pa.bool_()), ("at_edge", pa.bool_()), ("record_id", pa.int64()), ("line_no", pa.int32())]))),
])
_ROW_SQL = "key bigint, source string, page_uid bigint, document_id string, page int, text string, ids array<bigint>, glyphs array<bigint>, near array<struct<i: int, top: int, bottom: int, line: string, key: string, outer: string, number: int, marked: boolean, at_edge: boolean, record_id: bigint, line_no: int>>"


def _near(lines: list[str], record_of) -> list[dict]:
    """Facts on the lines near a page's edges."""
    filled = [i for i, t in enumerate(lines) if _FILLED.search(t)]
    n = len(filled)
    if not n:
        return []
    sizes = [len(lines[i].strip()) for i in filled]
    short = 0.6 * max(sizes)
    down = next((p for p in range(n) if p >= NEAR and sizes[p] > short), n)
    up = next((p for p in range(n - 1, -1, -1) if p < n - NEAR and sizes[p] > short), -1)
    found = {}
    for p in [*range(down), *range(max(down, up + 1), n)]:
        line = lines[filled[p]]
        found[p] = (line, running_key(line), *page_number(line))
    small = lambda p: p in found and (found[p][2] is not None or sizes[p] <= 12)
    out = []
    for p, (line, key, number, marked) in found.items():
        top, bottom = p + 1, n - p
        outer = p - 1 if top <= bottom else p + 1
        record, no = record_of(filled[p])
        out.append({
            "i": filled[p], "top": top, "bottom": bottom, "line": line, "key": key, "outer": found[outer][1] if outer in found and line.rstrip()[-1:] not in _HYPHENS else "", "number": number, "marked": marked,
            "at_edge": top == 1 or bottom == 1 or top == 2 and small(0) or bottom == 2 and small(n - 1), "record_id": record, "line_no": no,
        })
    return out


def _glyph_text(at: slice, ids: list, texts: list, spaces: list, x0: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> tuple[str, list[int]]:
    """The lines that glyphs make, and the glyph of each character."""
    x0, y0, y1 = x0[at], y0[at], y1[at]
    new = np.ones(len(x0), bool)
    space = np.array([s is True for s in spaces[at]])
    new[1:] = (y0[1:] - y0[:-1] > 0.5 * (y1[1:] - y0[1:])) | (x0[1:] < x0[:-1]) & space[1:] | np.isnan(x0[1:] + y0[1:] + y1[1:] + x0[:-1] + y0[:-1])
    out, owners = [], []
    for g, t, s, first in zip(ids[at], texts[at], space.tolist(), new.tolist()):
        if not t:
            continue
        if out and (first or s):
            out.append("\n" if first else " ")
            owners.append(None)
        out.append(t[0] if t[0] != "\n" else " ")
        owners.append(g)
    return "".join(out), owners


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of pages from rows sorted by key, kind (0 the page itself, 1 a read line, 2 a glyph), place and id."""
    held: pa.Table | None = None

    def rows(table: pa.Table) -> pa.RecordBatch:
        c = {name: table.column(name) for name in table.column_names}
        key = c["key"].to_numpy()
        kind, ids, texts, spaces = c["kind"].to_numpy(), c["id"].to_pylist(), c["text"].to_pylist(), c["space"].to_pylist()
        x0, y0, y1 = (c[k].to_numpy().astype(float) for k in ("x0", "y0", "y1"))
        documents, numbers, uids = c["document_id"], c["page"], c["page_uid"]
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        out = []
        for a, b in zip(cuts, cuts[1:]):
            if kind[a] != 0:
                continue  # of no scanned page
            uid, base = uids[a].as_py(), (documents[a].as_py(), numbers[a].as_py())
            read, drawn = a + np.searchsorted(kind[a:b], (1, 2))
            if texts[a] and _FILLED.search(texts[a]):
                out.append((int(key[a]), "parsed_pages", uid, *base, texts[a], None, None, _near(texts[a].split("\n"), lambda i, u=uid: (u, i))))
            lines = [(r, t.replace("\n", " ")) for r, t in zip(ids[read:drawn], texts[read:drawn]) if t is not None]
            if any(_FILLED.search(t) for _, t in lines):
                own = [r for r, _ in lines]
                out.append((int(key[a]), "ocr_texts", uid, *base, "\n".join(t for _, t in lines), own, None, _near([t for _, t in lines], lambda i, o=own: (o[i], 0))))
            if drawn < b:
                text, owners = _glyph_text(slice(drawn, b), ids, texts, spaces, x0, y0, y1)
                if _FILLED.search(text):
                    out.append((int(key[a]), "native_glyphs", uid, *base, text, None, owners, _near(text.split("\n"), lambda i: (None, None))))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_ROW)], schema=_ROW)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        key = table.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))  # the last page may go on in the next batch
        held = table.slice(cut)
        if cut:
            yield rows(table.slice(0, cut))
    if held is not None:
        yield rows(held)


def scanned_pages(pages: DataFrame, ocr: DataFrame, glyphs: DataFrame) -> DataFrame:
    """A row for each scanned page and source: key, source, page_uid, document_id, page, text (lines), ids (of read lines), glyphs (of characters), near."""
    whole = pages.where("parse_route = 'vision_fusion' and (page_uid is not null or native_text is not null)")
    apart = F.coalesce("page_uid", -1 - F.shiftrightunsigned(F.xxhash64("document_id", "page", "native_text"), 1))  # pages without an id stay apart
    no = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rest = [no("boolean", "space"), no("float", "x0"), no("float", "y0"), no("float", "y1")]
    own = whole.select(apart.alias("key"), F.lit(0).alias("kind"), F.lit(0).alias("at"), no("bigint", "id"), F.col("native_text").alias("text"), "document_id", F.col("page").cast("int").alias("page"), "page_uid", *rest)
    meta = [no("string", "document_id"), no("int", "page"), no("bigint", "page_uid")]
    read = ocr.where("text is not null and page_uid is not null").select(F.col("page_uid").alias("key"), F.lit(1).alias("kind"), F.col("line_index").cast("int").alias("at"), F.col("ocr_id").alias("id"), "text", *meta, *rest)
    drawn = glyphs.where("text is not null and page_uid is not null").select(F.col("page_uid").alias("key"), F.lit(2).alias("kind"), F.col("glyph_index").cast("int").alias("at"), F.col("glyph_id").alias("id"), "text", *meta, F.col("space_before").alias("space"), "x0", "y0", "y1")
    rows = own.unionByName(read).unionByName(drawn).repartition("key").sortWithinPartitions("key", "kind", "at", "id", "text")
    return rows.mapInArrow(_build, _ROW_SQL)


def _recurring(near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each document what recurs on its pages: tokens (k: the key of a line at an edge, p: a key behind another), and the usual distance of printed from counted page numbers."""
    token = F.array(
        F.when(F.col("at_edge") & (F.col("line_key") != ""), F.struct(F.concat(F.lit("k"), "line_key").alias("token"), F.lit(None).cast("string").alias("outer"))),
        F.when(~F.col("at_edge") & (F.col("line_key") != "") & (F.col("outer") != ""), F.struct(F.concat(F.lit("p"), "outer", F.lit("\n"), "line_key").alias("token"), F.concat(F.lit("k"), "outer").alias("outer"))),
        F.when(F.col("number").isNotNull() & ((F.col("top") <= 2) | (F.col("bottom") <= 2)), F.struct(F.concat(F.lit("n"), F.col("number") - F.col("page")).alias("token"), F.lit(None).cast("string").alias("outer"))),
    )
    asked = near.where("document_id is not null").select("document_id", "page", F.explode(F.filter(token, lambda x: x.isNotNull())).alias("t")).select("document_id", "page", "t.token", "t.outer")
    stats = checkpoint(asked.groupBy("document_id", "token").agg(F.count("*").alias("n"), F.max("outer").alias("outer"), (F.min("page") != F.max("page")).alias("recurs")))
    usual = stats.where("recurs and token like 'n%'").groupBy("document_id").agg(F.max(F.struct("n", F.substring("token", 2, 20).cast("int").alias("offset")))["offset"].alias("usual"))
    known = stats.where("recurs and token like 'k%'").select("document_id", F.substring("token", 2, 1_000_000).alias("known"), "n")
    pairs = stats.where("recurs and token like 'p%'").select("document_id", "token", F.col("n").alias("m"), F.substring("outer", 2, 1_000_000).alias("known"))
    pairs = pairs.join(known, ["document_id", "known"]).where("2 * m >= n").select("document_id", "token")  # a block of lines: the second recurs with the first
    # keys within two edits: then the first three or last three glyphs are kept, or each end has one edit and all between is kept
    single = stats.where("not recurs and token like 'k%' and length(token) > 6").select("document_id", F.substring("token", 2, 1_000_000).alias("key"))
    part = lambda tag, c: F.concat(F.lit(tag), c)
    right = lambda c: F.substring(c, F.char_length(c) - 2, F.lit(3))
    middle = lambda c, a, z: F.substring(c, F.lit(4 + a), F.char_length(c) - 6 - a - z)
    k, q = F.col("known"), F.col("key")
    asks = known.where("length(known) >= 8").select("document_id", "known", F.explode(F.array(part("a", F.substring(k, 1, 3)), part("z", right(k)), part("m", middle(k, 0, 0)))).alias("part"))
    gives = single.select("document_id", "key", F.explode(F.array_distinct(F.array(part("a", F.substring(q, 1, 3)), part("z", right(q)), *(part("m", middle(q, a, z)) for a in (-1, 0, 1) for z in (-1, 0, 1))))).alias("part"))
    close = gives.join(asks, ["document_id", "part"]).where(F.levenshtein("key", "known", 2) >= 0).select("document_id", part("k", q).alias("token")).distinct()
    exact = known.select("document_id", part("k", k).alias("token"))
    return exact.unionByName(close).unionByName(pairs), usual


def edges_of(pages: DataFrame) -> DataFrame:
    """A row for each page and source: key, source, document_id, page; ``edges``, its running lines and page numbers (i, record_id, line_no, edge); head and tail, its first and last body lines."""
    near = pages.select("key", "source", "document_id", "page", F.explode("near").alias("x")).select("key", "source", "document_id", "page", "x.i", "x.top", "x.bottom", "x.line", F.col("x.key").alias("line_key"), "x.outer", "x.number", "x.marked", "x.at_edge", "x.record_id", "x.line_no")
    recurring, usual = _recurring(near)
    token = F.when(F.col("line_key") != "", F.when(F.col("at_edge"), F.concat(F.lit("k"), "line_key")).when(F.col("outer") != "", F.concat(F.lit("p"), "outer", F.lit("\n"), "line_key")))
    near = near.withColumn("token", token).join(recurring.withColumn("known", F.lit(True)), ["document_id", "token"], "left").join(usual, "document_id", "left")
    expected = (F.col("page") + F.col("usual")).cast("string")
    short = F.char_length(F.trim("line")) <= 24
    near = near.withColumn("digits", F.when(short & F.col("usual").isNotNull(), F.translate(F.regexp_replace("line", r"[^\w|!�]|(?i)page|seite|página|pagina|стр", ""), "lI|!OoSsBgZz", "1111005589zz")))
    digits = F.col("digits")
    close = (F.char_length(digits) == F.char_length(expected)) & (F.char_length(expected) >= 2) & (F.levenshtein(digits, expected) <= 1)
    counts = (F.col("number") - F.col("page") == F.col("usual")) | (F.col("marked") & F.col("number").isNotNull() & F.col("at_edge")) | close
    is_number = ((F.col("top") <= 2) | (F.col("bottom") <= 2)) & F.coalesce(counts, F.lit(False)) & short
    edge = F.when(is_number, "page_number").when(F.col("known"), "running_line")
    page = Window.partitionBy("key", "source")
    # further in, a line is of a block only if all lines outside it are
    outside = lambda by, far: F.min(F.when(F.col(by) < F.col(far), F.col("edge").isNotNull()).otherwise(True)).over(page.orderBy(by).rowsBetween(Window.unboundedPreceding, -1))
    near = near.withColumn("edge", edge).withColumn("whole", F.coalesce(F.when(F.col("top") <= F.col("bottom"), outside("top", "bottom")).otherwise(outside("bottom", "top")), F.lit(True)))
    near = near.select("key", "source", "document_id", "page", "i", "line", "record_id", "line_no", F.when(F.col("at_edge") | F.col("whole") | is_number, F.col("edge")).alias("edge"))
    # grouped as the windows were, so nothing is shuffled again
    of_body = F.when(F.col("edge").isNull(), F.col("i"))
    line = F.struct("source", "key", "line", "record_id", "line_no")
    found = F.collect_list(F.when(F.col("edge").isNotNull(), F.struct("i", "record_id", "line_no", "edge")))
    return near.groupBy("key", "source", "document_id", "page").agg(found.alias("edges"), F.min_by(line, of_body).alias("head"), F.max_by(line, of_body).alias("tail"))


def with_neighbours(each: DataFrame) -> DataFrame:
    """For each page and source: its edges' lines, and the last and first body lines of the pages before and after."""
    whole = each.where("source <> 'native_glyphs' and document_id is not null and page is not null")
    heads = whole.where("head is not null").select("document_id", (F.col("page") - 1).alias("page"), "key", F.col("head").alias("after"))
    tails = whole.where("tail is not null").select("document_id", (F.col("page") + 1).alias("page"), "key", F.col("tail").alias("before"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("key"))).alias(c)
    sent = heads.unionByName(tails, allowMissingColumns=True).groupBy("document_id", "page").agg(first("after"), first("before"))
    same = F.col("after.source") == F.col("source")
    return each.join(sent, ["document_id", "page"], "left").select(
        "key", "source", F.transform("edges", lambda x: x["i"]).alias("edges"), F.col("before.source").alias("before_source"), F.col("before.key").alias("before_key"), F.col("before.line").alias("before"),
        F.col("after.line").alias("after"), F.when(same, F.col("after.record_id")).alias("after_record"), F.when(same, F.col("after.line_no")).alias("after_line"),
    )
