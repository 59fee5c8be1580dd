"""Problem 2: text of scanned pages repaired into continuous paragraphs.

Lines at the edges of pages are compared over their document with digits masked (:mod:`scan_pages`): what recurs is a
running line; numbers that go up with the pages are page numbers. The other lines give words, joined where a line's end
divides them, and for scripts without spaces characters with their neighbours. Words are grouped by the skeleton that all
confusable glyphs share; the frequent form of a group, supported by the word before or by far more occurrences, replaces
the rare ones. Characters are replaced where another has almost all occurrences between the same neighbours, and that so
often that the character hardly occurs by itself. All counts are of the whole corpus, clean pages included. Windows then
put the repaired lines together.

The texts are read twice: once to count, in tables of a task's own, so that only distinct forms are shuffled; once, with
what the counts decide, to find the places. Frequent right forms are known to every task (``KNOWN`` of them at most), so
of millions of occurrences only the rare forms' leave it, to be joined with the fixes. Whether a task knows a form decides
nothing else: all right forms support with the word before, and none of them is misread for its glyphs.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkquarry.llm.frames import integers
from sparkquarry.llm.scan_pages import edges_of, scanned_pages, skeleton, with_neighbours
from sparkquarry.session import checkpoint
from sparkquarry.sources import spread

#: A form is misread if a form of the same skeleton has at least so many occurrences, and so many times its own.
LEAST, TIMES = 5, 8
#: Right forms that every task knows, the most frequent; occurrences of all other forms are joined with the fixes.
KNOWN = 100_000
#: Entries of a task's counters, after which it hands them on.
HELD = 400_000
#: Bits of the sets that tell tasks which contexts may matter; what passes by chance goes at the join behind.
BITS = 1 << 22

_STRANGE = "|!†¢�"
_CLASS = r"[^\W_぀-ヿ㐀-鿿฀-๿가-힯|!†¢�]"
#: A word that is no part of a name, address or setting.
_WORD = re.compile(rf"(?<![_=/\\@:])(?<!\w\.)(?<!{_CLASS})(?>(?:[|!†¢�]*+{_CLASS}++)++[|†¢�]*+)(?![_=/\\@])(?![.:][^\W_])")
_TAIL = re.compile(rf"{_CLASS}+$")
_HEAD = re.compile(rf"{_CLASS}+")
_LETTER = re.compile(r"[^\W\d_]")
_IDEOGRAPH = re.compile(r"[぀-ヿ㐀-鿿]")
_DIVIDER = re.compile(r"(?<=[^\W\d_])([-­¬‐])[ \t]*$|(?<=[|!†¢�])([-­¬‐])[ \t]*$")
_LATIN, _CYR = re.compile(r"[A-Za-z]"), re.compile(r"[Ѐ-ӿ]")
_INSIDE = re.compile(r"(?<=[^\W\d_])[|†¢](?=[^\W\d_])")
_FILLED = re.compile(r"[^\s\x00-\x1f\x7f-\x9f]")


def words(text: str) -> list[tuple[int, str]]:
    """Words with letters, and their places."""
    return [(m.start(), m[0]) for m in _WORD.finditer(text) if _LETTER.search(m[0])]


def context(text: str) -> str:
    """Characters for contexts: without white space, numbers and names as one sign each."""
    return re.sub(r"[A-Za-z_=./]+", "A", re.sub(r"\d+(?:\.\d+)*", "#", re.sub(r"\s+", "", text)))


def is_divided(line: str) -> re.Match | None:
    """The hyphen at a line's end, if there is one."""
    return _DIVIDER.search(line) if line.rstrip(" \t")[-1:] in ("-", "\xad", "¬", "‐") else None


def first_word(line: str) -> tuple[int, str] | None:
    """The word that a line begins with."""
    found = _WORD.search(line)
    return (found.start(), found[0]) if found and _LETTER.search(found[0]) and not line[: found.start()].strip() else None


def last_word(line: str, end: int) -> tuple[int, str] | None:
    """The word that ends at ``end``."""
    begin = max(line.rfind(" ", 0, end), line.rfind("\t", 0, end)) + 1
    found = [(begin + a, w) for a, w in words(line[begin:])]
    return found[-1] if found and found[-1][0] + len(found[-1][1]) == end else None


def is_wrong(w: str) -> bool:
    """Glyphs that no word has."""
    return not w.isascii() and ("�" in w or _CYR.search(w) is not None and _LATIN.search(w) is not None) or _INSIDE.search(w) is not None


def body_lines(text: str, edges) -> list[tuple[int, str]]:
    """Numbers and texts of the lines that are neither blank nor at an edge."""
    out = {int(e) for e in edges} if edges is not None else ()
    return [(i, t) for i, t in enumerate(text.split("\n")) if i not in out and _FILLED.search(t)]


_COUNTS = "kind string, form string, skel string, begun string, scanned bigint, clean bigint"


class _Counts:
    """Words (w), words written with a hyphen (y), words divided by a line's end (j) and ideographs (c) of one task."""

    def __init__(self, clean: bool):
        self.clean = clean
        self.clear()

    def clear(self):
        self.w, self.y, self.j, self.c = Counter(), Counter(), Counter(), Counter()

    def __len__(self):
        return len(self.w) + len(self.y) + len(self.j)

    def add(self, text: str) -> None:
        low = text.lower()
        self.w.update(_WORD.findall(low))
        if "-" in low:
            parts = low.split("-")
            for a, b in zip(parts, parts[1:]):
                if a and b and a[-1].isalnum() and b[0].isalnum() and (w := _TAIL.search(a.rsplit(None, 1)[-1])) and (s := _HEAD.match(b)):
                    self.y[w[0], s[0]] += 1
        if not low.isascii():
            self.c.update(_IDEOGRAPH.findall(low))
            if "�" in low:
                self.c["�"] += low.count("�")

    def frame(self) -> pd.DataFrame:
        rows = [("w", f, skeleton(f), "", n) for f, n in self.w.items() if n > 0 and _LETTER.search(f)]
        rows += [("y", f"{a}-{b}", skeleton(a) + "-" + skeleton(b), a, n) for (a, b), n in self.y.items() if _LETTER.search(a) and _LETTER.search(b)]
        rows += [("j", f, skeleton(f), "", n) for f, n in self.j.items()] + [("c", f, f, "", n) for f, n in self.c.items()]
        out = pd.DataFrame(rows, columns=["kind", "form", "skel", "begun", "scanned"])
        out["clean"] = 0
        if self.clean:
            out["scanned"], out["clean"] = out["clean"], out["scanned"]
        self.clear()
        return out


def _count_clean(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = _Counts(True)
    for pdf in pdfs:
        for text in pdf["text"]:
            held.add(text)
        if len(held) > HELD:
            yield held.frame()
    yield held.frame()


def _count_scanned(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = _Counts(False)
    for pdf in pdfs:
        for text, edges, before, after in zip(pdf["text"], pdf["edges"], pdf["before"], pdf["after"]):
            lines = [t for _, t in body_lines(text, edges)]
            held.add("\n".join(lines))
            if lines and before and is_divided(before) and (second := first_word(lines[0])):
                held.w[second[1].lower()] -= 1  # belongs to the page before
            for k, t in enumerate(lines):
                if (m := is_divided(t)) and (w := last_word(t, m.start())):
                    following = lines[k + 1] if k + 1 < len(lines) else after or ""
                    second = first_word(following)
                    held.w[w[1].lower()] -= 1
                    if second:
                        held.j[(w[1] + second[1]).lower()] += 1
                        if k + 1 < len(lines):
                            held.w[second[1].lower()] -= 1
        if len(held) > HELD:
            yield held.frame()
    yield held.frame()


def count_forms(body: DataFrame, clean: DataFrame) -> DataFrame:
    """``kind, form, skel, begun, scanned, clean``: occurrences of every form, summed in the tasks before they are shuffled. Glyphs repeat their page's text, so they don't count."""
    scanned = body.where("source <> 'native_glyphs'").select("text", "edges", "before", "after").mapInPandas(_count_scanned, _COUNTS)
    both = scanned.unionByName(clean.mapInPandas(_count_clean, _COUNTS))
    return checkpoint(both.groupBy("kind", "form", "skel", "begun").agg(F.sum("scanned").alias("scanned"), F.sum("clean").alias("clean")))


def word_fixes(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Misread forms with ``best``, the right one, and ``sure``, whether that holds without context; and the forms that are the most frequent of their skeleton."""
    forms = counts.where("kind in ('w', 'j')").groupBy("form", "skel").agg(F.sum("scanned").alias("scanned"), F.sum("clean").alias("clean")).withColumn("n", F.col("scanned") + F.col("clean"))
    proper = F.col("form").rlike(r"^[\p{L}\p{M}]+$") & (F.col("n") >= LEAST)
    top = F.max(F.when(proper, F.struct("n", "form"))).over(Window.partitionBy("skel"))
    forms = checkpoint(forms.withColumn("proper", proper).withColumn("t", top).select("form", "n", "proper", F.col("t.form").alias("best"), F.col("t.n").alias("n_best"), (F.col("clean") * 5 <= F.col("scanned")).alias("rarely")))
    odd = F.col("form").rlike(f"[0-9{_STRANGE}]")
    rare = forms.where((F.col("form") != F.col("best")) & (F.col("n_best") >= TIMES * F.col("n")) & F.col("rarely") & ((F.char_length("form") >= 4) | (odd & (F.char_length("form") >= 2)))).select("form", "n", "best", "n_best")
    # forms with one glyph lost or no letter: any frequent form that fits the rest
    sign = rf"[0-9$@€{_STRANGE}]"
    lost = forms.where(F.col("form").rlike(rf"^[\p{{L}}\p{{M}}]*{sign}[\p{{L}}\p{{M}}]*$") & (F.char_length("form") >= 4) & F.col("rarely"))
    lost = lost.select("form", F.col("n").alias("n_form"), F.concat_ws("|", F.regexp_replace("form", sign, ""), F.char_length(F.regexp_extract("form", rf"^([^0-9$@€{_STRANGE}]*)", 1)) + 1).alias("rest"))
    fits = forms.where("proper").select("form", "n", F.explode(F.sequence(F.lit(1), F.char_length("form"))).alias("i")).select(F.col("form").alias("best"), "n", F.concat_ws("|", F.concat(F.expr("substring(form, 1, i - 1)"), F.expr("substring(form, i + 1)")), "i").alias("rest"))
    found = lost.join(fits, "rest").where(F.col("n") >= TIMES * F.col("n_form")).groupBy("form").agg(F.max(F.struct("n", "best")).alias("t")).select("form", F.col("t.best").alias("best_lost"))
    fixes = rare.join(found, "form", "full").select("form", F.coalesce("best_lost", "best").alias("best"), (F.coalesce(F.col("n_best") >= 4 * TIMES * F.col("n"), F.lit(True)) | odd | (F.char_length("form") >= 6)).alias("sure"))
    return checkpoint(fixes), forms.where("proper and form = best").select("form", "n")


def _bits(values: DataFrame) -> np.ndarray:
    """A set of ``BITS`` bits of the first column's strings, whatever their number."""
    at = values.select(F.pmod(F.xxhash64(values.columns[0]), F.lit(BITS)).cast("int").alias("b")).distinct().toPandas()["b"]
    out = np.zeros(BITS, bool)
    out[at.to_numpy(int)] = True
    return out


_CONTEXTS = "ctx bigint, form int, n bigint"
_LOST = ord("�")


def _contexts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The two characters on either side of each ideograph, as one number, and the ideograph."""
    c = np.frombuffer(("^^" + context(text) + "$$").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    at = np.flatnonzero((c >= 0x3040) & (c <= 0x30FF) | (c >= 0x3400) & (c <= 0x9FFF) | (c == _LOST))
    return _pack(c[at - 2], c[at - 1], c[at + 1], c[at + 2]), c[at]


def _pack(a, b, c, d):
    return (a & 0xFFFF) << 48 | (b & 0xFFFF) << 32 | (c & 0xFFFF) << 16 | d & 0xFFFF


def _place(ctx: np.ndarray) -> np.ndarray:
    """The bit of a context."""
    h = ctx.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(31))) % np.uint64(BITS)).astype(np.int64)


def character_fixes(counts: DataFrame, body: DataFrame, clean: DataFrame) -> tuple[dict[str, str], DataFrame | None]:
    """Misread ideographs with the right ones, and for lost ones the most frequent ideograph of each context.

    Only ideographs that are rare on clean pages can be misread; there are no more of them than ideographs. Contexts in
    which none of them occurs are not counted.
    """
    chars = counts.where("kind = 'c'").select("form", (F.col("scanned") + F.col("clean")).alias("n"), "scanned", "clean").where("clean * 5 <= n and scanned > 0").toPandas()
    if not len(chars):
        return {}, None
    sc = body.sparkSession.sparkContext
    total = dict(zip(map(ord, chars["form"]), chars["n"]))
    doubted = np.zeros(0x110000, bool)
    doubted[list(total)] = True
    shared = sc.broadcast(doubted)
    texts = body.where("source <> 'native_glyphs'").where(F.col("text").rlike("[\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}]")).select("text", "edges")
    wanted_in = texts.where(F.col("text").rlike("[" + "".join(rf"\x{{{c:x}}}" for c in total) + "]"))

    def body_text(text, edges) -> str:
        return "\n".join(t for _, t in body_lines(text, edges))

    def wanted(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros(BITS, bool)
        for pdf in pdfs:
            for text, edges in zip(pdf["text"], pdf["edges"]):
                ctx, form = _contexts(body_text(text, edges))
                found[_place(ctx[shared.value[form]])] = True
        yield pd.DataFrame({"b": np.flatnonzero(found).astype(np.int32)})

    bits = np.zeros(BITS, bool)
    bits[wanted_in.mapInPandas(wanted, "b int").distinct().toPandas()["b"].to_numpy(int)] = True
    known = sc.broadcast(bits)

    def count(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            parts = [_contexts(body_text(text, edges)) for text, edges in zip(pdf["text"], pdf["edges"])]
            if not parts:
                continue
            ctx, form = (np.concatenate(x) for x in zip(*parts))
            keep = known.value[_place(ctx)]
            out = pd.DataFrame({"ctx": ctx[keep], "form": form[keep].astype(np.int32)})
            yield out.groupby(["ctx", "form"], sort=False).size().rename("n").reset_index()

    clean = clean.where(F.col("text").rlike("[\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}]")).select("text", F.array().cast("array<int>").alias("edges"))
    c = texts.unionByName(clean).mapInPandas(count, _CONTEXTS).repartition("ctx").groupBy("ctx", "form").agg(F.sum("n").alias("n"))
    top = F.max(F.when(F.col("form") != _LOST, F.struct("n", "form"))).over(Window.partitionBy("ctx"))
    c = checkpoint(c.withColumn("t", top).select("ctx", "form", "n", F.col("t.n").alias("n_best"), F.col("t.form").alias("best")).where((F.col("form") != F.col("best")) & (F.col("n_best") >= LEAST) & (F.col("n_best") >= TIMES * F.col("n"))))
    usual = c.where(F.col("form") != _LOST).groupBy("form", "best").agg(F.sum("n").alias("m")).groupBy("form").agg(F.sum("m").alias("m"), F.max(F.struct("m", "best")).alias("t")).select("form", "m", "t.best").toPandas()  # ideographs at most
    # a misread one stands where another belongs, and hardly by itself
    right = {chr(f): chr(b) for f, m, b in zip(usual["form"], usual["m"], usual["best"]) if f in total and m >= 0.3 * total[f]}
    return right, c.where(F.col("form") == _LOST).select("ctx", F.col("best").alias("lost_best"))


_PLACES = "kind string, source string, key bigint, record_id bigint, line_no int, line int, start int, form string, skel string, prev string, alt string, second string, cut int, record_2 bigint, line_no_2 int, line_2 int, start_2 int, far boolean, wrong boolean, soft boolean, ctx bigint, glyphs array<bigint>"
_NAMES = [c.split()[0] for c in _PLACES.split(", ")]


def _places(body: DataFrame, known: DataFrame, fixes: DataFrame, right: dict[str, str]) -> DataFrame:
    """Where something may be amiss: rare forms (w), hyphens at lines' ends (h), misread ideographs (c); and the words before forms that need context (b)."""
    sc = body.sparkSession.sparkContext
    safe = sc.broadcast(frozenset(r[0] for r in known.orderBy(F.desc("n"), "form").limit(KNOWN).collect()))
    # forms whose words before matter, as bits of a hash: no more than BITS however many they are
    doubt = sc.broadcast(_bits(fixes.where("not sure").select("best")))
    signs = sc.broadcast(right)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        ok, bits, chars = safe.value, doubt.value, signs.value
        any_doubt = bool(bits.any())
        signed = re.compile("[" + "".join(map(re.escape, chars)) + "�]") if chars else re.compile("�")
        asked: dict[str, bool] = {}

        def matters(form: str) -> bool:
            if (known := asked.get(form)) is None:
                if len(asked) > HELD:
                    asked.clear()
                known = asked[form] = bool(bits[xxhash.xxh64_intdigest(form.encode(), 42) % BITS])
            return known

        for pdf in pdfs:
            out, pairs = [], set()
            for source, key, uid, text, ids, owners, edges, before, after, far_record, far_line in zip(*(pdf[c] for c in ("source", "key", "page_uid", "text", "ids", "glyphs", "edges", "before", "after", "after_record", "after_line"))):
                lines = body_lines(text, edges)
                offsets = np.cumsum([0, *(len(t) + 1 for t in text.split("\n"))]) if owners is not None else None
                missing = lambda x: None if x is None or x != x else int(x)

                def record(i: int, uid=missing(uid), ids=ids, owners=owners):
                    return (int(ids[i]), 0) if ids is not None else (None, None) if owners is not None else (uid, i)

                def drawn(i: int, a: int, n: int, owners=owners, offsets=offsets):
                    return None if owners is None else [missing(g) for g in owners[offsets[i] + a : offsets[i] + a + n]]

                cut_before = before is not None and is_divided(before) is not None
                for k, (i, t) in enumerate(lines):
                    m = is_divided(t)
                    forms = _WORD.findall(t.lower())
                    odd = not ok.issuperset(forms) and any(f not in ok and len(f) > 1 and not f.isdigit() for f in forms)
                    if any_doubt and not odd:
                        odd = any(map(matters, forms))
                    if odd or m:
                        found = words(t)
                        if cut_before and found and not t[: found[0][0]].strip():
                            found = found[1:]  # belongs to the line before
                        prev = ""
                        for a, w in found:
                            form = w.lower()
                            if m and a + len(w) == m.start():
                                far = k + 1 == len(lines)
                                second = first_word((after or "") if far else lines[k + 1][1])
                                joined = form + (second[1].lower() if second else "")
                                there = (missing(far_record), missing(far_line), None) if far else (*record(lines[k + 1][0]), lines[k + 1][0])
                                alt = skeleton(w) + "-" + skeleton(second[1]) if second else None
                                soft = (m[1] or m[2]) in "­¬‐"
                                chained = re.search(r"[^\W_]+-$", t[:a]) is not None
                                place = (source, key, *record(i), i)
                                more = (len(w), *there, second[0], far) if second else (-1, None, None, None, None, False)
                                out.append(("h", *place, m.start(), joined, skeleton(joined), form, alt, second[1] if second else None, *more, chained, soft, None, drawn(i, m.start(), 1)))
                                wrong = joined not in ok and is_wrong(w + (second[1] if second else ""))
                                if joined not in ok and (second or wrong):
                                    ids_2 = None
                                    if owners is not None and second and not far:
                                        ids_2 = drawn(lines[k + 1][0], second[0], len(second[1]))
                                    elif owners is not None and second:
                                        ids_2 = [None] * len(second[1])
                                    own = drawn(i, a, len(w))
                                    out.append(("w", *place, a, joined, None, prev, None, second[1] if second else None, *more, wrong, False, None, None if own is None else own + (ids_2 or [])))
                                break
                            wrong = form not in ok and is_wrong(w)
                            if form not in ok and len(form) > 1 or wrong:
                                out.append(("w", source, key, *record(i), i, a, form, None, prev, None, None, -1, None, None, None, None, False, wrong, False, None, drawn(i, a, len(w))))
                            if prev and any_doubt and matters(form):
                                pairs.add((prev, form))
                            prev = form
                    cut_before = m is not None
                    if not t.isascii():
                        for x in signed.finditer(t):
                            a, ch, ctx, form = x.start(), x[0], None, chars.get(x[0], "")
                            if ch == "�":
                                prior = context((lines[k - 1][1] if k else before or "") + t[:a])[-2:].rjust(2, "^")
                                rest = context(t[a + 1 :] + (lines[k + 1][1] if k + 1 < len(lines) else after or ""))[:2].ljust(2, "$")
                                if not (_IDEOGRAPH.match(prior[-1]) or _IDEOGRAPH.match(rest[0])):
                                    continue
                                p = np.frombuffer((prior + rest).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                                ctx = int(_pack(*p))
                            out.append(("c", source, key, *record(i), i, a, form, None, None, None, None, -1, None, None, None, None, False, False, False, ctx, drawn(i, a, 1)))
            out += [("b", "", None, None, None, None, None, f, None, p, *[None] * 12) for p, f in pairs]
            yield integers(pd.DataFrame(out, columns=_NAMES), "key", "record_id", "line_no", "line", "start", "cut", "record_2", "line_no_2", "line_2", "start_2", "ctx")

    return checkpoint(body.select("source", "key", "page_uid", "text", "ids", "glyphs", "edges", "before", "after", "after_record", "after_line").mapInPandas(run, _PLACES))


@F.pandas_udf(T.ArrayType(T.StructType().add("a", T.IntegerType()).add("b", T.IntegerType())))
def _differences(form: pd.Series, best: pd.Series) -> pd.Series:
    """Where the read form differs from the right one."""
    out = []
    for f, b in zip(form, best):
        if b is None or b == "":
            # no right form known: the glyphs that can't be right
            most_cyr = len(_CYR.findall(f)) >= len(_LATIN.findall(f))
            odd = (_LATIN if most_cyr else _CYR) if _CYR.search(f) and _LATIN.search(f) else re.compile(f"[{_STRANGE}]")
            out.append([{"a": m.start(), "b": m.end()} for m in odd.finditer(f)])
        else:
            out.append([{"a": i, "b": max(j, i + 1)} for tag, i, j, _, _ in difflib.SequenceMatcher(None, f, b, False).get_opcodes() if tag != "equal"])
    return pd.Series(out)


class Analysis:
    """What is known of the scanned pages: ``edges`` (running lines and page numbers), ``body`` (the pages), ``hyphens`` that divide words, ``wrong`` (misread words), ``signs`` (misread ideographs)."""

    def __init__(self, pages: DataFrame, ocr: DataFrame, glyphs: DataFrame):
        rows = checkpoint(scanned_pages(pages, ocr, glyphs))
        each = checkpoint(edges_of(rows))
        self.edges = each.select("source", F.explode("edges").alias("x")).select("source", "x.*")
        self.body = body = checkpoint(rows.drop("near").join(with_neighbours(each), ["key", "source"]))
        clean = spread(pages.where("parse_route is distinct from 'vision_fusion' and native_text is not null").select("page_uid", F.col("native_text").alias("text")), "page_uid").select("text")
        counts = count_forms(body, clean)
        fixes, known = word_fixes(counts)
        right, lost = character_fixes(counts, body, clean)
        places = _places(body, known, fixes, right)

        ask = lambda of, what: F.struct(F.lit(of).alias("of"), F.col(what).alias("what"))
        asks = counts.where("kind in ('w', 'y')").select(F.explode(F.when(F.col("kind") == "w", F.array(ask("s", "skel"))).otherwise(F.array(ask("a", "skel"), ask("b", "begun")))).alias("x"), (F.col("scanned") + F.col("clean")).alias("n"))
        sums = asks.groupBy("x.of", "x.what").agg(F.sum("n").alias("n"))
        h = places.where("kind = 'h'").select("source", "key", "record_id", "line_no", "line", "start", "skel", "prev", "alt", "second", "start_2", "far", "soft", F.get("glyphs", F.lit(0)).alias("glyph"))
        of = lambda k: F.coalesce(F.max(F.when(F.col("of") == k, F.col("n"))), F.lit(0))
        h = h.withColumn("x", F.explode(F.array(ask("s", "skel"), ask("a", "alt"), ask("b", "prev")))).select(*h.columns, "x.of", "x.what").join(sums, ["of", "what"], "left")
        h = h.groupBy(*[c for c in h.columns if c not in ("of", "what", "n")]).agg(of("s").alias("joined"), of("a").alias("written"), of("b").alias("begun"))
        # a word is written with a hyphen if its parts are elsewhere, more often than as one word; if neither is, if its first part begins such words
        by_count = F.when((F.col("written") > 0) | (F.col("joined") > 0), F.col("written") <= F.col("joined")).otherwise(F.col("begun") == 0)
        own = F.when(F.col("second").isNull(), F.col("soft") | (F.col("begun") == 0)).otherwise(F.when(F.col("soft"), F.col("written") <= F.col("joined")).otherwise(by_count))
        self.hyphens = checkpoint(h.where(own))

        # right forms of two scripts, which look wrong to tasks that don't know them
        mixed = known.where(F.col("form").rlike("[A-Za-z]") & F.col("form").rlike(r"[\x{400}-\x{4ff}]")).select("form", F.lit(True).alias("right"))
        w = places.where("kind = 'w'").join(fixes.unionByName(mixed, allowMissingColumns=True), "form", "left").where(F.col("best").isNotNull() | F.col("wrong") & F.col("right").isNull())
        # context: the right form follows the same word elsewhere, or has far more occurrences
        pairs = places.where("kind = 'b'").select("prev", F.col("form").alias("best")).distinct().withColumn("follows", F.lit(True))
        w = w.join(pairs, ["prev", "best"], "left").where(F.col("wrong") | F.col("sure") | F.coalesce("follows", F.lit(False)))
        self.wrong = checkpoint(w.select("source", "key", "record_id", "line_no", "line", "start", "form", F.coalesce("best", F.lit("")).alias("best"), "cut", "record_2", "line_no_2", "line_2", "start_2", "far", "glyphs"))
        c = places.where("kind = 'c'")
        c = c.join(lost, "ctx", "left") if lost is not None else c.withColumn("lost_best", F.lit(None).cast("int"))
        self.signs = c.select("source", "key", "record_id", "line_no", "line", "start", "form", "lost_best", "glyphs")


def scan_defects(pages: DataFrame, ocr: DataFrame, glyphs: DataFrame) -> DataFrame:
    """``record_table, record_id, line_no, defect``: one row for each line, or glyph, and defect.

    Null and blank texts have none; pages without a document are compared with none; pages parsed again count again, but
    their recurrence supports nothing. Repeated ids are one record; lines and glyphs without a page's id belong to none.
    Other columns are left out. Empty tables give no rows.
    """
    a = Analysis(pages, ocr, glyphs)
    line = ["source", "record_id", "line_no"]
    drawn = F.col("source") == "native_glyphs"
    edges = a.edges.where(~drawn).select(*line, F.col("edge").alias("defect"))
    hyphens = a.hyphens.select("source", F.when(drawn, F.col("glyph")).otherwise(F.col("record_id")).alias("record_id"), F.coalesce("line_no", F.lit(0)).alias("line_no"), F.lit("hyphen_break").alias("defect"))
    w = a.wrong.withColumn("d", F.explode(_differences("form", "best")))
    second = (F.col("cut") >= 0) & (F.col("d.a") >= F.col("cut"))
    text = w.where(~drawn).select("source", F.when(second, F.col("record_2")).otherwise(F.col("record_id")).alias("record_id"), F.when(second, F.col("line_no_2")).otherwise(F.col("line_no")).alias("line_no"))
    signs = a.signs.where(~drawn).select(*line)
    # a word over two pages is of either only where both are of one source
    known = text.where("line_no is not null").unionByName(signs)
    ids = w.where(drawn).select("source", F.explode(F.expr("slice(glyphs, d.a + 1, d.b - d.a)")).alias("record_id")).unionByName(a.signs.where(drawn).select("source", F.explode("glyphs").alias("record_id"))).where("record_id is not null")
    misread = known.unionByName(ids.withColumn("line_no", F.lit(0))).withColumn("defect", F.lit("misread"))
    return edges.unionByName(hyphens).unionByName(misread).distinct().select(F.col("source").alias("record_table"), "record_id", F.col("line_no").cast("int").alias("line_no"), "defect")


#: Stands at the end of lines that go on without a space.
_GLUE = "\u2060"


def _as_read(right: str, read: str) -> str:
    """The right form with the capitals of the read one."""
    letters = [c for c in read if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return right.upper()
    return right[:1].upper() + right[1:] if read[:1].isupper() else right


def mend(lines: list[tuple[int, str]], after: str | None, moved: bool, hyphens: dict, words_: dict, signs: dict) -> list[tuple[int, str]]:
    """A page's body lines repaired: ``hyphens`` by line its place; ``words_`` by line start, form, best, cut; ``signs`` by line place and right character. ``moved``: the first word belongs to the page before."""
    out, skip = [], moved
    for k, (i, t) in enumerate(lines):
        following = lines[k + 1][1] if k + 1 < len(lines) else after or ""
        edits = [(a, a + 1, c) for a, c in signs.get(i, ()) if c]
        head = first_word(t) if skip else None
        at = hyphens.get(i)
        tail, second = None, first_word(following) if at is not None else None
        for a, form, best, cut in words_.get(i, ()):
            if not best:
                continue
            if cut < 0:
                edits.append((a, a + len(form), _as_read(best, t[a : a + len(form)])))
            elif at is not None:
                tail = (a, _as_read(best, t[a:at] + (second[1] if second else "")))
        end = len(t)
        if at is not None:
            # behind the word's second part goes what stands right after it, up to a space
            rest = following[second[0] + len(second[1]) :].split(None, 1) if second else []
            mark = rest[0] if rest and second and not following[second[0] + len(second[1])].isspace() else ""
            a, whole = tail or (at, second[1] if second else "")
            edits.append((a, end, whole + mark))
        for a, b, new in sorted(edits, reverse=True):
            t = t[:a] + new + t[b:]
        if skip and head:
            t = t[head[0] :].split(None, 1)[1] if len(t[head[0] :].split(None, 1)) > 1 else ""
        skip = at is not None and second is not None
        t = t.strip()
        if at is None and is_divided(t) and following[:1].isalpha():
            t += _GLUE  # a word written with a hyphen, divided there
        out.append((i, t))
    return out


def repaired_paragraphs(pages: DataFrame, ocr: DataFrame, glyphs: DataFrame) -> DataFrame:
    """``source, page_uid, document_id, page, paragraph_no, text``: the paragraphs without running lines and page numbers, misread words and characters put right, divided words joined, lines reflowed.

    A divided word is whole on its first line, also if a page ends there. A paragraph ends with a sentence on a line left
    short, and around lines that stand alone; one that goes on over pages is whole on the page where it begins. Of pages
    parsed again the one with the least id takes part in such. Null and blank texts have no paragraphs.
    """
    a = Analysis(pages, ocr, glyphs)
    by_page = lambda df, name, *columns: df.groupBy("source", "key").agg(F.collect_list(F.struct(*columns)).alias(name))
    right = F.coalesce(F.nullif("form", F.lit("")), F.lit(""))
    body = a.body.join(by_page(a.hyphens, "hyphens", "line", "start"), ["source", "key"], "left").join(by_page(a.wrong.where("best <> ''"), "words", "line", "start", "form", "best", "cut"), ["source", "key"], "left")
    body = body.join(by_page(a.signs.withColumn("right", right), "signs", "line", "start", "right", "lost_best"), ["source", "key"], "left")
    over = a.hyphens.where("far and second is not null").select(F.col("source").alias("before_source"), F.col("key").alias("before_key"), F.lit(True).alias("moved")).distinct()
    body = body.join(over, ["before_source", "before_key"], "left")

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = []
            for source, key, uid, document, page, text, edges, after, hyphens, found, signs, moved in zip(*(pdf[c] for c in ("source", "key", "page_uid", "document_id", "page", "text", "edges", "after", "hyphens", "words", "signs", "moved"))):
                lines = body_lines(text, edges)
                w: dict[int, list] = {}
                for x in found if found is not None else ():
                    w.setdefault(x["line"], []).append((x["start"], x["form"], x["best"], x["cut"]))
                c: dict[int, list] = {}
                for x in signs if signs is not None else ():
                    b = x["lost_best"]
                    c.setdefault(x["line"], []).append((x["start"], x["right"] or (chr(int(b)) if b is not None and b == b else "")))
                h = {x["line"]: x["start"] for x in hyphens} if hyphens is not None else {}
                mended = mend(lines, after, moved is True, h, w, c)
                width = max((len(t) for _, t in lines), default=0)
                rows += [(source, key, uid, document, page, n, t, len(raw), width, n in h) for (n, t), (_, raw) in zip(mended, lines) if t]
            yield integers(pd.DataFrame(rows, columns=["source", "key", "page_uid", "document_id", "page", "at", "text", "size", "width", "divided"]), "key", "page_uid", "page", "at")

    lines = body.select("source", "key", "page_uid", "document_id", "page", "text", "edges", "after", "hyphens", "words", "signs", "moved").mapInPandas(run, "source string, key bigint, page_uid bigint, document_id string, page int, at int, text string, size int, width int, divided boolean")
    own = Window.partitionBy("source", "key").orderBy("at")
    following = F.lead("text").over(own)
    stop = F.col("text").rlike(r"[.!?:。！？：؟।][\"”’»“)」]*\s*$")
    short = F.col("size") < 0.8 * F.col("width")
    alone = (F.col("size") < 0.6 * F.col("width")) & F.coalesce(following.rlike(r"^\s*[\p{Lu}\p{Lo}\d]"), F.lit(True)) & ~F.col("text").rlike(r"[,、，]\s*$") & ~F.col("divided")
    lines = lines.withColumn("ends", (stop & short) | alone).withColumn("no", F.coalesce(F.sum(F.col("ends").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " ")
    parts = checkpoint(lines.groupBy("source", "key", "page_uid", "document_id", "page", "no").agg(text.alias("text"), F.max_by(stop | F.col("ends"), "at").alias("closed")))
    # over pages: of each page of a document one row goes through the window
    row = parts.where("source <> 'native_glyphs' and document_id is not null and page is not null").groupBy("source", "document_id", "page", "key").agg(F.max("no").alias("last"), F.max_by("closed", "no").alias("closed"), F.min_by("text", "no").alias("head"))
    row = row.groupBy("source", "document_id", "page").agg(F.min_by(F.struct("key", "last", "closed", "head"), "key").alias("r")).select("source", "document_id", "page", "r.*")
    order = Window.partitionBy("source", "document_id").orderBy("page")
    goes_on = (F.lag("page").over(order) == F.col("page") - 1) & ~F.lag("closed").over(order) & ~F.col("head").rlike(r"^\s*(?:[-*•]|\d+[.)])\s")
    row = row.withColumn("goes_on", F.coalesce(goes_on, F.lit(False))).withColumn("root", F.when(F.col("goes_on") & (F.col("last") == 0), F.lit(None)).otherwise(F.struct("key", "page", F.col("last").alias("no"))))
    row = row.withColumn("root", F.last("root", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))).where("goes_on and root is not null").select("source", "key", F.lit(0).alias("no"), F.col("root.key").alias("to_key"), F.col("root.no").alias("to_no"))
    parts = parts.join(row, ["source", "key", "no"], "left")
    to = [F.coalesce("to_key", "key").alias("key"), F.coalesce("to_no", "no").alias("no")]
    mine = F.when(F.col("to_key").isNull(), F.struct("page_uid", "document_id", "page"))
    whole = parts.select("source", *to, mine.alias("at"), F.struct("page", F.col("key").alias("k"), "text").alias("t")).groupBy("source", "key", "no").agg(F.max("at").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda x: x["text"]), " ").alias("text"))
    return whole.select("source", "at.*", F.col("no").cast("int").alias("paragraph_no"), F.regexp_replace(F.regexp_replace("text", _GLUE + " ?", ""), r"(?<=[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]) (?=[\x{3040}-\x{30ff}\x{3400}-\x{9fff}])", "").alias("text"))
