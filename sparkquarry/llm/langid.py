"""Problem 9: languages of documents and of the segments of mixed ones, by multinomial naive Bayes over hashed n-grams.

Character 1- to 3-grams are hashed into ``BUCKETS``; the model is the matrix of log probabilities of bucket and language
(of fixed size, so it may be broadcast). It is fitted on a bounded sample of documents whose label names a language,
twice: the second time on the lines alone that the first model finds to be in the label's language, so wrong labels and
mixed documents fall out. Batches of lines are scored in numpy; the lines' languages are then decoded together with a
cost for each change of language, so that short lines follow those around them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.llm.frames import integer_columns, integers
from sparkquarry.llm.tokenize import blocks
from sparkquarry.session import checkpoint
from sparkquarry.sources import spread

BITS = 16
BUCKETS = 1 << BITS
#: The bound of the sample: labelled documents of each language that the model is fitted on.
DOCUMENTS_PER_LANGUAGE = 1500
SMOOTHING = 0.05
#: What a change of language between lines costs, in units of log likelihood.
CHANGE = 18.0
#: No n-gram tells more than this between the best and the worst language.
CLIP = 7.0

_QUOTED = re.compile(r"[\"“„«「『‘][^\"“”„«»「」『』‘’\n]{1,160}[\"”“»」』’]")
#: ASCII runs with digits or signs of code: names, settings, addresses, options, files.
_NO_SIGN = r"[!\"%&'()*+,:;?A-Z\[\]a-z-]"
_CODE = re.compile(rf"(?<![!-~])(?:(?:{_NO_SIGN}|\.)*+[0-9_=/\\|<>{{}}$@#~^`][!-~]*+|--?[a-z][!-~]*+|(?:{_NO_SIGN}*+\.)++(?<=[a-z]\.)[a-z]{{2,4}}+(?![!-~]))")
_UNSPACED = re.compile(r"[฀-๿぀-ヿ㐀-鿿가-힯豈-﫿]")
_UNSPACED_PAIR = re.compile(_UNSPACED.pattern + ".*?" + _UNSPACED.pattern)
_ASCII_GAP = re.compile(r"[^A-Za-z]+")
_ASCII_LETTER, _ASCII_WORD = re.compile(r"[A-Za-z]"), re.compile(r"[A-Za-z][A-Za-z'’]*")
#: Something of code; quotations; scripts whose letters have marks of their own.
_CODE_SIGN, _QUOTE_SIGN, _MARKED = re.compile(r"[0-9_=/\\|<>{}$@#~^`]|-[a-z]|[a-z]\.[a-z]"), re.compile("[\"“„«「『‘]"), re.compile("[\u0300-\u036f\u0483-\u0489\u0591-\u1aff\u20d0-\u20f0\ua66f-\uabff\ufb1e\ufe00-\ufe2f\U00010000-\U0010ffff]")
_GAPS = re.compile(r"[\W\d_²³¹¼-¾⁰-₉①-⓿]+")
_STRIP = ".,;:!?()[]«»\"'“”„*#؟،。"
#: A token that is a word of two letters or more between marks.
_PLAIN = re.compile(rf"(?<!\S)[{re.escape(_STRIP)}]*+[^\W\d_]{{2,}}+(?:['’-][^\W\d_]++)*+[{re.escape(_STRIP)}]*+(?!\S)|(?<!\S)[{re.escape(_STRIP)}]*+[^\W\d_](?:['’-][^\W\d_]++)++[{re.escape(_STRIP)}]*+(?!\S)")
#: Where a word wholly in capitals may be.
_CAPITALS = re.compile("[A-ZÀ-ÞΆ-ΫЀ-Я]['’-]?[A-ZÀ-ÞΆ-ΫЀ-Я]|[\u0100-\u0370\u0500-\u0590\u10a0-\u10ff\u13a0-\u13ff\u1c80-\u1fff\u2c00-\u2dff\ua640-\ua7ff]")
_NOT_PROSE = re.compile(r"^\s*(?:\$ |\[[\w.-]+\]\s*$|[\w.-]+\s*=\s*\S*\s*$|\d{4}-\d\d-\d\d[T ]\d\d:|\[\d+:\d+)")


@cache
def _letters():
    """A word; what isn't letters. Letters are with their marks, which scripts such as Devanagari need."""
    import regex

    return regex.compile(r"[\p{L}\p{M}]+(?:['’-][\p{L}\p{M}]+)*"), regex.compile(r"[^\p{L}\p{M}]+")


@cache
def _hidden() -> re.Pattern:
    """Invisible format characters."""
    return re.compile("[" + "".join(map(re.escape, (c for c in map(chr, range(0x10000)) if unicodedata.category(c) == "Cf"))) + "\U000e0001-\U000e007f]+")


def plain(text: str) -> str:
    """The text in composed form without invisible characters; its lines stay as many."""
    return text if text.isascii() else _hidden().sub("", unicodedata.normalize("NFC", text))


def is_prose(line: str) -> bool:
    """Whether a line has natural language; commands, logs, settings and tables of values have too few plain words."""
    if _NOT_PROSE.match(line):
        return False
    if not line.isascii() and _UNSPACED_PAIR.search(line):
        return True
    tokens = line.split()
    wanted = len(tokens) // 2
    if not _MARKED.search(line):
        found = _PLAIN.findall(line)
        return len(found) > wanted and (_CAPITALS.search(line) is None or sum(not w.isupper() for w in found) > wanted)
    word = _letters()[0].fullmatch
    for t in tokens:
        w = t.strip(_STRIP)
        if len(w) > 1 and not w.isupper() and (w.isalpha() or word(w)):
            wanted -= 1
            if wanted < 0:
                return True
    return False


def letters_of(line: str) -> str:
    """What is scored of a :func:`plain` line: words in lower case, without code and, where enough is left, quotations."""
    bare = _CODE.sub(" ", line) if _CODE_SIGN.search(line) else line
    if _QUOTE_SIGN.search(bare):
        rest = _QUOTED.sub(" ", bare)
        if sum(map(str.isalpha, rest)) >= 8:
            bare = rest
    if not bare.isascii() and _ASCII_LETTER.search(bare) and (dense := len(_UNSPACED.findall(bare))):
        # of two kinds of script in a line, the one that says more
        bare = (_ASCII_WORD if dense * 3 >= len(_ASCII_LETTER.findall(bare)) else _UNSPACED).sub(" ", bare)
    gap = _ASCII_GAP if bare.isascii() else _letters()[1] if _MARKED.search(bare) else _GAPS
    bare = gap.sub(" ", bare).strip()
    return f" {bare.lower()} " if bare else ""


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each n-gram, and the number of the text it is of, ascending by n only."""
    parts = list(_by_size(texts))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([b for b, _ in parts]), np.concatenate([o for _, o in parts])


def _by_size(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and texts' numbers of the 1-grams, the 2-grams, the 3-grams; numbers ascend in each."""
    joined = "\n".join(texts)
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(c):
        return
    end = c == 10
    text = np.cumsum(end) - end
    h = np.zeros(len(c), np.uint64)
    clean = np.ones(len(c), bool)
    for n in range(3):
        m = len(c) - n
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + c[n:] + np.uint64(n + 1)
        clean = clean[:m] & ~end[n:]
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        yield (mixed[clean] >> np.uint64(64 - BITS)).astype(np.int64), text[:m][clean]


#: Characters that are scored at once.
PIECE = 200_000


def _pieces(texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """The texts and their numbers in lists of about ``PIECE`` characters, longer ones cut at spaces, else anywhere."""
    held, numbers, size = [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while at < len(t):
            to = len(t)
            if to - at > PIECE:
                space = t.rfind(" ", at + PIECE // 2, at + PIECE)
                to = space + 1 if space > 0 else at + PIECE
            held.append(t[at:to])
            numbers.append(i)
            size += to - at
            at = to if to == len(t) or t[to - 1] != " " else to - 1  # the space bounds words on both sides
            if size >= PIECE:
                yield held, numbers
                held, numbers, size = [], [], 0
            if to == len(t):
                break
    if held:
        yield held, numbers


class Model:
    """``logp``: buckets by languages."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        total = counts.sum(0, keepdims=True)
        logp = np.log((counts + SMOOTHING) / (total + SMOOTHING * BUCKETS))
        top = logp.max(1, keepdims=True)
        self.logp = np.maximum(logp - top, -CLIP).astype(np.float32)
        self.logp[:, total[0] == 0] = -CLIP
        self.prior = (total[0] + 1) / (total.sum() + len(langs))

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods (texts by languages), each text's best offset alike, and the number of n-grams."""
        out, sizes = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for part, numbers in _pieces(texts):
            numbers = np.array(numbers)
            for buckets, of in _by_size(part):
                if len(of):
                    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                    at = numbers[of[starts]]
                    np.add.at(out, at, np.add.reduceat(self.logp[buckets], starts, axis=0))
                    np.add.at(sizes, at, np.diff(np.r_[starts, len(of)]))
        return out, sizes

    def confidence(self, scores: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the best language, and its posterior if the row's n-grams told no more than 30 independent ones of their kind."""
        s = scores / np.maximum(n, 1)[:, None] * np.minimum(n, 30)[:, None] + np.log(self.prior)
        p = np.exp(s - s.max(1, keepdims=True))
        best = np.where(n > 0, (scores + 1e-6 * np.log(self.prior)).argmax(1), s.argmax(1))
        return best, p[np.arange(len(best)), best] / p.sum(1)


def decode(scores: np.ndarray) -> list[int]:
    """The best sequence of languages for lines with these scores."""
    best = scores[0].copy()
    back = []
    for s in scores[1:]:
        k = int(best.argmax())
        stay = best >= best[k] - CHANGE
        back.append(np.where(stay, np.arange(len(best)), k))
        best = np.where(stay, best, best[k] - CHANGE) + s
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def segments(model: Model, texts: list[str | None]) -> list[list[tuple[int, int, int, float]]]:
    """Of each text its segments: first line, line after the last, index of the language, confidence."""
    lines, numbers, begins, totals = [], [], [0], []
    for t in texts:
        split = plain(t or "").split("\n")
        for no, line in enumerate(split):
            if is_prose(line):
                lines.append(letters_of(line))
                numbers.append(no)
        begins.append(len(lines))
        totals.append(len(split))
    scores, sizes = model.score(lines)
    said = np.concatenate(([0], np.cumsum(sizes)))
    said = said[np.array(begins)]
    each = scores.argmax(1).tolist()
    found: list[tuple[int, int, int, int, int, int]] = []  # text, first line, line after the last, language, and where its scores are
    bare = []
    for i, (at, end, n) in enumerate(zip(begins, begins[1:], totals)):
        if said[i + 1] == said[i]:
            bare.append(i)
            continue
        # lines that are all likeliest of one language are of it, as no change could gain anything
        path = each[at:end] if each[at:end].count(each[at]) == end - at else decode(scores[at:end])
        cuts = [0, *(k for k in range(1, len(path)) if path[k] != path[k - 1]), len(path)]
        for a, b in zip(cuts, cuts[1:]):
            found.append((i, 0 if a == 0 else numbers[at + a], n if b == len(path) else numbers[at + b], path[a], at + a, at + b))
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    if found:
        start, stop = np.array([f[4] for f in found]), np.array([f[5] for f in found])
        sums = np.concatenate((np.zeros((1, scores.shape[1])), np.cumsum(scores, 0)))
        upto = np.concatenate(([0], np.cumsum(sizes)))
        best, sure = model.confidence(sums[stop] - sums[start], upto[stop] - upto[start])
        for (i, first, last, lang, _, _), b, p in zip(found, best.tolist(), sure.tolist()):
            out[i].append((first, last, lang, p if b == lang else min(p, 0.5)))
    if bare:
        best, sure = model.confidence(*model.score([letters_of(plain(texts[i] or "")) for i in bare]))
        for i, b, p in zip(bare, best.tolist(), sure.tolist()):
            out[i] = [(0, totals[i], b, p)]
    return out


def label_of(lang: Column, codes: dict[str, str]) -> Column:
    """The two-letter code that a label names, in whatever case, with region, script, spaces or three letters; else null."""
    first = F.split(F.lower(F.trim(F.regexp_replace(lang, r"\s+", " "))), "[-_ ]").getItem(0)
    return F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))[first]


def read_codes(codes: DataFrame) -> dict[str, str]:
    """Two- and three-letter codes by the two-letter code they mean; a few rows at any scale."""
    rows = [r for r in codes.select("lang", "lang3").collect() if r.lang]
    return {r.lang3.lower(): r.lang for r in rows if r.lang3} | {r.lang.lower(): r.lang for r in rows}


_COUNTS = "lang int, bucket int, n double"


def fit(df: DataFrame, codes: dict[str, str], text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = DOCUMENTS_PER_LANGUAGE) -> Model:
    """The model, from at most ``per_language`` labelled documents of each language, taken by a hash of their ids: no language sends more to be ranked, however many documents it has.

    Without labelled documents all languages stay equally likely.
    """
    langs = sorted(set(codes.values()))
    index = {x: i for i, x in enumerate(langs)}
    known = df.select(F.xxhash64(id_col).alias("_hash"), F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), label_of(F.col(lang_col), codes).alias("_lang")).where(F.col("_lang").isNotNull())
    # of a language with many documents only those under a threshold of the hash are read and ranked, some more than are wanted
    share = {r[0]: min(1.0, (per_language + 8 * per_language**0.5 + 20) / r[1]) for r in known.groupBy("_lang").count().collect()}
    limit = F.create_map(*(F.lit(x) for k, v in share.items() for x in (k, int(v * 2**63) if v < 1 else 2**63 - 1))) if share else F.create_map(F.lit(""), F.lit(0))
    known = known.where((F.shiftrightunsigned("_hash", 1) <= limit[F.col("_lang")]) & F.col("_text").rlike(r"(?U)\S"))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_hash", "_id"))
    taken = known.withColumn("_rank", rank).where(F.col("_rank") <= per_language).repartition(df.sparkSession.sparkContext.defaultParallelism * 2, "_rank").select("_text", "_lang")

    def prose(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            yield pd.DataFrame({"lines": ["\n".join(letters_of(x) for x in plain(text).split("\n") if is_prose(x)) for text in pdf["_text"]], "lang": pdf["_lang"].map(index)})

    sample = checkpoint(taken.mapInPandas(prose, "lines string, lang int"))
    model = None
    for _ in range(2):
        spoken = df.sparkSession.sparkContext.broadcast(model)  # buckets by languages at most

        def count(pdfs: Iterator[pd.DataFrame], spoken=spoken) -> Iterator[pd.DataFrame]:
            m, sums = spoken.value, np.zeros((len(langs), BUCKETS))
            for pdf in pdfs:
                for lang, texts in pdf.groupby("lang")["lines"]:
                    for part in blocks(texts):
                        lines = "\n".join(part).split("\n")
                        if m is not None:
                            scores, _n = m.score(lines)
                            lines = [x for x, best in zip(lines, scores.argmax(1)) if best == lang]
                        sums[lang] += np.bincount(ngrams(lines)[0], minlength=BUCKETS)
            at = np.nonzero(sums)
            yield pd.DataFrame({"lang": at[0].astype(np.int32), "bucket": at[1].astype(np.int32), "n": sums[at]})

        found = sample.mapInPandas(count, _COUNTS).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros((BUCKETS, len(langs)))
        counts[found["bucket"], found["lang"]] = found["n"]
        model = Model(langs, counts)
    return model


_SEGMENTS = "segment_no int, n_segments int, first_line int, last_line int, lang string, confidence double"


def assign(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A row for each segment: ``id_col``, the columns ``keep``, segment_no, n_segments, first_line, last_line, lang, confidence.

    A document of one language is segment 0. Null, blank and wordless texts get the language that is likeliest beforehand,
    with that low confidence. Null or repeated ids keep their rows; other columns are left out.
    """
    keep = keep or []
    src = spread(df.select(F.col(id_col), *keep, F.col(text_col).cast("string").alias("_text")), id_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.drop("_text").schema)
    whole = integer_columns(src.schema)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in pdfs:
            at = 0
            for texts in blocks(None if t is None else t for t in pdf["_text"]):
                found = segments(m, texts)
                rows = np.repeat(np.arange(at, at + len(texts)), [len(s) for s in found])
                flat = [(no, len(s), a, b - 1, m.langs[k], p) for s in found for no, (a, b, k, p) in enumerate(s)]
                part = integers(pdf.drop(columns="_text").iloc[rows].reset_index(drop=True), *whole)
                yield pd.concat([part, pd.DataFrame(flat, columns=["segment_no", "n_segments", "first_line", "last_line", "lang", "confidence"])], axis=1)
                at += len(texts)

    return src.mapInPandas(run, f"{fields}, {_SEGMENTS}")
