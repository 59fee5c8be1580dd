"""Problem 6: sentences of texts in any script, by the standard's sentence-break properties.

Terminators, closers, continuers and cases come from the Unicode property Sentence_Break. The rules of UAX 29 hold, with
these additions: abbreviations of the text's language don't end sentences (some only before a number); a terminator inside
a quotation or bracket ends nothing, right before its close only if what follows begins anew; in Thai, a space between
Thai words does; a line's end is a space, unless the line was left so short that the next word would easily have fitted: it stands alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.llm.frames import integers
from sparkquarry.sources import spread

# Abbreviations that never end a sentence, and those that don't before a number; "" of all languages, the others are words elsewhere.
_ALWAYS = {
    "": "dr prof mr mrs messrs e.g i.e vs cf incl excl viz rev z.b d.h u.a o.ä i.d.r u.u v.a bzw vgl ggf evtl inkl exkl sog insb zzgl abzgl allg p.ex c.-à-d c.à.d mme mlle p.ej ud uds sra srta dra ad.es sig sigg dott ing т.е т.к т.н т.з напр див пор проф акад",
    "en": "st gen hon resp al ext ms",
    "de": "gem bes hr fr str",
    "fr": "m mm resp",
    "es": "p.e sr",
    "pt": "sr exmo",
    "it": "es p.es",
    "ru": "см ср",
    "uk": "ін",
}
_BEFORE_NUMBER = {
    "": "nr nos fig figs sec secs chap vol eq abb abschn kap ziff tab p pp art ref ca approx aprox env ungef pág págs pag pagg núm num cap sez seç sect éq réf max min máx mín ver v tel рис ок стр гл пп табл разд мал бл прибл стор розд тел макс мин мін прим",
    "en": "no ch app para paras pt pts est",
    "de": "s zif bd bl ab mind höchst",
    "fr": "n no tél",
    "es": "n ec",
    "pt": "n eq",
    "it": "n circa rif",
    "ru": "с п ст т ч ул д",
    "uk": "с п ст т ч вул",
}
#: Frequent words that tell the languages apart.
_COMMON = {
    "en": "the of and is to in for with that this",
    "de": "der die das und ist nicht mit den von bei",
    "fr": "le la les des est une que pour dans et",
    "es": "el la los las que una por con del está",
    "pt": "o os uma não para com da do na por",
    "it": "il di che una per con della gli è dopo",
    "ru": "и что на не при если как после или с",
    "uk": "і що на не за якщо як після або є",
}
_MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember".split())
_WORD = re.compile(r"[^\W\d_]+")


@cache
def _sets(lang: str) -> tuple[frozenset[str], frozenset[str]]:
    return tuple(frozenset(w for k in ("", lang) for w in d.get(k, "").split()) for d in (_ALWAYS, _BEFORE_NUMBER))


@cache
def _common() -> dict[str, frozenset[str]]:
    return {k: frozenset(v.split()) for k, v in _COMMON.items()}


#: So many frequent words of one language tell that of a paragraph by itself.
TELLING = 3


def language_of(text: str, least: int = 1) -> str:
    """The language whose frequent words a text has most of, ``least`` at least, among those with abbreviations; "" if none."""
    words = [w.lower() for w in _WORD.findall(text)]
    best, most = "", least - 1
    for lang, common in _common().items():
        n = sum(w in common for w in words)
        if n > most:
            best, most = lang, n
    return best


@cache
def _patterns():
    import regex

    stop = r"\p{Sentence_Break=ATerm}\p{Sentence_Break=STerm}"
    # marks that may open as well close only where nothing follows at once
    markup = r"(?:</[A-Za-z][\w]*>|[*_`~'\"]++(?=[\s\p{P}]|$)|\[\^[^\[\]\s]{1,8}\])"
    closers = r"[\p{Pe}\p{Pf}”’»]|“(?=[\s\p{P}]|$)"
    end = regex.compile(rf"(?P<stop>[{stop}]+)(?P<close>(?:{closers}|{markup}|[   ]»)*)(?P<space>\s*)")
    # each stops at the next mark of its kind, so a run is searched in proportion to its length
    spans = regex.compile(r"“[^“”]++”|„[^„“”]++[“”]|«[^«»]++»|»(?=\p{L})[^«»]++(?<=\S)«|‘[^‘’\n]++’(?!\p{L})")
    straight = regex.compile(r"(?<![^\s(\[“„«])\"(?=\S)[^\"]++(?<=\S)\"(?!\w)")
    return end, straight, spans, regex.compile(r"\p{Sentence_Break=SContinue}"), regex.compile(r"\p{Sentence_Break=Lower}"), regex.compile(r"\p{Lo}"), regex.compile(r"[\p{L}\p{M}.'’-]*$")


_OPENERS = {c: o for o, c in ("()", "（）", "[]", "【】", "「」", "『』", "《》", "‹›")}
_BRACKET = re.compile("[" + re.escape("".join(c + o for c, o in _OPENERS.items())) + "]")


def _brackets(run: str) -> list[tuple[int, int]]:
    """Brackets that open and close with different marks, however long and deep; each kind by itself, empty ones left out."""
    out, opened = [], {o: [] for o in _OPENERS.values()}
    for m in _BRACKET.finditer(run):
        if (c := m[0]) in opened:
            opened[c].append(m.start())
        elif opened[_OPENERS[c]] and (s := opened[_OPENERS[c]].pop()) + 1 < m.start():
            out.append((s, m.end()))
    return out


_ITEM = re.compile(r"\s*(?:[-*+•·‣▪–—]|\d{1,3}[.)]|[(（]\d{1,3}[)）]|[A-Za-zА-я]\))[ \t　]+(?=\S)")
_MARKER = re.compile(r"\s*(?:[-*+•·‣▪–—]\s*)?(?:\d{1,3}[.)]|[A-Za-zА-я][.)])$")
#: Ends of lines that go on: hyphens and commas; scripts without spaces, which are wrapped anywhere.
_GOES_ON = re.compile(r"[-,，、぀-ヿ㐀-鿿]\s*$")
_THAI_GAP = re.compile(r"(?<=[ก-๏])[ \t]*\n?[ \t]*(?<=\s)(?=[ก-๏])")
_TERMINATED = re.compile(r"[.!?:。！？：؟।۔…][\"'”’»“)\]）】」』]*\s*$")


def runs(text: str) -> Iterator[tuple[int, int]]:
    """The parts of a text that no sentence crosses: paragraphs, list items, lines that stand alone."""
    lines = text.split("\n")
    at, starts = 0, []
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    widths = [len(x.rstrip()) for x in lines]
    page = max(widths)
    k, n = 0, len(lines)
    while k < n:
        if not lines[k].strip():
            k += 1
            continue
        j = k
        while j + 1 < n and lines[j + 1].strip():
            j += 1
        width = page if page <= 120 else max(widths[k : j + 1])
        begin, item = k, bool(_ITEM.match(lines[k]))
        for i in range(k, j + 1):
            if i < j:
                following = lines[i + 1].split(None, 1)[0]
                # paragraphs may be wrapped narrower than others, so the next word must have fitted easily
                fits = widths[i] + 1 + len(following) <= 0.6 * width and not following[0].islower() and not _GOES_ON.search(lines[i])
                starts_item = bool(_ITEM.match(lines[i + 1])) and (fits or item or _TERMINATED.search(lines[i]) is not None)
                if not (fits or starts_item):
                    continue
                item = starts_item
            yield starts[begin], starts[i] + widths[i]
            begin = i + 1
        k = j + 1


def _ends(run: str, always: frozenset[str], before_number: frozenset[str], lang: str) -> list[int]:
    end, straight, spans, continues, lower, caseless, word_before = _patterns()
    out = []
    inside = [m.span() for m in straight.finditer(run)] if '"' in run else []
    if any(c in run for c in "“„«»「『《‹‘([（【"):
        inside += [m.span() for m in spans.finditer(run, overlapped=True)] + _brackets(run)
    for m in end.finditer(run):
        stop, after = m["stop"], m.end()
        close_end = m.end("close")
        if after >= len(run):
            continue
        nxt = run[after]
        spaced = m.end("space") > close_end
        closed = close_end > m.end("stop")
        a = m.start()
        wide = ord(stop[-1]) > 0x2E80
        if not spaced and not wide:
            # an ASCII mark ends nothing within a word, number or address
            if not (stop[-1] in "!?" and ord(nxt) > 0x2E80 and caseless.match(nxt)):
                continue
        if any(s < a and close_end < e for s, e in inside):
            continue
        if continues.match(nxt):
            continue
        quoted = any(s < a < e <= close_end and run[:s].strip() for s, e in inside)
        if quoted and caseless.match(nxt):
            continue  # "…!" within a sentence of a script without cases
        token = run[after:].split(None, 1)[0]
        is_name = any(c.isdigit() or c in "_=" for c in token) or re.search(r"\w[./]\w", token) is not None
        if lower.match(nxt) and not is_name and ord(stop[-1]) < 0x80:
            continue
        if stop[-1] in ".．․﹒" and len(stop) == 1 and not closed:
            before = word_before.search(run, 0, a)[0]
            bare = before.lower().strip("'’-.")
            if not bare:
                if _MARKER.match(run[:a + 1]):
                    continue
                if lang == "de" and run[a - 1 : a].isdigit() and token.strip(".,;").lower() in _MONTHS:
                    continue
            else:
                joined = bare
                if len(bare) == 1:
                    earlier = run[: a - len(before)].rstrip()
                    if earlier.endswith(".") and len(p := word_before.search(earlier, 0, len(earlier) - 1)[0]) <= 2 and p:
                        joined = p.lower() + "." + bare
                if bare in always or joined in always:
                    continue
                if nxt.isdigit() and bare in before_number:
                    continue
                if len(bare) == 1 and not wide:
                    head = run[: a - len(before)].rstrip()
                    if not head:
                        continue  # the mark of an item
                    if not head[-1].isdigit() and (len(token) <= 2 and token.endswith(".") or joined == bare and before.isupper() and nxt.isupper() and not head[-1] in "=°"):
                        continue  # initials and spaced abbreviations
        out.append(close_end)
    if "฀" < max(run):
        for g in _THAI_GAP.finditer(run):
            if not any(s < g.start() < e for s, e in inside):
                out.append(g.start())
    return sorted(set(out))


def sentence_ends(text: str | None) -> list[int]:
    """Where sentences end, in code points from the text's start, white space behind them not included; none in blank texts."""
    if not text or text.isspace():
        return []
    parts = list(runs(text))
    whole, own = language_of(text), {}
    if len(parts) > 1:
        # a text may be of several languages; a paragraph that tells its own is of that
        own = {k: found for k, (a, b) in enumerate(parts) if (found := language_of(text[a:b], TELLING)) and found != whole}
    out = []
    for k, (a, b) in enumerate(parts):
        run = text[a:b]
        lang = own.get(k, whole)
        out += [a + e for e in _ends(run, *_sets(lang), lang)]
        out.append(b)
    return out


_SCHEMA = "record_table string, record_id bigint, sentence_no int, start_offset int, end_offset int, sentence string"


def split_sentences(df: DataFrame) -> DataFrame:
    """``record_table, record_id, sentence_no, start_offset, end_offset, sentence`` for rows ``record_table, record_id, text``.

    The sentences of a text one after another are the text, white space at its end aside: each begins where the one before
    ends, so leading space is its own. Null and blank texts give none. Repeated ids keep their rows; other columns are left out.
    """
    src = df.select("record_table", F.col("record_id").cast("bigint").alias("record_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike(r"(?U)\S"))

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = []
            for table, rid, text in pdf.itertuples(index=False):
                begin = 0
                for no, e in enumerate(sentence_ends(text)):
                    rows.append((table, rid, no, begin, e, text[begin:e]))
                    begin = e
            yield integers(pd.DataFrame(rows, columns=[c.split()[0] for c in _SCHEMA.split(", ")]), "record_id")

    return spread(src, "record_id").mapInPandas(run, _SCHEMA)
