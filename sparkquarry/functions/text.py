"""String and token functions as Catalyst expressions; one, the tightest span, runs in Arrow batches.

Case is folded by ``lower``, so that any SQL engine gives the same.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Patterns of terms and identifiers.
TERM = r"[A-Za-z0-9]+(?:[._/:+-][A-Za-z0-9]+)*|[\x{3400}-\x{9fff}]+"
SEPARATORS = r"[._/:+-]+"
#: Terms from here on are runs of ideographs; all others are ASCII.
FIRST_IDEOGRAPH = "\u3400"
COMPOSITE = r"[A-Za-z][A-Za-z0-9]*(?:[._/:+-][A-Za-z0-9]+)+"
VERSION = r"v?\d+(?:\.\d+){1,}(?:[_-][A-Za-z0-9]+)*"
#: The flag is a group, as SQL engines have no lookbehind to leave out what stands before.
FLAG = r"(?:^|[^\w-])(--?[A-Za-z][A-Za-z0-9-]*)"
HEX = r"0x[0-9a-f]+"
NAMED_NUMBER = r"[A-Za-z][A-Za-z0-9_.+-]*\d[A-Za-z0-9_.+-]*"
SPACED = r"[A-Za-z][A-Za-z0-9]*(?:\s*(?:[._/:+-]\s*|\s+)\d+(?:\s*(?:[._/:+-]\s*|\s+)[A-Za-z0-9]+)*)"
#: White space of any script, as Python strips it.
SPACE = r"[\s\x1c-\x1f]"
PHRASE = r"[A-Za-z][A-Za-z0-9]*(?:\s+[A-Za-z][A-Za-z0-9]*)+"

# Words that tell what a question is after, and relation markers in order of precedence.
TABLE_WORDS = ["性能", "规格", "参数", "吞吐", "精度", "量化", "对比表", "ttft", "tpot", "decode", "tps"]
FACT_WORDS = ["配置流程", "如何配置", "怎么配置", "支持哪些", "有哪些", "哪些模式", "哪些策略", "哪些 strategy", "which modes", "what modes", "which strategies", "what strategies", "how to configure"]
EXACT_WORDS = ["版本", "命令", "参数", "输出", "路径", "错误码", "日志", "型号", "地址", "version", "command", "parameter", "output", "path", "error code"]
SEMANTIC_WORDS = ["介绍", "概述", "原理", "总结", "是什么", "说明一下", "overview", "explain", "summarize"]
RELATION_MARKERS = ["设置为", "设为", "指向", "转给", "流向"]
SHORT_QUESTION = 48


def compact_identifier(c: Column) -> Column:
    """An identifier without case, spaces and punctuation."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def _every(pattern: str, c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def _bigrams(t: Column) -> Column:
    return F.when(F.char_length(t) > 1, F.transform(F.sequence(F.lit(1), F.char_length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def terms(c: Column) -> Column:
    """Index terms with repeats: of a run of ideographs every character and bigram, of another term itself, its parts, and its compact form if that has a digit and differs. Null gives null."""

    def expand(t: Column) -> Column:
        # with a separator there are parts, and the compact form differs; without there are neither
        characters = F.transform(F.sequence(F.lit(1), F.char_length(t)), lambda i: F.substring(t, i, F.lit(1)))
        compact = F.when(t.rlike("[0-9]"), F.array(F.translate(t, "._/:+-", ""))).otherwise(F.array().cast("array<string>"))
        split = F.concat(F.array(t), F.split(t, SEPARATORS), compact)
        return F.when(t >= FIRST_IDEOGRAPH, F.concat(characters, _bigrams(t))).otherwise(F.when(t.rlike("[._/:+-]"), split).otherwise(F.array(t)))

    return F.flatten(F.transform(_every(TERM, F.lower(c)), expand))


def n_terms(c: Column) -> Column:
    """The number of index terms, without building them."""
    parts = lambda t: F.char_length(t) - F.char_length(F.translate(t, "._/:+-", ""))
    of = lambda t: F.when(t >= FIRST_IDEOGRAPH, 2 * F.char_length(t) - 1).otherwise(F.when(parts(t) > 0, 2 + parts(t) + t.rlike("[0-9]").cast("int")).otherwise(1))
    return F.aggregate(_every(TERM, F.lower(c)), F.lit(0), lambda n, t: n + of(t)).cast("bigint")


def passage_terms(c: Column) -> Column:
    """Terms for lines: bigrams of ideographs, other terms whole."""
    return F.flatten(F.transform(_every(TERM, F.lower(c)), lambda t: F.when(t >= FIRST_IDEOGRAPH, _bigrams(t)).otherwise(F.array(t))))


def exact_terms(c: Column) -> Column:
    """Terms of three characters or more that a passage should hold literally."""
    return F.array_distinct(F.filter(_every(TERM, F.lower(c)), lambda t: (F.char_length(t) >= 3) & (~t.rlike(r"^\p{L}+$") | t.rlike("^[a-z]+$"))))


def index_text(c: Column) -> Column:
    """The text, with compact forms of identifiers that are written with spaces on a line of their own."""
    aliases = F.array_sort(F.array_distinct(F.transform(F.filter(_every(r"(?U)\b" + SPACED, c), lambda x: x.rlike("[0-9]")), compact_identifier)))
    return F.concat_ws("\n", F.nullif(c, F.lit("")), F.nullif(F.array_join(aliases, " "), F.lit("")))


def _any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.lower(c), F.lit(w))
    return out


def named_phrases(c: Column) -> Column:
    """Runs of two or more ASCII words, with single spaces, in lower case."""
    return F.transform(_every(r"(?U)\b" + PHRASE + r"\b", c), lambda x: F.lower(F.regexp_replace(x, r"(?U)\s+", " ")))


def relation_anchors(c: Column) -> Column:
    """The phrases right before and after the first relation marker (in the markers' order) that has different ones on both sides; else null."""
    out = F.lit(None).cast("array<string>")
    for marker in reversed(RELATION_MARKERS):
        at = F.instr(c, marker)
        left = F.try_element_at(named_phrases(F.substring(c, F.lit(1), at - 1)), F.lit(-1))
        right = F.get(named_phrases(F.substring(c, at + len(marker), F.char_length(c))), F.lit(0))
        out = F.when((at > 0) & left.isNotNull() & right.isNotNull() & (left != right), F.array(left, right)).otherwise(out)
    return out


def has_exact_shape(c: Column) -> Column:
    return c.rlike(COMPOSITE) | c.rlike(r"(?i)\b" + VERSION + r"\b") | c.rlike(FLAG) | c.rlike(r"(?i)\b" + HEX + r"\b") | c.rlike(r"(?i)\b" + NAMED_NUMBER + r"\b")


def retrieval_profile(c: Column) -> Column:
    """table, relation_fact, document_fact, exact, semantic or balanced, the first that fits."""
    shape = has_exact_shape(c)
    return (
        F.when(_any(c, TABLE_WORDS), "table").when(relation_anchors(c).isNotNull(), "relation_fact").when(_any(c, FACT_WORDS), "document_fact")
        .when(shape & (_any(c, EXACT_WORDS) | (F.char_length(F.trim(c)) <= SHORT_QUESTION)), "exact").when(_any(c, SEMANTIC_WORDS), "semantic").otherwise("balanced")
    )


def direct_identifiers(c: Column) -> Column:
    """Composite names, versions, flags, hexadecimals and terms with digits, the longest first."""
    low = F.lower(c)
    flags = F.regexp_extract_all(low, F.lit("(?U)" + FLAG), F.lit(1))
    named = F.filter(_every(TERM, low), lambda t: (F.char_length(t) >= 3) & t.rlike("^[!-~]+$") & t.rlike("[_0-9]"))
    found = F.array_distinct(F.concat(_every(COMPOSITE, low), _every(r"\b" + VERSION + r"\b", low), flags, _every(r"\b" + HEX + r"\b", low), named))
    return F.transform(F.array_sort(F.transform(found, lambda x: F.struct((-F.char_length(x)).alias("n"), x.alias("x")))), lambda s: s["x"])


def coverage(wanted: Column, content: Column) -> Column:
    """Those of the wanted strings that the content holds, without regard to case and runs of white space."""
    text = F.lower(F.regexp_replace(content, r"\s+", " "))
    return F.filter(wanted, lambda w: F.contains(text, w))


@F.pandas_udf(LongType())
def tightest_span(a: pd.Series, b: pd.Series, content: pd.Series) -> pd.Series:
    """The least distance between starts of two strings in the content, overlaps included; null if either is missing.

    Both lists of starts are walked once; higher-order functions would compare each start with each.
    """
    out = []
    for x, y, text in zip(a, b, content):
        text = None if text is None else re.sub(r"\s+", " ", text).lower()
        starts = [[m.start() for m in re.finditer(f"(?={re.escape(w)})", text)] if w and text else [] for w in (x, y)]
        i = j = 0
        best = None
        while i < len(starts[0]) and j < len(starts[1]):
            d = starts[0][i] - starts[1][j]
            best = abs(d) if best is None else min(best, abs(d))
            i, j = (i + 1, j) if d < 0 else (i, j + 1)
        out.append(best)
    return pd.Series(out, dtype="object")


def substantive(c: Column) -> Column:
    """At least 24 characters without headings and comments."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", ""), r"(?mdU)^\s{0,3}#{1,6}\s.*$", "")
    return F.char_length(F.regexp_replace(bare, rf"(?U)^{SPACE}+|{SPACE}+\z", "")) >= 24


def trace_id(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 12)


def source_family(path: Column) -> Column:
    """A path without the route before its extension."""
    return F.regexp_replace(path, r"\.(kg|text)\.md$", ".md")


def display_name(path: Column) -> Column:
    return source_family(F.regexp_extract(path, r"[^/]*$", 0))


def preview_url(chunk_id: Column, hits: Column) -> Column:
    """An address for a chunk, percent-encoded, with the chunks hit."""
    encode = lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit("/query/references/"), encode(chunk_id), F.lit("/view"), F.when(F.size(hits) > 0, F.concat(F.lit("?hits="), F.array_join(F.transform(hits, encode), ","))).otherwise(""), F.lit("#cited-passage"))


def valid_chunk_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9_.:-]{1,200}$"), F.lit(False))


def user_query(prompt: Column, marker: str = "---User Query---") -> Column:
    """What follows the last marker."""
    return F.trim(F.substring_index(prompt, marker, -1))


def message_tokens(contents: Column) -> Column:
    """An estimate for a list of messages: 8, and 12 each, and a token for each other and for four ASCII characters."""

    def of(m: Column) -> Column:
        m = F.coalesce(m, F.lit(""))
        other = F.char_length(F.regexp_replace(m, r"[\x00-\x7f]", ""))
        return other + F.floor((F.char_length(m) - other + 3) / 4).cast("int") + 12

    return F.lit(8) + F.aggregate(F.transform(contents, of), F.lit(0), lambda a, x: a + x)


def resolve_max_tokens(requested: Column, configured: int, context: int, estimated: Column, reserve: int) -> Column:
    return F.least(F.greatest(requested, F.lit(1)), F.lit(configured), F.greatest(F.lit(1), F.lit(context) - estimated - reserve))


FOOTER = rf"(?isU){SPACE}*(?:^|\n)[ \t]*(?:#{{1,6}}[ \t]*)?(?:references|参考资料|参考文献)[ \t]*[:：]?[ \t]*(?:\n|\[).*$"


def without_footer(c: Column) -> Column:
    """An answer without the list of references that begins on a line of its own."""
    return F.regexp_replace(F.regexp_replace(c, FOOTER, ""), rf"(?U){SPACE}+\z", "")


def heading_terms(c: Column) -> Column:
    """ASCII names of two characters or more, and bigrams of ideographs."""
    names = F.filter(_every(r"[a-z0-9][a-z0-9_.+-]*", F.lower(c)), lambda t: F.char_length(t) >= 2)
    return F.array_distinct(F.concat(names, F.flatten(F.transform(_every(r"[\x{3400}-\x{9fff}]+", c), _bigrams))))


def heading_score(query: Column, heading: Column) -> Column:
    low = F.lower(heading)
    return F.size(F.filter(heading_terms(query), lambda t: F.contains(low, t)))


def paragraph_sentences(c: Column) -> Column:
    """A paragraph at its end marks, or whole if some part would be shorter than 12 characters."""
    parts = F.transform(F.split(c, r"(?U)(?<=[。！？；!?])|(?<=[A-Za-z0-9][.!?])\s+"), lambda p: F.regexp_replace(p, rf"(?U)^{SPACE}+|{SPACE}+\z", ""))
    parts = F.filter(parts, lambda p: p != "")
    return F.when((F.size(parts) > 1) & ~F.exists(parts, lambda p: F.char_length(p) < 12), parts).otherwise(F.array(c))


def needs_next_page(result: Column, truncated: Column) -> Column:
    return F.coalesce(truncated, F.lit(False)) | F.contains(F.coalesce(result, F.lit("")), F.lit("<|MORE|>"))


def bounded_join(names: Column, budget: int) -> Column:
    """Names in order, joined by commas as long as they fit the budget, the first always; then an ellipsis."""
    ordered = F.array_sort(F.array_distinct(names))
    state = F.aggregate(
        ordered, F.struct(F.lit("").alias("s"), F.lit(False).alias("full")),
        lambda a, x: F.when(a["full"], a).when(a["s"] == "", F.struct(x.alias("s"), F.lit(False).alias("full")))
        .when(F.char_length(a["s"]) + 2 + F.char_length(x) <= budget, F.struct(F.concat(a["s"], F.lit(", "), x).alias("s"), F.lit(False).alias("full")))
        .otherwise(F.struct(F.concat(a["s"], F.lit(", …")).alias("s"), F.lit(True).alias("full"))),
    )
    return state["s"]


def continue_prompt(page: Column, seen: Column) -> Column:
    return F.concat(F.lit("Continue with page "), page.cast("string"), F.lit(". Already found: "), F.coalesce(F.nullif(seen, F.lit("")), F.lit("nothing")), F.lit(". Give only what is new."))


def prompt_or_default(prompt: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(prompt), F.lit("")), F.lit(default))


def visible_block(text: Column, source: Column, label: Column) -> Column:
    """Blocks with a letter or digit, other than read ones in figures and page margins."""
    return F.coalesce(text.rlike(r"[\p{L}\p{N}]"), F.lit(False)) & ~F.coalesce((source == "ocr") & label.isin("figure", "abandon"), F.lit(False))


def structural_heading(text: Column) -> Column:
    """Neither a bullet nor a line of a table of contents."""
    return ~text.rlike(r"^\s*[•●▪◦·\-*]") & (F.char_length(text) - F.char_length(F.replace(text, F.lit("."), F.lit(""))) < 8)


def list_style(text: Column) -> Column:
    return F.when(text.rlike(r"^\s*\d+(?:\.\d+)+"), "decimal").when(text.rlike(r"^\s*\d+[.)]"), "number").when(text.rlike(r"^\s*[A-Za-z][.)]"), "letter").when(text.rlike(r"^\s*[•●▪◦·\-*]\s"), "bullet").otherwise("none")


def section_label(headings: Column, content: Column, most: int = 200) -> Column:
    """The headings over a chunk, or the first heading in it."""
    own = F.nullif(F.array_join(F.filter(headings, lambda h: F.trim(h) != ""), " > "), F.lit(""))
    first = F.nullif(F.regexp_extract(content, r"(?m)^\s{0,3}#{1,6}\s+(.+?)\s*$", 1), F.lit(""))
    return F.substring(F.coalesce(own, first), 1, most)
