"""Queries that do the whole job of another whose SQL is bound to a part of it."""

import hashlib
import math
import re

from pyspark.sql import functions as F

from sparkquarry.functions import text as T
from sparkquarry.operators import geometry, lexical
from sparkquarry.plans import registry

QUERIES = registry.queries()


def test_cosine_over_all_chunks(spark):
    texts = {1: "alpha alpha beta", 500: "alpha gamma", 900: "delta", 901: "", 902: None}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id int, content string").where("chunk_id <> 901")
    q = spark.createDataFrame([(1, "alpha gamma zzz"), (2, "zzz"), (3, None)], "query_id int, query string")

    def vector(text):
        words = text.split()
        return {w: 1 + math.log(words.count(w)) for w in words}

    docs = {i: vector(t) for i, t in texts.items() if t}
    idf = {w: math.log(1 + 3 / n) for w in ("alpha", "gamma") if (n := sum(w in v for v in docs.values()))}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = {i: sum(idf[w] * v.get(w, 0) for w in idf) / length(v) / length(idf) for i, v in docs.items()}
    out = lexical.cosine(chunks, q).collect()
    assert [(r.query_id, r.chunk_id, r["rank"]) for r in sorted(out, key=lambda r: r["rank"])] == [(1, 500, 1), (1, 1, 2)]
    assert all(abs(r.score - want[r.chunk_id]) < 1e-8 for r in out)


def test_second_list_is_not_a_range_of_ids(spark, sf):
    rows = QUERIES["a05_j3_w3_w4_rrf"](spark, sf).where("vector_rank is not null").collect()
    assert rows and any(not 0 <= r.chunk_id - r.query_id <= 11 for r in rows)
    gate = QUERIES["p04_anchor_gate"](spark, sf).collect()
    assert any(not 0 <= r.chunk_id - r.query_id <= 11 for r in gate)


def _rows(spark, sf, table):
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_sentences_of_all_blocks(spark, sf):
    def count(text):
        parts = [p.strip() for p in re.split(r"(?<=[。！？；!?])|(?<=[A-Za-z0-9][.!?])\s+", text) if p.strip()]
        return len(parts) if len(parts) > 1 and all(len(p) >= 12 for p in parts) else 1

    case = "The first sentence here.\nThe second one there.\n\n\n第三句话在这里，也有十二个字以上。\nThe last one.\n"
    assert spark.createDataFrame([(case,)], "c string").select(F.size(T.paragraph_sentences(F.col("c")))).first()[0] == count(case) == 4
    want = {r.block_id: count(r.text) for r in _rows(spark, sf, "blocks").where("text is not null").collect()}
    assert {r.block_id: r.n for r in QUERIES["f31_paragraph_sentences"](spark, sf).collect()} == want


def test_footers_of_all_answers(spark, sf):
    def body(text):
        return re.sub(r"\s*(?:^|\n)[ \t]*(?:#{1,6}[ \t]*)?(?:references|参考资料|参考文献)[ \t]*[:：]?[ \t]*(?:\n|\[).*", "", text, flags=re.I | re.S).rstrip()

    cases = ["Done.　\n### References\n[1] a.md", "完成 ", "a \n\n参考资料：[1] b", "x\x1f"]
    assert [r[0] for r in spark.createDataFrame([(c,) for c in cases], "c string").select(T.without_footer(F.col("c"))).collect()] == ["Done.", "完成", "a", "x"]
    want = {(r.result_id, _md5(body(r.answer))) for r in _rows(spark, sf, "eval_results").where("answer is not null").collect()}
    assert {(r.result_id, r.digest) for r in QUERIES["f26_without_footer"](spark, sf).collect()} == want


def test_fit_of_all_documents(spark, sf):
    def fit(text):
        used = 0.0
        for i, c in enumerate(text):
            used += 0.25 if c < "\x80" else 1.0
            if used > 100:
                return text[:i]
        return text

    texts = {r.doc_id: r.text for r in _rows(spark, sf, "documents").where("text is not null").collect()}
    assert any(len(fit(t)) < 400 < len(t) for t in texts.values())
    assert {r.doc_id: r.digest for r in QUERIES["w18_token_fit"](spark, sf).collect()} == {i: _md5(fit(t)) for i, t in texts.items()}


def _admit(units):
    """The admission of one question's units, one after another."""
    best = max(u.score for u in units)
    place = {(u.chunk_rank, u.section, u.unit_index): u for u in units}
    core = [u for u in units if u.score >= max(0.1, best * 0.5)]
    near = {(u.chunk_rank, u.section, u.unit_index + k) for u in core for k in (-1, 1)}
    taken = core + [u for k, u in place.items() if k in near and u not in core and u.score >= max(0.1, best * 0.35)]
    out, used = [], 0
    for u in sorted(taken, key=lambda u: (-u.score, u.chunk_rank, u.unit_index))[:12]:
        if not out or used + u.size <= 6000:
            out.append(u)
            used += u.size
    return out


def test_admission_of_scored_units(spark, sf):
    from sparkquarry.plans.retrieval_q import admission_units

    questions = {}
    for u in admission_units(spark, sf).collect():
        questions.setdefault(u.query_id, []).append(u)
    want = {(u.query_id, u.chunk_rank, u.unit_index) for us in questions.values() for u in _admit(us)}
    got = {(r.query_id, r.chunk_rank, r.unit_index) for r in QUERIES["w11_admission"](spark, sf).collect()}
    assert got == want and {q for q, _, _ in got} == set(questions)


def test_anchors_of_all_questions(spark, sf):
    rows = QUERIES["f08_relation_anchors"](spark, sf).collect()
    assert {r.query for r in rows} == {r[0] for r in _rows(spark, sf, "eval_results").where("question is not null").select("question").collect()}


def test_otsl_cells(spark):
    t = spark.createDataFrame([(1, ["ched", "lcel", "nl", "rhed", "fcel", "nl", "ucel", "ecel", "nl"]), (2, None), (3, ["ched", "lcel", "nl", "ucel", "xcel", "nl"])], "table_id bigint, tokens array<string>")
    assert sorted(tuple(r) for r in geometry.otsl_cells(t).collect()) == [(1, 0, 0, 1, 2, "ched"), (1, 1, 0, 2, 1, "rhed"), (1, 1, 1, 1, 1, "fcel"), (1, 2, 1, 1, 1, "ecel"), (3, 0, 0, 2, 2, "ched")]


def test_lines_of_the_best_chunks(spark, sf):
    scored = QUERIES["f15_line_scores"](spark, sf).collect()
    assert any(int(r.line_id.split("-")[0]) != r.query_id for r in scored) and any(not r.line_id.endswith("-0") for r in scored)
    assert any(r.chunk_id != r.query_id for r in QUERIES["t19_t21_compact_lines"](spark, sf).collect())


def test_phrases_and_substance_of_whole_texts(spark, sf):
    def phrases(text):
        return "|".join(re.sub(r"\s+", " ", x).lower() for x in re.findall(rf"\b{T.PHRASE}\b", text))

    def solid(text):
        return len(re.sub(r"(?m)^\s{0,3}#{1,6}\s.*$", "", re.sub(r"(?s)<!--.*?-->", "", text)).strip()) >= 24

    texts = {r.doc_id: r.text for r in _rows(spark, sf, "documents").where("length(text) > 0").collect()}
    assert {r.chunk_id: r.phrases for r in QUERIES["f06_named_phrases"](spark, sf).collect()} == {i: phrases(t) for i, t in texts.items()}
    blocks = {r.block_id: r.text for r in _rows(spark, sf, "blocks").where("text is not null").collect()}
    assert {r.block_id: r.ok for r in QUERIES["f14_substantive"](spark, sf).collect()} == {i: solid(t) for i, t in blocks.items()}
    assert spark.createDataFrame([("　" * 30 + "短",)], "c string").select(T.substantive(F.col("c"))).first()[0] is False


def test_questions_keep_their_script(spark, tmp_path):
    spark.createDataFrame([(0, "decode 性能"), (100, "有哪些 pump modes"), (200, "如何配置 USB_TEST")], "result_id bigint, question string").write.parquet(str(tmp_path / "eval_results.parquet"))
    long = " and then some more words about it"
    docs = [(7, "decode 性能" + long), (8, "pump modes" + long), (9, "the usb_test" + long)]
    rows = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows.selectExpr("doc_id", "text", "'a.md' source", "'d' full_doc_id", "0 chunk_order_index", "array('') content_headings", "timestamp'2026-01-01' updated_at").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.query_id: (r.chunk_id, r.why) for r in QUERIES["w06_p18_protected_evidence"](spark, str(tmp_path)).collect()}
    assert got == {0: (7, "lexical"), 100: (8, "fact"), 200: (9, "fact")}
    assert {r.query: r.identifiers for r in QUERIES["f12_direct_identifiers"](spark, str(tmp_path)).collect()} == {"decode 性能": "", "有哪些 pump modes": "", "如何配置 USB_TEST": "usb_test"}
    assert [(r.query_id, r.chunks) for r in QUERIES["f13_identifier_coverage"](spark, str(tmp_path)).collect()] == [(200, 1)]
