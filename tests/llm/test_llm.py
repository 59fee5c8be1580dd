"""The operators of the problems against brute force, round trips and small cases."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("sparkquarry.llm.registry")

from sparkquarry.llm import digest, langid, markup, pack, pairs, registry, scan_pages, scans, sentences, split, tokenize  # noqa: E402

TOKENIZER = tokenize.tokenizer_file()


# problem 1


def test_digest_bound_holds_when_compressed():
    rng = random.Random(7)
    values = [rng.lognormvariate(3, 2) for _ in range(60_000)]
    eps = 0.01
    k = int(np.ceil(digest.DEPTH / eps))
    parts = []
    for i in range(6):
        x = np.array(values[i::6])
        exponent = np.floor(np.log2(x)).astype(int)
        leaf = (exponent - digest.LOWEST) * (1 << digest.MANTISSA) + ((x / 2.0**exponent - 1) * (1 << digest.MANTISSA)).astype(int)
        n, c = np.unique(leaf + digest.LEAVES, return_counts=True)
        parts.append(digest.compress(n, c, k))
    n, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    n, c = digest.compress(n, np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64), k)
    assert c.sum() == len(values) and len(n) <= 3 * k
    level = np.frexp(n.astype(float))[1] - 1
    right = (n + 1 << digest.DEPTH - level) - 1 - digest.LEAVES
    order = np.lexsort((-level, right))
    upto = np.cumsum(c[order])
    ordered = np.sort(values)
    for q in (0.01, 0.25, 0.5, 0.9, 0.99, 0.999):
        at = right[order][np.searchsorted(upto, np.ceil(q * len(values)))]
        top = 2.0 ** (digest.LOWEST + (at >> digest.MANTISSA)) * (1 + ((at & (1 << digest.MANTISSA) - 1) + 1) / (1 << digest.MANTISSA))
        rank = np.searchsorted(ordered, top, "right")
        assert abs(rank - q * len(values)) <= eps * len(values) + 1


def test_digest_merges_days_and_ignores_bad_values(spark):
    rows = [("a", d, float(v)) for d in (1, 2) for v in range(1, 101)] + [("a", 1, None), ("a", 1, -3.0), ("a", 1, float("nan")), (None, 1, 5.0), ("z", 1, 0.0)]
    df = spark.createDataFrame(rows, "k string, day int, v double").withColumn("node", F.lit("clash"))
    days = digest.build(df, ["k", "day"], "v")
    out = {(r.k, r.quantile): r for r in digest.estimate(digest.merge(days, ["k"]), ["k"], [0.5, 0.99]).collect()}
    assert out["a", 0.5].n == 200 and abs(out["a", 0.5].value - 50) < 0.01
    assert out[None, 0.5].n == 1 and out["z", 0.5].value < 1e-5 and out["a", 0.99].max_rank_error == 0
    assert digest.estimate(digest.build(df.limit(0), ["k"], "v"), ["k"], [0.5]).count() == 0


def test_once_counts_each_id_once(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (None, 3.0), (None, 3.0)], "id int, v double")
    assert sorted(r.v for r in digest.once(df, "id", "v").collect()) == [2.0, 3.0, 3.0]


def test_leaf_keeps_order(spark):
    values = sorted([0.0, 1e-9, 0.1, 0.5, 1.0, 1.00001, 2.0, 3.999999, 4.0, 8.0, 1e6, 1e30] + [2.0**k for k in range(-19, 43)])
    leaves = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(digest.leaf_of(F.col("v"))).collect()]
    assert leaves == sorted(leaves) and min(leaves) >= 0 and max(leaves) < digest.LEAVES


# problem 2


def _scan(spark, pages, ocr=(), glyphs=()):
    p = spark.createDataFrame([(u, d, n, r, t) for u, d, n, r, t in pages], "page_uid bigint, document_id string, page int, parse_route string, native_text string")
    o = spark.createDataFrame(list(ocr), "ocr_id bigint, page_uid bigint, line_index int, text string")
    g = spark.createDataFrame(list(glyphs), "glyph_id bigint, page_uid bigint, glyph_index int, text string, space_before boolean, x0 float, y0 float, y1 float")
    return p, o, g


def test_scan_defects(spark):
    clean = "The service hatch opens. Check the service hatch of the fail-safe pump. The fail-safe pump and the maintenance window.\n" * 12
    body = ["Pump overview   {n}", "The servicc hatch opens near the fail-", "safe pump. Check the mainte-", "nance window of the serv�ce hatch.", "8080", "All lines of page {k} are here."]
    pages = [(0, "c", 1, "pdfium_layout", clean)] + [(i, "d", i, "vision_fusion", "\n".join(body).format(n=40 + i, k="abcd"[i])) for i in (1, 2, 3)] + [(9, None, None, "vision_fusion", None), (10, None, 1, "vision_fusion", "")]
    found = {(r.record_table, r.record_id, r.line_no, r.defect) for r in scans.scan_defects(*_scan(spark, pages)).collect()}
    for i in (1, 2, 3):
        assert {("parsed_pages", i, 0, "running_line"), ("parsed_pages", i, 1, "misread"), ("parsed_pages", i, 2, "hyphen_break"), ("parsed_pages", i, 3, "misread")} <= found
        assert not any(x[1:3] in ((i, 4), (i, 5)) or x[1:] == (i, 1, "hyphen_break") for x in found)


def test_scan_defects_of_empty_tables(spark):
    assert scans.scan_defects(*_scan(spark, [])).count() == 0


def test_scan_repair(spark):
    clean = "The service hatch of the maintenance window opens.\n" * 40
    pages = [(0, "c", 1, "pdfium_layout", clean)] + [(i, "d", i, "vision_fusion", f"{w} sees the servicc hatch of the mainte-\nnance window of {w} opened.\n- {60 + i} -") for i, w in ((1, "Alpha"), (2, "Gamma"))]
    out = [r.text for r in scans.repaired_paragraphs(*_scan(spark, pages)).collect()]
    assert sorted(out) == [f"{w} sees the service hatch of the maintenance window of {w} opened." for w in ("Alpha", "Gamma")]


def _paragraphs(spark, pages):
    clean = "The installation of the service hatch follows. Use the fail-safe pump of the maintenance window.\n" * 40
    rows = scans.repaired_paragraphs(*_scan(spark, [(0, "c", 1, "pdfium_layout", clean), *((i, "d", i, "vision_fusion", t) for i, t in pages)])).collect()
    return [(r.page, r.text) for r in sorted(rows, key=lambda r: (r.page, r.paragraph_no))]


def test_words_over_lines_and_pages(spark):
    filler = "The service hatch of the pump follows the installation of it"
    pages = [(1, f"{filler}\nand the maintenance window is near the instal-"), (2, f"lation of the service hatch, which is here. {filler}.\nOpen.")]
    assert _paragraphs(spark, pages) == [(1, f"{filler} and the maintenance window is near the installation of the service hatch, which is here. {filler}. Open.")]


def test_misread_divided_words(spark):
    filler = "The service hatch of the pump follows the installation of it"
    pages = [(1, f"{filler}\nand so the instal-\n1ation, then lnstal-\nlation of the fail-\nsafe pump. {filler} is done.")]
    assert _paragraphs(spark, pages) == [(1, f"{filler} and so the installation, then installation of the fail-safe pump. {filler} is done.")]


def test_mending_touches_no_other_word():
    line = "tlie tliex tlie."
    assert scans.mend([(0, line)], None, False, {}, {0: [(0, "tlie", "the", -1)]}, {}) == [(0, "the tliex tlie.")]
    assert scans.mend([(0, "TLIE 申源")], None, False, {}, {0: [(0, "tlie", "the", -1)]}, {0: [(5, "电")]}) == [(0, "THE 电源")]
    assert scans.mend([(0, "a hyphen-"), (1, "ated) word")], None, False, {0: 8}, {}, {}) == [(0, "a hyphenated)"), (1, "word")]


@pytest.mark.parametrize("known", [0, 1, 100_000])
def test_right_forms_that_no_task_knows(spark, monkeypatch, known):
    monkeypatch.setattr(scans, "KNOWN", known)
    clean = "Some data and some more of it.\n" * 12
    text = "Now read the data of it\nand read the clata again\nor not any rnore of it\nas the gpuкарта shows\n" + "near a gpuкарта here\n" * 5 + "under the gpu-\nкарта too"
    found = {(r.record_id, r.line_no, r.defect) for r in scans.scan_defects(*_scan(spark, [(0, None, 1, "pdfium_layout", clean), (1, None, 2, "vision_fusion", text)])).collect()}
    assert {x for x in found if x[2] == "misread"} == {(1, 1, "misread")}  # "the data" is elsewhere, "any more" is not; what is frequent is right in two scripts


def test_headers_of_two_lines_and_near_keys(spark):
    body = ["{a} wide words stand in the middle of this page, enough of them", "to fill a line that is as wide as any other of the {a} page"]
    pages = [(i, "d", i, "vision_fusion", "\n".join(["Controller handbook", h, *(b.format(a=a) for b in body), "Closing words of the " + a])) for i, a, h in ((1, "first", "Release 7 notes"), (2, "other", "Release 8 notes"), (3, "third", "Release 9 notes"))]
    pages.append((4, "d", 4, "vision_fusion", "Controiler hanbook\n" + "\n".join(b.format(a="last") for b in body) + "\nNothing else is down here"))
    found = {(r.record_id, r.line_no) for r in scans.scan_defects(*_scan(spark, pages)).where("defect = 'running_line'").collect()}
    assert found == {(i, n) for i in (1, 2, 3) for n in (0, 1)} | {(4, 0)}


def test_misread_digits_in_running_lines():
    key = scan_pages.running_key
    assert key("Calibrati0n table overview") == key("Calibration table overview   157") and key("N0tes on it") == key("Notes on it") and key("Unit KX90 of 12") == key("Unit KX91 of 7")


def test_repeated_and_unnamed_pages(spark):
    rows = [(1, "d", 1, "vision_fusion", "Pump overview\nText one is here."), (1, "d", 1, "vision_fusion", "Pump overview\nText one is here."), (None, "d", 2, "vision_fusion", "Pump overview\nText two is there."), (None, None, None, "vision_fusion", None)]
    found = sorted((str(r.record_id), r.line_no, r.defect) for r in scans.scan_defects(*_scan(spark, rows, [(None, None, None, None), (5, 99, 0, "x")], [(None, None, None, None, None, None, None, None)])).collect())
    assert found == [("1", 0, "running_line"), ("None", 0, "running_line")]


def test_page_numbers():
    assert scan_pages.page_number("第 118 页 / 122") == (118, True) and scan_pages.page_number("- 89 -") == (89, True) and scan_pages.page_number("cxxii") == (122, False) and scan_pages.page_number("Page 172 / 177") == (172, True)
    assert scan_pages.page_number("l02")[0] == 102 and scan_pages.page_number("relay")[0] is None and scan_pages.page_number("")[0] is None


def test_skeletons():
    for wrong, right in (("rclais", "relais"), ("reaclies", "reaches"), ("coiirant", "courant"), ("enablecl", "enabled"), ("alarrn", "alarm"), ("wind0w", "window"), ("davori", "davon")):
        assert scans.skeleton(wrong) == scans.skeleton(right)


# problem 3


@pytest.mark.parametrize(
    ("text", "kinds", "part"),
    [
        ("<p>A <b>b</b></p><ul><li>x<li>y</ul>", ["html"], "- x\n- y"),
        ("<table><tr><th>a<th>b</tr><tr><td>1</td><td>2</td></tr></table>", ["html"], "a | b\n1 | 2"),
        ("# Head\n\n- one\n- two", ["markdown"], "# Head"),
        ("see **bold\ntext** here", ["markdown"], "bold\ntext"),
        ("== Head ==\n[[A|b]] '''c'''", ["wiki"], "## Head\nb c"),
        (r"\section{Head} and \textbf{b} $x^2$", ["latex"], "# Head"),
        ("```html\n<b>x</b>\n```\nplain", ["markdown"], "<b>x</b>"),
        ("(a < b && c > d), R&D, 2 * 3 * 4, x_1, US$5 / US$7", [], "US$5"),
        ("relayctl set <name> --lane <lane> C:\\new\\table", [], "<lane>"),
        ("{{TBL:tb1}}", [], "{{TBL:tb1}}"),
        ("a &amp; b", ["html"], "a & b"),
        ("", [], ""),
    ],
)
def test_markup(text, kinds, part):
    out, found = markup.clean(text)
    assert found == kinds and part in out


def test_markup_spares_own_headings(spark):
    assert markup.clean("## Pump", "Pump", 2)[1] == [] and markup.clean("## Other", "Pump", 2)[1] == ["markdown"]
    rows = [("t", 1, None, None, None), ("t", 2, "", None, None), ("t", 2, "**x**", None, None), ("t", None, "plain words", None, None)]
    out = markup.clean_markup(spark.createDataFrame(rows, "record_table string, record_id bigint, text string, heading string, heading_level int").withColumn("markup", F.lit(1))).collect()
    assert sorted((str(r.record_id), r.text) for r in out) == [("1", None), ("2", ""), ("2", "x"), ("None", "plain words")]


def test_link_boilerplate_is_dropped():
    links = "".join(f'<li><a href="#{i}">menu {i}</a></li>' for i in range(8))
    page = f"<div><ul>{links}</ul></div><div><p>{'Long text about the pump and its valve. ' * 8}</p><p>{'More of it follows here. ' * 6}</p></div>"
    out = markup.clean(page)[0]
    assert "menu 3" not in out and "Long text" in out and "More of it" in out


# problem 4


@pytest.fixture(scope="module")
def model(spark, sf):
    return registry._languages(spark, sf)[2]


@pytest.mark.parametrize(
    ("question", "answer", "defect"),
    [
        ("How is the pump set?", None, "empty_answer"),
        ("How is the pump set?", " \u00a0", "empty_answer"),
        ("How is the pump set?", "N/A", "empty_answer"),
        ("How is the pump set?", "Hello! I'm sorry, but I can't help with that request.", "refusal"),
        ("How is the pump set?", "I could not find a separate entry, but the manual says that the pump is on.", None),
        ("How is the pump set?", "HOW IS THE PUMP SET", "copied_question"),
        ("How is the pump set?", "How is the pump set? Open the valve and wait for two seconds.", None),
        ("How is the pump set?", "Open the valve and wait for two sec", "truncated"),
        ("How is the pump set?", "Run this:\n\n```sh\nmount -o ro /dev", "truncated"),
        ("How is the pump set?", "Open the cover.\n1. Pump setup\n2. Valve setup\n\n### References\n\n- [1] a.md", None),
        ("How is the pump set?", "link_rate=4800", None),
        ("How is the pump set?", "请确认上层消息队列能够缓存固件镜像。", "other_language"),
        ("How is the pump set?", "Stellen Sie die Grenze der Pumpe auf 40 V und warten Sie, bis die Statusanzeige nach der Prüfung blinkt.", "other_language"),
        (None, "Open the valve and wait for two seconds.", None),
    ],
)
def test_pair_defects(model, question, answer, defect):
    assert pairs.defects(model, [question], [answer]) == [defect]


def test_pairs_count_once(spark, model):
    df = spark.createDataFrame([(1, "q?", None), (1, "q?", None), (None, None, ""), (2, "q?", "The pump works well.")], "result_id bigint, question string, answer string").withColumn("defect", F.lit("clash"))
    assert sorted(map(str, (r.result_id for r in pairs.flag_pairs(df, model).collect()))) == ["1", "None"]


# problem 5


def test_pieces_join_to_the_text():
    rng = random.Random(3)
    for _ in range(200):
        words = ["".join(rng.choice("abc éü电池") for _ in range(rng.randint(1, 90))) for _ in range(rng.randint(1, 60))]
        text = "".join(w + rng.choice([" ", ". ", "\n", "\n\n", ", ", "。", ""]) for w in words)
        limit = rng.randint(20, 200)
        overlap = rng.randint(0, limit // 2)
        pieces = split.cut(text, limit, overlap)
        assert all(b - a <= limit for a, b, _ in pieces)
        joined, end = "", 0
        for i, (a, b, _) in enumerate(pieces):
            assert a == (0 if i == 0 else end - overlap) and b > end
            joined += text[end:b]
            end = b
        assert joined == text


def test_cuts_fall_at_strong_boundaries():
    text = "word " * 30 + "\n\n" + "word " * 30
    (a, b, s), *_ = split.cut(text, 200, 0)
    assert text[:b].endswith("\n\n") and split.BOUNDARIES[s] == "paragraph"


def test_split_items_edges(spark):
    rows = [("t", 1, None, 10, 2), ("t", 2, "", 10, 2), ("t", 3, "x" * 25, 10, 2), ("t", 3, "short", 10, 2), ("t", None, "short", 10, 2), ("t", 4, "short", None, None)]
    out = split.split_items(spark.createDataFrame(rows, "record_table string, record_id bigint, text string, max_chars int, overlap_chars int").withColumn("piece_no", F.lit(0)))
    assert split.split_items(spark.createDataFrame([("t", None, "x" * 25, 10, 2), ("t", 1, "x" * 25, 10, 2)], "record_table string, record_id bigint, text string, max_chars int, overlap_chars int")).where("record_id is null").count() == 3
    assert out.where("record_id = 3").count() == 1 + 3 and out.where("record_id is null or record_id = 2").count() == 2 and out.where("record_id in (1, 4)").count() == 0


# problem 6


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("One. Two! Three?", ["One.", "Two!", "Three?"]),
        ("See Fig. 3 and e.g. the pump. It ends at 5 p.m. The rest follows.", ["See Fig. 3 and e.g. the pump.", "It ends at 5 p.m.", "The rest follows."]),
        ('He said "Save it." Then it ran.', ['He said "Save it."', "Then it ran."]),
        ('The screen shows "Link down!" and the pump stops.', ['The screen shows "Link down!" and the pump stops.']),
        ("(It stays off.) Check it.", ["(It stays off.)", "Check it."]),
        ("请确认网络桥。屏幕显示“连接中断！”时，灯会闪烁。", ["请确认网络桥。", "屏幕显示“连接中断！”时，灯会闪烁。"]),
        ("Verwenden Sie z. B. die Karte. Am 3. Mai war es so.", ["Verwenden Sie z. B. die Karte.", "Am 3. Mai war es so."]),
        ("ห้ามถอดสายออก ตั้งค่าเป็น 4.8 โวลต์แล้วรอ 478 วินาที", ["ห้ามถอดสายออก", "ตั้งค่าเป็น 4.8 โวลต์แล้วรอ 478 วินาที"]),
        ("Head line\n\nThe text is\nwrapped here. eth0 must stay up.\n\n1) One\n2) Two", ["Head line", "The text is\nwrapped here.", "eth0 must stay up.", "1) One", "2) Two"]),
        (" \n", []),
        (None, []),
    ],
)
def test_sentences(text, wanted):
    out, begin = [], 0
    for e in sentences.sentence_ends(text):
        out.append(text[begin:e].strip())
        begin = e
    assert out == wanted


def test_sentence_rows(spark):
    df = spark.createDataFrame([("t", None, "One. Two."), ("t", 1, "One."), ("t", 1, None), ("t", 2, " ")], "record_table string, record_id bigint, text string").withColumn("end_offset", F.lit("clash"))
    assert sorted((str(r.record_id), r.end_offset) for r in sentences.split_sentences(df).collect()) == [("1", 4), ("None", 4), ("None", 9)]


def test_sentences_leave_nothing_out(spark, sf):
    out = registry.p6_sentences(spark, sf).groupBy("record_table", "record_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sentence_no", "sentence"))), lambda x: x["sentence"]), "").alias("whole"))
    blocks = spark.read.parquet(f"{sf}/blocks.parquet").select(F.lit("blocks").alias("record_table"), F.col("block_id").alias("record_id"), "text").where(F.col("text").rlike(r"(?U)\S"))
    assert blocks.join(out, ["record_table", "record_id"], "left").where(F.col("whole").isNull() | ~F.expr("startswith(text, whole)") | (F.expr("rtrim(text)") != F.expr("rtrim(whole)")) & F.expr("substring(text, length(whole) + 1)").rlike(r"(?U)\S")).count() == 0


# problem 7


def test_ids_equal_the_tokenizer(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    texts = ["", " ", "a  b\n\n c", "<|endoftext|>", "été 电池🔧 \t x", "'s don't I'LL 12345", "aaaaaaaaaaaaaaaa", "x" * 5000, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    docs = docs.select("doc_id", "text", "ids").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit("x").alias("ids")))
    got = {r.doc_id: r.ids for r in tokenize.encode_corpus(docs).collect()}
    want = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()}
    assert got == want
    assert {r.doc_id: r.n_tokens for r in tokenize.token_counts(docs).collect()} == {k: len(v) for k, v in want.items()}
    assert tokenize.encode_corpus(docs.limit(0)).count() == 0


# problem 8


def test_packing(spark):
    rng = random.Random(1)
    sizes = [(i, rng.randint(0, 900)) for i in range(2000)] + [(5, 10), (None, 7), (None, 7), (2001, None), (2002, 2048)]
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens int")
    specs = spark.createDataFrame([(1, 512), (2, 4096), (3, 0)], "spec_id int, capacity_tokens int")
    out = pack.pack_items(df, specs, items_per_packer=100).cache()
    bins = out.groupBy("spec_id", "capacity", "bin_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n"))
    assert bins.where("used > capacity").count() == 0
    for spec, capacity in ((1, 512), (2, 4096)):
        mine = out.where(F.col("spec_id") == spec)
        assert mine.agg(F.sum("n_tokens")).first()[0] == sum(s or 0 for _, s in sizes)
        assert mine.count() == sum(max(1, -(-(s or 0) // capacity)) for _, s in sizes)
        assert pack.packing_report(mine).first().used > 0.93
    assert pack.pack_items(df.limit(0), specs).count() == 0


def test_best_fit_closes_the_fullest():
    fit = pack.BestFit(10, 2)
    assert fit.put(6, "a") == [] and fit.put(7, "b") == [] and fit.put(5, "c") == [["b"]] and fit.put(4, "d") == [["a", "d"]]


# problem 9


def test_languages(model):
    text = "The pump must be connected before the valve is opened.\n$ mount -o ro /dev/vol1\n\nDie Pumpe muss angeschlossen sein, bevor das Ventil geöffnet wird und die Prüfung beginnt.\nStellen Sie die Grenze ein und warten Sie."
    (first, last, lang, p), (_, _, lang2, _) = langid.segments(model, [text])[0]
    assert (model.langs[lang], model.langs[lang2]) == ("en", "de") and (first, last) == (0, 3) and 0.5 < p <= 1
    assert len(langid.segments(model, [None, "", "\n\n", "123 == 5"])) == 4


def test_language_edges(spark, model):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "请确认上层消息队列能够缓存固件镜像。")], "doc_id bigint, text string").withColumn("lang", F.lit("x"))
    out = langid.assign(docs, model).collect()
    assert len(out) == 3 and {r.lang for r in out if r.doc_id is None} == {"zh"} and all(r.confidence < 0.9 for r in out if r.doc_id == 1)


def test_labels(spark):
    codes = {"en": "en", "eng": "en", "zh": "zh", "zho": "zh"}
    rows = [("EN", "en"), (" en ", "en"), ("en-GB", "en"), ("zh_Hans", "zh"), ("zho", "zh"), ("und", None), ("", None), (None, None)]
    df = spark.createDataFrame(rows, "lang string, want string").withColumn("got", langid.label_of(F.col("lang"), codes))
    assert all(r.want == r.got for r in df.collect())


def test_held_out_accuracy(spark, sf, model):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    codes = langid.read_codes(spark.read.parquet(f"{sf}/language_codes.parquet"))
    big = langid.fit(docs.where("doc_id % 2 = 0"), codes)
    out = langid.assign(docs.where("doc_id % 2 = 1 and length(text) > 60").withColumn("_l", langid.label_of(F.col("lang"), codes)), big, keep=["_l"]).where("n_segments = 1 and _l is not null").collect()
    assert statistics.mean(r._l == r.lang for r in out) > 0.9  # some labels are wrong
