"""Cases beyond what patterns used to be bound to."""

import pytest

from sparkquarry.llm import markup, pairs, split


@pytest.mark.parametrize(
    ("text", "kinds", "wanted"),
    [
        ("$" + "x + " * 200 + "y$ is long", ["latex"], "$" + "x + " * 200 + "y$ is long"),
        ("see *" + "word " * 200 + "end* here", ["markdown"], "see " + "word " * 200 + "end here"),
        ("see _" + "word " * 200 + "end_ here", ["markdown"], "see " + "word " * 200 + "end here"),
        ("[" + "word " * 200 + "](a.md)", ["markdown"], "word " * 200),
        ("[[A|" + "word " * 200 + "]]", ["wiki"], "word " * 200),
        ("[http://a.b " + "word " * 200 + "x]", ["wiki"], "word " * 200 + "x"),
        ("{{a|" * 50 + "deep" + "}}" * 50, ["wiki"], "deep"),
        (r"\textbf{" * 50 + "deep" + "}" * 50, ["latex"], "deep"),
        ("{{a|{b}}} {{x", [], "{{a|{b}}} {{x"),
        ("\\section{Head}\n% checked\nIt is 5 % of it.", ["latex"], "# Head\n\nIt is 5 % of it."),
        ("% of all\nIt is plain.", [], "% of all\nIt is plain."),
    ],
)
def test_markup_of_any_length_and_depth(text, kinds, wanted):
    assert markup.clean(text) == (wanted, kinds)


def test_numbers_of_a_long_list():
    out = markup.clean("<ol>" + "<li>item" * 30_000 + "</ol>")[0]
    assert out.endswith("\n30000. item")


def test_boxes_beside_the_content_go():
    text = "".join(f"<p>{'Long text about the pump and its valve. ' * 8}</p>" for _ in range(4))
    page = f"<html><body><header>Site of the maker</header><div class=side><p>News: the fair opens</p></div><div id=main><h1>Pump</h1>{text}<ul><li>one<li>two</ul></div><div class=more><h2>Annex</h2><ul><li>a<li>b</ul></div><footer>© 2026 Maker, all rights reserved</footer></body></html>"
    out = markup.clean(page)[0]
    assert not any(x in out for x in ("fair", "Site", "rights")) and all(x in out for x in ("# Pump", "Long text", "- one\n- two", "## Annex", "- a\n- b"))


def test_nothing_goes_of_fragments():
    out = markup.clean("<p>Short.</p><ul><li>" + "Long item of the list. " * 20 + "</ul><div>Note</div><table><tr><td>1<td>2</table>")[0]
    assert all(x in out for x in ("Short.", "Long item", "1 | 2"))


@pytest.mark.parametrize(
    "answer",
    [
        "I cannot answer this. " * 60, "I cannot answer the question " + "about this and that " * 40 + "here.", "No relevant information was found.", "Leider kann ich diese Frage nicht beantworten.", "Je ne sais pas.", "Désolé, je ne peux pas répondre.",
        "No puedo responder a esta pregunta.", "Nenhuma informação relevante foi encontrada.", "Non posso rispondere a questa domanda.", "К сожалению, я не могу ответить на этот вопрос.", "Немає відповіді на це.", "抱歉，我无法回答这个问题。", "该请求超出了我的服务范围。",
        "申し訳ありませんが、その質問にはお答えできません。", "죄송하지만 이 질문에는 답변할 수 없습니다.", "ขออภัย ฉันไม่สามารถตอบคำถามนี้ได้", "ไม่พบข้อมูลที่เกี่ยวข้อง", "क्षमा करें, मैं इस प्रश्न का उत्तर नहीं दे सकता।", "मुझे नहीं पता।", "عذرا، لا أستطيع الإجابة على هذا السؤال.", "لا توجد معلومات حول هذا.",
    ],
)
def test_refusals(answer):
    assert pairs.is_refusal(answer)


@pytest.mark.parametrize(
    "answer",
    [
        "Do not remove the answer cache while the pump runs.", "If the log contains no information about it, open the valve.", "I could not find an entry, but the pump is on.", "The valve is open.", "Wenn keine Antwort kommt, starten Sie die Pumpe neu.", "如果没有找到信息，请重启设备。", "ถ้าไม่พบข้อมูล ให้เปิดวาล์ว", "यदि जानकारी नहीं मिलती है, तो वाल्व खोलें।", "إذا لم تجد معلومات، افتح الصمام.", "Der Deckel kann nicht geöffnet werden.", "",
    ],
)
def test_no_refusals(answer):
    assert not pairs.is_refusal(answer)


def test_copies_however_often():
    q = "How is the pump set up here?"
    assert all(pairs.is_copy(q, " ".join([q] * n)) for n in (1, 2, 5, 40)) and pairs.is_copy(q, " ".join([q] * 7 + ["How is the pump"]))
    assert not pairs.is_copy(q, " ".join([q] * 3) + " Open the valve and wait for two seconds until it is set up.") and not pairs.is_copy(q, "the pump " * 9)
    assert pairs.is_copy("the " * 5000, "the " * 5000)


def test_overlaps_that_do_not_fit():
    for overlap, taken in ((10, 5), (99, 5), (-3, 0)):
        pieces = split.cut("x" * 45, 10, overlap)
        assert all(b - a <= 10 for a, b, _ in pieces) and all(c == b - taken for (_, b, _), (c, _, _) in zip(pieces, pieces[1:])) and pieces[-1][1] == 45


@pytest.mark.parametrize(("answer", "cut"), [("Do this.\n1. Pump setup\n2. Valve\n3.", True), ("Do this:\n- one\n-", True), ("3.", False), ("Do this.\n1. Pump setup\n2. Valve", False), ("Steps\n\n## Pump\n\n##", True)])
def test_items_that_only_begin(answer, cut):
    assert pairs.is_truncated(answer) == cut
