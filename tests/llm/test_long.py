"""Sentences of long texts, quotations and brackets."""

import pytest

from sparkquarry.llm import sentences


def test_language_of_the_whole_text():
    text = "x = y z 12 the of and\n\n" * 1000 + "Der Wert ist mit dem Regler nicht zu verstellen, und die Anzeige ist von der Pumpe. " * 400
    assert len("x = y z 12 the of and\n\n" * 1000) > 20_000 and sentences.language_of(text) == "de"
    tail = "Siehe Abb. 3 und bl. 5 im Anhang."
    assert [e for e in sentences.sentence_ends(text + "\n\n" + tail) if e > len(text) + 2] == [len(text) + 2 + len(tail)]


@pytest.mark.parametrize(("a", "b"), ["()", "“”", "«»", "「」", "[]", '""', ("(a (b) ", ")")])
def test_long_quotations_and_brackets_are_one(a, b):
    text = "He said " + a + "One is here. Two is there. " * 60 + "Done" + b + " and went on."
    assert sentences.sentence_ends(text) == [len(text)]


def test_unpaired_brackets_hold_nothing():
    assert sentences.sentence_ends("It is (open. Then more. End) x) here. Last.") == [37, 43]
    assert sentences.sentence_ends("It is (open. Then more. Last.") == [12, 23, 29]


def test_paragraphs_of_several_languages():
    german = "Der Wert ist mit dem Regler von Teil bl. 5 nicht zu verstellen, und die Anzeige ist aus."
    english = "The value is in the table of the manual for this unit, no. 5 of the list. It is set."
    text = "\n\n".join([english, german, english, english])
    ends = sentences.sentence_ends(text)
    assert [text[a:b].strip() for a, b in zip([0, *ends], ends)] == [english[:-11], "It is set.", german, english[:-11], "It is set.", english[:-11], "It is set."]
