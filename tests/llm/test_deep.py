"""Markup nested deeper than Python recurses."""

import pytest

from sparkquarry.llm import markup


@pytest.mark.parametrize("tag", ["b", "div", "span", "li", "sub", "h2"])
def test_deep_markup_keeps_its_text(tag):
    out, found = markup.clean(f"start <{tag}>" * 3000 + "deep **bold** [[A|wiki]] end")
    assert "deep" in out and out.rstrip().endswith("end") and found == ["html", "markdown", "wiki"]
