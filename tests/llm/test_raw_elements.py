"""Elements that only look raw, or close themselves, don't swallow the page; formulas keep their text."""

from __future__ import annotations

import pytest

from folioscope.llm import html_text


@pytest.mark.parametrize(
    ("source", "texts"),
    [
        ("<p>a<svg-icon></svg-icon> b</p><p>c</p>", ["a b", "c"]),
        ("<title-bar>x</title-bar><p>c", ["x", "c"]),
        ("<p>a <math-field>q</math-field> b</p><object-view>k</object-view><p>z", ["a q b", "k", "z"]),
        ('<p>a<svg viewBox="0 > 1"/> b</p><p>c<svg\n/>d</p>', ["a b", "cd"]),
        ("<p>a<svg/> b<svg width=1/></p><p>c", ["a b", "c"]),
        ("<p>a <math/> b <math><mi>x</mi><mo>=</mo></math> c</p>", ["a b x= c"]),
        ('<p>a<svg class="k"><title>T</title><path d="x"/></svg> b<script src="x"/>no</script></p>', ["a b"]),
    ],
)
def test_raw_names_end(source, texts):
    assert html_text.parse(source).texts == texts
