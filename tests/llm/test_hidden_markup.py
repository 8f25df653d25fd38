"""Markup inside lines."""

import re

import pytest

from doclens.llm import line_dedup


@pytest.mark.parametrize("text", ["<b>a</b> <script>\n<i>x</i></SCRIPT>b<!-- c --><BR>d <styles> <a href=x>e</a>", "< b > </ a> <b", "<style>x</style ><em\n>f</em>", ""])
def test_hidden_markup_is_the_same(text):
    assert re.sub(line_dedup._HIDDEN_AHEAD, "", text) == re.sub(line_dedup._HIDDEN, "", text)
