"""Inline elements whose class names furniture, inside headings and sentences."""

import pytest

from tidemark.llm.html_text import main_text


@pytest.mark.parametrize("inside, want", [
    ("<h1><span class='header'>Title here</span></h1><p>Some words follow.</p>", "Title here Some words follow."),
    ("<p>He used the <a class='nav-link'>linked words</a> here.</p>", "He used the linked words here."),
    ("<p>Words of a text.</p><p><a class='share'>Share this</a></p>", "Words of a text."),
])
def test_names_do_not_cut_headings_or_sentences(inside, want):
    assert main_text(f"<html><body><main>{inside}</main></body></html>") == want
