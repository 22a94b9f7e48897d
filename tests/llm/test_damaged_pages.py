"""Pages with broken markup: never an error, and the article is still there."""

import random

import pytest

from tidemark.llm import main_text

TEXT = "A sentence of the article that is long enough to count as content on any page, with some more words in it."


@pytest.mark.parametrize("odd", ["<![ foo ]>", "<![>", "<![", "5 <![0-9] pattern", "<![foo[bar]]>", "<![CDATA[x]]>", "<!", "<!>", "<?", "</", "</ >", "<!-", "&#", "<!DOCTYPE [<!ENTITY"])
def test_bogus_declarations(odd):
    text, _ = main_text.extract(f"<html><body><article><p>{TEXT}</p><p>{TEXT}</p></article><p>{odd}</p></body></html>")
    assert TEXT in text
    main_text.extract(odd)


@pytest.mark.parametrize("page", ["<head><title>T</title><article><p>{0}</p></article>", "<title>T</title><meta charset=x><main><p>{0}</p></main>", "<html><head><link rel=x><p>{0}<p>{0}", "<head><script>var a</script><noscript><img src=x></noscript><div><p>{0}</p></div>"])
def test_a_page_without_its_body_tag(page):
    text, _ = main_text.extract(page.format(TEXT))
    assert TEXT in text and "var a" not in text and text.split("\n")[0] != "T"


def test_damaged_pages_never_raise():
    rng = random.Random(11)
    parts = ["<", ">", "<!", "<![", "]]>", "<!--", "-->", "<p>", "</p>", "<a href='", "'", '"', "=", "&", "&#x", ";", "<script>", "</script>", "<title>", "</head>", "<article>", "<td", "text ", "é", "\x00", "/", "?", "[", "]"]
    for _ in range(10_000):
        text, _ = main_text.extract("".join(rng.choices(parts, k=rng.randrange(40))))
        assert isinstance(text, str)
