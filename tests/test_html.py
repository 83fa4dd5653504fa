"""Awkward pages against texts written by hand."""

import pytest

from calibrant.functions import text as t

PAGES = [
    (None, ""),
    ("plain & simple", "plain & simple"),
    ("<p>caf&eacute; &#233; &#xE9; &#X2014; &hellip;</p>", "café é é — …"),
    ('<a title="1>2">link</a> <b data-x=\'a>b\'>bold</b>', "link bold"),
    ("&amp;eacute; &eacute; &amp;amp;", "&eacute; é &amp;"),
    ("&lt;b&gt; &quot;q&quot; &apos;s&apos; &#39;", "<b> \"q\" 's' '"),
    ("a&nbsp;b&#160;c", "a b c"),
    ("&unknown; &#0; &#1114112; &#xD800; &#128578;", "&unknown; � � � 🙂"),
    ("<p class=don't>Text it's</p> done", "Text it's done"),
    ('<p title="never closed>text</p> more', "text more"),
    ("<head><title>x</title></head><script>if (a<b) {}</script><style>p{}</style>body<!-- c > d -->end", "body end"),
    ("&copy; 2024 &middot; A &amp; B", "© 2024 · A & B"),
]


def test_pages(spark):
    rows = [(i, html) for i, (html, _) in enumerate(PAGES)] + [(99, "<p>x</p>" * 20_000 + "'" * 5000 + "<a =" + '="' * 3000)]
    got = {x["i"]: x["text"] for x in spark.createDataFrame(rows, "i int, html string").select("i", t.html_to_text(t.F.col("html")).alias("text")).collect()}
    for i, (html, want) in enumerate(PAGES):
        assert got[i] == want, html
    assert got[99].startswith("x x x ")


@pytest.mark.parametrize("tag", t.DROPPED)
def test_dropped_elements(spark, tag):
    row = spark.createDataFrame([(f"a<{tag} k='v'>gone</{tag} >b",)], "html string").select(t.html_to_text(t.F.col("html"))).first()
    assert row[0] == "a b"
