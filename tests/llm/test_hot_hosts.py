"""URLs: one host with a third of all rows."""

from calibrant.llm import op6_urls as op6
from calibrant.llm import repeats
from calibrant.llm.common import Scratch


def test_hot_host(spark, monkeypatch):
    """The joins that spare heavy keys the exchange give the rows of the plain ones."""
    rows = [(i, f"http://{'hot.example.com' if i % 3 == 0 else f'h{i}-news.example.org'}/{'en' if i % 2 else 'es'}/{i % 40 if i % 3 else 7}", "<title>news</title>") for i in range(400)] + [(None, None, None)] * 5
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    plain = sorted(map(repr, op6.filter_urls(pages, Scratch(spark)).collect()))
    monkeypatch.setattr(repeats, "LEAST", 3)
    assert sorted(map(repr, op6.filter_urls(pages, Scratch(spark)).collect())) == plain and len(plain) == len(rows)
