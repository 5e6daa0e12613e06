"""What the operators leave on disk while they run."""

from nearfield.llm import html
from nearfield.llm.common import shuffles


def test_the_exchange_leaves_no_shuffle_for_the_next(spark, monkeypatch):
    page = lambda k: f"<body><p>one two three four five six seven eight nine</p><p>page {k}</p></body>"
    pages = spark.createDataFrame([(k, "http://a.b/", page(k)) for k in range(40)], "page_id long, url string, html string")
    left, forget = [], html.forget

    def watched(*tables, gone=frozenset()):
        forget(*tables, gone=gone)
        left.append((len(gone), len(gone & shuffles(spark))))

    monkeypatch.setattr(html, "forget", watched)
    assert sorted(r.text for r in html.extract(pages).collect()) == sorted(f"page {k}" for k in range(40))
    assert left[0][0] >= 1 and left[0][1] == 0
