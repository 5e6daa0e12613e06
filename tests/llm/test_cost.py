"""How much work the operators do for a row."""

import random
import sys

import pyarrow as pa
import pytest

from nearfield.llm import decontam, html


class Whole:
    """A table in one part, whose functions are handed back to be run here."""

    def __getattr__(self, name):
        return (lambda run, schema: run) if name == "mapInArrow" else (lambda *_, **__: self)


def test_heads_of_pages_are_mixed_for_a_chunk_at_once(spark, monkeypatch):
    """A page is short: steps of numpy for each page cost several times what its parsing does."""
    shared, mixed, calls = "a line that every one of these pages has in common", html._mixed, []
    rows = [(k, "http://a.b/", f"<body><p>{shared}</p><p>page {k} of all</p>") for k in range(500)]
    pages = pa.RecordBatch.from_pydict(dict(zip(("page_id", "url", "html"), map(list, zip(*rows, strict=True)), strict=True)))
    monkeypatch.setattr(html, "_mixed", lambda x: calls.append(len(x)) or mixed(x))
    monkeypatch.setattr(html.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    (chunk,) = html.parse(Whole())(iter([pages]))
    (sent,) = html.heads(Whole(), html.REPEAT, 1, html.mask_for(1 << 20))(iter([chunk]))
    back = chunk.select(["chunk", "kind", "n", "body"]).to_pylist() + sent.select(["chunk", "kind", "n", "body"]).to_pylist()
    (texts,) = html.without_repeats(Whole(), Whole(), html.REPEAT, html.mask_for(1 << 20))(iter([pa.RecordBatch.from_pylist(back)]))
    assert texts.column("text").to_pylist() == [f"page {k} of all" for k in range(500)]
    assert 0 < len(calls) < 100


def test_tokens_of_any_size_are_told_apart(spark):
    """Passages that differ in the last byte of one token only, beside empty pages and pages that are repeated whole."""
    rows, want = [], {}
    for n, size in enumerate((1, 7, 8, 9, 16, 63, 64, 65, 300)):
        for k, last in enumerate("xyzz"):
            text = " ".join(["é" * n + "ü", "b" * (size - 1) + last, *(f"w{size}_{j}" for j in range(6))])
            rows.append((10 * n + k, f"http://h{size}.org/", f"<body><p>{text}</p>"))
            want[10 * n + k] = text if last != "z" else ""
        rows += [(10 * n + 8, f"http://h{size}.org/", None), (10 * n + 9, f"http://h{size}.org/", "<body><p>short</p><br><p>one")]
        want |= {10 * n + 8: "", 10 * n + 9: "short\none"}
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    assert {r.page_id: r.text for r in html.extract(df).collect()} == want


def searched(docs, items, width=10, calls=None):
    """The index of docs and its hits, both made here, and the calls that this took."""
    texts = pa.array([(x or "").encode() for _, x in docs], pa.binary())
    batch = pa.RecordBatch.from_pydict({"doc_id": [k for k, _ in docs], "text": texts})
    shared = type("Shared", (), {"value": decontam.Block([(k, (x or "").encode()) for k, x in items], width)})
    build, search = decontam.build_index(Whole()), decontam._search_block(Whole(), shared, 0)
    if calls is not None:
        sys.setprofile(lambda frame, event, what: calls.append(event) if event in ("call", "c_call") else None)
    try:
        index = list(build(iter([batch])))
        hits = list(search(iter(index)))
    finally:
        sys.setprofile(None)
    return index, [r for x in hits for r in x.to_pylist()]


@pytest.fixture
def on_task(monkeypatch):
    monkeypatch.setattr(decontam.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())


def test_words_and_phrases_of_a_segment_are_handled_at_once(spark, on_task):
    """A call for each word, term or phrase costs several times what arrays of them do."""
    docs = [(k, " ".join(f"w{k}x{j}" for j in range(300))) for k in range(100)]
    items = [(f"i{k}", " ".join(text.split()[::-1])) for k, text in docs] + [("found", docs[7][1][:100])]
    searched(docs[:2], items[:2])  # imports
    calls = []
    _, hits = searched(docs, items, calls=calls)
    assert [r["doc_id"] for r in hits if r["n_words"] == 300 and r["items"] == ["found"] * bool(r["spans"])] == [k for k, _ in docs]
    assert [r["doc_id"] for r in hits if r["spans"]] == [7]
    # the documents hold 30,000 terms and the words of 29,100 windows
    assert len(calls) < 5_000


@pytest.mark.parametrize(("words", "size", "step"), [(1 << 15, 4 << 20, 1 << 18), (60, 4 << 20, 1 << 18), (200, 90, 1), (1, 1, 7)])
def test_segments_of_any_size_give_the_hits_of_brute_force(spark, on_task, monkeypatch, words, size, step):
    """Few and very frequent words, windows of one word repeated, texts without words, ids that are out of order."""
    for name, value in (("SEGMENT_WORDS", words), ("SEGMENT_BYTES", size), ("STEP_POSITIONS", step), ("CHUNK_BYTES", 5 * size)):
        monkeypatch.setattr(decontam, name, value)
    draw = random.Random(words)
    text = lambda most: " -".join(draw.choices(["a", "B", "é", "dd", "Ü9"], [20, 5, 3, 1, 1], k=draw.randrange(most)))
    docs = [((k * 7) % 101, None if k == 3 else "., " if k == 5 else text(120)) for k in range(60)]
    items = [(f"i{k % 25}", text(9)) for k in range(30)] + [("a", "a " * 6), ("one", "dd"), ("none", None)]
    index, hits = searched(docs, items, 4)
    want = decontam.brute_force(docs, items, 4)
    assert [r["doc_id"] for r in hits] == [k for k, _ in docs] and (len(index) > 1) == (words < 1 << 15)
    for r in hits:
        spans = [(s["start"], s["end"]) for s in r["spans"]]
        assert (r["n_words"], sum(b - a for a, b in spans), len(r["items"])) == want[r["doc_id"]][:3]
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


def test_positions_beyond_sixteen_bits(spark, on_task):
    long = " ".join(f"w{k % 70_001}" for k in range(140_000))
    docs = [(1, "x"), (2, long), (3, None), (4, "w0 w1 w2")]
    _, hits = searched(docs, [("p", "w69999 w70000 w0 w1"), ("q", "w5 w4")], 4)
    assert [(r["doc_id"], [tuple(s.values()) for s in r["spans"]], r["items"]) for r in hits] == [
        (1, [], []), (2, [(69_999, 70_003)], ["p"]), (3, [], []), (4, [], []),
    ]
