"""HTML extraction: blocks, landmarks, and the suffix array of a host.

A page is cut into blocks at block-level tags. Comments, scripts, styles and the like are dropped whole. A block
inside navigation, footers, asides, forms or an element whose class, id or role names such a part is chrome; a block
inside `article` or `main` is content, also where chrome from outside holds them; any other is open. A page with nothing
but chrome has it as open blocks. A page's text is its open and content blocks without what
its host repeats.

For that the token streams of a host's pages are one text with a suffix array, whose order matters only as far as it
tells whether two suffixes share `REPEAT` tokens: neighbours that do, on distinct pages, are the heads of repeated
passages, and consecutive heads make up the longest ones, whatever their length. So suffixes are sorted by their
leading tokens, a hash of which, with the host, stands for them; shards of the sorted array are buckets of an exchange
(`exchange.py`), and a host of any size is dealt over all of them. A bucket tells the pages how many distinct pages
hold each head. Open tokens that two pages hold go. Landmarks guard an article, as its text is wanted whole even where
some other pages repeat it: content tokens go only if `COMMON` pages at least and more than half of the host's pages
hold the passage, and not if no content is left.

A hash has as many bits as make a chance match rarer than one in a million suffixes, whatever their number, up to 64.

Edge cases: null or empty html gives the empty text; a tag that the page's end cuts off is dropped; a reference
that it cuts off stays as it is; pages with a null url share one host; rows that repeat a page count as pages of their
own, so the open text of a page that is there twice goes; a page of any length is read whole; a head that a page holds
twice counts once; an empty table gives no row; only page_id, url and html are read, other columns may have any name.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm import exchange
from nearfield.llm.common import forget, lean, materialise, shuffles

#: Tokens that a repeated passage has at least.
REPEAT = 8
#: Pages that hold a passage at least before it goes from content.
COMMON = 3
#: Bytes of html in one chunk.
CHUNK_BYTES = 8 << 20
#: Bytes of html whose heads one bucket takes; smaller ones make more rows of an exchange, one for each chunk and bucket.
BUCKET_BYTES = 16 << 20
#: Bytes of a token that are mixed at a time, and those of a long token.
_WORD, _LONG = 8, 64
#: Tokens hashed at a time.
_RUN = 1 << 14
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(_WORD + 1)], np.uint64)

#: Elements by what they do to the text (fixed by HTML).
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p "
    "pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style template noscript iframe svg annotation textarea title head select button".split())
CHROME_TAGS = frozenset("nav footer aside form dialog menu".split())
CONTENT_TAGS = frozenset("article main".split())
#: Names in class, id or role of page furniture; a hyphenated name counts if all its words are here or below.
CHROME_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent contentinfo cookie "
    "cookies disclaimer footer header login masthead menu modal nav navbar navigation newsletter notice pagination "
    "popup promo related replies reply search share sharing sidebar signup social sponsor sponsored subscribe toolbar "
    "widget".split()
)
#: Words that say where furniture is or how it is laid out.
PLACE_WORDS = frozenset(
    "area bar bottom box button buttons container desktop form global inner left link links list main mobile outer "
    "primary right secondary site sub top wrap wrapper".split()
)
#: Names of furniture that head an article when they are inside one.
HEADER_WORDS = frozenset("header masthead banner".split())

_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^<]*\Z|[^<]+|<",
    re.DOTALL,
)
_HINT = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_NAME = re.compile(r"[a-z0-9]+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
#: What an element is; chrome inside content is told apart, as nothing in it is content again.
_OPEN, _CONTENT, _CHROME, _INNER_CHROME = 0, 1, 2, 3


def _furniture(name: str, inside: int) -> bool:
    words = set(_NAME.findall(name))
    named = words & CHROME_WORDS
    if inside == _CONTENT:
        named -= HEADER_WORDS
    return bool(named) and words <= CHROME_WORDS | PLACE_WORDS


def _kind(tag: str, attributes: str, inside: int) -> int:
    if inside == _INNER_CHROME:
        return inside
    chrome = _INNER_CHROME if inside == _CONTENT else _CHROME
    if tag in CHROME_TAGS or (tag == "header" and inside != _CONTENT):
        return chrome
    content = tag in CONTENT_TAGS
    if attributes and tag not in ("html", "body"):
        hints = [(m[0][:4].lower() == "role", (m[1] or m[2] or m[3] or "").lower().split()) for m in _HINT.finditer(attributes)]
        content = content or any(role and "main" in names for role, names in hints)
        # the main part is never furniture, an article may be (a reader's comment)
        if tag != "main" and not any(role and "main" in names for role, names in hints):
            if any(_furniture(name, _CONTENT if content else inside) for _, names in hints for name in names):
                return chrome
    return _CONTENT if content else inside


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(kind, text) of the blocks that are not chrome (or of all, as open, if there is no other), in page order;
    references decoded, white space folded."""
    found: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    kind, text, skip_to = _OPEN, [], 0

    def close() -> None:
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            if whole:
                found.append((kind, whole))
            text.clear()

    for m in _PIECE.finditer(page):
        if m.start() < skip_to:
            continue
        tag = m[2]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                text.append(m[0])
            continue
        tag = tag.lower()
        if m[1]:
            if any(t == tag for t, _ in stack):
                if tag in BLOCK_TAGS:
                    close()
                while stack:
                    gone, _ = stack.pop()
                    if gone == tag:
                        break
                new = stack[-1][1] if stack else _OPEN
                if new != kind:
                    close()
                    kind = new
            elif tag in BLOCK_TAGS:
                close()
            continue
        if tag in RAW_TAGS and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, m.end())
            # an unclosed head is left to its children, anything else runs to the end
            if end or tag != "head":
                skip_to = end.end() if end else len(page)
                close() if tag in BLOCK_TAGS else text.append(" ")
                continue
        if tag == "br":
            text.append(" ")
        if tag in VOID_TAGS or m[3].endswith("/"):
            if tag in BLOCK_TAGS:
                close()
            continue
        if tag in BLOCK_TAGS:
            close()
            if tag == "p" and any(t == "p" for t, _ in stack):  # a paragraph ends the one before
                while stack and stack[-1][0] not in CONTENT_TAGS and stack.pop()[0] != "p":
                    pass
        new = _kind(tag, m[3], stack[-1][1] if stack else _OPEN)
        if new != kind:
            close()
            kind = new
        stack.append((tag, new))
    close()
    return [b for b in found if b[0] < _CHROME] or [(_OPEN, t) for _, t in found]


def parse(pages: DataFrame) -> DataFrame:
    """chunk, kind, n and body: some pages each, packed, with page_id, url, host, and the kinds and texts (a line each) of
    the blocks that are not chrome."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in parts:
            step = min(exchange.ITEMS, max(1, batch.num_rows * CHUNK_BYTES // max(batch.column(2).nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                hosts, kinds, texts = [], [], []
                for url, page in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    host = _HOST.match(url or "")
                    blocks = blocks_of(page or "")
                    hosts.append(host[1].lower() if host else "")
                    kinds.append([k for k, _ in blocks])
                    texts.append("\n".join([t for _, t in blocks]))
                read = pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array(c, t) for c, t in ((hosts, pa.string()), (kinds, pa.list_(pa.int8())), (texts, pa.string())))],
                    names=["page_id", "url", "host", "kinds", "text"],
                )
                yield pa.RecordBatch.from_pydict(
                    {"chunk": [chunk], "kind": pa.array([1], pa.int32()), "n": pa.array([part.num_rows], pa.int32()), "body": [_packed(read)]}
                )
                chunk += 1

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(lean(run), "chunk long, kind int, n int, body binary")


def _packed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_batch(rows)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())


def _opened(body: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(body)).read_next_batch()


def _digest(token: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(token, digest_size=8).digest(), "little")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Tokens(NamedTuple):
    """Where the tokens of a chunk's pages are; numpy goes over all pages at once, as a page alone is short."""

    #: UTF-8 of the pages, one after the other, and 8 bytes more
    data: np.ndarray
    #: first byte and byte behind the last one of each token
    starts: np.ndarray
    ends: np.ndarray
    #: tokens before each block and each page, and their number
    blocks: np.ndarray
    pages: np.ndarray


def tokens_of(texts: pa.StringArray) -> Tokens:
    """The tokens of pages of which each block is a line and each token is between single spaces."""
    _, offsets, body = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    size = int(offsets[-1] - offsets[0])
    data = np.zeros(size + _WORD, np.uint8)
    if size:
        data[:size] = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    line, gap = data[:size] == 10, data[:size] == 32
    heads = offsets[:-1][np.diff(offsets) > 0]
    first, opens = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
    first[1:], opens[1:] = line, line | gap
    first[heads] = opens[heads] = True
    starts = np.flatnonzero(opens[:size])
    after = np.append(starts[1:], size)[: len(starts)]
    ends = after - (line | gap)[after - 1]
    blocks = np.append(np.flatnonzero(first[starts]), len(starts))
    return Tokens(data, starts, ends, blocks, np.searchsorted(starts, offsets))


def token_hashes(t: Tokens, start: int, stop: int) -> np.ndarray:
    """64 bits for each of the tokens from start to stop: its length, then 8 bytes at a time, mixed; long ones digested."""
    at, sizes = t.starts[start:stop], t.ends[start:stop] - t.starts[start:stop]
    words = np.ndarray((len(t.data) - _WORD + 1,), "<u8", t.data, strides=(1,))
    hashes = _mixed(sizes.astype(np.uint64))
    for k in range(0, min(int(sizes.max(initial=0)), _LONG), _WORD):
        more = np.flatnonzero(sizes > k) if k else slice(None)
        word = words[at[more] + k] & _BYTES[np.minimum(sizes[more] - k, _WORD)]
        hashes[more] = _mixed(hashes[more] * _STEP + word)
    for i in np.flatnonzero(sizes > _LONG).tolist():
        hashes[i] = _digest(t.data[at[i] : at[i] + sizes[i]].tobytes())
    return hashes


def heads_of(t: Tokens, hosts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, at, page): the `least` leading tokens of each suffix within a block, hashed with the page's host; at counts
    over all tokens. Shorter blocks are no passage."""
    total = len(t.starts)
    at = np.flatnonzero(np.arange(total) + least <= np.repeat(t.blocks[1:], np.diff(t.blocks)))
    page = np.repeat(np.arange(len(hosts)), np.diff(t.pages))[at]
    key = np.empty(max(0, total - least + 1), np.uint64)
    for start in range(0, len(key), _RUN):  # short runs stay in the processor's cache
        stop = min(start + _RUN, len(key))
        span, size = token_hashes(t, start, stop + least - 1), 1
        while 2 * size <= least:
            span, size = _mixed(span[:-size] * _STEP + span[size:]), 2 * size
        if size < least:  # two overlapping spans cover the rest
            span = _mixed(span[: size - least] * _STEP + span[least - size :])
        key[start:stop] = span
    return _mixed(key[at] * _STEP + hosts[page]), at, page


def hosts_of(pages: pa.RecordBatch) -> np.ndarray:
    """64 bits for the host of each page."""
    found = pages.column("host").dictionary_encode()
    known = np.array([_digest(h.encode()) for h in found.dictionary.to_pylist()], np.uint64)
    return known[found.indices.to_numpy()]


def mask_for(suffixes: int) -> np.uint64:
    """The leading bits of a hash that are compared: 20 and more beyond the binary logarithm of the suffixes' number."""
    bits = min(64, -(-(max(suffixes, 1).bit_length() + 20) // 8) * 8)
    return np.uint64(((1 << bits) - 1) << (64 - bits))


def held_by(key: np.ndarray, page: np.ndarray, hosts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and how many pages hold each; every page holds its host's."""
    key, page = np.append(key, hosts), np.append(page, np.arange(len(hosts)))
    order = np.argsort(key, kind="stable")
    key, page = key[order], page[order]
    new = np.append(True, key[1:] != key[:-1])
    first = np.flatnonzero(new)
    return key[first], np.add.reduceat(new | np.append(True, page[1:] != page[:-1]), first, dtype=np.int64)


def heads(chunks: DataFrame, least: int, buckets: int, mask: np.uint64) -> DataFrame:
    """What each chunk sends: its distinct heads with the number of its pages that hold them; a host's own key has the
    number of its pages."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for chunk, body in zip(*(batch.column(c).to_pylist() for c in ("chunk", "body")), strict=True):
                pages = _opened(body)
                hosts = hosts_of(pages)
                key, _, page = heads_of(tokens_of(pages.column("text")), hosts, least)
                yield exchange.dealt_counts(chunk, *held_by(key & mask, page, hosts & mask), buckets)

    return chunks.select("chunk", "body").mapInArrow(lean(run), exchange.SCHEMA)


def texts_of(t: Tokens, kinds: np.ndarray, at: np.ndarray, times: np.ndarray, pages: np.ndarray, least: int) -> pa.StringArray:
    """The pages' blocks without the tokens of repeated passages; times: how many of the host's pages (`pages`) hold the
    head that stands at `at`. Content goes by the stricter rule."""
    content = np.repeat(kinds == _CONTENT, np.diff(t.blocks))
    hit = at[np.where(content[at], (times >= COMMON) & (2 * times > pages), times > 1)]
    gone = np.zeros(len(content) + 1, np.int32)
    gone[hit] += 1
    gone[hit + least] -= 1
    keep = np.cumsum(gone)[:-1] == 0
    left = np.diff(np.append(0, np.cumsum(content & keep))[t.pages])
    keep |= content & np.repeat(left == 0, np.diff(t.pages))
    kept = np.flatnonzero(keep)
    # a token takes the byte before it along, but for a page's first one: a space, or a line's end before another block
    page, block = (np.repeat(np.arange(len(b) - 1), np.diff(b))[kept] for b in (t.pages, t.blocks))
    joined = np.append(False, page[1:] == page[:-1])[: len(kept)]
    start, end = t.starts[kept] - joined, t.ends[kept]
    data, taken = t.data.copy(), np.zeros(len(t.data) + 1, np.int8)
    data[start[joined]] = np.where(np.append(False, block[1:] == block[:-1])[: len(kept)][joined], 32, 10)
    taken[start] += 1
    taken[end] -= 1
    body = data[np.cumsum(taken, dtype=np.int8)[:-1].view(bool)]
    offsets = np.append(0, np.cumsum(end - start))[np.searchsorted(kept, t.pages)].astype(np.int32)
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(body))


def without_repeats(chunks: DataFrame, answers: DataFrame, least: int, mask: np.uint64) -> DataFrame:
    """page_id, url, text of the parsed pages: what their host doesn't repeat."""

    def strip(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in exchange.runs(parts, "chunk"):
            known, _, totals = exchange.replies(run)
            order = np.argsort(known)
            known, totals = np.append(known[order], np.uint64(0)), np.append(totals[order], 1).astype(np.int64)

            def held(keys: np.ndarray) -> np.ndarray:
                place = np.searchsorted(known[:-1], keys & mask)  # noqa: B023
                return np.where(known[place] == keys & mask, totals[place], 1)  # noqa: B023

            pages = _opened(next(r["body"] for r in run if r["kind"] == 1))
            hosts, t = hosts_of(pages), tokens_of(pages.column("text"))
            key, at, page = heads_of(t, hosts, least)
            kinds = pages.column("kinds").flatten().to_numpy()
            texts = texts_of(t, kinds, at, held(key), held(hosts)[page], least)
            yield pa.RecordBatch.from_arrays(
                [pages.column(0), pages.column(1), texts], names=["page_id", "url", "text"]
            )

    rows = chunks.unionByName(answers.filter("kind = 0").select("chunk", "kind", "n", "body"))
    return exchange.by_chunk(rows, strip, "page_id long, url string, text string")


def extract(pages: DataFrame, least: int = REPEAT) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    buckets, mask = max(1, -(-size // BUCKET_BYTES)), mask_for(size // 4)
    chunks = materialise(parse(pages))
    before = shuffles(pages.sparkSession)
    answers = materialise(exchange.answered(heads(chunks, least, buckets, mask), buckets))
    forget(gone=shuffles(pages.sparkSession) - before)  # the exchange's shuffle must be gone before the next one is written
    texts = without_repeats(chunks, answers, least, mask)
    return texts.withColumn("n_chars", F.length("text").cast("long"))
