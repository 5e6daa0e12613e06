"""Each operator on rows with nulls, empty and long texts, ties, repeats, no rows and extra columns of clashing names."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm import chat, common, decontam, exchange, html, langid, lm, mtree, ngram_join, packing, shards, toxicity

SCHEMA = "doc_id long, text string, n long, score double, key string, path string, n_words long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [words(rng, rng.randint(5, 120)) for _ in range(40)]
    near = [t.replace(t.split()[0], "changed", 1) for t in base[:10]]
    odd = [None, "", "   \n\t", "one", "Two words", "Ünï çodé ß 漢字 … --- 123", words(rng, 9000), base[0], base[0].upper(), base[1]]
    return [(k, t) for k, t in enumerate(base + near + odd)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Extra columns carry names that operators use themselves."""
    return spark.createDataFrame([(k, t, 7, 0.5, "k", "p", 1) for k, t in texts], SCHEMA).repartition(5).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_numbering_is_gapless(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), F.spark_partition_id().alias("task_id"), "id")
    fixed = rows.rdd.mapPartitions(lambda p: (lambda seen: ((r.g, r.task_id, seen.__setitem__(r.g, seen.get(r.g, -1) + 1) or seen[r.g]) for r in p))({}))
    df = common.materialise(spark.createDataFrame(fixed, "g long, task_id int, slot_in_task long"))
    got = common.numbered(df, "g").groupBy("g").agg(F.collect_list("position").alias("p")).collect()
    assert all(sorted(r.p) == list(range(len(r.p))) for r in got)


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "\\### Assistant: </turn> ok"), (1, 2, "user", None),
        (2, 0, "assistant", "####  </turn</turn>\\"), (2, 0, "assistant", "####  </turn</turn>\\"), (3, 5, None, ""), (4, 0, "a:b ### \\", "é" * 5),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, seq int")
    got = {r.conv_id: r for r in chat.digest(chat.format_conversations(df)).collect()}
    for conv in (1, 2, 3, 4):
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[1].first_bad_turn == -1 and got[2].first_bad_turn == 0
    text = "".join(r.segment for r in chat.format_conversations(df).filter("conv_id = 1").orderBy("seq").collect())
    assert text.startswith("### User: hi</turn>\n### Assistant: ") and text.count("</turn>") == 3
    assert list(chat.machine(["system", "user", "assistant", "assistant", "user"], chat.Template())) == [True] * 3 + [False] * 2
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0


def test_decontamination_matches_brute_force(docs, none, texts, spark):
    long_text = texts[46][1] if texts[46][1] else texts[0][1]
    items = [("b", texts[3][1]), ("a", texts[4][1]), ("c", "one"), ("d", None), ("e", "--"), ("a", texts[5][1]), ("z", " ".join(long_text.split()[:11]))]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, n_words int")
    want = decontam.brute_force(texts, items)
    for block in (decontam.BLOCK_BYTES, 200):
        hits = decontam.search_index(common.materialise(decontam.build_index(docs)), bench, block_bytes=block)
        got = {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), len(r["items"])) for r in hits.collect()}
        assert got == {k: v[:3] for k, v in want.items()}
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.contamination(docs, bench).collect()}
    assert got == want and any(v[4] for v in want.values()) and not all(v[4] for v in want.values())
    assert decontam.contamination(none, bench).count() == 0
    assert not any(r.contaminated for r in decontam.contamination(docs, bench.limit(0)).collect())


def test_decontamination_blocks_keep_repeated_ids(spark):
    """A benchmark of several blocks gives the rows of one block, also where documents share an id."""
    a, b = (" ".join(f"{c}{k}" for k in range(12)) for c in "ab")
    rows = [(1, a), (1, f"x {b}"), (1, "neither"), (2, b), (2, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame([("p", a), ("q", b)], "item_id string, text string")
    index = common.materialise(decontam.build_index(docs))
    one, many = (
        sorted(str(r) for r in decontam.search_index(index, bench, block_bytes=size).collect()) for size in (decontam.BLOCK_BYTES, 10)
    )
    assert one == many and len(one) == len(rows)


def test_proximity(spark):
    rows = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "alpha beta gamma"), (3, "gamma beta alpha")], "doc_id long, text string")
    item = spark.createDataFrame([("i", "alpha beta gamma")], "item_id string, text string")
    got = {r.doc_id: len(r.spans) for r in decontam.decontaminate(rows, item, slop=2).collect()}
    assert got == {1: 1, 2: 1, 3: 0}


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_jaccard_join_matches_brute_force(docs, none, texts, width, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(docs, width, percent).collect()}
    assert got == ngram_join.brute_force(texts, width, percent)
    assert ngram_join.link(none, width, percent).count() == 0


def test_jaccard_chains_and_large_groups(spark):
    rng = random.Random(5)
    base = words(rng, 100, 5000).split()
    rows = []
    for k in range(120):  # copies that each change another word, and a chain that drifts away
        copy = list(base)
        copy[k % 100] = f"x{k}"
        rows.append((k, " ".join(copy)))
    drift = list(base)
    for k in range(60):
        drift[k] = f"d{k}"
        rows.append((200 + k, " ".join(drift)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(df, 4, 85).collect()}
    assert got == ngram_join.brute_force(rows, 4, 85)


def test_keep_one_keeps_columns_and_clean_rows(docs, texts):
    kept = ngram_join.keep_one(docs)
    want = {d for d, (_, c) in ngram_join.brute_force(texts, 5, 80).items() if d == c}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want


def test_keep_one_tells_rows_of_one_id_apart(spark):
    """Unlike texts under one id, rows without an id and repeated rows: one row of each component stays, and every row without a gram."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = [(1, a), (1, b), (2, a.upper()), (None, c), (None, d), (5, d), (7, c + " more"), (3, None), (3, ""), (8, b), (9, "once"), (9, "once")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, text_hash string").repartition(3)
    got = sorted((str(r.doc_id), str(r.text)) for r in ngram_join.keep_one(df).collect())
    assert got == sorted((str(i), str(t)) for i, t in [(1, a), (1, b), (5, d), (7, c + " more"), (3, None), (3, ""), (9, "once")])


def test_exchange_counts_every_shared_key(spark):
    """Against a plain count, with a key that all items hold and items without keys."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    items = [np.unique(np.append(rng.integers(0, 3000, n).astype(np.uint64) << np.uint64(50), np.uint64(7))) for n in (0, 5, 200, 900, 900, 40)]
    items.append(np.empty(0, np.uint64))
    values, held = np.unique(np.concatenate(items), return_counts=True)
    many = {int(v): int(c) for v, c in zip(values, held) if c > 1}

    def deal(parts):
        for batch in parts:
            for chunk in batch.column(0).to_pylist():
                some = items[3 * chunk : 3 * chunk + 3]
                yield exchange.dealt(chunk, np.concatenate(some), np.repeat(np.arange(len(some)), [len(x) for x in some]), b"p", 4)

    def assemble(chunk, payload, keys, owner, total):
        assert payload == b"p"
        return pa.RecordBatch.from_arrays(
            [pa.array(3 * chunk + owner), pa.array(keys.view(np.int64)), pa.array(total)], names=["item", "key", "total"]
        )

    rows = spark.range(0, 3, 1, 3).mapInArrow(deal, exchange.SCHEMA)
    got = sorted((r.item, r.key, r.total) for r in exchange.exchanged(rows, 4, assemble, "item long, key long, total long").collect())
    want = [(k, int(np.uint64(g).view(np.int64)), many[int(g)]) for k, x in enumerate(items) for g in x if int(g) in many]
    assert got == sorted(want) and len(got) > 500


def test_wide_signatures_never_bound_too_low():
    rng = np.random.default_rng(6)
    for _ in range(200):
        both = rng.integers(0, 1 << 63, rng.integers(1, 900)).astype(np.uint64)
        x, y = (np.unique(np.append(both, rng.integers(0, 1 << 63, rng.integers(0, 4000)).astype(np.uint64))) for _ in "xy")
        most = ngram_join.most_common(ngram_join.signature(x), ngram_join.signature(y), len(x), len(y))
        assert len(np.intersect1d(x, y)) <= most <= min(len(x), len(y))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.id: r.comp for r in ngram_join.components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_components_end_only_at_rest(spark, monkeypatch):
    """Rounds that still change something after the sixtieth are not the last."""
    calls = []

    def never_at_rest(df):
        calls.append(1)
        if len(calls) > 70:
            raise RuntimeError("still going")
        return spark.createDataFrame([(1, -len(calls))], "a long, b long")

    monkeypatch.setattr(ngram_join, "materialise", never_at_rest)
    monkeypatch.setattr(ngram_join, "forget", lambda df: None)
    with pytest.raises(RuntimeError, match="still going"):
        ngram_join.components(spark.createDataFrame([(1, 2)], "a long, b long"))


def test_mtree_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 8))
    x[100:160] = x[100]
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    rows += [(900, None, 1), (901, [1.0, None] * 4, 1), (902, [float("nan")] * 8, 1), (903, [float("inf")] * 8, 1), (904, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(3)
    got = mtree.search(df, df.filter("vec_id % 50 = 0"), 10).collect()
    v = np.floor(x * 1024).astype(np.int64)
    for q in range(0, 700, 50):
        scores = v @ v[q]
        order = [i for i in np.lexsort((np.arange(700), -scores)) if i != q][:10]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [(r.vec_id, r.score) for r in own] == [(i, scores[i]) for i in order]
    assert {r.query_id for r in got} == set(range(0, 700, 50))
    assert mtree.search(df.limit(0), df, 10).count() == 0 and mtree.search(df.filter("vec_id < 5"), df.filter("vec_id = 0"), 10).count() == 4


def test_mtree_skips_distances():
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(20, 6)) * 200
    x = np.floor(np.repeat(centers, 200, 0) + rng.normal(size=(4000, 6))).astype(np.int64)
    rows = pa_rows(x)
    tree = mtree.Searcher(rows)
    best = tree.top(-1, x[0], 5)
    scores = x @ x[0]
    assert [s for s, _ in best] == sorted(scores.tolist(), reverse=True)[:5] and tree.computed < 2500


def pa_rows(x):
    import pyarrow as pa

    squares = (x.astype(float) ** 2).sum(1)
    lift = float(squares.max())
    tree = mtree.Tree(np.column_stack([x.astype(float), np.sqrt(lift - squares)]))
    put = lambda v, kind: np.asarray(v, kind).tobytes()
    assert pa
    return {
        "dim": x.shape[1], "vectors": put(x, np.int64), "ids": put(range(len(x)), np.int64), "id_ends": put(range(1, len(x) + 1), np.int64),
        "first_child": put(tree.first, np.int64), "n_child": put(tree.count, np.int64), "is_leaf": put(tree.leaf, np.bool_),
        "router": put(tree.router, np.int64), "radius": put(tree.radius, np.float64), "to_parent": put(tree.to_parent, np.float64),
        "entry_order": put(tree.order, np.int64), "entry_dist": put(tree.dist, np.float64), "lift": lift,
    }


def test_flow_moves_the_fewest_bytes():
    parts = shards.transfers({0: (0, 10, 1000), 1: (0, 10, 100), 2: (1, 4, 400)}, 3)
    into = {}
    for flows in parts.values():
        for shard, n in flows:
            into[shard] = into.get(shard, 0) + n
    assert sorted(into.values()) == [8, 8, 8] and sum(n for _, n in parts[0] if _ == 0) == 8 - sum(n for _, n in parts[1] if _ == 0)
    moved_small = sum(n for s, n in parts[1] if s != 0)
    assert moved_small == 10, "the small rows leave first"
    assert shards.transfers({}, 4) == {}


def test_resharding(docs, none, texts, tmp_path):
    placed = shards.reshard(shards.measured(docs), 7)
    got = {r.doc_id: r for r in placed.collect()}
    assert len(got) == len(texts)
    for k, t in texts:
        raw = (t or "").encode()
        assert (got[k].size, got[k].text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    by = {}
    for r in got.values():
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    placed = common.materialise(placed)
    affected = shards.rewrite(docs, placed, str(tmp_path / "s"))
    moved = {r.shard for r in got.values() if r.shard != r.old_shard} | {r.old_shard for r in got.values() if r.shard != r.old_shard}
    assert set(affected) == moved
    back = docs.sparkSession.read.parquet(str(tmp_path / "s"))
    assert back.count() == sum(1 for r in got.values() if r.shard in moved)
    assert shards.reshard(shards.measured(none), 7).count() == 0


def test_rewrite_places_each_row_once(spark, tmp_path):
    """Repeated ids, equal rows, null ids, clashing columns, and a second run over the first."""
    rows = [(k % 20, f"text {k % 20} {k // 40}", k) for k in range(80)] + [(None, None, 90), (None, "n", 91)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Shard int").repartition(3)
    placed = common.materialise(shards.reshard(shards.measured(docs).withColumn("task_id", F.lit(1)).withColumn("slot", F.lit(2)), 5))
    affected = shards.rewrite(docs, placed, str(tmp_path / "s"))
    assert shards.rewrite(docs, placed, str(tmp_path / "s")) == affected
    got = spark.read.parquet(str(tmp_path / "s"))
    pairs = lambda df: sorted((str(r.doc_id), r.shard, r.slot) for r in df.collect())
    assert pairs(got) == pairs(placed.filter(F.col("shard").isin(affected))) and got.columns.count("text") == 1
    assert placed.count() == len(rows) and placed.columns.count("slot") == 1


def test_appended_columns_replace_those_of_their_name(spark):
    df = spark.createDataFrame([(1, "x", 5, 6, 7)], "doc_id long, text string, Toxic_Score int, lang_pred int, lang_score int")
    model = toxicity.Model({" x": 2.0}, [], 1.0, -0.1)
    assert toxicity.annotate(df, model).columns == ["doc_id", "text", "lang_pred", "lang_score", "toxic_score"]
    own = langid.Model(["en"], langid.byte_classes(np.zeros(256)), np.ones((langid.CODES**4, 1), np.float32))
    found = langid.identify(df, own)
    assert found.columns == ["doc_id", "text", "Toxic_Score", "lang_pred", "lang_score"] and found.first().lang_pred == "en"
    assert toxicity.annotate(df, model).first().toxic_score > 0


def test_hits_inside_exceptions_match_brute_force():
    rng = random.Random(2)
    for _ in range(50):
        text = " " + " ".join(rng.choices("ab abc b c cab".split(), k=60)) + " "
        model = toxicity.Model({" ab": 1.0, " c": 2.0, " b ": 3.0}, rng.sample([" ab c ", " c ab ", " b b ", " cab ab", " abc "], 3))
        automaton = model.automaton()
        spans = [(i, i + len(e)) for e in model.exceptions for i in range(len(text)) if text.startswith(e, i)]
        best = {}
        for e, w in model.weights.items():
            for i in range(len(text)):
                if text.startswith(e, i) and (i not in best or len(e) > best[i][0]):
                    best[i] = (len(e), w)
        want = [(i, i + n, w) for i, (n, w) in sorted(best.items()) if not any(a <= i and i + n <= b for a, b in spans)]
        assert toxicity.hits(text, automaton) == want


def test_products_beyond_doubles_are_exact():
    rng = np.random.default_rng(3)
    x = rng.integers(1 << 24, 1 << 25, (300, 64))
    tree = mtree.Searcher(pa_rows(x))
    for q in (0, 7):
        scores = [sum(int(a) * int(b) for a, b in zip(v, x[q], strict=True)) for v in x]
        want = sorted(((s, i) for i, s in enumerate(scores) if i != q), key=lambda z: (-z[0], z[1]))[:10]
        assert tree.top(q, x[q], 10) == want
    wide = rng.integers(1 << 40, 1 << 41, (20, 8))
    assert mtree.Searcher(pa_rows(wide)).top(-1, wide[0], 1)[0][0] == max(sum(int(a) * int(b) for a, b in zip(v, wide[0], strict=True)) for v in wide)


def test_packing_round_trip(spark, docs, none, texts):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    placed = packing.pack(docs, path, packing.crc32_of).persist()
    rows = placed.collect()
    for k, t in texts:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        own = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start)
        assert own[0].doc_tokens == len(ids) and sum(r.length for r in own) == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.measured for r in own)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    assert set(sequences) == set(range(len(sequences)))
    made = {r.sequence_id: r for r in packing.sequences(docs, path, placed).collect()}
    assert all(len(made[s].input_ids) in (2048, made[s].n_tokens) for s in made) and set(made) == set(sequences)
    assert packing.pack(none, path, packing.crc32_of).count() == 0


@pytest.mark.parametrize("text", ["Don't. it's, A.B. x'., word., \x1c Tab  <|ENDOFTEXT|> <|endoftext|>", "É́. Σ, ß.ﬁ, 10.5, a,b", "a.\x85b, ć.", "".join(map(chr, range(1, 300)))])
def test_stretches_give_the_tokenizers_ids(text):
    P = pytest.importorskip("public_tokenizers")
    ids = packing.Ids(P.path("word_bpe_49k.json"))
    want = ids.tokenizer.encode(text, add_special_tokens=False).ids + [1]
    assert np.frombuffer(next(ids.of([text.encode()])), "<u4").tolist() == want


def test_nnls_and_plan():
    rng = np.random.default_rng(4)
    a, x = rng.random((12, 20)), np.maximum(rng.normal(size=20), 0)
    got = packing.nnls(a, a @ x)
    assert (got >= 0).all() and np.allclose(a @ got, a @ x, atol=1e-4)
    histogram = np.concatenate([[0], rng.integers(0, 60, packing.CLASSES)])
    used, total = np.zeros_like(histogram), 0
    for combination, repeats in packing.plan(histogram):
        assert sum(combination) <= packing.CLASSES and repeats > 0
        total += repeats
        for k in combination:
            used[k] += repeats
    need = (histogram * np.arange(len(histogram))).sum() / packing.CLASSES
    assert (used == histogram).all() and total <= 1.06 * need + 2
    assert packing.plan(np.zeros(packing.CLASSES + 1, int)) == []


def test_html_blocks():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav>menu</nav><div class='cookie-notice'>c</div><article><header><h1>Head &amp; line</h1></header>"
        "<p>One <b>bold</b>\n text<p>Two&nbsp;&lt;x&gt;<br>more<ul><li>a<li>b</ul><div class=\"ad\">buy</div><script>var t='</p>';</script><!-- no --><aside>s</aside>end"
        "</article><section id=comments><p>said</p></section><footer>f</footer>"
    )
    assert [t for _, t in html.blocks_of(page)] == ["Head & line", "One bold text", "Two <x> more", "a", "b", "end"]
    assert html.blocks_of("<article><p>cut &am") == [(1, "cut &am")] and html.blocks_of("<article>x</artic") == [(1, "x")]
    assert html.blocks_of("") == []


def test_html_suffixes_remove_what_a_host_repeats(spark):
    shared = "all rights reserved by the owners of this very site"
    rows = [(k, f"https://a.example/{k}", f"<body><p>{shared}</p><p>own text number {k} of the page</p>", "x") for k in range(6)]
    rows += [(50, "https://b.example/1", f"<body><p>{shared}</p>", "x"), (51, None, None, "x"), (52, "u", "", "x"), (53, "https://a.example/z", f"<article>{shared}</article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(4)
    got = {r.page_id: r for r in html.extract(df).collect()}
    assert all(got[k].text == f"own text number {k} of the page" for k in range(6))
    assert got[50].text == shared and got[53].text == shared and got[51].text == "" and got[52].n_chars == 0
    assert html.extract(df.limit(0)).count() == 0


def test_html_suffixes_decide_on_pages_with_landmarks(spark):
    """What most pages of a host repeat inside the article goes, copied articles stay, and a teaser isn't the page."""
    call = "write to the makers of this site and tell them what you think"
    own = [f"the story of page {k} tells what happened there on day {k} of that year" for k in range(8)]
    rows = [(k, f"https://a.example/{k}", f"<body><article><p>{own[k]}</p><div class='cta'>{call}</div></article>") for k in range(8)]
    rows += [(20, "https://a.example/20", f"<body><article><p>{own[1]}</p></article>")]
    long_text = "outside of the card stands the main text of the page that must stay"
    rows += [(30, "https://a.example/30", f"<body><article><p>see also</p></article><div><p>{long_text}</p></div>")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(got[k] == own[k] for k in range(8)) and got[20] == own[1]
    assert got[30] == f"see also\n{long_text}"


def test_html_suffixes_match_brute_force(spark, monkeypatch):
    """Every substring of REPEAT tokens of every page against all others of its host, over chunks of two pages."""
    rng = random.Random(9)
    shared = [" ".join(f"s{k}_{j}" for j in range(rng.randint(6, 30))) for k in range(6)]
    pages = []
    for k in range(40):
        host, blocks = f"h{k % 3}.org", []
        for _ in range(rng.randint(1, 6)):
            words = [f"u{rng.randint(0, 10**9)}" for _ in range(rng.randint(1, 12))]
            words[len(words) // 2 : len(words) // 2] = rng.choice(shared).split() if rng.random() < 0.6 else []
            blocks.append((rng.random() < 0.5, " ".join(words)))
        pages.append((k, host, blocks))
    least, want = html.REPEAT, {}
    windows = lambda t: [tuple(t.split()[i : i + least]) for i in range(len(t.split()) - least + 1)]
    for k, host, blocks in pages:
        others = [{w for _, t in b for w in windows(t)} for _, h, b in pages if h == host]
        marks = []
        for content, text in blocks:
            gone = [False] * len(text.split())
            for i, w in enumerate(windows(text)):
                times = sum(w in o for o in others)
                if (times >= html.COMMON and 2 * times > len(others)) if content else times > 1:
                    gone[i : i + least] = [True] * least
            marks.append(gone)
        if all(all(g) for (content, _), g in zip(blocks, marks) if content):
            marks = [[False] * len(g) if content else g for (content, _), g in zip(blocks, marks)]
        kept = (" ".join(w for w, g in zip(t.split(), gone) if not g) for (_, t), gone in zip(blocks, marks))
        want[k] = "\n".join(t for t in kept if t)
    part = lambda content, text: f"<article><p>{text}</p></article>" if content else f"<div><p>{text}</p></div>"
    rows = [(k, f"http://{h}/{k}", "".join(part(*b) for b in blocks)) for k, h, blocks in pages]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert got == want and sum(len(b[2]) for b in rows) > 0 and any(len(t.split("\n")) > 1 for t in want.values())


def test_html_chrome_names_are_whole():
    of = lambda page: [t for _, t in html.blocks_of(page)]
    assert of("<article><div class='entry-header'><h1>Head</h1></div><div class='header'>line</div><p>text</p></article>") == ["Head", "line", "text"]
    for name in ("layout has-sidebar", "no-sidebar", "page sidebar", "search"):
        assert of(f"<div class='{name}'><article><p>text</p></article></div>") == ["text"]
    assert of("<form><main class='widget'><p>text</p></main></form><div class='site-footer'>f</div>") == ["text"]
    assert of("<article><p>text</p><aside><article>other</article></aside></article><div id=comments><article class='comment odd'>c</article></div>") == ["text"]
    assert of("<article><p>if <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds</p></article>") == ["if x=1 holds"]
    assert of("<div class='promo'><p>all there is</p></div>") == ["all there is"]


def test_html_short_blocks_are_no_passages(spark):
    rows = [(k, "https://a.example/", f"<body><p>Of.</p><p>page {k} says so</p>") for k in range(4)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Of.\npage {k} says so" for k in range(4))


def test_language_model_of_bytes(spark):
    rng = random.Random(8)
    sample = {"en": "the and of to in that with from this", "de": "der die und nicht über für schön größe", "fr": "le la et été où ça français élève"}
    rows = [(k, " ".join(rng.choices(sample[la].split(), k=12)), la, 1.0) for k in range(240) for la in [("en", "de", "fr")[k % 3]]]
    rows += [(900, None, "en", 1.0), (901, "", "fr", 1.0), (902, "123 !!", "en", 1.0), (903, "the and of " * 9000, None, 1.0), (5, rows[5][1], rows[5][2], 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").repartition(4)
    got = langid.language_of(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == la for k, _, la, _ in rows[:240]) and by[903].lang_pred == "en"
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (900, 901, 902)) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in langid.language_of(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.language_of(df.limit(0)).count() == 0
    model = langid.fit(df)
    assert np.allclose((2.0 ** -(model.costs[:, 0] * model.unit)).reshape(-1, langid.CODES).sum(1), 1, atol=1e-3)
    kept = langid.keep(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(by) - {900, 901, 902}


def test_code_lengths_sum_symbol_by_symbol():
    counts = np.zeros((langid.CODES,) * 4)
    code = langid.byte_classes(np.zeros(256))
    index, _ = langid.coded([b"abracadabra"], code)
    np.add.at(counts.reshape(-1), index, 1)
    p = langid.distribution(counts)
    assert np.allclose(p.sum(-1), 1)
    model = langid.Model(["x"], code, -np.log2(p).reshape(-1, 1))
    want = [sum(-np.log2(p.ravel()[i]) for i in langid.coded([t], code)[0]) for t in (b"abra", b"zz", b"cad abra")]
    assert np.allclose(langid.code_lengths([b"abra", b"zz", b"cad abra"], model)[:, 0], want)
    long = b"abra cadabra " * 50_000  # over several blocks
    got = langid.code_lengths([b"zz", long, b"abra"], model)[:, 0]
    assert np.allclose(got, [want[1], -np.log2(p.ravel()[langid.coded([long], code)[0]]).sum(), want[0]])


def test_toxicity_learns_and_folds(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(400):
        text = words(rng, 30)
        bad = k % 4 == 0
        if bad:
            text += " you " + rng.choice(["nastyman", "vilething", "gruesome"]) + " go"
        rows.append((k, text, 1.0))
        labels.append((k, 1, int(bad), 5))
    rows += [(900, None, 1.0), (901, "", 1.0), (902, "you NA5TYMAN go", 1.0), (903, "you nаstymаn", 1.0), (904, words(rng, 9000), 1.0), (3, rows[3][1], 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text int")
    got = toxicity.toxicity(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by = {r.doc_id: r.predicted for r in got}
    assert all(by[k] == int(k % 4 == 0) for k in range(400))
    assert (by[900], by[901], by[902], by[903], by[904]) == (0, 0, 1, 1, 0)
    model = toxicity.fit(docs, marks)
    kept = toxicity.keep(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, p in by.items() if not p}
    assert {r.predicted for r in toxicity.toxicity(docs, marks.limit(0)).collect()} == {0}
    assert toxicity.toxicity(docs.limit(0), marks).count() == 0


@pytest.mark.parametrize("exact", [True, False])
def test_toxicity_lexicon_has_room_beside_copies(spark, exact):
    """Copies, or near copies, of a long toxic text don't push the insults of few documents out of the lexicon."""
    rng = random.Random(10)
    letters = lambda n: "".join(rng.choices("bcdfghklmnprstvz", k=n))
    long_text = " ".join(letters(12) for _ in range(700))
    rows = [(k, words(rng, 30) + (f" you {('nastyman', 'vilething')[k % 2]} go" if k < 60 else "")) for k in range(800)]
    rows += [(k, long_text if exact else f"{long_text} w{k}") for k in range(1000, 1150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame([(k, int(k < 60 or k >= 1000)) for k, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    found = toxicity.scores([b"you nastyman go", b"you vilething go", b"w1 w2 w3"], model, model.automaton())
    assert found[0] >= 0.5 and found[1] >= 0.5 and found[2] < 0.5
    if exact:
        assert not any(w[:8] in e for w in long_text.split() for e in model.weights)


def test_exception_phrases_excuse():
    model = toxicity.Model({" idio": 5.0}, [" idiom idiot "], 2.0, -3.0)
    automaton = model.automaton()
    assert toxicity.strength(toxicity.folded("you idiot"), automaton) > 0
    assert [h[0] for h in toxicity.hits(toxicity.folded("an idiom idiot proof"), automaton)] == []
    assert toxicity.folded("Ⅰ 1D10T  ｉｄｉ０ｔ") .count("idiot") == 2


def test_language_model_scores(spark, docs, none, texts):
    from collections import Counter
    from math import log10

    got = {r.doc_id: r for r in lm.score(docs, lm.learned_from()).collect()}
    cut = lambda t: (t or "").encode().translate(common.LOWER).split() + [None]
    counts = Counter(w for k, t in texts if zlib.crc32(str(k).encode()) % 7 != 2 for w in cut(t))
    n, v = sum(counts.values()), len(counts)
    for k, t in texts:
        own = cut(t)
        assert (got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert got[k].base_score == pytest.approx(sum(log10((counts[w] + 1) / (n + v + 1)) for w in own))
        assert np.isfinite(got[k].score) and got[k].score < 0
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 7 == 2)
    assert lm.score(none, lm.learned_from()).count() == 0
    assert lm.score(docs, F.lit(False)).filter("n_known = 0 AND train_tokens = 0").count() == len(texts)


def test_log_bilinear_learns_and_is_normalised():
    rng = np.random.default_rng(0)
    counts = np.zeros((lm.CONTEXTS**2, lm.TARGETS), np.int64)
    context = rng.integers(0, lm.CONTEXTS**2, 60_000)
    np.add.at(counts, (context, 1 + context % lm.CONTEXTS % 8), 1)
    table = lm.train(counts).log10()
    assert np.allclose((10.0 ** table.astype(float)).sum(1), 1, atol=1e-3)
    model = (counts * table).sum() / counts.sum()
    share = counts.sum(0) / counts.sum()
    unigram = (counts.sum(0) * np.log10(np.maximum(share, 1e-12))).sum() / counts.sum()
    assert model > unigram + 0.3


def test_log_bilinear_trains_on_every_count(monkeypatch):
    """A cell of one token among very many touches the parameters, and the rows carry the counts."""
    rng = np.random.default_rng(1)
    counts = np.zeros((lm.CONTEXTS**2, lm.TARGETS), np.int64)
    counts[rng.integers(0, lm.CONTEXTS**2, 5000), rng.integers(0, lm.TARGETS, 5000)] = 1
    counts[7, 9] = 10**10
    seen = np.zeros_like(counts, dtype=float)

    def step(self, c2, c1, w, *rest):
        np.add.at(seen, (c2 * lm.CONTEXTS + c1, w), rest[0] if len(rest) > 1 else 1)

    monkeypatch.setattr(lm.LogBilinear, "step", step)
    lm.train(counts)
    assert ((seen > 0) == (counts > 0)).all() and np.allclose(seen, counts)


def test_pipeline_keeps_clean_documents(spark, tmp_path, monkeypatch):
    """Every stage of the pipeline on a small corpus with one bad document for each, and documents without a text."""
    import corpus_pipeline

    rng = random.Random(12)
    lexicon = {"en": "the and of to in that with from this over under", "de": "der die und nicht mit von auf ist ein eine auch"}
    prose = lambda la, n: " ".join(rng.choices(lexicon[la].split(), k=n)) + " " + " ".join(f"{rng.choice('bcdfg')}a{rng.randint(0, 10**6)}" for _ in range(n))
    rows = [(k, prose("en" if k % 2 else "de", 40), "en" if k % 2 else "de", "s") for k in range(120)]
    toxic = [(200 + k, prose("en", 30) + " vilewretch scumlord " * 3, "en", "s") for k in range(60)]
    passage = " ".join(f"quiz{k}" for k in range(14))
    bad = [(300, rows[0][1], "de", "s"), (301, rows[2][1] + " more", "de", "s"), (302, prose("en", 30) + " " + passage, "en", "s"), (303, None, None, "s"), (304, "12 34", None, "s")]
    spark.createDataFrame(rows + toxic + bad, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i >= 200)) for i in [*range(120), *range(200, 260)]], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("q", passage)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()} == set(range(120))
    empty = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, empty, str(tmp_path))
        assert left.columns == empty.columns and left.count() == 0, name
