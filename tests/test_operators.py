"""Operators one by one, on small made-up tables."""

import json
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import dates, ids, text
from millrace.operators import chunking, graph, merging, rendering, resolution, splitting, structure, sync
from millrace.operators.components import components
from millrace.plans.tables import shared_dir
from millrace.sources import layout, registry
from millrace.sources.html import html_elements, page_elements


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    "edtf, begin, stop",
    [
        ("1984", "1984-01-01", "1985-01-01"), ("1984~", "1983-01-01", "1986-01-01"), ("1984-05", "1984-05-01", "1984-06-01"), ("1984-02-29", "1984-02-29", "1984-03-01"), ("1984-02-29T10:00:00", "1984-02-29", "1984-03-01"), ("198X", "1980-01-01", "1990-01-01"),
        ("19XX", "1900-01-01", "2000-01-01"), ("1984/1986-03", "1984-01-01", "1986-04-01"), ("1984/..", "1984-01-01", None), ("../1984", None, "1985-01-01"), ("1984-1986", "1984-01-01", "1987-01-01"), ("1986-1984", None, None), ("P1Y", None, None), ("", None, None), (None, None, None), ("soon", None, None), ("1984-13", None, None),
    ],
)
def test_fuzzy_dates(spark, edtf, begin, stop):
    e = F.lit(edtf).cast("string")
    assert tuple(one(spark, dates.start(e).cast("string"), dates.end(e).cast("string"))) == (begin, stop)


def test_overlap_is_half_open(spark):
    d = lambda s: F.lit(s).cast("date")
    row = one(spark, dates.overlaps(d("2000-01-01"), d("2001-01-01"), d("2001-01-01"), d(None)), dates.overlaps(d("2000-01-01"), d("2001-01-01"), d("2000-12-31"), d(None)), dates.overlaps(d(None), d(None), d("1900-01-01"), d("1900-01-02")))
    assert tuple(row) == (False, True, True)


def test_text_functions(spark):
    lit = F.lit
    row = one(spark, text.font_size(lit('<p style="font-size: 16px">')), text.font_size(lit("<p>")), text.is_bold(lit('<p style="font-weight: 700">')), text.is_centred(lit('<p style="text-align: center">')), text.all_capitals(lit("ÄB 1")), text.all_capitals(lit("12")), text.heading_level(lit("<H3 a>x</H3>")), text.with_heading_level(lit("<h3 a>x</h3>"), lit(2)), text.squeeze_blank_lines(lit("a\n\n\n\nb\n\n\nc\nd")), text.visible(lit("<p>- a &amp; b -</p>\n")))
    assert tuple(row) == (12.0, None, True, True, True, False, 3, "<h2 a>x</h2>", "a\n\nb\n\nc\nd", "a & b")
    df = spark.createDataFrame([("ＡＢ  “q”. H~2~O",), (None,)], "t string").select(text.comparison_form("t"))
    assert [r[0] for r in df.collect()] == ['ab "q" h2o', None]
    assert abs(one(spark, text.cosine(F.array(lit(1.0), lit(0.0)), F.array(lit(1.0), lit(1.0))))[0] - 0.70710678) < 1e-6


def test_ids_equal_python(spark):
    import hashlib

    chunk = one(spark, ids.chunk_id(F.lit("s"), F.lit(2), F.lit(None), F.lit("h")))[0]
    assert chunk == str(uuid.UUID(hashlib.sha256("s\x1f2\x1f\x1fh".encode()).hexdigest()[:32]))
    assert one(spark, ids.entity_id(F.array(F.lit("b"), F.lit("a"))))[0] == hashlib.sha256(b"a\x00b").hexdigest()
    empty = F.array().cast("array<struct<element_type:string,html:string>>")
    want = hashlib.sha256((ids.DOMAIN + '{"elements":[],"title":null}').encode()).hexdigest()
    assert one(spark, ids.content_hash(F.lit(None).cast("string"), empty))[0] == want
    quoted = hashlib.sha256((ids.DOMAIN + '{"elements":[],"title":' + json.dumps('a"b\\é/', ensure_ascii=False) + "}").encode()).hexdigest()
    assert one(spark, ids.content_hash(F.lit('a"b\\é/'), empty))[0] == quoted
    assert tuple(one(spark, ids.source_of(F.lit(""), F.lit("p"), F.lit("i")), ids.token_of(F.lit("")))) == ("p", None)


PAGE = "<html><head><title>T</title></head><body><nav>n</nav><div>ad</div><article><h1>A</h1><p>x<b>y</p><aside class=footnote>f</aside><aside>gone</aside></article><h7>deep</h7><p class=heading>h</p><p id='fn_3'>[3] note</p><table><thead><tr><th>only</th></tr></thead><tbody></tbody></table><img src='http://x'></body></html>"


def test_html_modes(spark):
    title, strict = page_elements(PAGE)
    assert title == "T"
    assert [(e[0], e[1], e[3], e[4]) for e in strict] == [("paragraph", None, "ad", None), ("heading", 6, "deep", None), ("heading", 6, "h", None), ("footnote", None, "note", 3), ("paragraph", None, "only", None)]
    unwrapped = page_elements(PAGE, "unwrap")[1]
    assert [(e[0], e[3]) for e in unwrapped][:4] == [("paragraph", "ad"), ("heading", "A"), ("paragraph", "xy"), ("footnote", "f")]
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string")
    assert html_elements(df, "unwrap").groupBy("page_id").count().collect()[0]["count"] == len(unwrapped)
    with pytest.raises(ValueError):
        html_elements(df, "other")


def test_layout(spark):
    span = lambda s, **k: {"type": "text", "content": s, **k}
    block = lambda kind, *texts, **k: {"type": kind, "bbox": [0.0, 0.0, 9.0, 9.0], "lines": [{"bbox": [0.0, 10.0 * i, 5.0, 10.0 * i + 8.25], "spans": [span(t)]} for i, t in enumerate(texts)], **k}
    table = {"type": "table", "bbox": [], "lines": [], "blocks": [{"type": "table_body", "bbox": [], "lines": [{"bbox": [], "spans": [{"type": "table", "html": "<table></table>"}]}]}]}
    body = {"pdf_info": [{"page_idx": 0, "para_blocks": [block("title", "A & B"), block("text", "one", "two"), block("text", " "), table, block("code", "x", " y"), block("list", "i", "j")], "discarded_blocks": [block("page_footnote", "12 note"), block("header", "head")]}]}
    docs = spark.createDataFrame([(1, json.dumps(body)), (2, "{}"), (3, None)], "doc_id int, json string")
    got = [(r.element_type, r.html, r.footnote) for r in layout.layout_elements(docs).orderBy("page", "nth").collect()]
    assert got == [("heading", "<h1>A &amp; B</h1>", None), ("paragraph", "<p>one two</p>", None), ("table", "<table></table>", None), ("raw_text", "<div><pre><code>x\n y</code></pre></div>", None), ("list", "<ul><li>i</li><li>j</li></ul>", None), ("footnote", "<aside>note</aside>", 12), ("raw_text", "<div>head</div>", None)]
    assert [r.doc_id for r in layout.layout_errors(docs).collect()] == [2]
    assert layout.layout_elements(docs).where("element_type = 'heading'").first().line_height == 8.2


def test_snapshots(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "1", "title": "t", "source_path": "p", "source_hash": "h", "elements": [{"id": "e", "element_type": "paragraph", "html": "<p/>", "page": 1}], "metadata": {"k": "v"}}))
    (tmp_path / "b.json").write_text("{broken")
    rows = layout.read_snapshots(spark, str(tmp_path)).collect()
    assert sorted((r.id or "", r.bad is not None) for r in rows) == [("", True), ("1", False)]
    stored = layout.read_snapshots(spark, str(tmp_path), "file").where("id = '1'").first()
    assert stored.source_path.endswith("a.json") and stored.source_hash is None


def test_registry(spark):
    r = registry.Registry()
    r.register(registry.Format("mine", ".html", 5))
    assert [x.name for x in r.get("mine")] == ["mine"] and ".html" in r.describe()
    routed = {x.path: (x.parser, x.error) for x in r.route(spark.createDataFrame([("a.HTML",), ("b.pdf",), ("c",)], "path string")).collect()}
    assert routed == {"a.HTML": ("mine", None), "b.pdf": (None, "needs a service key"), "c": (None, "no parser for this suffix")}
    r.unregister(".html", "mine")
    for wrong in (lambda: r.get("mine"), lambda: r.unregister(".html", "mine")):
        with pytest.raises(KeyError):
            wrong()
    stamped = registry.stamp(spark.createDataFrame([("x/y.txt", None)], "path string, parser string"), "text", "path").first()
    assert (stamped.parser, stamped.filename) == ("text", "y.txt")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=40), st.integers(1, 40))
def test_packing_in_order_conserves_and_fits(sizes, budget):
    import pandas as pd

    made = splitting.pack_in_order.func(pd.Series([sizes]), pd.Series([budget]))[0]
    assert all(total == sum(sizes[first : first + n]) and n > 0 for first, n, total in made)
    packs = [k for k, (_, n, _) in enumerate(made) for _ in range(n)]
    assert len(packs) == len(sizes) and packs == sorted(packs) and set(packs) == set(range(len(set(packs))))
    for k in set(packs):
        mine = [s for s, p in zip(sizes, packs) if p == k]
        assert sum(mine) <= budget or len(mine) == 1 or sum(mine[:-1]) == 0 or all(s == 0 for s in mine[1:])


def test_windows_lose_no_word(spark):
    words = [f"w{i}" for i in range(137)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, ""), (3, "a"), (4, None)], "doc_id int, text string")
    for size, overlap in ((10, 3), (137, 0), (50, 49)):
        rows = splitting.token_windows(df, size=size, overlap=overlap).where("doc_id = 1").orderBy("slice").collect()
        seen = {}
        for r in rows:
            for i, w in enumerate(r.text.split()):
                seen[r.start + i] = w
        assert [seen[i] for i in range(137)] == words and all(r.n_tokens <= size for r in rows)
    with pytest.raises(ValueError):
        splitting.token_windows(df, size=5, overlap=5)


def test_footnotes(spark):
    elements = spark.createDataFrame([(1, 0, "paragraph", 1, "As shown.1 2 and 12 more"), (1, 1, "paragraph", 2, "page two 1"), (1, 2, "footnote", 1, "1 x")], "doc_id int, pos int, element_type string, page int, text string")
    notes = spark.createDataFrame([(1, 1, 1), (1, 1, 12)], "doc_id int, page int, number int")
    got = sorted((r.number, r.start, r.before, r.after) for r in structure.footnote_candidates(elements, notes).collect())
    assert got == [(1, 9, "As shown.", " 2 and 12 more"), (12, 9, "As shown.", " and 12 more"), (12, 17, "As shown.1 2 and ", " more")]
    scored = structure.footnote_score(F.lit("As shown."), F.lit(" x"), F.lit(9), F.lit(True), F.lit(False))
    assert one(spark, scored)[0] == 4


def test_refs_and_rendering(spark):
    elements = spark.createDataFrame([(1, 0, '<p>a <ref id="x" rel="image"/> b <ref id="y" rel="table"/><ref rel="image"/></p>'), (1, 1, "<p>c</p>")], "doc_id int, pos int, html string")
    assert [(r.target_id, r.rel) for r in structure.inline_refs(elements.where("pos = 0").withColumn("html", F.regexp_replace("html", "<ref rel[^>]*>", ""))).orderBy("nth").collect()] == [("x", "image"), ("y", "table")]
    inline = spark.createDataFrame([(1, "x", "[pic]")], "doc_id int, target_id string, shown string")
    done = {r.pos: r.html for r in rendering.resolve_refs(elements, inline).collect()}
    assert done == {0: "<p>a [pic] b [missing ref: y][invalid ref: no id]</p>", 1: "<p>c</p>"}
    assert rendering.markdown("<h2>T</h2><p>a <b>b</b> <i>c</i></p><ul><li>x</li><li>y<ol><li>z</li></ol></li></ul><a href='u'>l</a>") == "## T\n\na **b** *c*\n\n- x\n- y\n\n  1. z[l](u)"
    assert rendering.render(elements.where("pos = 1"), "markdown").first().rendered == "c"


def test_chunks_and_metadata(spark):
    splits = spark.createDataFrame([(1, 0, 1, "t", 1)], "doc_id int, split_sequence int, split_total int, text string, n_tokens int")
    topics = chunking.topic_chunks(splits, F.array(F.lit("a"), F.lit(" "), F.lit("b"))).collect()
    assert [(r.ordinal, r.embedding_content, r.text) for r in topics] == [(0, "a", "t"), (1, "b", "t")] and len({r.chunk_id for r in topics}) == 2
    assert chunking.topic_chunks(splits, F.array(F.lit(" "))).first().embedding_content == "t"
    embed = chunking.embedder(lambda ts: [[float(len(t))] for t in ts], batch=2)
    assert sorted(r[0][0] for r in spark.createDataFrame([("a",), ("bb",), (None,)], "t string").select(embed("t")).collect()) == [0.0, 1.0, 2.0]
    a, b = spark.createDataFrame([(1, 0), (1, 1)], "doc_id int, pos int"), spark.createDataFrame([(1, 0), (2, 0)], "doc_id int, pos int")
    assert sorted(map(tuple, chunking.concatenate(a, b).collect())) == [(1, 0), (1, 1), (1, 2), (2, 0)]


def test_merging():
    a = [(0, "<p>Title here</p>"), (1, "<p>same text</p>"), (2, "<p>only in a at all</p>"), (3, "<p>the last one</p>")]
    b = [(0, "<p>Title <b>here</b></p>"), (1, "<p>same text</p>"), (2, "<p>the last one</p>"), (3, "<img>")]
    ops = merging.align(a, b)
    assert [(o[0], o[1], o[2]) for o in ops] == [("merge", [0], [0]), ("keep", [1], [1]), ("delete", [2], []), ("keep", [3], [2]), ("insert", [], [3])]
    assert ops[0][3] == "<p>Title <b>here</b></p>" and ops[0][4] == "richer b"
    assert all(o[0] != "insert" for o in merging.align(a, b, insertions=False)) and merging.align([], []) == []


def test_merging_passes_documents_through_batches(spark):
    docs = {d: [(p, f"<p>line {p * d % 5} of {d}</p>") for p in range(d % 9)] for d in range(40)} | {None: [(0, "<p>no id</p>")]}
    other = {d: [(p, h.replace("line", "<b>line</b>") if p % 3 else h) for p, h in e if p % 4 != 2] for d, e in docs.items() if d != 7} | {99: [(0, "<p>new</p>")]}
    frame = lambda x: spark.createDataFrame([(d, p, h) for d, e in x.items() for p, h in e], "doc_id long, pos int, html string").repartition(5)
    want = {(d, n, o[0], *map(tuple, o[1:3]), *o[3:]) for d in docs.keys() | other.keys() for n, o in enumerate(merging.align(docs.get(d, []), other.get(d, [])))}
    key, had = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, "3")
    try:
        ops = merging.merge_operations(frame(docs), frame(other))
        got = [(r.doc_id, r.seq, r.op, tuple(r.a_pos), tuple(r.b_pos), r.html, r.reason) for r in ops.collect()]
    finally:
        spark.conf.set(key, had)
    assert len(got) == len(want) and set(got) == want
    assert "MapInArrow" in ops._jdf.queryExecution().toString() and "FlatMapGroups" not in ops._jdf.queryExecution().toString()


def test_resolution_rounds(spark):
    table = {"ann": [1.0, 0.0], "anna": [0.99, 0.1], "ann | anna": [0.0, 1.0], "bob": [0.02, 1.0], "cy": [-1.0, 0.0]}
    mentions = spark.createDataFrame([(i, n) for i, n in enumerate(["ann", "anna", "bob", "cy"])], "cluster long, identity string")
    embed = chunking.embedder(lambda ts: [table.get(t, [-1.0, -1.0]) for t in ts])
    everything = lambda p: p.withColumns({"merge": F.lit(True), "pending": F.lit(False)})
    done = resolution.resolve(mentions, embed, everything, least=0.95, rounds=3)
    groups = {}
    for r in done.entities.collect():
        groups.setdefault(r.root, set()).add(r.identity)
    assert sorted(map(sorted, groups.values())) == [["ann", "anna", "bob"], ["cy"]]
    capped = resolution.resolve(mentions, embed, everything, least=0.95, rounds=1)
    assert capped.entities.select("root").distinct().count() == 3
    waits = resolution.resolve(mentions, embed, lambda p: p.withColumns({"merge": F.lit(False), "pending": F.lit(True)}), least=0.95)
    assert waits.pending.count() == 2 and waits.rounds == 1


def test_near_pairs_across_blocks(spark):
    import numpy as np

    v = np.random.default_rng(0).normal(size=(150, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.5)) if i != j}
    got = {(r.id, r.near_id) for r in resolution.near_pairs(df, 0.5, None, block=20).collect()}
    assert got == want


def moved_rows(spark, df):
    """Rows that are written to shuffles while ``df`` is computed."""
    store, doubles = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._gateway.jvm.double, 0)

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, doubles, None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = total()
    rows = df().collect()
    return total() - before, rows


def test_near_pairs_move_vectors_once(spark):
    import numpy as np

    v = np.random.default_rng(1).normal(size=(4000, 16)).astype(np.float32)
    v[1000:1300] = v[0] + 0.001 * v[1000:1300]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").cache()
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    sims = np.round(u @ u.T, 6)
    np.fill_diagonal(sims, -1)
    want = {}
    for i, j in zip(*np.nonzero(sims >= 0.9)):
        want.setdefault(int(i), []).append((-sims[i, j], int(j)))
    moved, rows = moved_rows(spark, lambda: resolution.near_pairs(df, 0.9, 5))
    assert moved < 4000 + 6 * 4000
    assert {(r.id, r.near_id, r["rank"]) for r in rows} == {(i, j, k) for i, found in want.items() for k, (_, j) in enumerate(sorted(found)[:5], 1)}


def test_near_pairs_at_the_threshold(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [6.0, 8.0]), (2, [4.0, 3.0]), (3, [0.0, 0.0]), (4, None), (None, [3.0, 4.0])], "vec_id long, embedding array<double>")
    for block in (1, 2, 100):
        assert sorted(map(tuple, resolution.near_pairs(df, 1.0, 5, block=block).collect())) == [(1, 2, 1.0, 1), (2, 1, 1.0, 1)]
    with pytest.raises(Exception, match="differ in length"):
        resolution.near_pairs(spark.createDataFrame([(1, [3.0]), (2, [6.0, 8.0])], "vec_id long, embedding array<double>"), 0.5).collect()


@pytest.mark.parametrize("block", [40, 100_000])
def test_near_links_have_the_components_of_all_pairs(spark, block):
    import numpy as np

    rng = np.random.default_rng(2)
    v = np.concatenate([np.repeat(rng.normal(size=(1, 8)), 200, 0) + 0.01 * rng.normal(size=(200, 8)), rng.normal(size=(300, 8))])
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(rng.permutation(500) + 7, v)], "vec_id long, embedding array<double>")
    rooted = lambda edges: set(map(tuple, components(edges.toDF("u", "v")).collect()))
    links = resolution.near_links(df, 0.85, block=block)
    assert rooted(links) == rooted(resolution.near_pairs(df, 0.85, None, block=block).select("id", "near_id"))
    assert block == 40 or links.count() < 500


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", "k"), ("b", "b", "k"), ("c", "a", "m"), ("a", "zz", "k")], "src string, dst string, kind string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    step = lambda kinds=None: sorted(map(tuple, graph.neighbours(nodes, edges, nodes, kinds).collect()))
    assert step() == [("a", "b"), ("a", "c"), ("b", "a"), ("b", "b"), ("c", "a")] and step(["m"]) == [("a", "c"), ("c", "a")]
    assert graph.drop_dangling(edges, nodes).count() == 3
    rows = spark.createDataFrame([("1", True, None, None, "x"), ("2", False, None, None, "x")], "entity_id string, has_date boolean, begin date, stop date, f string")
    assert [r.entity_id for r in graph.query_entities(rows, F.lit("1900-01-01").cast("date"), None, {"f": "x"}, 5).collect()] == ["1"]


SINK = "source_id string, source_hash string, content_hash string, row int"


def test_sync_contract_and_crashes(spark):
    store = sync.VersionedTable(spark, f"{shared_dir(spark)}/contract-{uuid.uuid4().hex}")
    produce = lambda s: s.select("source_id", F.col("token").alias("source_hash"), F.lit("").alias("content_hash"), F.explode(F.sequence(F.lit(1), F.length("source_id"))).alias("row"))
    first = spark.createDataFrame([("a", "1"), ("bb", "1"), ("c", None)], "source_id string, token string")
    status = lambda f: {r.source_id: r.status for r in f.collect()}
    assert status(sync.sync(store, first, produce, SINK)) == {"a": "add", "bb": "add", "c": "add"}
    second = spark.createDataFrame([("a", "1"), ("bb", "2"), ("d", "1")], "source_id string, token string")
    before = sorted(map(tuple, store.read().collect()))
    store.stage(store.read().limit(1))  # a crash between staging and commit leaves the old table
    assert sorted(map(tuple, store.read().collect())) == before
    feed = sync.change_feed(second, sync.source_state(store.read()).withColumn("token", F.col("source_hash")))
    assert status(feed) == {"a": "skip", "bb": "update", "c": "delete", "d": "add"}
    sync.sync(store, second, produce, SINK)
    assert sorted((r.source_id, r.source_hash, r.row) for r in store.read().collect()) == [("a", "1", 1), ("bb", "2", 1), ("bb", "2", 2), ("d", "1", 1)]
    assert set(status(sync.sync(store, second, produce, SINK)).values()) == {"skip"}
    assert store.vacuum() >= 3 and store.read().count() == 4
    mixed = spark.createDataFrame([("s", "1", "", 1), ("s", "2", "", 2)], SINK)
    assert sync.source_state(mixed).first().source_hash is None
    assert sync.repeated_sources(first.union(first.where("source_id = 'a'"))).first().source_id == "a"


def test_untouched_buckets_keep_their_files_and_writers_conflict(spark):
    store = sync.VersionedTable(spark, f"{shared_dir(spark)}/buckets-{uuid.uuid4().hex}", buckets=8)
    rows = spark.createDataFrame([(f"s{i}", "1", "", i) for i in range(100)], SINK)
    assert store.replace(rows) == 1
    before = store._manifest()["buckets"]
    other = sync.VersionedTable(spark, store.folder, buckets=8)
    assert other.delete_keys(spark.createDataFrame([("s7",)], "source_id string")) == 2
    after = other._manifest()["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1 and sorted(r.row for r in store.read().collect()) == [i for i in range(100) if i != 7]
    with pytest.raises(sync.Conflict):
        store.replace(rows, expected=1)
    held = store._manifest
    store._manifest = lambda: {**held(), "version": 1}  # read before the other writer committed
    with pytest.raises(sync.Conflict):
        store.replace(rows, expected=1)
    assert other.read().count() == 99


def test_packs_of_a_long_text_are_linear(spark):
    from millrace.operators import splitting

    text = "\n".join(f"line {i} of some words" for i in range(200_000))
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    units = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    got = splitting.greedy_packs(df, units, lambda u: F.size(F.split(u, " ")), 50)
    assert got.agg(F.count("*"), F.sum("n_units"), F.max("n_tokens"), F.max("split_total")).first()[:] == (20_000, 200_000, 50, 20_000)


def test_stream_is_idempotent(spark, tmp_path):
    from millrace.streaming.sync import apply_batch

    store = sync.VersionedTable(spark, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}")
    batch = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "source_id string, token string")
    run = apply_batch(store, lambda s: s.select("source_id", F.col("token").alias("source_hash"), F.lit("").alias("content_hash"), F.lit(1).alias("row")), SINK, order="token")
    for n in (0, 0):
        run(batch, n)
    assert sorted((r.source_id, r.source_hash) for r in store.read().collect()) == [("a", "2"), ("b", "1")]
