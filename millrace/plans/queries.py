"""The named queries over the driver's tables: each applies operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, ids, text
from ..operators import cascade, chunking, graph, merging, rendering, resolution, splitting, structure, sync
from ..sources import html, registry, tables
from .tables import shared_dir, write_table

BUDGET = 120
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.text_elements(table(spark, sf_dir, "documents"))


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.conversation_elements(table(spark, sf_dir, "conversations"))


def packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return splitting.greedy_packs(table(spark, sf_dir, "documents"), units, text.word_count, BUDGET)


@query
def elements_from_text(spark, d):
    return lines(spark, d).select("doc_id", "pos", "element_type", "html", "text")


@query
def documents_by_type_counts(spark, d):
    both = lines(spark, d).select(F.lit("text").alias("origin"), "element_type").unionByName(talk(spark, d).select(F.lit("talk").alias("origin"), "element_type"))
    return both.groupBy("origin", "element_type").agg(F.count("*").alias("n"))


@query
def chunk_greedy_pack(spark, d):
    return packs(spark, d).select("doc_id", "split_sequence", "split_total", "n_units", "n_tokens", F.sha2("text", 256).alias("content_hash"))


@query
def chunk_ids(spark, d):
    return chunking.chunks(packs(spark, d)).select("chunk_id", "source_id", "split_sequence", "content_hash")


@query
def content_hash_text(spark, d):
    parts = F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), lambda x: F.struct(F.lit("paragraph").alias("element_type"), F.concat(F.lit("<p>"), text.escape(x), F.lit("</p>")).alias("html")))
    return table(spark, d, "documents").select("doc_id", ids.content_hash(F.col("source"), parts).alias("content_hash"))


@query
def exact_duplicate_groups(spark, d):
    seeds = resolution.seeds(table(spark, d, "documents"), "text").select("doc_id", F.sha2("seed", 256).alias("seed"))
    return seeds.groupBy("seed").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


@query
def empty_document_filter(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "source").join(lines(spark, d).select("doc_id").distinct(), "doc_id", "left_semi")


@query
def conv_split_by_headings(spark, d):
    return splitting.split_by_headings(talk(spark, d)).select("doc_id", "pos", "element_type", "split_id")


@query
def conv_hierarchical_split(spark, d):
    return splitting.split_hierarchically(talk(spark, d)).select("doc_id", "pos", "split_level", "split_id")


@query
def conv_heading_context_asof(spark, d):
    return splitting.heading_context(talk(spark, d)).select("doc_id", "pos", "context")


def _sized(spark, d, size):
    return table(spark, d, "part").select("p_partkey", "p_brand", size.cast("double").alias("size"))


@query
def heading_level_dense_rank(spark, d):
    return structure.size_levels(_sized(spark, d, F.col("p_size") % 6), "p_brand", "size").select("p_partkey", "level")


@query
def heading_level_compressed(spark, d):
    return structure.size_levels(_sized(spark, d, F.col("p_size")), "p_brand", "size").select("p_partkey", "level")


@query
def heading_effective_size(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", structure.effective_size(F.col("p_size").cast("double"), F.col("p_name").rlike("a"), F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0).alias("size"))


@query
def heading_normalize(spark, d):
    return structure.normalise_levels(talk(spark, d).where("level is not null")).select("doc_id", "pos", "level")


@query
def main_headings(spark, d):
    return structure.main_heading(talk(spark, d))


@query
def title_detection(spark, d):
    shown = lines(spark, d).select("doc_id", "pos", "text", F.lit(1).alias("level"), F.floor(F.col("pos") / 2).cast("int").alias("page"), (F.length("text") % 7 + 10).cast("double").alias("size"), (F.length("text") % 2 == 0).alias("centred"))
    return structure.detect_title(shown).select("doc_id", "pos", "title")


@query
def looks_like_metadata(spark, d):
    return lines(spark, d).select("doc_id", "pos", text.looks_like_metadata(F.col("text")).alias("is_metadata"))


@query
def pages_elements(spark, d):
    return html.html_elements(table(spark, d, "pages"), "strict")


@query
def pages_structural_unwrap(spark, d):
    return html.html_elements(table(spark, d, "pages"), "unwrap")


@query
def pages_titles(spark, d):
    return html.page_titles(table(spark, d, "pages"))


@query
def pages_markup_richness(spark, d):
    return table(spark, d, "pages").select("page_id", text.markup_richness(F.col("html")).cast("int").alias("richness"))


@query
def sentence_split_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).alias("n_sentences"))


@query
def token_window_slices(spark, d):
    cut = splitting.token_windows(table(spark, d, "documents"))
    return cut.select("doc_id", "slice", "start", "n_tokens", F.sha2("text", 256).alias("text_hash"))


@query
def render_prompt_conversation(spark, d):
    return rendering.render(talk(spark, d), "html").select("doc_id", F.sha2("rendered", 256).alias("html_hash"), F.length("rendered").alias("n_chars"))


@query
def render_plain_conversation(spark, d):
    return rendering.render(talk(spark, d), "plain").select("doc_id", F.sha2("rendered", 256).alias("text_hash"))


def _noted(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id") % 50, "doc_id", "source").toDF("group", "id", "source")
    elements = docs.select(F.col("group").alias("doc_id"), F.col("id").alias("pos"), F.col("id").cast("string").alias("element_id"), F.when(F.col("id") % 4 == 0, "footnote").otherwise("paragraph").alias("element_type"))
    tag = F.concat(F.lit('<p>x<ref id="'), (F.col("id") + F.col("id") % 7 * 50).cast("string"), F.lit('" rel="'), F.when(F.col("id") % 3 == 0, "footnote").when(F.col("id") % 3 == 1, "table").otherwise("unknown"), F.lit('"/></p>'))
    refs = structure.inline_refs(docs.select(F.col("group").alias("doc_id"), F.col("id").alias("pos"), tag.alias("html")))
    return elements, refs


@query
def refs_broken(spark, d):
    elements, refs = _noted(spark, d)
    return structure.broken_refs(refs, elements).select("doc_id", "pos", "target_id", "rel")


@query
def footnotes_orphaned(spark, d):
    elements, refs = _noted(spark, d)
    return structure.orphaned_footnotes(elements, refs).select("doc_id", "element_id")


@query
def footnote_scoring(spark, d):
    cut = lines(spark, d).select("doc_id", F.col("pos").alias("element_pos"), F.substring("text", 1, 50).alias("before"), F.substring("text", 51, 50).alias("after"), F.when(F.length("text") % 3 == 0, 0).otherwise(50).alias("start"))
    scored = cut.withColumn("score", structure.footnote_score(F.col("before"), F.col("after"), F.col("start"), F.col("element_pos") > 1, F.col("element_pos") > 5))
    return structure.best_candidates(scored, ["doc_id"]).select("doc_id", "element_pos", "score")


@query
def group_reachability(spark, d):
    n = table(spark, d, "nation")
    edges = n.select(F.col("n_nationkey").cast("long").alias("src"), (F.col("n_nationkey") * 2 % 25).cast("long").alias("dst")).unionByName(n.select(F.col("n_nationkey").cast("long").alias("src"), (F.col("n_nationkey") + F.col("n_regionkey") % 2).cast("long").alias("dst")))
    return structure.reachable(n.select(F.col("n_nationkey").cast("long").alias("node")), edges)


def _versions(spark, d):
    docs = table(spark, d, "documents").dropDuplicates(["doc_id"])
    now = docs.select(F.col("doc_id").alias("source_id"), F.sha2("text", 256).alias("token"))
    old = docs.where("doc_id % 10 <> 3").select(F.col("doc_id").alias("source_id"), F.when(F.col("doc_id") % 7 == 0, "").when(F.col("doc_id") % 11 == 0, "other").otherwise(F.sha2("text", 256)).alias("token"))
    return now.where("source_id % 13 <> 5"), old


@query
def sync_change_feed(spark, d):
    return sync.change_feed(*_versions(spark, d))


@query
def sync_orphans(spark, d):
    now, old = _versions(spark, d)
    return sync.change_feed(now, old).where("status = 'delete'").select("source_id")


@query
def sync_source_state(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("source_id"), F.when(F.col("source").endswith("1"), "same").otherwise(F.col("lang")).alias("source_hash"), F.lit("").alias("content_hash"))
    return sync.source_state(rows)


@query
def sync_apply_end_state(spark, d):
    now, old = _versions(spark, d)
    feed = sync.change_feed(now, old)
    return sync.end_state(old, feed, now.where("source_id % 17 <> 2")).select("source_id", "token")


@query
def sync_versioned_sink(spark, d):
    now, old = _versions(spark, d)
    sink = lambda rows: rows.select("source_id", F.col("token").alias("source_hash"), F.lit("").alias("content_hash"))
    import uuid

    store = sync.VersionedTable(spark, f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}", buckets=16)
    store.replace(sink(old))
    sync.sync(store, now, sink, "source_id long, source_hash string, content_hash string")
    return store.read().select("source_id", "source_hash")


@query
def split_cascade(spark, d):
    """Conversations cut into parts of at most 160 words: by headings, then elements, sentences and slices."""
    cut = cascade.split_cascade(talk(spark, d), budget=160, overlap=20)
    return cut.select("doc_id", "split_sequence", "split_total", "how", "n_tokens", F.sha2("text", 256).alias("text_hash"))


@query
def mention_finalize_ids(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("source_id"), F.lit(0).alias("split"), F.col("o_orderkey").alias("place"), F.sha2("o_orderpriority", 256).alias("content_hash"), F.concat(F.lit('{"status":"'), F.col("o_orderstatus"), F.lit('"}')).alias("payload"))
    return resolution.finalise_mentions(rows).select("source_id", "place", "ordinal", "mention_id")


def _edges(spark, d):
    edges = table(spark, d, "orders").select(F.col("o_orderkey").alias("edge"), F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 40).alias("dst"))
    customers = table(spark, d, "customer").where("c_custkey % 9 <> 4")
    mapping = customers.select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1000000).alias("new"))
    return edges, mapping


@query
def edge_endpoint_rewrite(spark, d):
    return graph.rewrite_endpoints(*_edges(spark, d))[0].select("edge", "src", "dst")


@query
def edge_orphans(spark, d):
    return graph.rewrite_endpoints(*_edges(spark, d))[1].select("edge", "src", "dst")


@query
def edges_not_dangling(spark, d):
    edges, mapping = _edges(spark, d)
    return graph.drop_dangling(edges, mapping.select(F.col("old").alias("node"))).select("edge", "src", "dst")


@query
def pattern_filter(spark, d):
    c = table(spark, d, "customer")
    edges = c.select(F.col("c_custkey").alias("edge"), F.col("c_mktsegment").alias("src_kind"), F.when(F.col("c_acctbal") < 0, "owes").otherwise("owns").alias("kind"), F.when(F.col("c_nationkey") % 2 == 0, "even").otherwise("odd").alias("dst_kind"))
    return graph.allowed(edges, [("BUILDING", "owes", "even"), ("MACHINERY", "owns", "odd"), ("AUTOMOBILE", "owns", "even")]).select("edge", "src_kind", "kind", "dst_kind")


@query
def graph_neighbors(spark, d):
    c, s, n = (table(spark, d, x) for x in ("customer", "supplier", "nation"))
    edges = c.select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"), F.lit("lives").alias("kind")).unionByName(s.select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"), F.lit("hosts").alias("kind")))
    nodes = c.where("c_custkey % 3 <> 0").select(F.concat(F.lit("c"), "c_custkey").alias("node")).unionByName(s.select(F.concat(F.lit("s"), "s_suppkey").alias("node"))).unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("node")))
    return graph.neighbours(n.select(F.concat(F.lit("n"), "n_nationkey").alias("node")), edges, nodes, ["lives", "hosts"])


@query
def entity_blocking_topk(spark, d):
    return resolution.near_pairs(table(spark, d, "embeddings"), 0.5, 5)


@query
def entity_components(spark, d):
    from ..operators.components import components

    return components(resolution.near_links(table(spark, d, "embeddings"), 0.6))


@query
def entity_canonical(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("mention_id"), "c_nationkey", F.concat_ws("\n", F.concat(F.lit("kind: "), "c_mktsegment"), F.concat(F.lit("sign: "), F.when(F.col("c_acctbal") < 0, "minus"))).alias("identity"), F.col("c_mktsegment").alias("source_id"))
    return resolution.canonical(c, "c_nationkey")


def _dated(spark, d):
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 8
    iso = F.date_format(day, "yyyy-MM-dd")
    year = F.substring(iso, 1, 4)
    form = F.when(k == 0, year).when(k == 1, F.substring(iso, 1, 7)).when(k == 2, iso).when(k == 3, F.concat(F.substring(iso, 1, 3), F.lit("X"))).when(k == 4, F.concat(year, F.lit("~"))).when(k == 5, F.concat(year, F.lit("/.."))).when(k == 6, F.concat(year, F.lit("-"), (year.cast("int") + 3).cast("string"))).otherwise("P1Y")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", form.alias("edtf"))
    return o.withColumns({"begin": dates.start(F.col("edtf")), "stop": dates.end(F.col("edtf")), "precision": dates.precision(F.col("edtf"))})


@query
def fuzzy_date_bounds(spark, d):
    return _dated(spark, d).select("o_orderkey", "edtf", F.col("begin").cast("string").alias("begin"), F.col("stop").cast("string").alias("stop"), "precision")


@query
def date_overlap_query(spark, d):
    rows = _dated(spark, d).withColumns({"has_date": F.col("edtf") != "P1Y", "entity_id": F.col("o_orderkey")})
    return graph.query_entities(rows, F.lit("1995-06-01").cast("date"), F.lit("1995-09-01").cast("date")).select("entity_id", "edtf")


@query
def date_union(spark, d):
    rows = _dated(spark, d).withColumn("has_date", F.col("edtf") != "P1Y")
    return graph.union_dates(rows, ["o_custkey"]).select("o_custkey", F.col("begin").cast("string").alias("begin"), F.col("stop").cast("string").alias("stop"))


@query
def sibling_documents(spark, d):
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("parent_id"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("doc_id"))
    return chunking.siblings(turns)


@query
def metadata_merge_policy(spark, d):
    c = table(spark, d, "conversations")
    a = F.create_map(F.lit("role"), "role", F.lit("turn"), F.col("turn").cast("string"))
    b = F.create_map(F.lit("role"), F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise("other"), F.lit("size"), F.length("text").cast("string"))
    shown = lambda m: F.array_join(F.transform(F.array_sort(F.map_keys(m)), lambda k: F.concat(k, F.lit("="), m[k])), ";")
    return c.select("conv_id", "turn", *(shown(chunking.merge_metadata(a, b, p)).alias(p) for p in ("first", "second", "strict")))


@query
def parser_routing(spark, d):
    kinds = F.element_at(F.array(*map(F.lit, [".html", ".HTM", ".azure.json", "_middle.json", ".pdf", ".document.json", ".bin"])), (F.col("page_id") % 7 + 1).cast("int"))
    files = table(spark, d, "pages").select("page_id", F.concat(F.lit("f"), F.col("page_id").cast("string"), kinds).alias("path"))
    return registry.Registry().route(files).select("page_id", "path", "parser", "error")


@query
def merge_parses(spark, d):
    a = lines(spark, d).select("doc_id", "pos", "html")
    b = a.where("pos % 7 <> 3").select("doc_id", "pos", F.when(F.col("pos") % 5 == 0, F.replace("html", F.lit(" the "), F.lit(" <b>the</b> "))).otherwise(F.col("html")).alias("html"))
    return merging.merge_operations(a, b).select("doc_id", "seq", "op", "reason")


@query
def bm25_terms(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.explode(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")).alias("term"))
    tf = words.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n")).where("df >= 3")


@query
def event_windows(spark, d):
    from ..streaming.sync import event_windows as windows

    return windows(table(spark, d, "events"))


@query
def stream_sync_available_now(spark, d):
    import uuid

    from ..streaming.sync import start

    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows, at = write_table(table(spark, d, "documents").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("source_id"), F.sha2("text", 256).alias("token")), "stream-input")
    store = sync.VersionedTable(spark, f"{folder}/sink", buckets=16)
    sink = lambda r: r.select("source_id", F.col("token").alias("source_hash"), F.lit("").alias("content_hash"))
    start(spark.readStream.schema(rows.schema).parquet(at), store, sink, "source_id long, source_hash string, content_hash string", f"{folder}/state", order="source_id").awaitTermination()
    return store.read().select("source_id", "source_hash")
