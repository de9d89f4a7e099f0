"""Queries: similarity graph, retrieval and expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import retrieval as R
from ..operators.rollups import source_stats
from .registry import query
from .views import read, view

COS = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"
EDGES_SQL = f"""with e as (select a.id as src_id, b.id as dst_id, {COS} as w from f_nodes a join f_nodes b on a.tenant_id = b.tenant_id and a.id <> b.id where {COS} >= 0.3) select src_id, dst_id, round(w, 6) as weight from e qualify row_number() over (partition by src_id order by w desc, dst_id) <= 10"""


@query(EDGES_SQL, ("f_nodes",))
def k2_similarity_edges(spark, d):
    return G.similarity_edges(view(spark, d, "f_nodes"), 0.3, 10).withColumn("weight", F.round("weight", 6))


@query(EDGES_SQL.replace("a.tenant_id = b.tenant_id", "a.client_id = b.client_id").replace("0.3)", "0.2)"), ("f_nodes",))
def k3_client_edges(spark, d):
    """Nodes are compared within their client only."""
    return G.similarity_edges(view(spark, d, "f_nodes"), 0.2, 10, "client_id").withColumn("weight", F.round("weight", 6))


@query(EDGES_SQL, ("f_nodes",))
def k4_extend_edges(spark, d):
    """The edges of three batches of nodes, each added to what the one before left; equal to the edges of all nodes at once."""
    nodes = view(spark, d, "f_nodes")
    edges, so_far = None, None
    for k in range(3):
        added = nodes.where(F.pmod(F.xxhash64("id"), F.lit(3)) == k)
        edges = G.similarity_edges(added, 0.3, 10) if edges is None else G.extend_edges(so_far, edges, added, 0.3, 10)
        so_far = added if so_far is None else so_far.unionByName(added)
    return edges.withColumn("weight", F.round("weight", 6))


@query(f"select a.vec_id as src_id, b.vec_id as dst_id, round({COS}, 6) as weight from embeddings a join embeddings b on a.vec_id <> b.vec_id and {COS} >= 0.3")
def j8_cosine_expression(spark, d):
    """All pairs of vectors at a cosine of 0.3 or more."""
    return G.theta_pairs(read(spark, d, "embeddings").withColumnRenamed("vec_id", "id"), 0.3).withColumn("weight", F.round("weight", 6))


def chunk_id():
    """One number for each chunk: no two documents share one, however many lines they have."""
    return F.col("document_id").cast("long") * (1 << 32) + F.col("chunk_index")


@query(
    """select 'chunk:' || (cast(c.document_id as bigint) * 4294967296 + chunk_index) as node_key, d.client_id, 'Chunk ' || chunk_index as name, case when length(t) > 80 then substring(t, 1, 80) || '…' else t end as description, cast(c.document_id as varchar) as doc
    from (select *, replace(regexp_replace(content, '^\\s+|\\s+$', '', 'g'), chr(10), ' ') as t from f_chunks) c join f_documents d on d.id = c.document_id""",
    ("f_chunks", "f_documents"))
def k1_chunk_nodes(spark, d):
    """A node for every chunk."""
    chunks = view(spark, d, "f_chunks").withColumn("id", chunk_id())
    return G.chunk_nodes(chunks, view(spark, d, "f_documents")).select("node_key", "client_id", "name", "description", F.col("properties")["document_id"].alias("doc"))


STORED = "tenant_id string, client_id string, {}, properties map<string,string>, seen_count long, last_seen_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz"


@query(
    f"""with firsts as (select document_id, min(chunk_index) as chunk_index from f_chunks group by document_id),
    c as (select cast(f.document_id as bigint) * 4294967296 + f.chunk_index as id, f.tenant_id, e.embedding from f_chunks f left join firsts using (document_id, chunk_index) left join embeddings e on e.vec_id = firsts.document_id), v as (select * from c where embedding is not null),
    e as (select a.id as src, b.id as dst from v a join v b on a.tenant_id = b.tenant_id and a.id <> b.id where {COS} >= 0.25 qualify row_number() over (partition by a.id order by {COS} desc, b.id) <= 10)
    select (select count(*) from c) as fetched, (select count(*) from v) as valid, (select count(*) from c) - (select count(*) from v) as skipped, (select count(*) from e) as edges, (select count(*) from v) as nodes, (select count(distinct id) from v) as stored_nodes, (select count(*) from (select distinct src, dst from e)) as stored_edges""",
    ("f_chunks",))
def k4_build_graph(spark, d):
    """The build over every chunk, merged into empty tables, and its summary (A6). A document's vector is its first chunk's; the others are skipped."""
    chunks = view(spark, d, "f_chunks")
    firsts = chunks.groupBy("document_id").agg(F.min("chunk_index").alias("chunk_index"))
    vectors = firsts.join(read(spark, d, "embeddings").select(F.col("vec_id").alias("document_id"), "embedding"), "document_id")
    chunks = chunks.withColumn("id", chunk_id()).join(vectors, ["document_id", "chunk_index"], "left")
    nodes, edges, summary = G.build_graph(chunks, view(spark, d, "f_documents"), 64, 0.25, 10)
    stored_nodes = spark.createDataFrame([], STORED.format("node_key string, type string, name string, description string, status string, embedding array<float>"))
    stored_edges = spark.createDataFrame([], STORED.format("src_id long, dst_id long, rel_type string, weight double, is_active boolean"))
    kept = G.merge_graph(nodes, edges, stored_nodes, stored_edges, "2024-01-01")
    for name, table in zip(("stored_nodes", "stored_edges"), kept, strict=True):
        summary = summary.join(F.broadcast(table.agg(F.count(F.lit(1)).alias(name))))
    return summary


@query("select event_type, count(*) filter (where kind = 'Chunk') as valid, count(*) filter (where kind <> 'Chunk') as rejected from (select event_type, case when event_id % 3 = 0 then 'Chunk' else 'Video' end as kind from events) group by event_type")
def k5_validate_types(spark, d):
    rows = read(spark, d, "events").select("event_type", F.when(F.col("event_id") % 3 == 0, "Chunk").otherwise("Video").alias("type"))
    ok, bad = G.validate_node_type(rows)
    marked = ok.withColumn("good", F.lit(True)).unionByName(bad.withColumn("good", F.lit(False)))
    return marked.groupBy("event_type").agg(F.count_if("good").alias("valid"), F.count_if(~F.col("good")).alias("rejected"))


def query_table(spark, d):
    """Every twentieth vector asks."""
    return read(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


HITS = f"""hits as (select a.vec_id as query_id, b.id as node_id, {COS} as sim, row_number() over (partition by a.vec_id order by {COS} desc, b.id) as rank from embeddings a join f_nodes b on true where a.vec_id % 20 = 0 and b.status = 'active' qualify rank <= {{}})"""


@query("with " + HITS.format(5) + " select query_id, node_id, round(sim, 6) as similarity, cast(rank as int) as rank from hits", ("f_nodes",))
def g1_semantic_search(spark, d):
    return R.semantic_search(view(spark, d, "f_nodes"), query_table(spark, d), 5).withColumn("similarity", F.round("similarity", 6))


@query("with " + HITS.format(50) + " select query_id, node_id, cast(rank as int) as rank, round(sim, 6) as similarity from hits", ("f_nodes",))
def g8_all_nodes(spark, d):
    """The widest dump: 50 nodes a query, the operator's bound."""
    return R.semantic_search(view(spark, d, "f_nodes"), query_table(spark, d), 50).withColumn("similarity", F.round("similarity", 6))


NEAR = "near as (select * from (select src_id, dst_id, weight, row_number() over (partition by src_id order by weight desc, dst_id) as k from f_edges where is_active and weight >= 0.2) where k <= 3 and dst_id in (select id from f_nodes where status = 'active'))"


@query("with " + NEAR + " select src_id, dst_id, weight, cast(k as int) as k from near", ("f_nodes", "f_edges"))
def g2_neighbours(spark, d):
    return R.neighbours(view(spark, d, "f_edges"), view(spark, d, "f_nodes"), 3, 0.2)


def searched(spark, d, k=5):
    nodes = view(spark, d, "f_nodes")
    return R.graph_search(R.semantic_search(nodes, query_table(spark, d), k), R.neighbours(view(spark, d, "f_edges"), nodes, 3, 0.2))


#: The expansion as a fold over each query's seeds by rank.
SEARCH = (
    HITS.format(5) + ", " + NEAR + """, lists as (select src_id, list(dst_id order by k) as near from near group by src_id),
    seeds as (select query_id, list({'node': node_id, 'sim': round(sim, 4), 'near': coalesce(near, []::bigint[]), 'found': []::struct(node bigint, source varchar, sim double)[]} order by rank) as seeds from hits left join lists on src_id = node_id group by query_id),
    folded as (select query_id, list_reduce(seeds, lambda a, s: {'node': a.node, 'sim': a.sim, 'near': a.near, 'found': case when list_contains(list_transform(a.found, lambda r: r.node), s.node) then a.found
      else a.found || [{'node': s.node, 'source': 'vector', 'sim': s.sim}] || list_transform(list_filter(s.near, lambda x: x <> s.node and not list_contains(list_transform(a.found, lambda r: r.node), x)), lambda x: {'node': x, 'source': 'graph_expansion', 'sim': null::double}) end},
      {'node': 0::bigint, 'sim': 0::double, 'near': []::bigint[], 'found': []::struct(node bigint, source varchar, sim double)[]}) as f from seeds),
    searched as (select query_id, pos - 1 as pos, r.node as node_id, r.source as source, r.sim as similarity from (select query_id, unnest(f.found) as r, generate_subscripts(f.found, 1) as pos from folded))"""
)
#: Results with a node's whole text, which no single chunk index names.
HYDRATED = SEARCH + """, firsts as (select id as document_id, cast(null as int) as chunk_index, text as content from f_documents),
    hydrated as (select s.*, case when c.document_id is null then '' when c.document_id % 5 <> 0 and content <> '' then content when c.document_id % 10 <> 0 and substring(content, 1, 80) <> '' then substring(content, 1, 80) else 'a name' end as content, c.document_id, c.chunk_index from searched s left join firsts c on c.document_id = s.node_id)"""
HYDRATED_VIEWS = ("f_nodes", "f_edges", "f_documents")


@query("with " + SEARCH + " select * from searched", ("f_nodes", "f_edges"))
def g3_graph_search(spark, d):
    return searched(spark, d)


def hydrated(spark, d):
    chunks = view(spark, d, "f_documents").select(F.col("id").alias("document_id"), F.lit(None).cast("int").alias("chunk_index"), F.col("text").alias("content"))
    texts = chunks.select(F.col("document_id").alias("node_id"), F.when(F.col("document_id") % 5 != 0, F.col("content")).alias("content"), F.when(F.col("document_id") % 10 != 0, F.substring("content", 1, 80)).alias("description"), F.lit("a name").alias("name"), "document_id", "chunk_index")
    return R.hydrate(searched(spark, d), texts)


@query("with " + HYDRATED + " select * from hydrated", HYDRATED_VIEWS)
def g4_result_rows(spark, d):
    """Results with their text, by fallbacks (J7)."""
    return hydrated(spark, d)


@query("with " + SEARCH + " select query_id, count(*) filter (where source = 'vector') as seed_nodes, count(*) filter (where source = 'graph_expansion') as expanded_nodes from searched group by query_id", ("f_nodes", "f_edges"))
def g5_expansion_counts(spark, d):
    return R.expansion_counts(searched(spark, d))


@query("with " + HITS.format(5) + " select q.vec_id as query_id, round(coalesce(max(sim), 0), 4) as top_score, case when max(sim) is null then 'empty' when round(max(sim), 4) >= 0.6 then 'answer' else 'low_confidence' end as outcome from embeddings q left join hits on hits.query_id = q.vec_id where q.vec_id % 20 = 0 group by q.vec_id", ("f_nodes",))
def g6_confidence_gate(spark, d):
    return R.confidence_gate(searched(spark, d), query_table(spark, d))


@query("with " + HITS.format(10) + ", t as (select *, max(sim) over (partition by query_id) as top from hits) select query_id, node_id, cast(rank as int) as rank, case when top >= 0.6 then 1 else 2 end as attempt from t where top < 0.6 or rank <= 5", ("f_nodes",))
def g7_retry(spark, d):
    return R.retrieve_with_retry(R.semantic_search(view(spark, d, "f_nodes"), query_table(spark, d), 10)).select("query_id", "node_id", "rank", "attempt")


@query(
    "with " + HYDRATED + """ select query_id, cast(count(*) as int) as n, string_agg('- ' || coalesce(cast(document_id as varchar), 'unknown') || ' (chunk ' || coalesce(cast(chunk_index as varchar), '?') || ')', chr(10) order by pos) filter (where pos < 5) as listing,
    string_agg('[' || source || ' | Score: ' || coalesce(cast(similarity as varchar), 'N/A') || '] ' || substring(content, 1, 500), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by pos) as scored from hydrated group by query_id""",
    HYDRATED_VIEWS)
def g9_format_sources(spark, d):
    return R.format_sources(hydrated(spark, d)).select("query_id", F.size("sources").alias("n"), "listing", "scored")


@query(
    "with recursive_base as (select 1), " + NEAR + """, h0 as (select vec_id as query_id, vec_id as node_id from embeddings where vec_id % 20 = 0), h1 as (select query_id, dst_id as node_id, src_id as parent from (select h0.query_id, n.dst_id, n.src_id, n.weight from h0 join near n on n.src_id = h0.node_id where (h0.query_id, n.dst_id) not in (select query_id, node_id from h0)) qualify row_number() over (partition by query_id, dst_id order by weight desc, src_id) = 1),
    h2 as (select query_id, dst_id as node_id, src_id as parent from (select h1.query_id, n.dst_id, n.src_id, n.weight from h1 join near n on n.src_id = h1.node_id where (h1.query_id, n.dst_id) not in (select query_id, node_id from h0 union all select query_id, node_id from h1)) qualify row_number() over (partition by query_id, dst_id order by weight desc, src_id) = 1)
    select query_id, node_id, 0 as hop, null::bigint as parent from h0 union all select query_id, node_id, 1, parent from h1 union all select query_id, node_id, 2, parent from h2""",
    ("f_nodes", "f_edges"),
)
def g10_expand_hops(spark, d):
    near = R.neighbours(view(spark, d, "f_edges"), view(spark, d, "f_nodes"), 3, 0.2)
    seeds = query_table(spark, d).select("query_id", F.col("query_id").alias("node_id"))
    return R.expand_hops(seeds, near, 2)


@query(
    "select document_id as query_id, string_agg(case when trim(content, ' ' || chr(9) || chr(13)) <> '' then '[Source ' || rn || ']' || chr(10) || content end, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rn) as context from (select *, row_number() over (partition by document_id order by chunk_index) as rn from f_chunks) group by document_id",
    ("f_chunks",),
)
def c1_assemble_context(spark, d):
    return R.assemble_context(view(spark, d, "f_chunks").select(F.col("document_id").alias("query_id"), F.col("chunk_index").alias("pos"), "content"))


@query("with " + HYDRATED + " select query_id, string_agg('[Chunk ' || (pos + 1) || ']' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by pos) as context from hydrated group by query_id", HYDRATED_VIEWS)
def a10_ordered_text(spark, d):
    """The variant that keeps blank texts."""
    return R.assemble_context(hydrated(spark, d), "Chunk", skip_blank=False)


@query("with " + HYDRATED + " select query_id, count(distinct document_id) as documents_retrieved, cast(sum(length(content)) as bigint) as context_length from hydrated group by query_id", HYDRATED_VIEWS)
def a11_retrieval_stats(spark, d):
    return source_stats(hydrated(spark, d))
