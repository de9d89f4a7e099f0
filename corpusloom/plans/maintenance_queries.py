"""Queries: upserts, pruning, expiry, deletes, windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import maintenance as M
from ..operators import upserts as U
from .graph_queries import chunk_id
from .registry import query
from .views import read, view

AS_OF = "2024-01-20"


def clock(df):
    t = F.lit("2024-01-01").cast("timestamp_ntz")
    return df.withColumns({"created_at": t, "updated_at": t})


def props(*pairs):
    return F.create_map(*[x for k, v in pairs for x in (F.lit(k), v.cast("string"))])


U1_SQL = """with new as (select n_key as k, count(*) as times, arg_max(nm, seq) as nm, max(seq) as last from (select vec_id % 400 as n_key, 'new ' || vec_id as nm, vec_id as seq from embeddings where vec_id % 2 = 1) group by 1),
    old as (select vec_id as k, 'old ' || vec_id as nm, vec_id from embeddings where vec_id % 2 = 0 or vec_id % 3 = 0)
    select cast(coalesce(old.k, new.k) as varchar) as node_key, coalesce(new.nm, old.nm) as name, coalesce(case when old.k is not null then 1 else 0 end, 0) + coalesce(times, 0) as seen_count,
    case when old.k is not null then cast(old.k as varchar) end as p_old, cast(new.last as varchar) as p_new, case when new.k is not null then 'new' else 'old' end as p_both, new.k is not null as touched from old full join new on old.k = new.k"""


def node_tables(spark, d):
    """(old nodes, batch of new ones with seq): the old table's nodes are even or divisible by three, the batch repeats keys."""
    e = read(spark, d, "embeddings")
    base = lambda df, name, p: df.select(F.lit("t0").alias("tenant_id"), F.lit(None).cast("string").alias("client_id"), F.col("k").cast("string").alias("node_key"), F.lit("Chunk").alias("type"), name.alias("name"), F.lit(None).cast("string").alias("description"), F.lit("active").alias("status"), p.alias("properties"), "seq")
    target = base(e.where("vec_id % 2 = 0 or vec_id % 3 = 0").withColumns({"k": F.col("vec_id"), "seq": F.lit(0)}), F.concat(F.lit("old "), F.col("k").cast("string")), props(("old", F.col("k")), ("both", F.lit("old")))).drop("seq")
    target = clock(target).withColumns({"embedding": F.lit(None).cast("array<float>"), "seen_count": F.lit(1).cast("long"), "last_seen_at": F.col("updated_at")})
    batch = base(e.where("vec_id % 2 = 1").withColumns({"k": F.col("vec_id") % 400, "seq": F.col("vec_id")}), F.concat(F.lit("new "), F.col("seq").cast("string")), props(("new", F.col("seq")), ("both", F.lit("new"))))
    return target, batch


def node_rows(out):
    p = F.col("properties")
    return out.select("node_key", "name", "seen_count", p["old"].alias("p_old"), p["new"].alias("p_new"), p["both"].alias("p_both"), (F.col("updated_at") == F.lit(AS_OF).cast("timestamp_ntz")).alias("touched"))


@query(U1_SQL)
def u1_upsert_nodes(spark, d):
    target, batch = node_tables(spark, d)
    return node_rows(U.upsert(target, batch, U.NODES, AS_OF))


@query(U1_SQL)
def s10_published_nodes(spark, d):
    """The old nodes in a table of buckets; two writers that start from the same version upsert half of the batch each, one
    compacts while the other commits, and what is read is what one upsert of the whole batch gives."""
    from ..session import work_folder
    from ..sources.tables import BucketTable, Conflict

    target, batch = node_tables(spark, d)
    batch = batch.withColumn("embedding", F.lit(None).cast("array<float>"))
    folder = work_folder(spark, "nodes")
    one, other = (BucketTable(spark, folder, U.NODES, target.schema, buckets=16) for _ in range(2))
    one.load(target)
    one.append(batch.where("seq % 4 = 1"), AS_OF, "halves", 0)
    staged = one.staged_compaction({0, 1, 2, 3})
    other.append(batch.where("seq % 4 = 3"), AS_OF, "halves", 1)
    other.append(batch.where("seq % 4 = 3"), AS_OF, "halves", 1)  # repeated by its writer: counts once
    other.compact({3, 4})
    try:
        staged()
    except Conflict:  # bucket 3 was merged by the other writer
        one.compact({0, 1, 2, 3})
    one.vacuum(keep=1, hours=0)
    return node_rows(one.read())


@query(
    """with t as (select src_id, dst_id, weight, is_active from f_edges where id % 2 = 0), b as (select src_id, (dst_id + id % 2) % 150 as dst_id, case when id % 5 = 0 then null else weight end as weight, id from f_edges),
    n as (select src_id, dst_id, arg_max(weight, id) filter (where weight is not null) as weight, count(*) as times from b group by all)
    select coalesce(t.src_id, n.src_id) as src_id, coalesce(t.dst_id, n.dst_id) as dst_id, coalesce(n.weight, t.weight) as weight, case when n.times is not null then true else t.is_active end as is_active, cast(coalesce(n.times, 0) + case when t.src_id is null then 0 else 1 end as bigint) as seen_count
    from t full join n on t.src_id = n.src_id and t.dst_id = n.dst_id""",
    ("f_edges",),
)
def u2_upsert_edges(spark, d):
    e = view(spark, d, "f_edges")
    keys = [F.lit("t0").alias("tenant_id"), F.lit("c0").alias("client_id"), "src_id", "dst_id", F.lit("related_to").alias("rel_type")]
    target = clock(e.where("id % 2 = 0").select(*keys, "weight", "is_active")).withColumns({"properties": props(("m", F.lit("cosine"))), "seen_count": F.lit(1).cast("long"), "last_seen_at": F.col("updated_at")})
    batch = e.withColumns({"dst_id": (F.col("dst_id") + F.col("id") % 2) % 150, "weight": F.when(F.col("id") % 5 != 0, F.col("weight"))}).select(*keys, "weight", props(("m", F.lit("cosine"))).alias("properties"), F.col("id").alias("seq"))
    return U.upsert(target, batch, U.EDGES, AS_OF).select("src_id", "dst_id", "weight", "is_active", "seen_count")


@query(
    """with t as (select document_id, chunk_index, content from f_chunks where chunk_index % 2 = 0), b as (select document_id, chunk_index, case when document_id % 4 = 0 then null else 'v2 ' || content end as content from f_chunks where document_id % 3 = 0)
    select coalesce(t.document_id, b.document_id) as document_id, coalesce(t.chunk_index, b.chunk_index) as chunk_index, coalesce(b.content, t.content) as content, b.document_id is not null as touched from t full join b on t.document_id = b.document_id and t.chunk_index = b.chunk_index""",
    ("f_chunks",),
)
def u3_upsert_chunks(spark, d):
    c = view(spark, d, "f_chunks")
    target = clock(c.where("chunk_index % 2 = 0").select("tenant_id", "document_id", "chunk_index", "content")).withColumn("metadata", props(("a", F.lit(1))))
    batch = c.where("document_id % 3 = 0").select("tenant_id", "document_id", "chunk_index", F.when(F.col("document_id") % 4 != 0, F.concat(F.lit("v2 "), "content")).alias("content"), props(("b", F.lit(2))).alias("metadata"), F.lit(1).alias("seq"))
    out = U.upsert(target, batch, U.CHUNKS, AS_OF)
    return out.select("document_id", "chunk_index", "content", (F.col("updated_at") == F.lit(AS_OF).cast("timestamp_ntz")).alias("touched"))


@query(
    """with t as (select source_uri, client_id, tenant_id, source_type from f_documents where id % 3 <> 0), b as (select source_uri, client_id, tenant_id, 'scan' as source_type from f_documents where id % 2 = 0)
    select coalesce(t.source_uri, b.source_uri) as source_uri, coalesce(b.source_type, t.source_type) as source_type, case when b.source_uri is null then '1' end as a, case when b.source_uri is not null then '2' end as b from t full join b on t.source_uri = b.source_uri""",
    ("f_documents",),
)
def u4_upsert_documents(spark, d):
    """Metadata is replaced, not merged."""
    f = view(spark, d, "f_documents")
    key = ["tenant_id", "client_id", "source_uri"]
    target = clock(f.where("id % 3 <> 0").select(*key, "source_type", F.lit("t").alias("title"))).withColumn("metadata", props(("a", F.lit(1))))
    batch = f.where("id % 2 = 0").select(*key, F.lit("scan").alias("source_type"), F.lit("t").alias("title"), props(("b", F.lit(2))).alias("metadata"), F.col("id").alias("seq"))
    return U.upsert(target, batch, U.DOCUMENTS, AS_OF).select("source_uri", "source_type", F.col("metadata")["a"].alias("a"), F.col("metadata")["b"].alias("b"))


@query(
    """with t as (select tenant_id, client_id, min(id) as s from f_documents where id % 2 = 0 group by all), b as (select tenant_id, client_id, max(id) as s from f_documents where id % 3 = 0 group by all)
    select coalesce(t.tenant_id, b.tenant_id) as tenant_id, coalesce(t.client_id, b.client_id) as client_id, 'summary ' || coalesce(b.s, t.s) as summary, case when t.tenant_id is not null then '1' end as a, case when b.tenant_id is not null then '2' end as b from t full join b on t.tenant_id = b.tenant_id and t.client_id = b.client_id""",
    ("f_documents",),
)
def u5_upsert_summaries(spark, d):
    f, key = view(spark, d, "f_documents"), ["tenant_id", "client_id"]
    text = lambda c: F.concat(F.lit("summary "), c.cast("string")).alias("summary")
    target = clock(f.where("id % 2 = 0").groupBy(*key).agg(text(F.min("id")))).withColumn("metadata", props(("a", F.lit(1))))
    batch = f.where("id % 3 = 0").groupBy(*key).agg(text(F.max("id"))).withColumns({"metadata": props(("b", F.lit(2))), "seq": F.lit(1)})
    return U.upsert(target, batch, U.SUMMARIES, AS_OF).select(*key, "summary", F.col("metadata")["a"].alias("a"), F.col("metadata")["b"].alias("b"))


@query("select id, case when id % 4 = 0 then 'new ' || id else 'old' end as title, case when id % 2 = 0 then 'p' else 'x' end as k, id % 2 = 0 as touched from f_documents", ("f_documents",))
def u6_patch_documents(spark, d):
    f = view(spark, d, "f_documents")
    target = clock(f.select("id", F.lit("old").alias("title"), props(("k", F.lit("x"))).alias("metadata")))
    patches = f.where("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, F.concat(F.lit("new "), F.col("id").cast("string"))).alias("title"), props(("k", F.lit("p"))).alias("metadata"))
    out = U.patch_documents(target, patches, AS_OF)
    return out.select("id", "title", F.col("metadata")["k"].alias("k"), (F.col("updated_at") == F.lit(AS_OF).cast("timestamp_ntz")).alias("touched"))


@query("select c_custkey, c_mktsegment as a, c_name as b, cast(c_nationkey as varchar) as c from customer")
def u7_merge_props(spark, d):
    c = read(spark, d, "customer")
    m = U.merge_props(props(("a", F.col("c_mktsegment")), ("b", F.lit("left"))), props(("b", F.col("c_name")), ("c", F.col("c_nationkey"))))
    return c.select("c_custkey", m.alias("m")).select("c_custkey", *[F.col("m")[k].alias(k) for k in "abc"])


DEGREE = "with ends as (select id as e, unnest(list_distinct([src_id, dst_id])) as id from f_edges where is_active{}), deg as (select id, count(*) as degree from ends group by id)"


@query(DEGREE.format("") + " select f_nodes.id, coalesce(degree, 0) as degree from f_nodes left join deg on f_nodes.id = deg.id", ("f_nodes", "f_edges"))
def j2_node_degree(spark, d):
    return M.node_degree(view(spark, d, "f_nodes"), view(spark, d, "f_edges")).select("id", "degree")


@query("select id, is_active and not age_days > 90 as is_active from f_edges", ("f_edges",))
def p1_prune_edges(spark, d):
    return M.prune_edges(view(spark, d, "f_edges")).select("id", "is_active")


PRUNED = DEGREE.format(" and age_days <= 90") + ", pruned as (select f_nodes.id, coalesce(degree, 0) as degree, f_nodes.status as was, case when status <> 'archived' and age_days > 180 and coalesce(degree, 0) < 3 then 'archived' else status end as status from f_nodes left join deg on f_nodes.id = deg.id)"


@query(PRUNED + " select id, degree, status from pruned", ("f_nodes", "f_edges"))
def p2_prune_nodes(spark, d):
    return M.prune_nodes(view(spark, d, "f_nodes"), M.prune_edges(view(spark, d, "f_edges"))).select("id", "degree", "status")


TRIM = "select id, {0} from f_evidence qualify row_number() over (partition by {0} order by score desc nulls last, created_at desc, id) <= {1}"


@query(TRIM.format("edge_id", 5), ("f_evidence",))
def p3_trim_edge_evidence(spark, d):
    return M.trim_evidence(view(spark, d, "f_evidence"), "edge_id", 5).select("id", "edge_id")


@query(TRIM.format("node_id", 10), ("f_evidence",))
def p4_trim_node_evidence(spark, d):
    return M.trim_evidence(view(spark, d, "f_evidence"), "node_id", 10).select("id", "node_id")


@query(
    PRUNED + """, e as (""" + TRIM.format("edge_id", 5) + """), n as (""" + TRIM.format("node_id", 10) + """)
    select (select count(*) from pruned where was <> status) as nodes_archived, (select count(*) from f_edges where is_active and age_days > 90) as edges_archived, (select count(*) from f_evidence) - (select count(*) from e) as edge_evidence_deleted, (select count(*) from f_evidence) - (select count(*) from n) as node_evidence_deleted""",
    ("f_nodes", "f_edges", "f_evidence"),
)
def p5_prune(spark, d):
    """The whole prune and its summary (A7)."""
    ev = view(spark, d, "f_evidence")
    before = view(spark, d, "f_nodes"), view(spark, d, "f_edges"), ev, ev
    return M.prune_summary(before, M.prune(*before))


@query("select count(*) filter (where expires_at < timestamp '2024-01-20') as deleted from f_outputs", ("f_outputs",))
def d1_expire_outputs(spark, d):
    return M.expire_outputs(view(spark, d, "f_outputs"), AS_OF)[1]


@query("select id, client_id, output_type from f_outputs where expires_at is null or expires_at >= timestamp '2024-01-20'", ("f_outputs",))
def d1_outputs_left(spark, d):
    """The rows that an expiry leaves."""
    return M.expire_outputs(view(spark, d, "f_outputs"), AS_OF)[0].select("id", "client_id", "output_type")


@query("select id, created_at from f_outputs where expires_at >= timestamp '2024-01-20' and output_type = 'purchase'", ("f_outputs",))
def o2_newest_outputs(spark, d):
    return M.newest_outputs(view(spark, d, "f_outputs"), AS_OF, "purchase").select("id", "created_at")


def deletion(spark, d, nodes=False):
    docs = view(spark, d, "f_documents")
    chunks = view(spark, d, "f_chunks").withColumn("id", chunk_id())
    evidence = read(spark, d, "events").select("event_id", ((F.col("event_id") % 1000) * (1 << 32) + F.col("event_id") % 7).alias("chunk_id"))
    keys = chunks.select(F.concat(F.lit("chunk:"), F.col("id").cast("string")).alias("node_key")) if nodes else None
    return M.delete_documents(docs.where("source_type = 'pdf'").select("id"), docs, chunks, evidence, keys)


DELETED = """with key as (select cast(document_id as bigint) * 4294967296 + chunk_index as id, source_type from f_chunks join f_documents f on document_id = f.id), gone as (select id from key where source_type = 'pdf'),
    evidence as (select event_id, (event_id % 1000) * 4294967296 + event_id % 7 as chunk_id from events), remains as (select 'documents' as kind, cast(id as varchar) as k from f_documents where source_type <> 'pdf'
    union all select 'chunks', cast(id as varchar) from key where source_type <> 'pdf' union all select 'evidence', cast(event_id as varchar) from evidence where chunk_id not in (select id from gone) union all select 'nodes', 'chunk:' || id from key where source_type <> 'pdf')"""


def remains(parts, keys):
    """(kind, k): the keys of several tables in one."""
    rows = [df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("k")) for (kind, key), df in zip(keys, parts, strict=True)]
    return reduce(lambda a, b: a.unionByName(b), rows)


@query(DELETED + " select kind, k from remains", ("f_documents", "f_chunks"))
def d2_rows_left(spark, d):
    """Which rows a deletion leaves in each table, the graph purged as well."""
    return remains(deletion(spark, d, True), [("documents", "id"), ("chunks", "id"), ("evidence", "event_id"), ("nodes", "node_key")])


@query(DELETED + " select kind, count(*) as n from remains group by kind", ("f_documents", "f_chunks"))
def d2_delete_documents(spark, d):
    """What is left of each table, the graph purged as well."""
    names = ("documents", "chunks", "evidence", "nodes")
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in zip(names, deletion(spark, d, True), strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("select id from f_edges where src_id not in (select id from f_nodes where status = 'archived') and dst_id not in (select id from f_nodes where status = 'archived')", ("f_edges", "f_nodes"))
def d3_delete_nodes(spark, d):
    nodes = view(spark, d, "f_nodes")
    return M.delete_nodes(nodes.where("status = 'archived'").select("id"), nodes, view(spark, d, "f_edges"), view(spark, d, "f_evidence"))[1].select("id")


@query(
    """with gone as (select id from f_nodes where status = 'archived') select 'nodes' as kind, cast(id as varchar) as k from f_nodes where id not in (select id from gone)
    union all select 'edges', cast(id as varchar) from f_edges where src_id not in (select id from gone) and dst_id not in (select id from gone) union all select 'evidence', cast(id as varchar) from f_evidence where node_id not in (select id from gone)""",
    ("f_nodes", "f_edges", "f_evidence"),
)
def d3_rows_left(spark, d):
    """Which nodes, edges and evidence a node deletion leaves."""
    nodes = view(spark, d, "f_nodes")
    return remains(M.delete_nodes(nodes.where("status = 'archived'").select("id"), nodes, view(spark, d, "f_edges"), view(spark, d, "f_evidence")), [("nodes", "id"), ("edges", "id"), ("evidence", "id")])


@query("with k as (select distinct tenant_id, client_id from f_documents), s as (select distinct tenant_id, client_id from f_documents where tenant_id <> 'de') select k.tenant_id, k.client_id, s.tenant_id is not null as deleted from k left join s on k.tenant_id = s.tenant_id and k.client_id = s.client_id", ("f_documents",))
def d4_delete_summaries(spark, d):
    keys = view(spark, d, "f_documents").select("tenant_id", "client_id").distinct()
    return M.delete_summaries(keys, keys.where("tenant_id <> 'de'"))[1]
