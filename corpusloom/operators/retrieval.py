"""Retrieval for tables of queries: exact top-k, graph expansion, confidence gate, formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import numbered_texts
from .graph import best_pairs


def semantic_search(nodes: DataFrame, queries: DataFrame, top_k: int = 5, group: str | None = None) -> DataFrame:
    """(query_id, node_id, similarity, rank): each query's best active nodes, exactly; ties to the smaller id.

    queries: query_id, embedding (and the group column). Queries are held, nodes stream by; each part keeps its best.
    """
    if not 1 <= top_k <= 50:
        raise ValueError("top_k must lie in 1 to 50")
    cols = [group] if group else []
    q = queries.select(F.col("query_id").alias("id"), "embedding", *cols)
    found = best_pairs(q, nodes.where("status = 'active'").select("id", "embedding", *cols), top_k, -2.0, False, group)
    rank = F.row_number().over(Window.partitionBy("src_id").orderBy(F.desc("weight"), "dst_id"))
    return found.select(F.col("src_id").alias("query_id"), F.col("dst_id").alias("node_id"), F.col("weight").alias("similarity"), rank.alias("rank"))


def neighbours(edges: DataFrame, nodes: DataFrame, max_neighbours: int = 3, min_weight: float = 0.75) -> DataFrame:
    """(src_id, dst_id, weight, k): best active outgoing edges; the limit comes before inactive nodes are left out."""
    strong = edges.where("is_active").where(F.col("weight") >= min_weight)
    k = F.row_number().over(Window.partitionBy("src_id").orderBy(F.desc("weight"), "dst_id"))
    best = strong.select("src_id", "dst_id", "weight").withColumn("k", k).where(F.col("k") <= max_neighbours)
    return best.join(nodes.where("status = 'active'").select(F.col("id").alias("dst_id")), "dst_id", "left_semi").select("src_id", "dst_id", "weight", "k")


def graph_search(hits: DataFrame, near: DataFrame) -> DataFrame:
    """(query_id, pos, node_id, source, similarity): seeds by rank, each followed by its unseen neighbours.

    A seed that an earlier seed pulled in stays an expansion, without score, and is not expanded. hits come from
    semantic_search (50 seeds a query at most), near from neighbours.
    """
    lists = near.groupBy(F.col("src_id").alias("node_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "dst_id"))), lambda x: x["dst_id"]).alias("near"))
    seeds = hits.join(lists, "node_id", "left").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "node_id", "similarity", F.coalesce("near", F.array().cast("array<long>")).alias("near")))).alias("seeds"))
    row = "struct<node_id:bigint,source:string,similarity:double>"
    empty = F.array().cast(f"array<{row}>")

    def step(acc: Column, s: Column) -> Column:
        known = F.transform(acc, lambda r: r["node_id"])
        own = F.array(F.struct(s["node_id"].alias("node_id"), F.lit("vector").alias("source"), s["similarity"].alias("similarity")).cast(row))
        new = F.filter(F.array_distinct(s["near"]), lambda x: ~F.array_contains(known, x) & (x != s["node_id"]))
        more = F.transform(new, lambda x: F.struct(x.alias("node_id"), F.lit("graph_expansion").alias("source"), F.lit(None).cast("double").alias("similarity")).cast(row))
        return F.when(F.array_contains(known, s["node_id"]), acc).otherwise(F.concat(acc, own, more))

    folded = seeds.select("query_id", F.aggregate("seeds", empty, step).alias("rows"))
    return folded.select("query_id", F.posexplode("rows").alias("pos", "r")).select("query_id", "pos", "r.node_id", "r.source", F.round("r.similarity", 4).alias("similarity"))


def hydrate(results: DataFrame, texts: DataFrame) -> DataFrame:
    """results with content: the node's chunk text, else description, else name, else empty. texts: node_id and these."""
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    return results.join(texts, "node_id", "left").withColumn("content", F.coalesce(some("content"), some("description"), some("name"), F.lit(""))).drop("description", "name")


def expansion_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("query_id").agg(F.count_if(F.col("source") == "vector").alias("seed_nodes"), F.count_if(F.col("source") == "graph_expansion").alias("expanded_nodes"))


def confidence_gate(results: DataFrame, queries: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(query_id, top_score, outcome): answer, low_confidence or empty; every query has a row."""
    top = results.groupBy("query_id").agg(F.min_by("similarity", "pos").alias("top_score"), F.count(F.lit(1)).alias("n"))
    out = queries.select("query_id").distinct().join(top, "query_id", "left")
    return out.select("query_id", F.coalesce("top_score", F.lit(0.0)).alias("top_score"), F.when(F.col("n").isNull(), "empty").when(F.col("top_score") >= threshold, "answer").otherwise("low_confidence").alias("outcome"))


def retrieve_with_retry(hits: DataFrame, narrow: int = 5, threshold: float = 0.6) -> DataFrame:
    """(query_id, node_id, similarity, rank, attempt): the narrow result where its top score is enough, else the wide one.

    hits: semantic_search with the wide k; both attempts are read off it.
    """
    top = F.max("similarity").over(Window.partitionBy("query_id"))
    rows = hits.withColumn("attempt", F.when(top >= threshold, 1).otherwise(2))
    return rows.where((F.col("attempt") == 2) | (F.col("rank") <= narrow))


def format_sources(results: DataFrame) -> DataFrame:
    """(query_id, sources, listing, scored): previews of 200 characters, the first five as a list, scored lines of 500."""
    score = F.coalesce(F.col("similarity").cast("string"), F.lit("N/A"))
    row = F.struct("pos", F.struct("node_id", "similarity", "source", F.substring("content", 1, 200).alias("content_preview")).alias("s"), F.concat(F.lit("- "), F.coalesce(F.col("document_id").cast("string"), F.lit("unknown")), F.lit(" (chunk "), F.coalesce(F.col("chunk_index").cast("string"), F.lit("?")), F.lit(")")).alias("l"), F.concat(F.lit("["), "source", F.lit(" | Score: "), score, F.lit("] "), F.substring("content", 1, 500)).alias("t"))
    rows = results.groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("x"))
    part = lambda name: F.transform("x", lambda r: r[name])
    return rows.select("query_id", part("s").alias("sources"), F.array_join(F.slice(part("l"), 1, 5), "\n").alias("listing"), F.array_join(part("t"), "\n\n---\n\n").alias("scored"))


def assemble_context(results: DataFrame, label: str = "Source", skip_blank: bool = True) -> DataFrame:
    """(query_id, context): numbered texts in order of pos."""
    rows = results.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]).alias("texts"))
    return rows.select("query_id", numbered_texts(F.col("texts"), label, skip_blank).alias("context"))


def expand_hops(seeds: DataFrame, near: DataFrame, hops: int) -> DataFrame:
    """(query_id, node_id, hop, parent): true expansion over hops; a node counts where it is first reached, by its best edge.

    seeds: query_id, node_id. Each hop is a join, a left-anti join with what was seen and a choice of parent, cut off by
    a checkpoint where the session has a checkpoint folder.
    """
    seen = seeds.select("query_id", "node_id", F.lit(0).alias("hop"), F.lit(None).cast("long").alias("parent"))
    frontier = seen
    for h in range(1, hops + 1):
        step = frontier.select("query_id", F.col("node_id").alias("src_id")).join(near, "src_id")
        step = step.select("query_id", F.col("dst_id").alias("node_id"), F.col("src_id").alias("parent"), "weight").join(seen, ["query_id", "node_id"], "left_anti")
        best = F.row_number().over(Window.partitionBy("query_id", "node_id").orderBy(F.desc("weight"), "parent"))
        frontier = step.withColumn("k", best).where("k = 1").select("query_id", "node_id", F.lit(h).alias("hop"), "parent")
        seen = seen.unionByName(frontier)
        if seen.sparkSession.sparkContext.getCheckpointDir():
            seen = seen.checkpoint()
            frontier = seen.where(F.col("hop") == h)
    return seen
