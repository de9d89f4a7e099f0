"""Staleness, degrees, evidence trimming, expiry and cascading deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def node_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with ``degree`` over active edges: a loop counts once, a node without edges has 0.

    "Source or destination" becomes one row for each end, so it is an equi-join after a map-side combined count.
    """
    ends = edges.where("is_active").select(F.explode(F.array_distinct(F.array("src_id", "dst_id"))).alias("id"))
    return nodes.join(ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")), "id", "left").na.fill(0, ["degree"])


def prune_edges(edges: DataFrame, days: int = 90) -> DataFrame:
    """Active edges not seen for more than ``days`` days become inactive. age_days counts up to the time of the run."""
    return edges.withColumn("is_active", F.col("is_active") & ~(F.col("age_days") > days))


def prune_nodes(nodes: DataFrame, edges: DataFrame, days: int = 180, min_degree: int = 3) -> DataFrame:
    """Stale nodes of low degree are archived; edges are those left by prune_edges."""
    out = node_degree(nodes, edges)
    stale = (F.col("status") != "archived") & (F.col("age_days") > days) & (F.col("degree") < min_degree)
    return out.withColumn("status", F.when(stale, "archived").otherwise(F.col("status")))


def trim_evidence(evidence: DataFrame, owner: str, keep: int) -> DataFrame:
    """The ``keep`` best rows of each owner: score down with nulls last, newest, then id."""
    w = Window.partitionBy(owner).orderBy(F.desc_nulls_last("score"), F.desc("created_at"), "id")
    return evidence.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= keep).drop("_k")


def prune(nodes: DataFrame, edges: DataFrame, edge_evidence: DataFrame, node_evidence: DataFrame) -> tuple[DataFrame, ...]:
    """All four steps in order: (nodes, edges, edge evidence, node evidence)."""
    kept = prune_edges(edges)
    return prune_nodes(nodes, kept), kept, trim_evidence(edge_evidence, "edge_id", 5), trim_evidence(node_evidence, "node_id", 10)


def prune_summary(before: tuple[DataFrame, ...], after: tuple[DataFrame, ...]) -> DataFrame:
    """One row of what a prune did; four aggregates of one row each, joined by broadcast."""
    def active(df: DataFrame, test: str, name: str) -> DataFrame:
        return df.agg(F.count_if(F.expr(test)).alias(name))

    names = [("status <> 'archived'", "nodes_archived"), ("is_active", "edges_archived"), ("true", "edge_evidence_deleted"), ("true", "node_evidence_deleted")]
    out = None
    for (test, name), b, a in zip(names, before, after, strict=True):
        one = active(b, test, "b").join(F.broadcast(active(a, test, "a"))).select((F.col("b") - F.col("a")).alias(name))
        out = one if out is None else out.join(F.broadcast(one))
    return out


def expire_outputs(outputs: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(rows left, one row with the number deleted)."""
    gone = F.col("expires_at") < F.lit(as_of).cast("timestamp_ntz")
    return outputs.where(~gone), outputs.agg(F.count_if(gone).alias("deleted"))


def newest_outputs(outputs: DataFrame, as_of: str, output_type: str | None = None) -> DataFrame:
    """Outputs not yet expired, newest first."""
    rows = outputs.where(F.col("expires_at") >= F.lit(as_of).cast("timestamp_ntz"))
    rows = rows.where(F.col("output_type") == output_type) if output_type else rows
    return rows.orderBy(F.desc("created_at"), "id")


def delete_documents(ids: DataFrame, docs: DataFrame, chunks: DataFrame, evidence: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, ...]:
    """Documents, chunks and evidence without those of ids; with nodes given, the graph's chunk nodes go, too."""
    gone_chunks = chunks.join(ids.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    out = (docs.join(ids, "id", "left_anti"), chunks.join(ids.select(F.col("id").alias("document_id")), "document_id", "left_anti"), evidence.join(gone_chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti"))
    if nodes is None:
        return out
    keys = gone_chunks.select(F.concat(F.lit("chunk:"), F.col("id").cast("string")).alias("node_key"))
    return (*out, nodes.join(keys, "node_key", "left_anti"))


def delete_nodes(ids: DataFrame, nodes: DataFrame, edges: DataFrame, evidence: DataFrame) -> tuple[DataFrame, ...]:
    """Nodes, edges and node evidence without what hangs on ids."""
    left = edges.join(ids.select(F.col("id").alias("src_id")), "src_id", "left_anti").join(ids.select(F.col("id").alias("dst_id")), "dst_id", "left_anti")
    return nodes.join(ids, "id", "left_anti"), left, evidence.join(ids.select(F.col("id").alias("node_id")), "node_id", "left_anti")


def delete_summaries(keys: DataFrame, summaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summaries left, keys with whether a row went)."""
    key = ["tenant_id", "client_id"]
    return summaries.join(keys, key, "left_anti"), keys.join(summaries.select(*key, F.lit(True).alias("deleted")).distinct(), key, "left").na.fill(False, ["deleted"])
