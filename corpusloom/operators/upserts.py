"""Natural-key upserts as full outer joins: the batch is reduced to one row for each key first, then merged once.

Property columns are maps of JSON-encoded values, so a JSON null differs from a missing key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType


def merge_props(a: Column, b: Column) -> Column:
    """Shallow merge of two maps; b wins; nulls are empty."""
    empty = F.create_map().cast("map<string,string>")
    return F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda k, x, y: F.coalesce(y, x))


@dataclass(frozen=True)
class Rule:
    """How an upsert treats columns: overwrite takes the batch's value, keep_old takes it unless null, merge joins maps."""

    key: tuple[str, ...]
    overwrite: tuple[str, ...] = ()
    keep_old: tuple[str, ...] = ()
    merge: tuple[str, ...] = ()
    counts: bool = False
    reactivates: bool = False


NODES = Rule(("tenant_id", "client_id", "node_key"), ("type", "name", "description", "status"), ("embedding",), ("properties",), counts=True)
EDGES = Rule(("tenant_id", "client_id", "src_id", "dst_id", "rel_type"), (), ("weight",), ("properties",), counts=True, reactivates=True)
CHUNKS = Rule(("tenant_id", "document_id", "chunk_index"), (), ("page_start", "page_end", "content", "content_tokens", "embedding"), ("metadata",))
DOCUMENTS = Rule(("tenant_id", "client_id", "source_uri"), ("source_type", "title", "metadata"))
SUMMARIES = Rule(("tenant_id", "client_id"), ("summary", "topics", "source_stats"), (), ("metadata",))


def fold_batch(batch: DataFrame, rule: Rule, seq: str = "seq") -> DataFrame:
    """One row for each key, as if the batch's rows came one after another in order of seq."""
    aggs = [F.max_by(c, seq).alias(c) for c in rule.overwrite if c in batch.columns]
    if "_at" in batch.columns:
        aggs += [F.min_by("_at", seq).alias("_first_at"), F.max_by("_at", seq).alias("_last_at")]
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in rule.keep_old if c in batch.columns]
    out = batch.groupBy(*rule.key).agg(F.count(F.lit(1)).alias("_times"), *aggs)
    for c in (c for c in rule.merge if c in batch.columns):
        # The last value of each property, key by key and property by property, so that no task gathers a key's rows.
        last = batch.select(*rule.key, seq, F.explode(c).alias("_p", "_v")).groupBy(*rule.key, "_p").agg(F.max(F.struct(F.col(seq).alias("s"), F.col("_v").alias("v"))).alias("_x"))
        maps = last.groupBy(*rule.key).agg(F.map_from_entries(F.collect_list(F.struct("_p", "_x.v"))).alias(c))
        o, m = out.alias("o"), maps.alias("m")
        same = reduce(and_, [F.col(f"o.{k}").eqNullSafe(F.col(f"m.{k}")) for k in rule.key])
        out = o.join(m, same, "left").select("o.*", F.coalesce(f"m.{c}", F.create_map().cast("map<string,string>")).alias(c))
    return out


def upsert(target: DataFrame, batch: DataFrame, rule: Rule, as_of: str | None, seq: str = "seq") -> DataFrame:
    """The table after the batch. Null keys are equal to null keys here; rows of other keys stay as they are.

    With as_of None each row of the batch brings its own time in ``_at``, so that one upsert does for many batches.
    """
    new = fold_batch(batch, rule, seq)
    first, now = (F.col("n._first_at"), F.col("n._last_at")) if as_of is None else (F.lit(as_of).cast(target.schema["updated_at"].dataType),) * 2
    t, n = target.alias("t"), new.alias("n")
    same = reduce(and_, [F.col(f"t.{k}").eqNullSafe(F.col(f"n.{k}")) for k in rule.key])
    joined = t.withColumn("_t", F.lit(True)).alias("t").join(n, same, "full")
    is_old, is_new = F.col("t._t").isNotNull(), F.col("n._times").isNotNull()
    out = []
    for c in target.columns:
        old, given = F.col(f"t.{c}"), F.col(f"n.{c}") if c in new.columns else None
        if c in rule.key:
            value = F.when(is_old, old).otherwise(given)
        elif c in rule.overwrite and given is not None:
            value = F.when(is_new, given).otherwise(old)
        elif c in rule.keep_old and given is not None:
            value = F.coalesce(given, old)
        elif c in rule.merge and given is not None:
            value = F.when(is_new & is_old, merge_props(old, given)).when(is_new, given).otherwise(old)
        elif c == "seen_count" and rule.counts:
            value = F.coalesce(old, F.lit(0)) + F.coalesce("n._times", F.lit(0))
        elif c == "is_active" and rule.reactivates:
            value = F.when(is_new, True).otherwise(old)
        elif c in ("updated_at", "last_seen_at"):
            value = F.when(is_new, now).otherwise(old)
        elif c == "created_at":
            value = F.coalesce(old, first)
        else:
            value = old
        # Nested columns stay as they are: a cast may not drop that what they hold can be null.
        kind = target.schema[c].dataType
        out.append((value.cast(kind) if isinstance(kind, AtomicType) else value).alias(c))
    return joined.select(*out)


def patch_documents(target: DataFrame, patches: DataFrame, as_of: str) -> DataFrame:
    """Title if given, metadata laid over; patches: id, title, metadata, one row for each id."""
    p = patches.select("id", F.col("title").alias("_title"), F.col("metadata").alias("_metadata"), F.lit(True).alias("_hit"))
    out = target.join(p, "id", "left")
    return out.withColumns({
        "title": F.coalesce("_title", "title"), "metadata": F.when(F.col("_metadata").isNotNull(), merge_props(F.col("metadata"), F.col("_metadata"))).otherwise(F.col("metadata")),
        "updated_at": F.when(F.col("_hit"), F.lit(as_of).cast(target.schema["updated_at"].dataType)).otherwise(F.col("updated_at")),
    }).select(target.columns)
