"""Tables of buckets: writers side by side, repeats, compaction, versions, and what a batch writes."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.upserts import CHUNKS, Rule, upsert
from corpusloom.sources.tables import BucketTable, Conflict
from corpusloom.streaming import ingest

SCHEMA = "tenant_id string, k long, name string, weight double, props map<string,string>, seen_count long, created_at timestamp_ntz, updated_at timestamp_ntz"
RULE = Rule(("tenant_id", "k"), ("name",), ("weight",), ("props",), counts=True)


def batch(spark, rows):
    return spark.createDataFrame(rows, "tenant_id string, k long, name string, weight double, props map<string,string>, seq long")


def plain(df):
    return sorted((repr((r["tenant_id"], r["k"], r["name"], r["weight"], sorted((r["props"] or {}).items()), r["seen_count"], r["created_at"], r["updated_at"])) for r in df.collect()))


def table(spark, path, **more):
    return BucketTable(spark, str(path), RULE, SCHEMA, **({"buckets": 8} | more))


ROWS = [[("t", k, f"n{v}-{k}", None if (k + v) % 3 else float(v), {f"p{v}": str(k), "both": str(v)}, k) for k in range(v * 5, v * 5 + 20)] + [(None, 7, f"null key {v}", 1.0, None, 100), ("t", v * 5, f"again {v}", None, {"again": "1"}, 101)] for v in range(4)]


def in_order(spark, batches):
    """The same batches upserted one after another in memory."""
    out = spark.createDataFrame([], SCHEMA)
    for k, rows in enumerate(batches):
        out = upsert(out, batch(spark, rows), RULE, f"2024-01-0{k + 1}")
    return plain(out)


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_logs_and_merges_equal_upserts_in_order(spark, tmp_path):
    logged, merged = table(spark, tmp_path / "a"), table(spark, tmp_path / "b")
    for k, rows in enumerate(ROWS):
        logged.append(batch(spark, rows), f"2024-01-0{k + 1}")
        merged.merge(batch(spark, rows), f"2024-01-0{k + 1}")
    want = in_order(spark, ROWS)
    assert plain(logged.read()) == plain(merged.read()) == want
    assert len(logged.manifest()["logs"]) == 4 and not merged.manifest()["logs"]
    assert plain(logged.read(version=2)) == in_order(spark, ROWS[:2])
    logged.compact(set(range(8)))
    assert plain(logged.read()) == want and not logged.manifest()["logs"]


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    t = table(spark, tmp_path / "t", buckets=16)
    t.merge(batch(spark, [("t", k, "n", 1.0, {}, k) for k in range(200)]), "2024-01-01")
    before, size = t.manifest()["base"], sum(map(os.path.getsize, files(tmp_path)))
    t.merge(batch(spark, [("t", 3, "new", None, {"x": "1"}, 0)]), "2024-01-02")
    after = t.manifest()["base"]
    assert len(before) == 16 and sum(before[b] != after[b] for b in before) == 1
    assert sum(map(os.path.getsize, files(tmp_path))) - size < size / 4
    (row,) = t.read().where("k = 3").collect()
    assert (row["name"], row["weight"], row["seen_count"]) == ("new", 1.0, 2)


def test_two_writers_from_one_version_both_survive(spark, tmp_path):
    one, other = table(spark, tmp_path / "t"), table(spark, tmp_path / "t")
    one.append(batch(spark, ROWS[0]), "2024-01-01")
    stale = one.manifest()
    name, held = other._write(batch(spark, ROWS[1]).withColumns({"_at": F.lit("2024-01-02").cast("timestamp_ntz")}))
    assert one.append(batch(spark, ROWS[2]), "2024-01-03") == 2
    assert other._commit(stale, lambda m: m | {"logs": [*m["logs"], [name, held]]}) == 3  # takes the next number, drops nothing
    assert [len(x[1]) > 0 for x in one.manifest()["logs"]] == [True] * 3
    got = {r["k"]: r["seen_count"] for r in one.read().where("tenant_id = 't'").collect()}
    assert set(got) == set(range(30)) and got[12] == 3


def test_a_stale_compaction_is_refused_and_redone(spark, tmp_path):
    one, other = table(spark, tmp_path / "t"), table(spark, tmp_path / "t")
    one.append(batch(spark, ROWS[0]), "2024-01-01")
    staged = one.staged_compaction(set(range(8)))
    other.append(batch(spark, ROWS[1]), "2024-01-02")
    staged()  # a later log doesn't hinder it and stays
    assert len(one.manifest()["logs"]) == 1 and plain(one.read()) == in_order(spark, ROWS[:2])
    staged = one.staged_compaction(set(range(8)))
    other.merge(batch(spark, ROWS[2]), "2024-01-03")
    with pytest.raises(Conflict):
        staged()
    assert plain(one.read()) == in_order(spark, ROWS[:3])


def test_many_writers_at_once(spark, tmp_path):
    def write(k):
        t = table(spark, tmp_path / "t")
        for j in range(2):
            (t.merge if j else t.append)(batch(spark, [("t", i, f"w{k}", None, {f"w{k}": str(j)}, j) for i in range(12)]), "2024-01-01")

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    rows = table(spark, tmp_path / "t").read().collect()
    assert len(rows) == 12 and all(r["seen_count"] == 8 and r["props"] == {f"w{k}": "1" for k in range(4)} for r in rows)


def test_a_repeated_batch_of_a_writer_counts_once(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    for number in (0, 0, 1, 0):
        t.append(batch(spark, [("t", 1, f"b{number}", None, {}, 0)]), "2024-01-01", "w", number)
    (row,) = t.read().collect()
    assert (row["name"], row["seen_count"]) == ("b1", 2)


def test_vacuum_keeps_what_versions_name(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    for k, rows in enumerate(ROWS):
        t.merge(batch(spark, rows), f"2024-01-0{k + 1}")
    assert t.vacuum(keep=1) == 0  # nothing is old enough
    want = plain(t.read())
    held = len(files(tmp_path))
    assert t.vacuum(keep=1, hours=-1) > 0
    assert len(files(tmp_path)) < held and plain(t.read()) == want and len(os.listdir(tmp_path / "t" / "manifest")) == 1


def test_empty_tables_and_batches(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    assert t.read().count() == 0 and t.compact({1, 2}) is None
    t.merge(batch(spark, []), "2024-01-01")
    assert t.read().count() == 0
    t.load(spark.createDataFrame([("t", 1, "n", 1.0, {}, 1, None, None)], SCHEMA))
    with pytest.raises(Conflict):
        t.load(t.read())
    with pytest.raises(ValueError, match="buckets"):
        table(spark, tmp_path / "t", buckets=9).read()


def prepare(docs):
    none = F.lit(None).cast("string")
    found = docs.select("tenant_id", F.lit("c").alias("client_id"), F.col("document_id").cast("string").alias("source_uri"), F.lit("pdf").alias("source_type"), none.alias("title"), F.create_map().cast("map<string,string>").alias("metadata"))
    return found, docs.select("tenant_id", "document_id", F.lit(1).alias("page"), "text")


def test_ingest_over_two_runs(spark, tmp_path):
    src, folder = tmp_path / "docs", str(tmp_path / "target")
    rows = lambda *r: spark.createDataFrame(r, "document_id long, tenant_id string, text string").coalesce(1)
    many = [(k, "t", f"Some words of {k}.\nhyphen-\nated lines. " * 30) for k in range(3, 60)]
    rows((1, "t", "One a b.  Two c d. Three e f."), (2, "t", "Four."), *many).write.parquet(str(src))
    documents, chunks = ingest.run(spark, str(src), prepare, folder, "2024-01-01", 4, 0, buckets=4)
    assert documents.count() == 59 and sorted((r["chunk_index"], r["content"], r["content_tokens"]) for r in chunks.where("document_id = 1").collect()) == [(0, "One a b.", 4), (1, "Two c d.", 4), (2, "Three e f.", 4)]
    assert chunks.where("content like '%hyphenated lines.%'").count() and not chunks.where("content like '%hyphen- %'").count()
    first, size = files(folder), sum(map(os.path.getsize, files(folder)))
    rows((1, "t", "One new b.")).write.mode("append").parquet(str(src))
    documents, chunks = ingest.run(spark, str(src), prepare, folder, "2024-01-02", 4, 0, buckets=4)
    got = {r["chunk_index"]: (r["content"], str(r["created_at"])[:10], str(r["updated_at"])[:10]) for r in chunks.where("document_id = 1").collect()}
    assert got[0] == ("One new b.", "2024-01-01", "2024-01-02") and got[1] == ("Two c d.", "2024-01-01", "2024-01-01") and documents.count() == 59
    assert first <= files(folder) and sum(map(os.path.getsize, files(folder) - first)) < size / 4  # in proportion to the batch
    assert ingest.tables(spark, folder, 4)[1].rule is CHUNKS
