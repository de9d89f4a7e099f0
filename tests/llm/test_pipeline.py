"""Queries of the training-data operators against SQL, and the pipeline stage by stage."""

import duckdb
import pytest
from pyspark.sql.functions import lit

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from corpusloom.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = c.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(x) for x in cols]
    assert sorted(repr(tuple(r[x] for x in cols)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_stages_of_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, columns of clashing names and an empty table through every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = [(None, None, None, None, None), (900001, None, "en", "src1", 0), (900002, "", None, None, 0), (900003, " \n\t", "en", "src1", 4), (900004, "word " * 30_000, "en", "src1", 150_000)]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(docs.limit(1))
    clash = {"key": "x", "th": 1, "rep": 2, "size": 3, "piece": 4, "y": 5, "keep": True, "n_lines": "z"}
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.where("false"), SF)
        assert none.count() == 0, name
        wide = rows.select("*", *[lit(v).alias(k) for k, v in clash.items()])
        out = stage(spark, wide, SF)
        if name != "best-fit packing":
            assert set(docs.columns) <= set(out.columns) and out.count() <= wide.count(), name
            assert out.where("doc_id = 900002").count() <= 1 and out.select(docs.columns).schema.simpleString() == docs.schema.simpleString(), name
        else:
            packed = out.groupBy("doc_id").sum("length").collect()
            assert {r["doc_id"]: r[1] for r in packed}[900002] == 1 and {r["doc_id"]: r[1] for r in packed}[900001] == 1


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns, seen = docs.columns, {r["doc_id"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert ids <= seen
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and docs.count() == len(ids)
            docs.write.mode("overwrite").parquet(path := f"{tmp_path}/{k}")
            docs = spark.read.parquet(path)
        if name == "quality classifier":
            clean = {d for d, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0}
            assert len(clean & ids) >= 0.95 * len(clean & seen)
        seen = ids
    assert {"sequence_id", "offset"} <= set(docs.columns)


def test_every_operator_has_one_query():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 11))
