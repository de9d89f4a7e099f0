"""Queries that take every row of their tables, against counts worked out in plain Python."""

import pytest

from corpusloom.operators import graph
from corpusloom.plans.graph_queries import STORED
from corpusloom.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def long_tables(spark, tmp_path_factory):
    """A document of 1200 lines, its successor, and one whose first line is blank."""
    d = str(tmp_path_factory.mktemp("long"))
    texts = [(1, "\n".join(f"line {i}" for i in range(1200))), (2, "one\n\ntwo"), (3, " \nlate"), (4, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d


def test_every_chunk_has_a_node_of_its_own(spark, long_tables):
    got = QUERIES["k1_chunk_nodes"](spark, long_tables).collect()
    assert len(got) == 1203 == len({r["node_key"] for r in got})
    assert sorted(r["name"] for r in got if r["doc"] != "1") == ["Chunk 0", "Chunk 1", "Chunk 2"]
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert QUERIES["k1_chunk_nodes"](spark, SF).count() == sum(x.strip(" ") != "" for t in texts if t is not None for x in t.split("\n"))


def test_the_build_takes_every_chunk_and_is_merged(spark, long_tables):
    vectors = [(i, [1.0] + [0.0] * 62 + [float(i)], 0) for i in (1, 2, 3)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{long_tables}/embeddings.parquet")
    got = QUERIES["k4_build_graph"](spark, long_tables).first().asDict()
    assert got == {"fetched": 1203, "valid": 3, "skipped": 1200, "nodes": 3, "edges": 6, "stored_nodes": 3, "stored_edges": 6}


def test_a_second_build_adds_no_rows(spark):
    docs = spark.createDataFrame([(1, "c1"), (2, "c2")], "id long, client_id string")
    chunks = spark.createDataFrame([("t", 10, 1, 0, "a", [1.0, 0.0]), ("t", 20, 2, 0, "b", [1.0, 0.1]), ("t", 21, 2, 1, "c", None)], "tenant_id string, id long, document_id long, chunk_index int, content string, embedding array<float>")
    nodes, edges, _ = graph.build_graph(chunks, docs, 2, 0.5)
    old = [spark.createDataFrame([], STORED.format(x)) for x in ("node_key string, name string, embedding array<float>", "src_id long, dst_id long, rel_type string, weight double, is_active boolean")]
    for _ in range(2):
        old = graph.merge_graph(nodes, edges, *old, "2024-01-01")
    assert sorted((r["client_id"], r["node_key"], r["seen_count"], r["embedding"][0]) for r in old[0].collect()) == [("c1", "chunk:10", 2, 1.0), ("c2", "chunk:20", 2, 1.0)]
    assert sorted((r["client_id"], r["src_id"], r["dst_id"], r["seen_count"], r["is_active"], r["rel_type"]) for r in old[1].collect()) == [("c1", 10, 20, 2, True, "related_to"), ("c2", 20, 10, 2, True, "related_to")]


def test_results_have_the_whole_text(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = [r for r in QUERIES["g4_result_rows"](spark, SF).collect() if r["node_id"] in texts and r["node_id"] % 5]
    assert any("\n" in r["content"] for r in got)
    assert all(r["content"] == texts[r["node_id"]] for r in got if texts[r["node_id"]])


@pytest.fixture(scope="module")
def cut_pages(spark, tmp_path_factory):
    """Pages whose titles and texts were cut within a character reference, or hold what only looks like one."""
    d = str(tmp_path_factory.mktemp("cut"))
    said = ["Auf&amp", "A &amp;&am", "&amp &amp; &copy &copy;", "R&D &lt 3 &lt; 4", "&nosuch; &#39;x&#39 &amp;lt;", "one&nbsp;two &quot", "&", "plain", "&middot &middot; &ampx;"]
    pages = [(k, f"http://s{k % 2}.example/p{k}?a=1&amp=2", f"<html><head><title>{s}</title></head><body><h1>{s}</h1><p>More {s}</p><a href='/x'>{s}</a></body></html>") for k, s in enumerate(said)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


@pytest.mark.parametrize("name", ["t11_extract_html", "t10_web_pages", "s12_number_pages"])
def test_references_cut_short_are_those_of_the_sql(spark, cut_pages, name):
    import duckdb

    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{cut_pages}/pages.parquet/*.parquet'")
    want = c.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, cut_pages).select(want.columns).collect()
    as_list = lambda rows: sorted(repr([list(v) if isinstance(v, (list, tuple)) else v for v in r]) for r in rows)
    assert as_list(got) == as_list(want.fetchall()) and len(got) == 9


@pytest.fixture(scope="module")
def many_vectors(spark, tmp_path_factory):
    """Two equal halves of 20,000 vectors, of which every twentieth asks."""
    import os

    import numpy as np
    import pandas as pd

    d = str(tmp_path_factory.mktemp("vectors"))
    x = np.tile(np.random.default_rng(6).normal(size=(20_000, 16)).astype(np.float32), (2, 1))
    frame = pd.DataFrame({"vec_id": range(40_000), "embedding": list(x), "label": 0})
    spark.createDataFrame(frame, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    for t in ("documents", "events"):
        os.symlink(f"{SF}/{t}.parquet", f"{d}/{t}.parquet")
    return d


#: Rows of each search over many_vectors, where they hang on no other table.
SEARCHES = {"g7_retry": 10_000, "g6_confidence_gate": 2_000, "g8_all_nodes": 100_000, "g3_graph_search": None, "g4_result_rows": None, "g9_format_sources": 2_000, "a11_retrieval_stats": 2_000, "a10_ordered_text": 2_000, "g1_semantic_search": 10_000}


@pytest.mark.parametrize("name", SEARCHES)
def test_searches_sort_few_of_their_pairs(spark, many_vectors, name):
    """73 million pairs within a time in which they can be compared but not sorted."""
    import time

    QUERIES[name](spark, SF).collect()  # what starts once
    begun = time.time()
    got = QUERIES[name](spark, many_vectors).collect()
    assert time.time() - begun < 15
    assert len({r["query_id"] for r in got}) == 2000 and SEARCHES[name] in (None, len(got))


def test_critical_values_of_small_samples(spark, tmp_path):
    """Two-sided 95 % values from printed tables."""
    known = {2: 12.706, 3: 4.303, 4: 3.182, 6: 2.571, 11: 2.228, 31: 2.042}
    spark.createDataFrame([(n,) for n in [1, *known] for _ in range(n)], "o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert {r["n"]: r["t"] for r in QUERIES["n9_t_table"](spark, str(tmp_path)).collect()} == known
