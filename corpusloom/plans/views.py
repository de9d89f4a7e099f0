"""Views over the given tables in the shape of the engine's own tables, as SQL that Spark and DuckDB both take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (base tables, SQL for both engines, or a pair of Spark's and DuckDB's)
VIEWS = {
    "f_documents": (["documents"], "select doc_id as id, lang as tenant_id, source as client_id, case doc_id % 5 when 0 then 'vtt' when 1 then 'pdf' when 2 then 'docx' when 3 then 'web' else 'xlsx' end as source_type, concat('bucket:pdf/', cast(doc_id as string), '.pdf') as source_uri, text from documents"),
    "f_chunks": (
        ["documents"],
        (
            "select doc_id as document_id, lang as tenant_id, source as client_id, chunk_index, content from documents lateral view posexplode(split(text, '\\n')) t as chunk_index, content where trim(content) <> ''",
            "select document_id, tenant_id, client_id, chunk_index, content from (select doc_id as document_id, lang as tenant_id, source as client_id, cast(generate_subscripts(string_split(text, chr(10)), 1) - 1 as int) as chunk_index, unnest(string_split(text, chr(10))) as content from documents) where trim(content) <> ''",
        ),
    ),
    "f_nodes": (["embeddings"], "select vec_id as id, 't0' as tenant_id, label as client_id, embedding, case when vec_id % 11 = 0 then 'archived' else 'active' end as status, cast(vec_id % 365 as int) as age_days from embeddings"),
    "f_edges": (["events"], "select min(event_id) as id, user_id as src_id, (user_id * 7 + event_id) % 150 as dst_id, max(value) / 500 as weight, min(event_id) % 3 <> 0 as is_active, cast(min(event_id) % 200 as int) as age_days from events group by user_id, (user_id * 7 + event_id) % 150"),
    "f_evidence": (["events"], "select event_id as id, user_id as edge_id, event_id % 97 as node_id, case when event_id % 7 = 0 then null else value end as score, ts as created_at from events"),
    "f_rating": (["events"], "select event_type as question_id, 'rating' as question_type, user_id as respondent_id, cast(1 + event_id % 5 as double) as value_num from events"),
    "f_choice": (["events"], "select 'q_choice' as question_id, 'multiple_choice' as question_type, event_id as respondent_id, event_type as value_str from events"),
    "f_yes_no": (["events"], "select 'q_yes_no' as question_id, 'yes_no' as question_type, event_id as respondent_id, event_type in ('purchase', 'signup') as value_bool from events"),
    "f_picks": (["events"], "select distinct 'q_checkbox' as question_id, user_id as respondent_id, cast(ts as date) as day, event_type as value_str from events"),
    "f_ranks": (["events"], "select 'q_ranking' as question_id, user_id as respondent_id, event_type as item, row_number() over (partition by user_id order by count(*) desc, event_type) as rank from events group by user_id, event_type"),
    "f_cues": (["conversations"], "select conv_id, turn as idx, cast(turn * 45 as double) as start_s, role as speaker, text from conversations"),
    "f_outputs": (["events"], "select event_id as id, user_id as client_id, event_type as output_type, ts as created_at, ts + interval 7 days as expires_at from events"),
    "f_items": (["events"], "select user_id as batch_id, event_id as idx, case when event_type = 'error' then 'failed' else 'complete' end as status from events"),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bases, sql = VIEWS[name]
    sql = sql if isinstance(sql, str) else sql[0]
    frames = {b: read(spark, sf_dir, b) for b in bases}
    for b in bases:
        sql = sql.replace(f"from {b}", f"from {{{b}}}")
    return spark.sql(sql, **frames)


def oracle(body: str, *names: str) -> str:
    """SQL for DuckDB with the views it needs in front."""
    parts = [f"{n} as ({s if isinstance(s, str) else s[1]})" for n in names for _, s in [VIEWS[n]]]
    body = body.strip()
    head = "with recursive " if body.lower().startswith("with recursive ") else "with "
    rest = body[len(head) :] if body.lower().startswith("with ") else None
    return (head + ", ".join(parts) + (", " + rest if rest else " " + body)) if parts else body
