"""Queries: profiles, JSON and form operators, model calls, streams."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import context as C
from .ingest_queries import chunks_sql, norm_sql
from .registry import query
from .views import VIEWS, read, view


@query(
    """select c_custkey, 'Company / Client Profile:' || chr(10) || 'Industry: ' || c_mktsegment || case when c_custkey % 3 = 0 then '' else chr(10) || 'Headcount: ' || c_custkey end || case when c_custkey % 2 = 0 then chr(10) || 'Location: ' || c_nationkey else '' end || chr(10) as strategic,
    chr(10) || chr(10) || 'Organization profile:' || chr(10) || 'Industry: ' || c_mktsegment || case when c_custkey % 3 = 0 then '' else chr(10) || 'Headcount: ' || c_custkey || ' employees' end || chr(10) || 'Company: ' || c_name || case when c_custkey % 2 = 0 then chr(10) || 'Location: ' || c_nationkey else '' end as survey from customer"""
)
def c2_profile_section(spark, d):
    none = F.lit(None).cast("string")
    demo = F.struct(none.alias("age_range"), none.alias("income_bracket"), F.lit("").alias("occupation"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("string")).alias("location"))
    p = F.struct(F.col("c_mktsegment").alias("industry"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey")).alias("headcount"), none.alias("revenue"), F.col("c_name").alias("company_name"), none.alias("persona"), demo.alias("demographic"))
    rows = read(spark, d, "customer").select("c_custkey", p.alias("p"))
    return rows.select("c_custkey", C.profile_section("p", "strategic").alias("strategic"), C.profile_section("p", "survey").alias("survey"))


@query("select c_custkey, case when c_custkey % 4 = 0 then ['a', 'b', 'c'] else [case when c_custkey % 3 = 0 then '' else c_mktsegment || ' ' end || c_name] end as queries from customer")
def c3_web_queries(spark, d):
    rows = read(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("industry"), F.col("c_name").alias("focus"), F.when(F.col("c_custkey") % 4 == 0, F.array(*map(F.lit, "abcd"))).otherwise(F.array().cast("array<string>")).alias("web_queries"))
    return C.web_queries(rows).select("c_custkey", "queries")


@query("select o_custkey as query_id, string_agg('[Web Result ' || k || '] ' || o_orderpriority || chr(10) || 'URL: http://o/' || o_orderkey || chr(10) || o_orderstatus, chr(10) || chr(10) order by k) as context from (select *, row_number() over (partition by o_custkey order by o_orderkey) as k from orders) group by o_custkey")
def c4_results_context(spark, d):
    o = read(spark, d, "orders")
    return C.results_context(o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("http://o/"), F.col("o_orderkey").cast("string")).alias("link"), F.col("o_orderstatus").alias("snippet")))


def hash_embedder(texts):
    """A stand-in for a model: eight figures from a digest."""
    return [[b / 255 for b in hashlib.md5((t or "").encode()).digest()[:8]] for t in texts]


@query(
    """select document_id, chunk_index, 8 as dim, round(list_sum(list_transform(range(8), lambda i: cast('0x' || substring(md5('Embed: ' || content), 2 * i + 1, 2) as int) / 255.0)), 6) as total from f_chunks""",
    ("f_chunks",),
)
def c5_infer(spark, d):
    rows = view(spark, d, "f_chunks").select("document_id", "chunk_index", F.concat(F.lit("Embed: "), "content").alias("prompt"))
    return C.infer(rows, "prompt", hash_embedder, "array<double>").select("document_id", "chunk_index", F.size("result").alias("dim"), F.round(F.aggregate("result", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def raw_outputs(spark, d):
    """Model outputs made of events: plain JSON, fenced JSON, and text."""
    k = F.col("event_id") % 3
    body = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "name": "'), F.col("event_type"), F.lit('"}'))
    raw = F.when(k == 0, body).when(k == 1, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone."))).otherwise(F.concat(F.lit("no JSON: "), F.col("event_type")))
    return read(spark, d, "events").select("event_id", raw.alias("raw"))


@query("select event_id, case when event_id % 3 < 2 then cast(json_extract(props, '$.k') as bigint) else -1 end as k, case when event_id % 3 < 2 then event_type else 'none' end as name, case when event_id % 3 = 0 then cast(json_extract(props, '$.k') as bigint) else -1 end as strict_k from events")
def c6_salvage_json(spark, d):
    """Both ways: with the fenced block (C6) and without (C12)."""
    none = F.struct(F.lit(-1).alias("k"), F.lit("none").alias("name"))
    schema = "struct<k:bigint,name:string>"
    rows = raw_outputs(spark, d).select("event_id", C.salvage_json(F.col("raw"), schema, none).alias("j"), C.ensure_parsed(F.col("raw"), schema, none).alias("s"))
    return rows.select("event_id", "j.k", "j.name", F.col("s.k").alias("strict_k"))


def forms(spark, d):
    """Question lists made of orders: bare, wrapped twice over, and broken."""
    q = F.concat(F.lit('{"type": "'), F.when(F.col("o_orderkey") % 2 == 0, "rating").otherwise("multiple_choice"), F.lit('", "text": "About '), F.col("o_orderpriority"), F.lit('", "options": ["x", "y"], "max": 7}'))
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.concat(F.lit("["), q, F.lit(", "), q, F.lit("]"))).when(k == 1, F.concat(F.lit('{"questions": ['), q, F.lit("]}"))).when(k == 2, F.concat(F.lit('```\n{"recommendations": ['), q, F.lit("]}\n```"))).otherwise("{}")
    return read(spark, d, "orders").select("o_orderkey", raw.alias("raw"))


@query(
    """select o_orderkey, p as pos, case when p is not null then case when o_orderkey % 2 = 0 then 'rating' else 'multiple_choice' end end as type, case when p is not null then 'About ' || o_orderpriority end as text, case when p is not null then 'x,y' end as options
    from (select *, unnest(case o_orderkey % 4 when 3 then [null::int] when 0 then [0::int, 1::int] else [0::int] end) as p from orders)"""
)
def c7_unwrap_questions(spark, d):
    """Every question of every form, in order; a form without any is one row of nulls."""
    rows = forms(spark, d).select("o_orderkey", F.posexplode_outer(C.unwrap_questions(C.json_variant(F.col("raw")))).alias("pos", "q"))
    get = lambda p, t="string": F.try_variant_get("q", f"$.{p}", t)
    return rows.select("o_orderkey", "pos", get("type").alias("type"), get("text").alias("text"), F.array_join(get("options", "array<string>"), ",").alias("options"))


@query(
    """select o_orderkey, unnest(case o_orderkey % 4 when 3 then [null::int] when 0 then [0::int, 1::int] else [0::int] end) as pos, case when o_orderkey % 4 = 3 then 'parse_error' else 'complete' end as status, case when o_orderkey % 4 <> 3 then case when o_orderkey % 2 = 0 then 'rating' else 'multiple_choice' end end as type, case when o_orderkey % 4 <> 3 then 'About ' || o_orderpriority end as label,
    case when o_orderkey % 4 <> 3 and o_orderkey % 2 = 0 then 7 end as max, case when o_orderkey % 4 <> 3 and o_orderkey % 2 = 0 then 'Poor' end as low, case when o_orderkey % 4 = 1 then 2 end as options from orders"""
)
def c8_normalize_questions(spark, d):
    """Every question of every form; a form without any is one row of nulls."""
    rows = C.normalize_questions(forms(spark, d), "raw").select("o_orderkey", "status", F.posexplode_outer("questions").alias("pos", "q"))
    q = F.col("q")
    return rows.select("o_orderkey", "pos", "status", q["type"].alias("type"), q["label"].alias("label"), q["max"].alias("max"), q["lowLabel"].alias("low"), F.when(q["options"].isNotNull(), F.size(q["options"])).alias("options"))


@query(
    """select o_custkey as survey_id, string_agg('Q' || k || '. [' || o_orderstatus || '] ' || o_orderpriority || case when o_orderkey % 2 = 0 then chr(10) || '   Options: x, y' else '' end || case when o_orderkey % 3 = 0 then chr(10) || '   Response summary: ' || o_orderkey else '' end, chr(10) || chr(10) order by k) as text
    from (select *, row_number() over (partition by o_custkey order by o_orderkey) as k from orders) group by o_custkey"""
)
def c9_render_survey(spark, d):
    o = read(spark, d, "orders")
    options = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array().cast("array<string>"))
    return C.render_survey(o.select(F.col("o_custkey").alias("survey_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("label"), options.alias("options"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey").cast("string")).alias("response_summary")))


@query("select p_partkey, 'Q1: ' || case when length(p_name) + 1 < 10 then 'too short — may lack clarity' else 'OK' end || chr(10) || 'Q2: does not end with ''?''; yes/no question — consider rephrasing as open-ended' as feedback from part")
def c10_lint_questions(spark, d):
    text = F.concat("p_name", F.lit("? | | Do you like "), "p_brand", F.lit("s"))
    return read(spark, d, "part").select("p_partkey", C.lint_questions(text).alias("feedback"))


@query("select p_partkey, '{\"title\":\"' || p_brand || '\",\"description\":\"d\",\"questions\":[{\"id\":1,\"text\":\"' || p_name || '?\",\"type\":\"open_ended\"},{\"id\":2,\"text\":\"Why?\",\"type\":\"open_ended\"}]}' as survey from part")
def c11_pipe_survey(spark, d):
    return read(spark, d, "part").select("p_partkey", C.pipe_survey(F.col("p_brand"), F.lit("d"), F.concat("p_name", F.lit("? || Why? |"))).alias("survey"))


@query("select event_id, case event_type when 'purchase' then 'buy' || chr(10) || 'sign' when 'signup' then 'sign' else 'sign' end as text from events")
def c13_type_instructions(spark, d):
    e = read(spark, d, "events").select("event_id", F.array("event_type", F.lit("signup"), F.lit("unknown")).alias("t"), "event_type")
    t = F.when(F.col("event_type") == "signup", F.array(F.lit("signup"))).otherwise(F.col("t"))
    return e.select("event_id", C.type_instructions(t, {"purchase": "buy", "signup": "sign"}).alias("text"))


QUOTE = "substring(coalesce(text, ''), 5, 60)"


def answers(spark, d):
    """(doc_id, kind, raw): answers in the form that the prompts ask for, plain, fenced, as text without JSON, and with fields missing."""
    docs = read(spark, d, "documents").withColumn("quote", F.expr(QUOTE))
    s = lambda **fields: F.struct(*[(v if hasattr(v, "alias") else F.lit(v)).alias(k) for k, v in fields.items()])
    n = F.col("doc_id").cast("string")
    full = {
        "sentiment": s(overall_sentiment=s(positive=0.5, negative=0.25, neutral=0.25), dominant_sentiment="positive", themes=F.array(s(theme=F.col("lang"), sentiment="mixed", confidence=0.85, description=F.col("source")), s(theme="second", sentiment="neutral", confidence=0.5, description="d")), notable_quotes=F.array(s(quote=F.col("quote"), sentiment="neutral", theme=F.col("lang"))), summary=F.concat(F.lit("Summary of "), n)),
        "insights": s(summary=F.concat(F.lit("Insights of "), n), actionable_insights=F.array(s(title=F.concat(F.lit("Title "), n), description=F.col("source"), category="ux", source_quote=F.col("quote"), priority="high"))),
        "strategic": s(executive_summary=F.concat(F.lit("Plan of "), n), convergent_themes=F.array(F.col("lang"), F.col("source")), action_points=F.array(s(title=F.concat(F.lit("Do "), n), description=F.col("quote"), priority="low", evidence=F.array(F.col("source"), F.lit("doc")))), future_recommendations=F.array(F.lit("next"))),
    }
    bare = {"sentiment": '{"dominant_sentiment": "negative"}', "insights": '{"actionable_insights": [{"title": "T"}]}', "strategic": '{"action_points": [{"title": "T"}]}'}
    k, out = F.col("doc_id") % 4, []
    for kind, fields in full.items():
        body = F.to_json(fields)
        raw = F.when(k == 0, body).when(k == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\n"))).when(k == 2, F.concat(F.lit("No JSON for "), n)).otherwise(F.lit(bare[kind]))
        out.append(docs.select("doc_id", F.lit(kind).alias("kind"), raw.alias("raw")))
    return out


@query(
    f"""with d as (select doc_id, doc_id % 4 as k, lang, source, {QUOTE} as quote, cast(doc_id as varchar) as n from documents)
    select doc_id, 'sentiment' as kind, case when k < 2 then 'Summary of ' || n when k = 2 then 'No JSON for ' || n else '' end as summary,
      case when k < 2 then 'positive;0.5,0.25,0.25;' || lang || '/mixed/0.85/' || source || '|second/neutral/0.5/d;' || quote || '/neutral/' || lang when k = 2 then 'neutral;0.33,0.33,0.34;;' else 'negative;-;;' end as body from d
    union all select doc_id, 'insights', case when k < 2 then 'Insights of ' || n when k = 2 then 'No JSON for ' || n else '' end, case when k < 2 then 'Title ' || n || '/' || source || '/ux/' || quote || '/high' when k = 2 then '' else 'T/-/-/-/medium' end from d
    union all select doc_id, 'strategic', case when k < 2 then 'Plan of ' || n when k = 2 then 'No JSON for ' || n else '' end, case when k < 2 then lang || ',' || source || ';Do ' || n || '/' || quote || '/low/' || source || '+doc;next' when k = 2 then ';;' else ';T/-/-/;' end from d"""
)
def c14_project_result(spark, d):
    """All fields of the three kinds of results, each as one line of text."""
    text = lambda x: F.coalesce(x.cast("string"), F.lit("-"))
    line = lambda *fields: lambda x: F.concat_ws("/", *[text(x[f]) for f in fields])
    each = lambda col, *fields: F.array_join(F.transform(col, line(*fields)), "|")
    sentiment, insights, strategic = (C.project_result(rows, "raw", kind) for rows, kind in zip(answers(spark, d), ("sentiment", "insights", "strategic"), strict=True))
    s = F.col("overall_sentiment")
    shares = F.when(s.isNull(), "-").otherwise(F.concat_ws(",", s["positive"], s["negative"], s["neutral"]))
    points = F.array_join(F.transform("action_points", lambda x: F.concat_ws("/", text(x["title"]), text(x["description"]), text(x["priority"]), F.array_join(x["evidence"], "+"))), "|")
    parts = [
        sentiment.select("doc_id", "kind", "summary", F.concat_ws(";", "dominant_sentiment", shares, each("themes", "theme", "sentiment", "confidence", "description"), each("notable_quotes", "quote", "sentiment", "theme")).alias("body")),
        insights.select("doc_id", "kind", "summary", each("actionable_insights", "title", "description", "category", "source_quote", "priority").alias("body")),
        strategic.select("doc_id", "kind", F.col("executive_summary").alias("summary"), F.concat_ws(";", F.array_join("convergent_themes", ","), points, F.array_join("future_recommendations", ",")).alias("body")),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    """with d as (select doc_id as i from documents where length(text) > 64)
    select i as client_id, unnest(list_filter([case when i % 2 = 0 then 'fractions do not sum to 1' end, case when i % 3 = 0 then 'dominant is not the largest' end, case when i % 5 = 0 then 'themes not 3 to 8' end, case when i % 7 = 0 then 'quote not in the transcript' end, case when i % 11 = 0 then 'confidence not between 0 and 1' end, case when i % 13 = 0 then 'unknown sentiment' end], lambda x: x is not null)) as violation, 'sentiment' as kind from d
    union all select i, unnest(list_filter([case when i % 2 = 0 then 'insights not 3 to 10' end, case when i % 3 = 0 then 'unknown category' end, case when i % 5 = 0 then 'unknown priority' end, case when i % 7 = 0 then 'quote not in the transcript' end, case when i % 11 = 0 then 'summary not 3 to 6 sentences' end], lambda x: x is not null)), 'insights' from d"""
)
def c15_check_results(spark, d):
    """Results with real quotes of 60 characters, each rule broken for some documents."""
    docs = read(spark, d, "documents").where("length(text) > 64").withColumn("quote", F.expr(QUOTE))
    i = F.col("doc_id")
    s = lambda **fields: F.struct(*[(v if hasattr(v, "alias") else F.lit(v)).alias(k) for k, v in fields.items()])
    quote = lambda q: s(quote=q, sentiment=F.when(i % 13 == 0, "furious").otherwise("neutral"), theme=F.lit(None).cast("string"))
    theme = s(theme="t", sentiment="mixed", confidence=F.when(i % 11 == 0, 1.5).otherwise(0.5), description="d")
    told = docs.select(
        i.alias("client_id"), s(positive=F.when(i % 2 == 0, 0.6).otherwise(0.5), negative=0.25, neutral=0.25).alias("overall_sentiment"), F.when(i % 3 == 0, "negative").otherwise("positive").alias("dominant_sentiment"),
        F.when(i % 5 == 0, F.array(theme)).otherwise(F.array(theme, theme, theme)).alias("themes"), F.array(quote(F.col("quote")), quote(F.col("quote")), quote(F.when(i % 7 == 0, "~never~").otherwise(F.col("quote")))).alias("notable_quotes"),
    )
    insight = s(title="t", description="d", category=F.when(i % 3 == 0, "wish").otherwise("ux"), source_quote=F.when(i % 7 == 0, "~never~").otherwise(F.col("quote")), priority=F.when(i % 5 == 0, "urgent").otherwise("low"))
    summary = F.when(i % 11 == 0, "One. Two.").otherwise("One. Two. Three.")
    found = docs.select(i.alias("client_id"), summary.alias("summary"), F.when(i % 2 == 0, F.array(insight, insight)).otherwise(F.array(insight, insight, insight)).alias("actionable_insights"))
    texts = docs.select(i.alias("client_id"), "text")
    return C.check_results(told, texts).withColumn("kind", F.lit("sentiment")).unionByName(C.check_results(found, texts, "insights").withColumn("kind", F.lit("insights")))


@query(
    """with o as (select o_orderkey as i from orders)
    select i as question_id, unnest(list_filter([case when i % 5 = 0 then 'unknown type' end, case when i % 7 = 0 then 'no label' end, case when i % 3 = 0 then 'id is not a UUID of version 4' end, case when i % 5 <> 0 and i % 2 = 0 then 'options not 3 to 6' end,
      case when i % 5 = 0 then 'fields of another type' end], lambda x: x is not null)) as violation from o"""
)
def c15_check_questions(spark, d):
    """Choice questions made of orders: types, labels, ids and numbers of options out of order for some."""
    i = F.col("o_orderkey")
    version = F.when(i % 3 == 0, "1").otherwise("4")
    uuid = F.concat(F.lit("00000000-0000-"), version, F.lit("000-8000-"), F.lpad(i.cast("string"), 12, "0"))
    options = F.when(i % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    q = F.struct(uuid.alias("id"), F.when(i % 5 == 0, "essay").otherwise("checkbox").alias("type"), F.when(i % 7 == 0, " ").otherwise("Which?").alias("label"), F.lit(True).alias("required"), options.alias("options"))
    return C.check_questions(read(spark, d, "orders").select(i.alias("question_id"), F.to_json(q).alias("question")))


@query(
    chunks_sql(f"select document_id, chunk_index + 1 as page, {norm_sql('content')} as text from f_chunks", 200, 30)
    + " select c.document_id, source_type, chunk_index, c.text as content, start_page as page_start, end_page as page_end, token_count as content_tokens from chunks c join f_documents f on c.document_id = f.id",
    ("f_chunks", "f_documents"),
)
def r1_incremental_ingest(spark, d):
    """Documents read as a stream, one page a line; every chunk's text, and its document's type, as the tables hold them after it."""
    from ..session import work_folder
    from ..streaming import ingest

    def prepare(batch):
        rows = batch.sparkSession.sql(VIEWS["f_documents"][1].replace("from documents", "from {documents}"), documents=batch)
        found = rows.select("tenant_id", "client_id", "source_uri", "source_type", F.lit(None).cast("string").alias("title"), F.create_map(F.lit("id"), F.col("id").cast("string")).alias("metadata"))
        lines = rows.select("tenant_id", F.col("id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("page", "text"))
        return found, lines.where("trim(text) <> ''").withColumn("page", F.col("page") + 1)

    documents, chunks = ingest.run(spark, f"{d}/documents.parquet", prepare, work_folder(spark, "ingest"), "2024-01-20", 200, 30, buckets=16)
    kinds = documents.select(F.col("metadata")["id"].cast("long").alias("document_id"), "source_type")
    return chunks.join(kinds, "document_id").select("document_id", "source_type", "chunk_index", "content", "page_start", "page_end", "content_tokens")


@query(
    """select conv_id as transcript_id, cast((k - 1) // 3 + 1 as int) as page, count(*) as cues, string_agg('[' || coalesce(speaker, '') || ']: ' || coalesce(text, ''), chr(10) order by idx) as text
    from (select *, row_number() over (partition by conv_id order by idx) as k from f_cues) group by conv_id, (k - 1) // 3""",
    ("f_cues",),
)
def r2_live_pages(spark, d):
    """Conversations read as a stream of cues; every page, closed or still open, is what the stream sent."""
    from ..session import work_folder
    from ..streaming import live_pages

    out = live_pages.newest_pages(live_pages.run(spark, f"{d}/conversations.parquet", work_folder(spark, "live")))
    return out.select("transcript_id", "page", F.col("cues").cast("long").alias("cues"), "text")


@query("select batch_id, count(*) as total, count(*) filter (where status = 'complete') as completed, count(*) filter (where status = 'failed') as failed, case when count(*) filter (where status = 'failed') = count(*) then 'failed' when count(*) filter (where status = 'failed') > 0 then 'partial_failure' else 'complete' end as status from f_items group by batch_id", ("f_items",))
def r3_live_status(spark, d):
    from ..session import work_folder
    from ..streaming import live_status

    return live_status.run(spark, f"{d}/events.parquet", work_folder(spark, "status"))
