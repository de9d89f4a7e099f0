"""Queries: sources, text and page preparation, transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, pages, rollups, scans, transcripts
from .registry import query
from .views import read, view


@query("select id, source_type from f_documents where tenant_id = 'en' and client_id = 'src3'", ("f_documents",))
def s1_scope(spark, d):
    return scans.scope(view(spark, d, "f_documents"), "en", "src3").select("id", "source_type")


W = "[\\p{L}\\p{N}\\p{M}_]"
def norm_sql(x: str) -> str:
    """Text normalisation without lookaround: runs of newlines are set aside as chr(1) while single ones become blanks."""
    t = f"regexp_replace({x}, '({W})-\\n({W})', '\\1\\2', 'g')"
    t = f"replace(replace(replace(replace({t}, chr(10) || chr(10), chr(1) || chr(1)), chr(1) || chr(10), chr(1) || chr(1)), chr(10), ' '), chr(1), chr(10))"
    return f"regexp_replace(regexp_replace(regexp_replace({t}, '\\n\\s*\\n+', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g'), '[ \\t]+', ' ', 'g')"


HIDDEN = "|".join(f"<{t}\\b.*?</{t}\\s*>" for t in ("script", "style", "nav", "header", "footer", "noscript", "head")) + "|<!--.*?-->"
REFS = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def html_sql() -> str:
    t = f"regexp_replace(regexp_replace(coalesce(html, ''), '(?is){HIDDEN}', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
    title = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
    for ref, sign in REFS:
        t, title = (f"replace({x}, '{ref.replace(chr(39), chr(39) * 2)}', '{sign}')" for x in (t, title))
    return f"""extracted as (select page_id, url, trim({title}) as title, trim(regexp_replace({t}, '\\s+', ' ', 'g')) as text,
    regexp_extract_all(html, '(?i)<a\\s[^>]*href=["'']([^"'']*)', 1) as links, lower(regexp_extract(url, '://([^/?#]*)', 1)) as site from pages)"""


EMBEDDED = "select c.document_id, c.tenant_id, d.client_id, c.chunk_index, length(c.content) as n from f_chunks c join embeddings e on e.vec_id = c.document_id join f_documents d on d.id = c.document_id"


def embedded(spark, d):
    """Chunks with the vector of their document, where it has one."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("document_id"), F.col("embedding").alias("_e"))
    return view(spark, d, "f_chunks").join(e, "document_id", "left").withColumnRenamed("_e", "embedding")


@query(EMBEDDED, ("f_chunks", "f_documents"))
def s2_embedded_chunks(spark, d):
    return scans.embedded_chunks(embedded(spark, d), view(spark, d, "f_documents")).select("document_id", "tenant_id", "client_id", "chunk_index", F.length("content").alias("n"))


@query("select * from (" + EMBEDDED + ") order by document_id, chunk_index limit 2000 offset 500", ("f_chunks", "f_documents"))
def s3_capped_chunks(spark, d):
    """The paged fetch with its cap of 2000, the operator's feature."""
    return scans.embedded_chunks(embedded(spark, d), view(spark, d, "f_documents"), limit=2000, offset=500).select("document_id", "tenant_id", "client_id", "chunk_index", F.length("content").alias("n"))


@query("select id, 'pdf' as bucket, concat(cast(id as string), '.pdf') as path, 'pdf' as file_type from f_documents union all select -1 - id, 'mine', concat('a/', cast(id as string), '.VTT'), 'vtt' from f_documents", ("f_documents",))
def s6_storage_uri(spark, d):
    docs = view(spark, d, "f_documents")
    stored = docs.select((-1 - F.col("id")).alias("id"), F.concat(F.lit("https://h/storage/v1/object/sign/mine/a/"), F.col("id").cast("string"), F.lit(".VTT?token=x/y")).alias("source_uri"))
    rows = docs.select("id", "source_uri").unionByName(stored)
    return rows.select("id", T.parse_storage_uri(F.col("source_uri")).alias("u")).select("id", "u.bucket", "u.path", "u.file_type").withColumn("file_type", F.lower("file_type"))


@query("select p_partkey, concat(trim(regexp_replace(regexp_replace(concat(p_name, ' (', p_brand, ')'), '[\\s\\[\\](),!@#$%^&+={}|;:''\"<>?]+', '_', 'g'), '_+', '_', 'g'), '_'), '.pdf') as key from part")
def s7_sanitize_key(spark, d):
    return read(spark, d, "part").select("p_partkey", T.sanitize_key(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(").pdf"))).alias("key"))


@query(
    """select cast(id as string) as path, case when id % 7 = 0 then 'not found' when source_type not in ('pdf', 'docx', 'xlsx') then 'unsupported type' end as reject_reason from f_documents""",
    ("f_documents",),
)
def s8_route_sources(spark, d):
    docs = view(spark, d, "f_documents").select("id", F.concat(F.col("id").cast("string"), F.lit("."), "source_type").alias("path"), F.lit("document").alias("kind"))
    valid, rejects = scans.route_sources(docs, docs.where("id % 7 <> 0"))
    rows = valid.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(rejects)
    return rows.select(F.regexp_extract("path", r"^(\d+)", 1).alias("path"), "reject_reason")


@query("select vec_id, len(embedding) = 64 and vec_id % 13 <> 0 as is_valid from embeddings")
def s9_valid_embeddings(spark, d):
    """Vectors given as text; every thirteenth lacks its last figure."""
    e = read(spark, d, "embeddings")
    cut = F.when(F.col("vec_id") % 13 == 0, F.slice("embedding", 1, F.size("embedding") - 1)).otherwise(F.col("embedding"))
    return scans.valid_embeddings(e.select("vec_id", F.to_json(cut).alias("embedding")), 64).select("vec_id", "is_valid")


@query("select user_id, id, created_at, expires_at from (select user_id, event_id as id, timestamp '2024-01-20' as created_at, timestamp '2024-01-27' as expires_at from events)")
def s11_append_outputs(spark, d):
    from ..sources.readers import with_expiry

    return with_expiry(read(spark, d, "events").select("user_id", F.col("event_id").alias("id")), "2024-01-20").select("user_id", "id", "created_at", "expires_at")


def sites(spark, d):
    p = read(spark, d, "pages")
    return pages.extract_html(p).withColumn("site", F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1)))


@query("with " + html_sql() + " select site, cast(row_number() over (partition by site order by page_id, url) as int) as page, 'Title: ' || title || chr(10) || chr(10) || 'URL: ' || url || chr(10) || chr(10) || text as text from extracted where text <> ''")
def s12_number_pages(spark, d):
    return pages.number_pages(sites(spark, d).select("site", F.col("page_id").alias("ordinal"), "title", "url", "text"))


@query("select doc_id, " + norm_sql("text") + " as text from documents")
def t1_normalize_text(spark, d):
    return read(spark, d, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("text"))


@query("select doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}\\p{M}_]+|[^\\p{L}\\p{N}\\p{M}_\\s]')) as tokens from documents")
def t2_token_len(spark, d):
    return read(spark, d, "documents").select("doc_id", T.token_len(F.col("text")).alias("tokens"))


def sentences_sql(x: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"


def tokens_sql(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+|[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]'))"


def chunks_sql(pages: str, most: int, overlap: int) -> str:
    """CTEs up to chunks: chunk ranges by recursion over the running sums of each document's sentences, and of long sentences' words."""
    sums = "[0] || list(total order by {0})"
    ends = lambda start: f"len(list_filter(p, lambda x: x <= p[{start} + 1] + {most})) - 1"
    tail = f"least(c.past - 1, greatest(c.first, len(list_filter(p, lambda x: x < p[c.past + 1] - {overlap}))))" if overlap else "c.past"
    return f"""with recursive pages_in as ({pages}), raw as (select document_id, page, unnest({sentences_sql('text')}) as s, generate_subscripts({sentences_sql('text')}, 1) as k from pages_in),
    s as (select document_id, page, s, row_number() over (partition by document_id order by page, k) as pos, {tokens_sql('s')} as n from raw), last as (select document_id, max(page) as last from pages_in group by 1),
    short as (select document_id, list(s order by pos) as ss, list(page order by pos) as pg, list(pos order by pos) as ps, {sums.format('pos')} as p, count(*) as m from (select *, cast(sum(n) over (partition by document_id order by pos) as bigint) as total from s where n <= {most}) group by 1),
    c(document_id, first, past, start) as (select document_id, 0, greatest(1, {ends('0')}), pg[1] from short
      union all select document_id, first, greatest(past_before + 1, {ends('first')}), start from (select c.document_id, {tail} as first, c.past as past_before, short.pg[c.past + 1] as start, short.p from c join short using (document_id) where c.past < m)),
    w as (select document_id, page, pos, w, row_number() over (partition by document_id, pos order by k) as k, {tokens_sql('w')} as n from (select document_id, page, pos, unnest(regexp_split_to_array(s, '\\s+')) as w, generate_subscripts(regexp_split_to_array(s, '\\s+'), 1) as k from s where n > {most})),
    long as (select document_id, page, pos, list(w order by k) as ws, {sums.format('k')} as p, count(*) as m from (select *, cast(sum(n) over (partition by document_id, pos order by k) as bigint) as total from w) group by all),
    l(document_id, pos, first, past) as (select document_id, pos, 0, least(m, len(list_filter(p, lambda x: x < {most}))) from long
      union all select l.document_id, l.pos, l.past, least(m, len(list_filter(p, lambda x: x < p[l.past + 1] + {most}))) from l join long using (document_id, pos) where l.past < m),
    chunks as (select document_id, cast(row_number() over (partition by document_id order by place, first) - 1 as int) as chunk_index, text, cast(start_page as int) as start_page, cast(end_page as int) as end_page, cast(token_count as int) as token_count from (
      select document_id, case when past < m then ps[past + 1] else 1000000000 end as place, first, array_to_string(ss[first + 1:past], ' ') as text, start as start_page, case when past < m then pg[past + 1] else last end as end_page, p[past + 1] - p[first + 1] as token_count from c join short using (document_id) join last using (document_id)
      union all select document_id, pos, first, array_to_string(ws[first + 1:past], ' '), page, page, p[past + 1] - p[first + 1] from l join long using (document_id, pos)))"""


@query(f"select doc_id, array_to_string({sentences_sql('text')}, chr(10) || '|') as sentences from documents")
def t3_sentences(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(T.sentences(F.col("text")), "\n|").alias("sentences"))


LINES = "select document_id, chunk_index + 1 as page, content as text from f_chunks"


def line_pages(spark, d):
    return view(spark, d, "f_chunks").select("document_id", (F.col("chunk_index") + 1).alias("page"), F.col("content").alias("text"))


@query(chunks_sql(LINES, 200, 30) + " select * from chunks", ("f_chunks",))
def t4_chunk_pages(spark, d):
    return chunking.chunk_pages(line_pages(spark, d), 200, 30)


@query(chunks_sql(LINES, 12, 0) + " select * from chunks", ("f_chunks",))
def t5_split_sentences(spark, d):
    """A bound so low that most sentences are split by words."""
    return chunking.chunk_pages(line_pages(spark, d), 12, 0)


@query(chunks_sql(LINES, 60, 40) + " select * from chunks", ("f_chunks",))
def t6_overlap(spark, d):
    return chunking.chunk_pages(line_pages(spark, d), 60, 40)


@query(
    """select document_id, cast((rn - 1) // 8 + 1 as int) as page, string_agg(trim(content), chr(10) || chr(10) order by chunk_index) as text
    from (select *, row_number() over (partition by document_id order by chunk_index) as rn from f_chunks) group by document_id, (rn - 1) // 8""",
    ("f_chunks",),
)
def t7_paragraph_pages(spark, d):
    return pages.paragraph_pages(view(spark, d, "f_chunks").select("document_id", F.col("chunk_index").alias("ord"), F.col("content").alias("text")))


@query(
    """with lines as (select c_nationkey as book, c_mktsegment as sheet, c_custkey as ord, 'c_custkey: ' || c_custkey || ' | c_name: ' || c_name as line from customer),
    ranked as (select *, (row_number() over (partition by book, sheet order by ord) - 1) // 9 as part from lines),
    parts as (select book, sheet, part, count(*) as n, string_agg(line, ' ' order by ord) as body from ranked group by all),
    more as (select book, sheet, part, body from parts union all select book, sheet, max(part) + 1, null from parts group by book, sheet having arg_max(n, part) = 9)
    select book, cast(row_number() over (partition by book order by sheet, part) as int) as page, concat('[Sheet: ', sheet, case when part = 0 then ']' else ' (cont.)]' end, coalesce(' ' || body, '')) as text from more"""
)
def t8_table_pages(spark, d):
    c = read(spark, d, "customer").select(F.col("c_nationkey").alias("book"), F.col("c_mktsegment").alias("sheet"), F.col("c_custkey").alias("ord"), "c_custkey", "c_name")
    return pages.table_pages(c, ["c_custkey", "c_name"], rows_per_page=10)


TYPED = (
    "select document_id, page, " + norm_sql("body") + """ as text from (select document_id, cast((rn - 1) // 8 + 1 as int) as page, string_agg(trim(content), chr(10) || chr(10) order by chunk_index) as body
    from (select *, row_number() over (partition by document_id order by chunk_index) as rn from f_chunks where document_id % 5 = 2) group by document_id, (rn - 1) // 8)
    union all select id, 1, """ + norm_sql("text") + " from f_documents where source_type in ('web', 'pdf', 'vtt')"
)


@query(chunks_sql(TYPED, 200, 30) + " select * from chunks union all select id, null, 'unsupported type: ' || source_type, null, null, null from f_documents where source_type = 'xlsx'", ("f_chunks", "f_documents"))
def t9_to_chunks(spark, d):
    """Word documents by paragraphs, web pages, transcripts and files as one page each; sheets have no builder here and are rejected."""

    def paragraphs(df):
        return pages.paragraph_pages(df.select(F.col("id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("ord", "text"))).select("document_id", "page", T.normalize_text(F.col("text")).alias("text"))

    def one_page(df):
        return pages.web_pages(df.select(F.col("id").alias("document_id"), F.lit(1).alias("page"), "text"))

    chunks, rejects = chunking.to_chunks(view(spark, d, "f_documents"), {"docx": paragraphs, "web": one_page, "pdf": one_page, "vtt": one_page}, max_tokens=200, overlap_tokens=30)
    return chunks.unionByName(rejects.select(F.col("id").alias("document_id"), F.col("reject_reason").alias("text")), allowMissingColumns=True)


@query(
    """select 0 as branch, id as ordinal, source_uri as source from f_documents where source_type not in ('vtt', 'web') union all select 1, id, source_uri from f_documents where source_type = 'vtt' union all select 2, page_id, url from pages""",
    ("f_documents",),
)
def x2_branches(spark, d):
    """Files, then transcripts, then links."""
    docs = view(spark, d, "f_documents").select(F.col("id").alias("position"), F.col("source_uri").alias("source"), "source_type")
    links = read(spark, d, "pages").select(F.col("page_id").alias("position"), F.col("url").alias("source"))
    return chunking.branches_in_order(docs.where("source_type not in ('vtt', 'web')"), docs.where("source_type = 'vtt'"), links).select("branch", "ordinal", "source")


@query("select batch_id, idx from f_items qualify row_number() over (partition by batch_id order by idx) <= 50", ("f_items",))
def o6_capped_items(spark, d):
    """Fifty items of a batch, the web branch's feature."""
    return chunking.capped_items(view(spark, d, "f_items")).select("batch_id", "idx")


def scratch(spark, name):
    from ..session import work_folder

    return work_folder(spark, name)


@query("select page_id as ordinal, url, html as text, lower(regexp_extract(url, '://([^/?#]*)', 1)) as source_url, cast(row_number() over (partition by lower(regexp_extract(url, '://([^/?#]*)', 1)) order by page_id) as int) as page from pages where trim(html, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def s4_scraped_json(spark, d):
    """Pages written as one JSON document for each site, and read back."""
    from ..sources.readers import read_scraped_json

    rows = read(spark, d, "pages").select(F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1)).alias("source_url"), F.struct("page_id", "url", "html").alias("p"))
    sites = rows.groupBy("source_url").agg(F.sort_array(F.collect_list("p")).alias("p"))
    shown = F.transform("p", lambda x, i: F.struct((i + 1).cast("int").alias("page"), x["url"].alias("url"), x["page_id"].cast("string").alias("title"), x["html"].alias("text")))
    path = scratch(spark, "sites")
    sites.select(F.to_json(F.struct("source_url", F.lit("2024-01-20").alias("scraped_at"), F.size("p").alias("total_pages"), shown.alias("pages"))).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return read_scraped_json(spark, path).select(F.col("title").cast("long").alias("ordinal"), "url", "text", "source_url", "page")


@query("select conv_id, 'WEBVTT' || chr(10) || string_agg(turn || ': ' || coalesce(text, ''), chr(10) order by turn) as text from conversations group by conv_id")
def s5_read_vtt(spark, d):
    """Conversations written as one file each, and read back whole."""
    from ..sources.readers import read_vtt

    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.concat(F.col("turn").cast("string"), F.lit(": "), F.coalesce("text", F.lit(""))).alias("line")))), lambda x: x["line"]), "\n")
    talks = read(spark, d, "conversations").groupBy("conv_id").agg(F.concat(F.lit("WEBVTT\n"), lines).alias("text"))
    path = scratch(spark, "transcripts")
    talks.select(F.concat(F.col("conv_id").cast("string"), F.lit("\n"), "text").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    parts = F.split("text", "\n", 2)
    return read_vtt(spark, path).select(parts[0].cast("long").alias("conv_id"), F.regexp_replace(parts[1], "\n$", "").alias("text"))


@query("with " + html_sql() + " select site, page_id as page, " + norm_sql("text") + " as text from extracted where text <> ''")
def t10_web_pages(spark, d):
    return pages.web_pages(sites(spark, d).select("site", F.col("page_id").alias("page"), "text"))


@query("with " + html_sql() + " select page_id, url, title, text, links from extracted")
def t11_extract_html(spark, d):
    return pages.extract_html(read(spark, d, "pages"))


@query(
    """with links as (select lower(regexp_extract(url, '://([^/?#]*)', 1)) as host, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) as root, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href=["'']([^"'']*)', 1)) as href from pages),
    found as (select distinct host, concat(root, regexp_replace(href, '[?#].*$', '')) as url from links where href <> '')
    select host, url from found where url not in (select regexp_replace(url, '[?#].*$', '') from pages) qualify row_number() over (partition by host order by url) <= 20"""
)
def t12_link_frontier(spark, d):
    return pages.link_frontier(pages.extract_html(read(spark, d, "pages")), read(spark, d, "pages").select("url"))


@query("select page_id, cast(k as int) as k, s from (select page_id, unnest(l) as s, generate_subscripts(l, 1) as k from (select page_id, list_filter([url, html, url], lambda x: length(x) >= 30) as l from pages))")
def t13_json_strings(spark, d):
    """Every string of a nested JSON text, escapes decoded, in order."""
    rows = read(spark, d, "pages").select("page_id", F.to_json(F.struct("url", F.struct(F.col("html").alias("body"), F.array("url", F.lit("short")).alias("more")).alias("x"))).alias("j"))
    return pages.json_strings(rows, "j").select("page_id", F.posexplode("strings").alias("k", "s")).withColumn("k", F.col("k") + 1)


@query("select e.event_id, case when position(e.event_type in e.props) > 0 then e.props else concat(e.props, chr(10), chr(10), e.event_type) end as text from events e")
def t14_merge_text(spark, d):
    return read(spark, d, "events").select("event_id", T.merge_text(F.col("props"), F.col("event_type")).alias("text"))


@query(
    """with t as (select doc_id, replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), ' ') as one from documents)
    select doc_id, case when length(one) > 80 then substring(one, 1, 80) || '…' else one end as short, substring(one, 1, 200) as cut from t"""
)
def t15_preview(spark, d):
    return read(spark, d, "documents").select("doc_id", T.preview(F.col("text")).alias("short"), T.preview(F.col("text"), 200, False).alias("cut"))


@query("select conv_id, turn, turn * 45 + 0.25::double as s from conversations")
def v1_vtt_seconds(spark, d):
    t = F.col("turn") * 45
    stamp = F.format_string("%02d:%02d:%02d,250", F.floor(t / 3600).cast("int"), F.pmod(F.floor(t / 60), F.lit(60)).cast("int"), F.pmod(t, F.lit(60)).cast("int"))
    return read(spark, d, "conversations").select("conv_id", "turn", T.vtt_seconds(stamp).alias("s"))


def vtt_files(spark, d):
    """Conversations written as WebVTT texts."""
    t = F.col("turn") * 45
    stamp = lambda x: F.format_string("%02d:%02d:%02d.000", F.floor(x / 3600).cast("int"), F.pmod(F.floor(x / 60), F.lit(60)).cast("int"), F.pmod(x, F.lit(60)).cast("int"))
    said = T.strip(F.regexp_replace(F.coalesce("text", F.lit("")), r"[<>]|\n\s*\n", " "))
    cue = F.concat(F.col("turn").cast("string"), F.lit("\n"), stamp(t), F.lit(" --> "), stamp(t + 44), F.lit(" align:start\n<v "), "role", F.lit(">"), said, F.lit("</v>"))
    cues = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", cue.alias("cue")))), lambda x: x["cue"]), "\n\n")
    return read(spark, d, "conversations").groupBy(F.col("conv_id").alias("transcript_id")).agg(F.concat(F.lit("WEBVTT\n\n"), cues).alias("text"))


@query(
    """select conv_id as transcript_id, cast(row_number() over (partition by conv_id order by turn) - 1 as int) as idx, cast(turn * 45 as double) as start_s, cast(turn * 45 + 44 as double) as end_s, role as speaker from conversations where trim(regexp_replace(coalesce(text, ''), '[<>\\s]', '', 'g')) <> ''"""
)
def v2_parse_vtt(spark, d):
    return transcripts.parse_vtt(vtt_files(spark, d)).drop("text")


def cues(spark, d):
    return view(spark, d, "f_cues").withColumnRenamed("conv_id", "transcript_id")


@query(
    # Cues come every 45 s here: a page takes the three that start within 120 s of its first.
    """select conv_id as transcript_id, cast((k - 1) // 3 + 1 as int) as page, count(*) as cues from (select conv_id, row_number() over (partition by conv_id order by idx) as k from f_cues) group by all""",
    ("f_cues",),
)
def v3_cue_windows(spark, d):
    return transcripts.window_numbers(cues(spark, d)).groupBy("transcript_id", "page").agg(F.count(F.lit(1)).alias("cues"))


@query("select conv_id as transcript_id, cast((k - 1) // 3 + 1 as int) as page, " + norm_sql("string_agg('[' || speaker || ']: ' || text, chr(10) order by k)") + " as text from (select *, row_number() over (partition by conv_id order by idx) as k from f_cues) group by conv_id, (k - 1) // 3", ("f_cues",))
def v3_cue_pages(spark, d):
    return transcripts.cue_pages(cues(spark, d))


@query("select tenant_id, client_id, count(*) as transcripts, case when count(*) >= 10 then 'deep' when count(*) >= 4 then 'comprehensive' else 'developing' end as tier from f_documents where source_type = 'vtt' group by all", ("f_documents",))
def v4_transcript_counts(spark, d):
    return transcripts.transcript_counts(view(spark, d, "f_documents"))


@query(
    """select document_id, chunk_index, rank from (select c.*, cast(row_number() over (partition by c.tenant_id, c.client_id order by chunk_index, document_id) as int) as rank
    from f_chunks c where document_id in (select id from f_documents where source_type = 'vtt')) where rank <= 50""",
    ("f_chunks", "f_documents"),
)
def v5_transcript_chunks(spark, d):
    return transcripts.transcript_chunks(view(spark, d, "f_chunks"), view(spark, d, "f_documents"), 50).select("document_id", "chunk_index", "rank")


@query("select o_custkey, case when count(*) >= 10 then 'deep' when count(*) >= 4 then 'comprehensive' else 'developing' end as tier from orders group by o_custkey")
def v6_depth_tier(spark, d):
    return read(spark, d, "orders").groupBy("o_custkey").agg(T.depth_tier(F.count(F.lit(1))).alias("tier"))


def summaries(spark, d):
    docs = view(spark, d, "f_documents").where("tenant_id <> 'de'")
    return docs.groupBy("tenant_id", "client_id").agg(F.concat(F.lit("About "), F.min("client_id")).alias("summary"), F.sort_array(F.collect_set("source_type")).alias("topics"))


@query(
    """with n as (select tenant_id, client_id, count(*) as transcripts from f_documents where source_type = 'vtt' group by all),
    r as (select c.tenant_id, c.client_id, content, n.transcripts, row_number() over (partition by c.tenant_id, c.client_id order by chunk_index, document_id) as rank from f_chunks c join n using (tenant_id, client_id) where document_id in (select id from f_documents where source_type = 'vtt')),
    t as (select tenant_id, client_id, count(*) as k, string_agg(case when trim(content, chr(9) || chr(13) || ' ') <> '' then '[Transcript Excerpt ' || rank || '] ' || content end, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank) as ctx from r where rank <= 15 + 5 * transcripts group by all),
    s as (select tenant_id, client_id, 'Summary: About ' || client_id || chr(10) || 'Topics: ' || array_to_string(list_sort(list_distinct(list(source_type))), ', ') as brief from f_documents where tenant_id <> 'de' group by tenant_id, client_id)
    select a.tenant_id, a.client_id, coalesce(n.transcripts, 0) as transcripts, case when n.transcripts >= 10 then 'deep' when n.transcripts >= 4 then 'comprehensive' when n.transcripts >= 1 then 'developing' else 'foundational' end as tier,
    coalesce(ctx, '(No video transcript data available yet. Ingest .vtt transcripts to unlock deeper analysis.)') as transcript_context, coalesce(brief, '(No context summary generated yet.)') as context_summary, coalesce(k, 0) as chunks_retrieved, brief is not null as has_summary
    from (select distinct tenant_id, client_id from f_documents) a left join n using (tenant_id, client_id) left join t using (tenant_id, client_id) left join s using (tenant_id, client_id)""",
    ("f_documents", "f_chunks"),
)
def v7_shared_context(spark, d):
    return transcripts.shared_context(view(spark, d, "f_documents"), view(spark, d, "f_chunks"), summaries(spark, d))


#: Windows of 510 words scored by log odds of hashed words, which are fitted on all labels: toxic negative, good positive, others neutral.
SENTIMENT_SQL = """with w as (select doc_id, pos // 510 as win, ('0x' || md5(w)[1:8])::bigint % 16384 as b from (select doc_id, unnest(words) as w, generate_subscripts(words, 1) - 1 as pos from (select doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\n]'), lambda x: x <> '') as words from documents))),
    l as (select doc_id, case when toxic = 1 then 'n' when quality = 1 then 'p' else 'z' end as c from labels where toxic is not null and quality is not null),
    k as (select b, count(*) filter (c = 'p') as p, count(*) filter (c = 'n') as n, count(*) filter (c = 'z') as z from w join l using (doc_id) group by b),
    g as (select *, p + n + z as a from (select range as b, coalesce(p, 0) as p, coalesce(n, 0) as n, coalesce(z, 0) as z from range(16384) left join k on b = range)),
    t as (select sum(p)::bigint + 16384 as p, sum(n)::bigint + 16384 as n, sum(z)::bigint + 16384 as z, sum(a)::bigint + 16384 as a from g),
    r as (select b, g.a, g.p, g.n, g.z, ln((g.p + 1) * t.a / ((g.a + 1) * t.p)) as rp, ln((g.n + 1) * t.a / ((g.a + 1) * t.n)) as rn, ln((g.z + 1) * t.a / ((g.a + 1) * t.z)) as rz from g, t),
    o as (select b, case when abs(rp) < 3 * sqrt(1 / (p + 1) + 1 / (a + 1)) then 0 else floor(1000 * rp) end as p, case when abs(rn) < 3 * sqrt(1 / (n + 1) + 1 / (a + 1)) then 0 else floor(1000 * rn) end as n, case when abs(rz) < 3 * sqrt(1 / (z + 1) + 1 / (a + 1)) then 0 else floor(1000 * rz) end as z from r),
    d as (select floor(1000 * ln((count(*) filter (c = 'p') + 1) / (count(*) + 3))) as p, floor(1000 * ln((count(*) filter (c = 'n') + 1) / (count(*) + 3))) as n, floor(1000 * ln((count(*) filter (c = 'z') + 1) / (count(*) + 3))) as z from l),
    s as (select doc_id, win, sum(o.p) + any_value(d.p) as p, sum(o.n) + any_value(d.n) as n, sum(o.z) + any_value(d.z) as z from w join o using (b), d group by all),
    e as (select doc_id, exp((p - greatest(p, n, z)) / 1000) as p, exp((n - greatest(p, n, z)) / 1000) as n, exp((z - greatest(p, n, z)) / 1000) as z from s),
    scores as (select d.doc_id as document_id, round(avg(p / (p + n + z)), 2) as positive, round(avg(n / (p + n + z)), 2) as negative, round(1 - avg(p / (p + n + z)) - avg(n / (p + n + z)) + 1e-9, 2) as neutral from documents d left join e using (doc_id) group by d.doc_id)"""


def scores(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text")
    label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    labels = read(spark, d, "labels").where("toxic is not null and quality is not null").select(F.col("doc_id").alias("document_id"), label.alias("label"))
    return transcripts.sentiment(docs, transcripts.fit_scorer(docs, labels))


@query(SENTIMENT_SQL + " select * from scores")
def v8_sentiment(spark, d):
    return scores(spark, d)


@query(SENTIMENT_SQL + " select lang, count(positive) as documents, round(avg(positive), 2) as positive, round(avg(negative), 2) as negative, round(avg(neutral), 2) as neutral from scores join documents on doc_id = document_id group by lang")
def v9_sentiment_rollup(spark, d):
    return transcripts.sentiment_rollup(scores(spark, d).join(read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "lang"), "document_id"), "lang")


@query("select document_id, string_agg(content, ' ' order by chunk_index) as text from f_chunks group by document_id", ("f_chunks",))
def v10_document_text(spark, d):
    return transcripts.document_text(view(spark, d, "f_chunks"))


@query(
    """with focus as (select tenant_id, client_id, position, focus from (select distinct tenant_id, cast(null as varchar) as client_id, 0 as position, 'pricing' as focus from f_documents union all select tenant_id, client_id, chunk_index as position, 'about ' || document_id as focus from f_chunks)
      qualify row_number() over (partition by tenant_id, client_id order by position, focus) <= 10)
    select c.tenant_id, c.client_id, position, count(*) as n from (select distinct tenant_id, client_id from f_documents) c join focus f on f.tenant_id = c.tenant_id and (f.client_id is null or f.client_id = c.client_id) group by all""",
    ("f_documents", "f_chunks"),
)
def v11_fan_out(spark, d):
    docs = view(spark, d, "f_documents")
    wide = docs.select("tenant_id").distinct().select("tenant_id", F.lit(None).cast("string").alias("client_id"), F.lit(0).alias("position"), F.lit("pricing").alias("focus"))
    own = view(spark, d, "f_chunks").select("tenant_id", "client_id", F.col("chunk_index").alias("position"), F.concat(F.lit("about "), F.col("document_id").cast("string")).alias("focus"))
    out = transcripts.fan_out(docs.select("tenant_id", "client_id").distinct(), wide.unionByName(own))
    return out.groupBy("tenant_id", "client_id", "position").agg(F.count(F.lit(1)).alias("n"))


@query("select id, tenant_id, total from (select *, count(*) over () as total from f_documents) order by id desc limit 50 offset 10", ("f_documents",))
def a2_page_with_total(spark, d):
    return scans.page_with_total(view(spark, d, "f_documents").select("id", "tenant_id"), [F.desc("id")], 50, 10)


@query("select distinct tenant_id, client_id from f_documents where client_id is not null", ("f_documents",))
def a3_clients(spark, d):
    return scans.clients(view(spark, d, "f_documents"))


@query(
    """with e as (select document_id, tenant_id, client_id from (""" + EMBEDDED + """)), keys as (select tenant_id, client_id from f_documents group by all)
    select k.tenant_id, k.client_id, (select count(*) from f_documents x where x.tenant_id = k.tenant_id and x.client_id = k.client_id) as documents,
    (select count(*) from f_chunks x where x.tenant_id = k.tenant_id and x.client_id = k.client_id) as chunks, (select count(*) from e x where x.tenant_id = k.tenant_id and x.client_id = k.client_id) as embedded_chunks,
    (select count(*) from e x where x.tenant_id = k.tenant_id and x.client_id = k.client_id) as nodes, (select count(*) from f_chunks x where x.tenant_id = k.tenant_id and x.client_id = k.client_id and x.chunk_index > 0) as edges from keys k""",
    ("f_documents", "f_chunks"),
)
def a1_stats(spark, d):
    """Nodes are the embedded chunks, edges join a chunk to the one before it."""
    c = embedded(spark, d)
    return scans.stats(view(spark, d, "f_documents"), c, c.where("embedding is not null"), c.where("chunk_index > 0"))


@query("select batch_id, count(*) as total, count(*) filter (where status = 'complete') as completed, count(*) filter (where status = 'failed') as failed, case when count(*) filter (where status = 'failed') = count(*) then 'failed' when count(*) filter (where status = 'failed') > 0 then 'partial_failure' else 'complete' end as status from f_items group by batch_id", ("f_items",))
def a4_batch_status(spark, d):
    return rollups.batch_status(view(spark, d, "f_items"))


@query(
    """select tenant_id, count(*) filter (where source_type not in ('web', 'vtt')) as documents, count(*) filter (where source_type = 'web') as web_pages, count(*) filter (where source_type = 'vtt') as transcripts, cast(sum(n) as bigint) as chunks
    from f_documents join (select document_id, count(*) as n from f_chunks group by document_id) on id = document_id group by tenant_id""",
    ("f_documents", "f_chunks"),
)
def a5_ingest_rollup(spark, d):
    n = view(spark, d, "f_chunks").groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("n_chunks"))
    return rollups.ingest_rollup(view(spark, d, "f_documents").join(n, "id"))


@query("select batch_id as run_id, count(*) as total, count(*) filter (where status = 'complete') as completed, count(*) filter (where status = 'failed') as failed, coalesce(string_agg(case when status = 'failed' then 'item ' || idx end, '; ' order by idx), '') as errors from f_items group by batch_id", ("f_items",))
def a9_run_rollup(spark, d):
    items = view(spark, d, "f_items").select(F.col("batch_id").alias("run_id"), F.col("idx").alias("item"), F.when(F.col("status") == "failed", F.concat(F.lit("item "), F.col("idx").cast("string"))).alias("error"))
    return rollups.run_rollup(items)


@query("select client_id as query_id, count(distinct document_id) as documents_retrieved, cast(sum(length(content)) as bigint) as context_length from f_chunks group by client_id", ("f_chunks",))
def a11_source_stats(spark, d):
    return rollups.source_stats(view(spark, d, "f_chunks").withColumnRenamed("client_id", "query_id"))
