"""The thin opN queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP1_SQL = """
with lines as (
  select doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents)),
firsts as (select k, min(doc_id) as first_doc from lines where length(k) >= 10 group by k),
judged as (select l.*, f.first_doc is not null and f.first_doc < l.doc_id as gone from lines l left join firsts f on l.k = f.k)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from judged group by doc_id
"""


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The query's rules: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list to block: canonical URLs that more than one page carries."""
    from .url_filter import canonical_url, judge_urls

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    listed = pages.groupBy(canonical_url(F.col("url")).alias("url")).agg(F.countDistinct("page_id").alias("n")).where("n > 1 and url is not null").select(F.concat(F.lit("http://"), "url").alias("url"))
    return judge_urls(pages, rules, listed).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = """
with p as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
listed as (select host, path from p where host <> '' group by host, path having count(distinct page_id) > 1),
rules(r_host, r_path, r_verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best as (
  select page_id, arg_max(r_host || r_path, length(r_host || r_path)) as rule, arg_max(r_verdict, length(r_host || r_path)) as rule_verdict
  from p join rules on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path) group by page_id)
select p.page_id, p.host, p.path, best.rule, coalesce(rule_verdict, case when listed.host is not null then 'block' end, 'allow') as verdict
from p left join best on p.page_id = best.page_id left join listed on p.host = listed.host and p.path = listed.path
"""


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_warc, write_warc

    records = read_warc(write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_columns

    return media_columns(table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_components

    return near_components(table(spark, sf_dir, "documents"))


def op4_exact_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


#: Base32 of a SHA-1, 20 bits at a time.
OP10_SQL = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
d as (select page_id, octet_length(encode(html)) as n, h, array_to_string(list_transform(range(32), lambda i:
  substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substring(h, 5 * (i // 4) + 1, 5) as int) >> cast(15 - 5 * (i % 4) as int)) & 31 as int) + 1, 1)), '') as digest, min(page_id) over (partition by h) as first_page from p)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest, case when page_id = first_page then 'response' else 'revisit' end as record_type, case when page_id <> first_page then first_page end as refers_to from d
"""

def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resample import importance_resample

    out = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), words=1, buckets=10_000, percent=10, least=20, seed=2024)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 of a word byte by byte, from a table of 256 entries made by its rule.
OP11_SQL = """
with recursive steps(i, k, c) as (
  select i, 0, cast(i as bigint) from range(256) t(i)
  union all select i, k + 1, xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end) from steps where k < 8),
crc_table as (select list(c order by i) as t from steps where k = 8),
texts as (select true as own, doc_id, text from documents union all select false, null, text from benchmark),
words as (select own, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as w from texts),
bytes as (select w, hex(encode(w)) as h from (select distinct w from words)),
crcs as (select w, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: cast(cast('0x' || substring(h, cast(2 * i + 1 as int), 2) as int) as bigint)), lambda c, b: xor(c >> 8, t[cast(xor(c & 255, b) as int) + 1]), cast(4294967295 as bigint)), 4294967295) % 10000 as b from bytes, crc_table),
counts as (select own, doc_id, b, count(*) as n from words join crcs using (w) group by all),
sums as (select b, sum(n) filter (where own) as s, sum(n) filter (where not own) as t from counts group by b),
totals as (select coalesce(sum(n) filter (where own), 0) as s, coalesce(sum(n) filter (where not own), 0) as t from counts),
gains as (select b, cast(floor(1000 * ln(((coalesce(sums.t, 0) + 1)::double * (totals.s + 10000)::double) / ((coalesce(sums.s, 0) + 1)::double * (totals.t + 10000)::double))) as bigint) as gain from sums, totals),
weights as (select doc_id, cast(sum(n) as bigint) as n, cast(sum(n * gain) as bigint) as g from counts join gains using (b) where own group by doc_id),
scored as (
  select d.doc_id, coalesce(n, 0) as n_features,
    case when n is null then 0 else (g - (((g % n) + n) % n)) // n end as weight,
    cast(floor(-1000 * ln(-ln((cast(cast('0x' || substring(sha256('2024:' || d.doc_id), 1, 8) as bigint) as double) + 0.5) / 4294967296.0))) as bigint) as luck
  from documents d left join weights using (doc_id)),
ranked as (select *, row_number() over (order by weight + luck desc, doc_id) as place from scored where n_features >= 20)
select s.doc_id, cast(s.n_features as bigint) as n_features, cast(s.weight as bigint) as weight, cast(s.weight + s.luck as bigint) as score,
  case when place <= (select count(*) * 10 // 100 from ranked) then place end as rank
from scored s left join ranked r on s.doc_id = r.doc_id
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scaled = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double"))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    vectors = table(spark, sf_dir, "embeddings").where(finite).select("vec_id", label.alias("label"), scaled.alias("v"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90)


OP12_SQL = """
with rows as (
  select row_number() over () as uid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings where label is not null and embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (select a.uid, a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, cast(list_inner_product(a.v, r.v) as bigint) as score from rows a join rows r on a.vec_id % 100 = 0 and a.uid <> r.uid),
positives as (select * from scores where same qualify row_number() over (partition by uid order by score desc, vec_id) <= 5)
select p.anchor_id, p.vec_id as positive_id, cast(row_number() over (partition by p.uid, p.vec_id order by n.score desc, n.vec_id) as int) as rank, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
from positives p join scores n on p.uid = n.uid and not n.same and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score
qualify row_number() over (partition by p.uid, p.vec_id order by n.score desc, n.vec_id) <= 10
"""


def op13_shared_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared_windows import shared_windows

    return shared_windows(table(spark, sf_dir, "documents"), width=13).drop("spans")


OP13_SQL = """
with words as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from documents),
windows as (select doc_id, i, hash(array_to_string(list_slice(w, i, i + 12), ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from words)),
firsts as (select h, min(doc_id) as first_doc from windows group by h),
gone as (select doc_id, i from windows join firsts using (h) where first_doc < doc_id),
each as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from words),
judged as (select e.doc_id, e.i, word, count(g.i) over (partition by e.doc_id order by e.i rows 12 preceding) > 0 as cut from each e left join gone g on e.doc_id = g.doc_id and e.i = g.i),
kept as (select doc_id, count(*) as n, count(*) filter (where cut) as n_cut, string_agg(word, ' ' order by i) filter (where not cut) as text from judged group by doc_id)
select w.doc_id, coalesce(n, 0) as n_words, coalesce(n_cut, 0) as n_removed, sha256(coalesce(k.text, '')) as kept_sha256 from words w left join kept k using (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_media_columns": op2_media_columns,
    "op3_near_dedup": op3_near_dedup,
    "op4_exact_repeats": op4_exact_repeats,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_decontamination": op6_decontamination,
    "op7_url_filter": op7_url_filter,
    "op8_html_text": op8_html_text,
    "op9_quality": op9_quality,
    "op10_warc": op10_warc,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_shared_windows": op13_shared_windows,
}
ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op7_url_filter": OP7_SQL,
    "op10_warc": OP10_SQL,
    "op11_importance_resampling": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_shared_windows": OP13_SQL,
}
