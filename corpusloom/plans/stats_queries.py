"""Queries: survey statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import survey_stats as O
from .registry import query
from .views import read, view

Z = S.z_value(0.95)
#: Student's t from the normal quantile (Cornish-Fisher); right to 4 decimals from about 12 degrees of freedom on.
T_SQL = f"({Z!r} + ({Z**3 + Z!r}) / (4 * (n - 1)) + ({5 * Z**5 + 16 * Z**3 + 3 * Z!r}) / (96 * (n - 1) ** 2) + ({3 * Z**7 + 19 * Z**5 + 17 * Z**3 - 15 * Z!r}) / (384 * (n - 1) ** 3) + ({79 * Z**9 + 776 * Z**7 + 1482 * Z**5 - 1920 * Z**3 - 945 * Z!r}) / (92160 * (n - 1) ** 4))"
WARN_SQL = "case when n < 3 then 'Insufficient data: ' || n || ' responses (minimum 3 required).' when n < 10 then 'Small sample size (' || n || '): confidence interval may be very wide.' end"
MEAN_SQL = "with a as (select question_id, count(value_num) as n, avg(value_num) as m, stddev_samp(value_num) as s from {} group by question_id) select question_id, n, round(m, 4) as mean, round(s, 4) as sd, round(m - " + T_SQL + " * s / sqrt(n), 4) as ci_lower, round(m + " + T_SQL + " * s / sqrt(n), 4) as ci_upper, " + WARN_SQL + " as warning from a"
WILSON_SQL = f"greatest(0.0, (count / n + {Z * Z!r} / (2 * n)) / (1 + {Z * Z!r} / n) - {Z!r} / (1 + {Z * Z!r} / n) * sqrt(count / n * (1 - count / n) / n + {Z * Z!r} / (4 * n * n))) as lo, least(1.0, (count / n + {Z * Z!r} / (2 * n)) / (1 + {Z * Z!r} / n) + {Z!r} / (1 + {Z * Z!r} / n) * sqrt(count / n * (1 - count / n) / n + {Z * Z!r} / (4 * n * n))) as hi"
SHARE_SQL = "select question_id, option, cast(count as bigint) as count, cast(n as bigint) as n, round(count / n, 4) as proportion, round(lo, 4) as ci_lower, round(hi, 4) as ci_upper from (select question_id, option, count, n, " + WILSON_SQL + " from ({}) c)"


@query(MEAN_SQL.format("f_rating"), ("f_rating",))
def n2_mean_ci(spark, d):
    return O.mean_ci(view(spark, d, "f_rating"))


@query(MEAN_SQL.format("(select 'nps-' || event_type as question_id, cast(event_id % 11 as double) as value_num from events)"))
def n2_nps_ci(spark, d):
    return O.mean_ci(read(spark, d, "events").select(F.concat(F.lit("nps-"), "event_type").alias("question_id"), (F.col("event_id") % 11).cast("double").alias("value_num")))


@query(SHARE_SQL.format("select question_id, 'Yes' as option, count(*) filter (where value_bool)::double as count, count(*)::double as n from f_yes_no group by 1 union all select question_id, 'No', count(*) filter (where not value_bool), count(*) from f_yes_no group by 1"), ("f_yes_no",))
def n3_yes_no_ci(spark, d):
    return O.yes_no_ci(view(spark, d, "f_yes_no"))


@query(SHARE_SQL.format("select question_id, value_str as option, count(*)::double as count, (select count(*) from f_choice)::double as n from f_choice group by 1, 2 union all select 'q_choice', 'never seen', 0, (select count(*) from f_choice)"), ("f_choice",))
def n4_choice_ci(spark, d):
    """Over the options that occur and one that nobody chose."""
    rows = view(spark, d, "f_choice")
    options = rows.select("question_id", F.col("value_str").alias("option")).distinct()
    unseen = options.select("question_id", F.lit("never seen").alias("option")).distinct()
    return O.choice_ci(rows, options.unionByName(unseen))


def picks(spark, d):
    return view(spark, d, "f_picks").groupBy("question_id", "respondent_id", "day").agg(F.array_sort(F.collect_list("value_str")).alias("value_list"))


@query(SHARE_SQL.format("select question_id, value_str as option, count(*)::double as count, (select count(*) from (select distinct respondent_id, day from f_picks))::double as n from f_picks group by 1, 2"), ("f_picks",))
def n5_checkbox_ci(spark, d):
    rows = picks(spark, d)
    return O.checkbox_ci(rows.withColumn("value_list", F.concat("value_list", F.slice("value_list", 1, 1))))


def rankings(spark, d):
    return view(spark, d, "f_ranks").groupBy("question_id", "respondent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias("value_list"))


RANK_SQL = "with a as (select question_id, item as option, count(*) as n, avg(rank) as m, stddev_samp(rank) as s from f_ranks group by all) select question_id, option, n, round(m, 4) as mean, round(m - " + T_SQL + " * s / sqrt(n), 4) as ci_lower, round(m + " + T_SQL + " * s / sqrt(n), 4) as ci_upper from a"


@query(RANK_SQL, ("f_ranks",))
def n6_ranking_ci(spark, d):
    return O.ranking_ci(rankings(spark, d))


#: Answers as text, and what each is as a number and as a boolean, by the rules of float() and of the accepted words.
ANSWERS = [("n/a", None, None), (" 7.50 ", 7.5, None), ("true", None, True), ("yes", None, True), ("y", None, None), ("1d", None, None), ("2.5f", None, None), ("1_000", 1000.0, None), ("2.5", 2.5, None), (" yes ", None, None), ("NO", None, False), ("-1e3", -1000.0, None), ("0", 0.0, False), ("1", 1.0, True), ("", None, None), (".5", 0.5, None), ("5.", 5.0, None), ("0x10", None, None), ("t", None, None), ("False", None, False)]


def _cases(k: str, values: list) -> str:
    return f"case {k} " + " ".join(f"when {i} then {v}" for i, v in enumerate(values) if v is not None) + " end"


def answers(df, k):
    return F.element_at(F.array(*[F.lit(a) for a, _, _ in ANSWERS]), (k + 1).cast("int"))


@query(f"select l_orderkey, l_linenumber, {_cases(f'(l_orderkey + l_linenumber) % {len(ANSWERS)}', [x for _, x, _ in ANSWERS])}::double as x, l_quantity::double as typed, case when l_returnflag = 'R' then 1.0 else 0.0 end::double as flag from lineitem")
def n7_to_double(spark, d):
    """Text, numbers and typed booleans."""
    rows = read(spark, d, "lineitem")
    raw = answers(rows, (F.col("l_orderkey") + F.col("l_linenumber")) % len(ANSWERS))
    return rows.select("l_orderkey", "l_linenumber", S.to_double(raw).alias("x"), S.to_double(F.col("l_quantity")).alias("typed"), S.to_double(F.col("l_returnflag") == "R").alias("flag"))


@query(f"select event_id, {_cases(f'event_id % {len(ANSWERS)}', [None if b is None else str(b).lower() for _, _, b in ANSWERS])} as b, value <> 0 as typed, event_type = 'error' as flag from events")
def n8_to_bool(spark, d):
    """Text, numbers and typed booleans."""
    rows = read(spark, d, "events")
    return rows.select("event_id", S.to_bool(answers(rows, F.col("event_id") % len(ANSWERS))).alias("b"), S.to_bool(F.col("value")).alias("typed"), S.to_bool(F.col("event_type") == "error").alias("flag"))


#: Student's t by bisection on its two-sided probability, a finite sum of powers of a cosine for whole degrees of freedom.
_ANGLE, _DF = "atan((low + high) / 2 / sqrt(n - 1))", "(n - 1)"
_EVEN = f"sin({_ANGLE}) * coalesce(list_sum(list_transform(range(0, {_DF} // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()) * pow(cos({_ANGLE}), 2 * k))), 0)"
_ODD = f"2 / pi() * ({_ANGLE} + sin({_ANGLE}) * coalesce(list_sum(list_transform(range(0, ({_DF} - 1) // 2), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1.0) - lgamma(k + 1.5)) * pow(cos({_ANGLE}), 2 * k + 1))), 0))"
_SHARE = f"(case when {_DF} % 2 = 0 then {_EVEN} else {_ODD} end)"


@query(
    f"""with recursive sizes as (select distinct count(*) as n from orders group by o_custkey having count(*) >= 2), steps(n, low, high, i) as (select n, 0.0::double, 1000.0::double, 0 from sizes union all
    select n, case when {_SHARE} < 0.95 then (low + high) / 2 else low end, case when {_SHARE} < 0.95 then high else (low + high) / 2 end, i + 1 from steps where i < 60) select n, round(low, 3) as t from steps where i = 60""",
)
def n9_t_table(spark, d):
    """Critical values for the sample sizes, two or more, that customers' orders give."""
    n = read(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("n").distinct()
    return n.select("n", F.round(S.t_critical(0.95)((F.col("n") - 1).cast("double")), 3).alias("t"))


@query("select key, round(lo, 4) as lo, round(hi, 4) as hi from (select key, " + WILSON_SQL + " from (select l_suppkey as key, count(*) filter (where l_returnflag = 'R')::double as count, count(*)::double as n from lineitem group by l_suppkey))")
def n10_wilson(spark, d):
    rows = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("key")).agg(F.count_if(F.col("l_returnflag") == "R").alias("count"), F.count(F.lit(1)).alias("n"))
    w = S.wilson(F.col("count"), F.col("n"), 0.95)
    return rows.select("key", F.round(w["lo"], 4).alias("lo"), F.round(w["hi"], 4).alias("hi"))


@query("select o_custkey, n, " + WARN_SQL + " as warning from (select o_custkey, count(*) as n from orders group by o_custkey)")
def n11_sample_warning(spark, d):
    rows = read(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("warning", S.sample_warning(F.col("n")))


def _share(sql: str) -> str:
    return "select question_id, option, n, proportion as estimate, ci_lower, ci_upper from (" + SHARE_SQL.format(sql) + ")"


N1_SQL = " union all ".join([
    "select question_id, null as option, n, mean as estimate, ci_lower, ci_upper from (" + MEAN_SQL.format("f_rating") + ")",
    _share("select question_id, 'Yes' as option, count(*) filter (where value_bool)::double as count, count(*)::double as n from f_yes_no group by 1 union all select question_id, 'No', count(*) filter (where not value_bool), count(*) from f_yes_no group by 1"),
    _share("select question_id, value_str as option, count(*)::double as count, (select count(*) from f_choice)::double as n from f_choice group by 1, 2"),
    _share("select question_id, value_str as option, count(*)::double as count, (select count(*) from (select distinct respondent_id, day from f_picks))::double as n from f_picks group by 1, 2"),
    "select question_id, option, n, mean as estimate, ci_lower, ci_upper from (" + RANK_SQL + ")",
])


@query(N1_SQL, ("f_rating", "f_yes_no", "f_choice", "f_picks", "f_ranks"))
def n1_confidence_intervals(spark, d):
    """A mixed table of all question types and one that has no interval."""
    kinds = {"value_num": "double", "value_bool": "boolean", "value_str": "string", "value_list": "array<string>"}

    def wide(df, kind):
        return df.select("question_id", F.lit(kind).alias("question_type"), *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])

    parts = [wide(view(spark, d, "f_rating"), "rating"), wide(view(spark, d, "f_yes_no"), "yes_no"), wide(view(spark, d, "f_choice"), "multiple_choice"), wide(picks(spark, d), "checkbox"), wide(rankings(spark, d), "ranking"), wide(view(spark, d, "f_choice"), "long_text")]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return O.confidence_intervals(rows)
