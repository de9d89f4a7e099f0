"""Confidence intervals of survey questions over long tables of responses.

Every aggregate is map-side combined, so a question that a third of all answers go to needs no special care; counts of
options are joined to their question's total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import MIN_SAMPLE, sample_warning, t_critical, wilson


def _t_table(rows: DataFrame, level: float) -> DataFrame:
    """(n, t) for the distinct sample sizes of rows."""
    return rows.where(F.col("n") >= MIN_SAMPLE).select("n").distinct().withColumn("t", t_critical(level)((F.col("n") - 1).cast("double")))


def _mean_interval(rows: DataFrame, level: float) -> DataFrame:
    """rows with n, mean, sd: ci_lower and ci_upper beside them, all rounded to 4."""
    with_t = rows.join(_t_table(rows, level), "n", "left")
    half = F.col("t") * F.col("sd") / F.sqrt("n")
    return with_t.withColumns({"ci_lower": F.round(F.col("mean") - half, 4), "ci_upper": F.round(F.col("mean") + half, 4), "mean": F.round("mean", 4), "sd": F.round("sd", 4)}).drop("t")


def mean_ci(responses: DataFrame, level: float = 0.95) -> DataFrame:
    """(question_id, n, mean, sd, ci_lower, ci_upper, warning) of value_num; intervals are null below three answers."""
    rows = responses.groupBy("question_id").agg(F.count("value_num").alias("n"), F.avg("value_num").alias("mean"), F.stddev_samp("value_num").alias("sd"))
    few = F.col("n") < MIN_SAMPLE
    out = _mean_interval(rows, level).withColumn("warning", sample_warning(F.col("n")))
    return out.select("question_id", "n", *[F.when(~few, F.col(c)).alias(c) for c in ("mean", "sd", "ci_lower", "ci_upper")], "warning")


def _shares(counts: DataFrame, level: float) -> DataFrame:
    w = wilson(F.col("count"), F.col("n"), level)
    return counts.where(F.col("n") >= MIN_SAMPLE).select("question_id", "option", "count", "n", F.round(F.col("count") / F.col("n"), 4).alias("proportion"), F.round(w["lo"], 4).alias("ci_lower"), F.round(w["hi"], 4).alias("ci_upper"))


def yes_no_ci(responses: DataFrame, level: float = 0.95) -> DataFrame:
    """Yes and No shares of value_bool."""
    rows = responses.groupBy("question_id").agg(F.count("value_bool").alias("n"), F.count_if("value_bool").alias("yes"))
    both = rows.select("question_id", "n", F.explode(F.array(F.struct(F.lit("Yes").alias("option"), F.col("yes").alias("count")), F.struct(F.lit("No").alias("option"), (F.col("n") - F.col("yes")).alias("count")))).alias("o"))
    return _shares(both.select("question_id", "n", "o.option", "o.count"), level)


def _with_options(counts: DataFrame, totals: DataFrame, options: DataFrame | None) -> DataFrame:
    """counts over the options given, else over those seen; unseen ones count 0."""
    if options is None:
        return counts.join(totals, "question_id")
    return options.join(totals, "question_id").join(counts, ["question_id", "option"], "left").na.fill(0, ["count"])


def choice_ci(responses: DataFrame, options: DataFrame | None = None, level: float = 0.95) -> DataFrame:
    """Shares of value_str. options: (question_id, option)."""
    given = responses.where("value_str is not null")
    counts = given.groupBy("question_id", F.col("value_str").alias("option")).agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy("question_id").agg(F.sum("count").alias("n"))
    return _shares(_with_options(counts, totals, options), level)


def checkbox_ci(responses: DataFrame, options: DataFrame | None = None, level: float = 0.95) -> DataFrame:
    """Shares of respondents that picked an option; value_list may be empty, an option picked twice counts once."""
    lists = responses.where("value_list is not null")
    totals = lists.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    counts = lists.select("question_id", F.explode(F.array_distinct("value_list")).alias("option")).groupBy("question_id", "option").agg(F.count(F.lit(1)).alias("count"))
    return _shares(_with_options(counts, totals, options), level)


def ranking_ci(responses: DataFrame, options: DataFrame | None = None, level: float = 0.95) -> DataFrame:
    """(question_id, option, n, mean, ci_lower, ci_upper): mean rank in value_list; zeros for items with under three ranks."""
    lists = responses.where(F.size("value_list") > 0)
    enough = lists.groupBy("question_id").agg(F.count(F.lit(1)).alias("answers")).where(F.col("answers") >= MIN_SAMPLE).select("question_id")
    ranks = lists.select("question_id", F.posexplode("value_list").alias("pos", "option"))
    rows = ranks.groupBy("question_id", "option").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("pos") + 1.0).alias("mean"), F.stddev_samp(F.col("pos") + 1.0).alias("sd"))
    if options is not None:
        rows = options.join(rows, ["question_id", "option"], "left").na.fill(0, ["n"])
    out = _mean_interval(rows, level).join(enough, "question_id", "left_semi")
    zero: Column = F.col("n") < MIN_SAMPLE
    return out.select("question_id", "option", "n", *[F.when(zero, 0.0).otherwise(F.col(c)).alias(c) for c in ("mean", "ci_lower", "ci_upper")])


def confidence_intervals(responses: DataFrame, level: float = 0.95) -> DataFrame:
    """All quantitative questions of a mixed table, one row for each estimate; other types are left out.

    The table is read once: each answer becomes rows of (total or not, option, value), and one grouping gives the counts and
    moments that every type's interval needs.

    responses: question_id, question_type, value_num, value_bool, value_str, value_list.
    """
    if not 0.5 <= level <= 0.99:
        raise ValueError("level must lie in 0.50 to 0.99")
    kind = F.col("question_type")
    part = lambda total, option, x: F.struct(F.lit(total).alias("total"), option.cast("string").alias("option"), x.cast("double").alias("x"))
    none, one = F.lit(None), F.lit(1.0)
    picks, ranks = F.array_distinct("value_list"), F.col("value_list")
    parts = (
        F.when(kind.isin("rating", "nps"), F.array(part(False, none, F.col("value_num"))))
        .when(kind == "yes_no", F.array(part(False, none, F.col("value_bool").cast("int"))))
        .when((kind == "multiple_choice") & F.col("value_str").isNotNull(), F.array(part(True, none, one), part(False, F.col("value_str"), one)))
        .when((kind == "checkbox") & ranks.isNotNull(), F.concat(F.array(part(True, none, one)), F.transform(picks, lambda o: part(False, o, one))))
        .when((kind == "ranking") & (F.size(ranks) > 0), F.concat(F.array(part(True, none, one)), F.transform(ranks, lambda o, k: part(False, o, k + 1))))
    )
    kinds = F.when(kind == "nps", "rating").otherwise(kind)
    moments = responses.select("question_id", kinds.alias("kind"), F.explode(parts).alias("p")).groupBy("question_id", "kind", "p.total", "p.option").agg(
        F.count("p.x").alias("n"), F.sum("p.x").alias("sum"), F.avg("p.x").alias("mean"), F.stddev_samp("p.x").alias("sd"), F.count(F.lit(1)).alias("rows")
    )
    answers = F.max(F.when(F.col("total"), F.col("rows"))).over(Window.partitionBy("question_id", "kind"))
    found = moments.withColumn("answers", answers).where(~F.col("total"))
    found = found.withColumn("t", t_critical(level)(F.when(F.col("n") >= MIN_SAMPLE, F.col("n") - 1).cast("double")))
    few, half = F.col("n") < MIN_SAMPLE, F.col("t") * F.col("sd") / F.sqrt("n")

    def estimate(option: Column, n: Column, value: Column, low: Column, high: Column) -> Column:
        return F.struct(option.alias("option"), n.alias("n"), F.round(value, 4).alias("estimate"), F.round(low, 4).alias("ci_lower"), F.round(high, 4).alias("ci_upper"))

    def share(option: Column, count: Column, n: Column) -> Column:
        w = wilson(count, n, level)
        return estimate(option, n, count / n, w["lo"], w["hi"])

    bounds = F.col("mean"), F.col("mean") - half, F.col("mean") + half
    option, yes, total = F.col("option"), F.col("sum").cast("long"), F.col("answers")
    out = (
        F.when(F.col("kind") == "rating", F.array(estimate(none.cast("string"), F.col("n"), *[F.when(~few, b) for b in bounds])))
        .when(F.col("kind") == "yes_no", F.when(~few, F.array(share(F.lit("Yes"), yes, F.col("n")), share(F.lit("No"), F.col("n") - yes, F.col("n")))))
        .when(F.col("kind") == "ranking", F.when(total >= MIN_SAMPLE, F.array(estimate(option, F.col("n"), *[F.when(few, 0.0).otherwise(b) for b in bounds]))))
        .otherwise(F.when(total >= MIN_SAMPLE, F.array(share(option, F.col("rows"), total))))
    )
    return found.select("question_id", F.explode(out).alias("e")).select("question_id", "e.*")
