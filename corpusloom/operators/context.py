"""Profiles, JSON salvage, question forms and model calls over columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences

#: What each profile style shows, as (label, field, behind it).
PROFILE_STYLES = {
    "strategic": ("Company / Client Profile:\n", [("Industry", "industry", ""), ("Headcount", "headcount", ""), ("Target age range", "demographic.age_range", ""), ("Income bracket", "demographic.income_bracket", ""), ("Occupation", "demographic.occupation", ""), ("Location", "demographic.location", "")], "\n"),
    "survey": ("\n\nOrganization profile:\n", [("Industry", "industry", ""), ("Headcount", "headcount", " employees"), ("Revenue", "revenue", ""), ("Company", "company_name", ""), ("Target persona", "persona", ""), ("Respondent age range", "demographic.age_range", ""), ("Income bracket", "demographic.income_bracket", ""), ("Respondent occupation", "demographic.occupation", ""), ("Location", "demographic.location", "")], ""),
}
UUID = r"(?i)^\{?(urn:uuid:)?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?$"
#: Fixed value: a fenced block in a model's answer.
FENCE = r"```(?:json)?\s*([\s\S]*?)```"


def profile_section(col: str, style: str) -> Column:
    """The filled fields of a profile struct as lines under a heading; empty if none is."""
    head, fields, tail = PROFILE_STYLES[style]
    value = lambda f: F.col(f"{col}.{f}").cast("string")
    lines = F.concat_ws("\n", *[F.when(value(f) != "", F.concat(F.lit(f"{label}: "), value(f), F.lit(after))) for label, f, after in fields])
    return F.when(lines == "", "").otherwise(F.concat(F.lit(head), lines, F.lit(tail)))


def web_queries(df: DataFrame, most: int = 3) -> DataFrame:
    """df with ``queries``: the given ones, or industry and focus; the first three."""
    own = F.array(F.concat(F.when(F.coalesce("industry", F.lit("")) != "", F.concat("industry", F.lit(" "))).otherwise(""), F.col("focus")))
    return df.withColumn("queries", F.slice(F.when(F.size("web_queries") > 0, F.col("web_queries")).otherwise(own), 1, most))


def results_context(results: DataFrame) -> DataFrame:
    """(query_id, context) of search results (query_id, pos, title, link, snippet)."""
    rows = results.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pos", "title", "link", "snippet"))).alias("x"))
    line = lambda r, i: F.concat(F.lit("[Web Result "), (i + 1).cast("string"), F.lit("] "), F.coalesce(r["title"], F.lit("")), F.lit("\nURL: "), F.coalesce(r["link"], F.lit("")), F.lit("\n"), F.coalesce(r["snippet"], F.lit("")))
    return rows.select("query_id", F.array_join(F.transform("x", line), "\n\n").alias("context"))


def infer(df: DataFrame, prompt_col: str, fn: Callable[[list[str]], list], result_type: str, batch_size: int = 64) -> DataFrame:
    """df with ``result``: fn called on batches of prompts inside tasks; it must give one value for each prompt."""
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, batch_size):
                part = batch.slice(a, batch_size)
                values = fn(part.column(prompt_col).to_pylist())
                if len(values) != part.num_rows:
                    raise ValueError(f"{part.num_rows} prompts gave {len(values)} results")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values)], names=[*part.schema.names, "result"])

    return df.mapInArrow(run, f"{schema}, result {result_type}")


def json_text(col: Column, fence: bool = True) -> Column:
    """The text if it is JSON, else what a fenced block in it holds if that is; else null."""
    inner = F.regexp_extract(col, FENCE, 1)
    whole = F.when(F.try_parse_json(col).isNotNull(), col)
    return F.coalesce(whole, F.when(F.try_parse_json(inner).isNotNull(), inner)) if fence else whole


def salvage_json(col: Column, schema: str, fallback: Column, fence: bool = True) -> Column:
    text = json_text(col, fence)
    return F.when(text.isNotNull(), F.from_json(text, schema)).otherwise(fallback.cast(schema))


def ensure_parsed(col: Column, schema: str, fallback: Column) -> Column:
    return salvage_json(col, schema, fallback, fence=False)


def json_variant(col: Column) -> Column:
    return F.coalesce(F.try_parse_json(col), F.try_parse_json(F.regexp_extract(col, FENCE, 1)))


def unwrap_questions(v: Column) -> Column:
    """Array of questions as variants, from an array or from ``questions`` or ``recommendations`` of an object; else null."""
    return F.coalesce(*[F.try_variant_get(v, path, "array<variant>") for path in ("$", "$.questions", "$.recommendations")])


def normalize_questions(df: DataFrame, col: str) -> DataFrame:
    """df with ``questions``: array of structs with each type's defaults, null with ``status`` parse_error if there are none.

    A question without a valid id gets one made from its place and label, so runs repeat.
    """
    get = lambda q, p, t="string": F.try_variant_get(q, f"$.{p}", t)

    def named(items: Column, salt: str) -> Column:
        return F.transform(items, lambda x, i: F.struct(_id(get(x, "id"), F.concat(F.lit(salt), i.cast("string"), F.coalesce(get(x, "label"), F.lit("")))).alias("id"), F.coalesce(get(x, "label"), F.lit("")).alias("label")))

    def _id(given: Column, seed: Column) -> Column:
        h = F.md5(seed)
        made = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
        return F.when(given.rlike(UUID), given).otherwise(made)

    def read(q: Column) -> Column:
        label = F.coalesce(F.when(get(q, "label") != "", get(q, "label")), get(q, "text"), F.lit(""))
        return F.struct(q.alias("q"), F.coalesce(get(q, "type"), F.lit("multiple_choice")).alias("kind"), label.alias("label"), get(q, "id").alias("id"))

    def one(x: Column, i: Column) -> Column:
        q, kind, label = x["q"], x["kind"], x["label"]
        of = lambda kinds, value: F.when(kind.isin(*kinds), value)
        strings = lambda p: F.coalesce(get(q, p, "array<string>"), F.array().cast("array<string>"))
        cards = lambda p: named(F.coalesce(get(q, p, "array<variant>"), F.array().cast("array<variant>")), p)
        return F.struct(
            _id(x["id"], F.concat(i.cast("string"), F.lit("|"), label)).alias("id"), kind.alias("type"), label.alias("label"), F.coalesce(get(q, "required", "boolean"), F.lit(False)).alias("required"),
            of(["multiple_choice", "checkbox"], strings("options")).alias("options"), of(["rating"], F.coalesce(get(q, "min", "int"), F.lit(1))).alias("min"), of(["rating"], F.coalesce(get(q, "max", "int"), F.lit(5))).alias("max"),
            of(["rating"], F.coalesce(get(q, "lowLabel"), F.lit("Poor"))).alias("lowLabel"), of(["rating"], F.coalesce(get(q, "highLabel"), F.lit("Excellent"))).alias("highLabel"),
            of(["ranking"], strings("items")).alias("items"), of(["card_sort"], cards("items")).alias("cards"), of(["card_sort"], cards("categories")).alias("categories"),
        )

    # explode(array(x)) has x made once: the planner would else repeat it in every field that reads it. So has the inner transform.
    out = df.withColumn("_v", F.explode(F.array(json_variant(F.col(col))))).withColumn("_q", F.explode(F.array(unwrap_questions(F.col("_v")))))
    return out.withColumns({"questions": F.transform(F.transform("_q", read), one), "status": F.when(F.col("_q").isNull(), "parse_error").otherwise("complete")}).drop("_q", "_v")


def render_survey(questions: DataFrame) -> DataFrame:
    """(survey_id, text) of (survey_id, pos, type, label, options, response_summary)."""
    rows = questions.groupBy("survey_id").agg(F.sort_array(F.collect_list(F.struct("pos", "type", "label", "options", "response_summary"))).alias("x"))

    def line(q: Column, i: Column) -> Column:
        head = F.concat(F.lit("Q"), (i + 1).cast("string"), F.lit(". ["), F.coalesce(q["type"], F.lit("unknown")), F.lit("] "), F.coalesce(q["label"], F.lit("")))
        return F.concat_ws("\n", head, F.when(F.size(q["options"]) > 0, F.concat(F.lit("   Options: "), F.array_join(q["options"], ", "))), F.when(q["response_summary"] != "", F.concat(F.lit("   Response summary: "), q["response_summary"])))

    return rows.select("survey_id", F.array_join(F.transform("x", line), "\n\n").alias("text"))


def _pipe_items(col: Column) -> Column:
    return F.filter(F.transform(F.split(col, r"\|"), lambda q: F.trim(q)), lambda q: q != "")


def lint_questions(col: Column) -> Column:
    """A line of feedback for each question of a pipe-separated list."""
    # Openers of yes-no questions and the wording of the feedback.
    openers = ("do you", "are you", "is it", "can you", "will you")

    def one(q: Column, i: Column) -> Column:
        found = F.array_compact(F.array(
            F.when(F.length(q) < 10, "too short — may lack clarity"), F.when(~q.endswith("?"), "does not end with '?'"),
            F.when(F.lower(q).rlike("^(" + "|".join(openers) + ")"), "yes/no question — consider rephrasing as open-ended"), F.when(F.length(q) > 200, "very long — consider splitting into multiple questions"),
        ))
        return F.concat(F.lit("Q"), (i + 1).cast("string"), F.lit(": "), F.when(F.size(found) == 0, "OK").otherwise(F.array_join(found, "; ")))

    return F.array_join(F.transform(_pipe_items(col), one), "\n")


def pipe_survey(title: Column, description: Column, col: Column) -> Column:
    """A survey as JSON from a pipe-separated list of questions."""
    items = F.transform(_pipe_items(col), lambda q, i: F.struct((i + 1).alias("id"), q.alias("text"), F.lit("open_ended").alias("type")))
    return F.to_json(F.struct(title.alias("title"), description.alias("description"), items.alias("questions")))


def type_instructions(types: Column, instructions: dict[str, str]) -> Column:
    """The instructions of an array of question types, known ones only, in order."""
    known = F.create_map(*[F.lit(x) for kv in instructions.items() for x in kv])
    return F.array_join(F.array_compact(F.transform(types, lambda t: F.element_at(known, t))), "\n")


#: Result fields by kind, and the values that some of them may take.
RESULT_SCHEMAS = {
    "strategic": "executive_summary string, convergent_themes array<string>, action_points array<struct<title:string,description:string,priority:string,evidence:array<string>>>, future_recommendations array<string>",
    "sentiment": "overall_sentiment struct<positive:double,negative:double,neutral:double>, dominant_sentiment string, themes array<struct<theme:string,sentiment:string,confidence:double,description:string>>, notable_quotes array<struct<quote:string,sentiment:string,theme:string>>, summary string",
    "insights": "summary string, actionable_insights array<struct<title:string,description:string,category:string,source_quote:string,priority:string>>",
}
SENTIMENTS = ["positive", "negative", "neutral"]
PRIORITIES = ["high", "medium", "low"]
CATEGORIES = ["feature_request", "pain_point", "improvement", "workflow", "ux", "other"]
QUESTION_TYPES = ["multiple_choice", "checkbox", "short_text", "long_text", "rating", "yes_no", "nps", "ranking", "card_sort"]
QUESTION_FORM = "id string, type string, label string, required boolean, options array<string>, items array<string>, categories array<string>, min int, max int, lowLabel string, highLabel string"


def project_result(df: DataFrame, col: str, kind: str) -> DataFrame:
    """df with the result's fields: from JSON in col (fenced or not), defaults where missing, the raw text as summary if there is none.

    An insight without a priority is of medium priority, an action point without evidence has an empty list.
    """
    schema, raw = RESULT_SCHEMAS[kind], F.col(col)
    text = json_text(raw)
    parsed = F.from_json(text, schema)
    summary = "executive_summary" if kind == "strategic" else "summary"
    thirds = F.struct(F.lit(0.33).alias("positive"), F.lit(0.33).alias("negative"), F.lit(0.34).alias("neutral"))
    given = {
        "actionable_insights": lambda x: x.withField("priority", F.coalesce(x["priority"], F.lit("medium"))),
        "action_points": lambda x: x.withField("evidence", F.coalesce(x["evidence"], F.array().cast("array<string>"))),
    }
    out = {}
    for name, kind_of in [(f.name, f.dataType) for f in _fields(schema)]:
        value = parsed[name]
        if name == summary:
            out[name] = F.when(text.isNull(), raw).otherwise(F.coalesce(value, F.lit("")))
        elif name == "dominant_sentiment":
            out[name] = F.coalesce(value, F.lit("neutral"))
        elif name == "overall_sentiment":
            out[name] = F.when(text.isNull(), thirds).otherwise(value)
        else:
            value = F.transform(value, given[name]) if name in given else value
            out[name] = F.coalesce(value, F.array().cast(kind_of))
    return df.withColumns(out)


def _fields(schema: str) -> list:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).fields


def _violations(rows: DataFrame, key: str, tests: dict[str, Column]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(True)), F.lit(n)) for n, t in tests.items()]))
    return rows.select(key, F.explode(found).alias("violation"))


def _any(col: str, field: str, bad: Callable[[Column], Column]) -> Column:
    """Whether some element's field is bad, or null."""
    return F.exists(col, lambda x: F.coalesce(bad(x[field]), F.lit(True)))


def check_results(results: DataFrame, texts: DataFrame, kind: str = "sentiment") -> DataFrame:
    """(client_id, violation) of the results that ``project_result`` gives, against the texts that they were made from.

    sentiment: fractions sum to 1, the dominant label is the largest fraction, 3 to 8 themes, 3 to 6 quotes that the text
    holds word for word, confidences between 0 and 1, known sentiments. insights: 3 to 10 insights of a known category and
    priority, quotes, where given, that the text holds, a summary of 3 to 6 sentences. strategic: known priorities.

    results: client_id and the kind's fields; texts: client_id, text. A missing value breaks the rule that needs it.
    """
    rows = results.join(texts, "client_id", "left")
    holds = lambda q: F.coalesce(F.col("text").contains(q), F.lit(False))
    if kind == "insights":
        return _violations(rows, "client_id", {
            "insights not 3 to 10": ~F.size("actionable_insights").between(3, 10),
            "unknown category": _any("actionable_insights", "category", lambda c: ~c.isin(CATEGORIES)),
            "unknown priority": _any("actionable_insights", "priority", lambda p: ~p.isin(PRIORITIES)),
            "quote not in the transcript": F.exists("actionable_insights", lambda x: x["source_quote"].isNotNull() & ~holds(x["source_quote"])),
            "summary not 3 to 6 sentences": ~F.size(sentences(F.col("summary"))).between(3, 6),
        })
    if kind == "strategic":
        return _violations(rows, "client_id", {"unknown priority": _any("action_points", "priority", lambda p: ~p.isin(PRIORITIES))})
    s = F.col("overall_sentiment")
    best = F.greatest(*[s[x] for x in SENTIMENTS])
    dominant = F.coalesce(*[F.when(F.col("dominant_sentiment") == x, s[x]) for x in SENTIMENTS])
    return _violations(rows, "client_id", {
        "fractions do not sum to 1": F.abs(s["positive"] + s["negative"] + s["neutral"] - 1) > 1e-6, "dominant is not the largest": dominant < best,
        "themes not 3 to 8": ~F.size("themes").between(3, 8), "quotes not 3 to 6": ~F.size("notable_quotes").between(3, 6),
        "quote not in the transcript": _any("notable_quotes", "quote", lambda q: ~holds(q)),
        "confidence not between 0 and 1": _any("themes", "confidence", lambda c: ~c.between(0.0, 1.0)),
        "unknown sentiment": _any("themes", "sentiment", lambda x: ~x.isin([*SENTIMENTS, "mixed"])) | _any("notable_quotes", "sentiment", lambda x: ~x.isin(SENTIMENTS)),
    })


def check_questions(questions: DataFrame, key: str = "question_id") -> DataFrame:
    """(question_id, violation) of form questions, given as JSON in ``question``: what each type of question needs and may have.

    A choice has 3 to 6 options, a ranking 3 to 6 items, a card sort 3 to 6 items and 2 to 4 categories with ids of their
    own, a rating whole bounds in order and both labels; the other types have none of these. Ids are UUIDs of version 4.
    """
    q = F.from_json("question", QUESTION_FORM)
    rows = questions.select(key, q.alias("q"))
    kind = F.col("q.type")
    of = lambda *types: F.coalesce(kind.isin(*types), F.lit(False))
    count = lambda c: F.when(F.col(f"q.{c}").isNull(), 0).otherwise(F.size(f"q.{c}"))
    part_ids = F.transform(F.concat(*[F.coalesce(f"q.{c}", F.array().cast("array<string>")) for c in ("items", "categories")]), lambda x: F.get_json_object(x, "$.id"))
    version4 = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    given = F.col("q.min").isNotNull() | F.col("q.max").isNotNull() | F.col("q.lowLabel").isNotNull() | F.col("q.highLabel").isNotNull()
    return _violations(rows, key, {
        "unknown type": ~kind.isin(QUESTION_TYPES), "no label": F.trim("q.label") == "", "required is not a boolean": F.col("q.required").isNull(),
        "id is not a UUID of version 4": ~F.col("q.id").rlike(version4),
        "options not 3 to 6": of("multiple_choice", "checkbox") & ~count("options").between(3, 6),
        "items not 3 to 6": of("ranking", "card_sort") & ~count("items").between(3, 6),
        "categories not 2 to 4": of("card_sort") & ~count("categories").between(2, 4),
        "card ids not unique UUIDs": of("card_sort") & (F.exists(part_ids, lambda i: F.coalesce(~i.rlike(version4), F.lit(True))) | (F.size(F.array_distinct(part_ids)) < F.size(part_ids))),
        "rating bounds or labels missing": of("rating") & F.coalesce(~((F.col("q.min") < F.col("q.max")) & F.col("q.lowLabel").isNotNull() & F.col("q.highLabel").isNotNull()), F.lit(True)),
        "fields of another type": ((count("options") > 0) & ~of("multiple_choice", "checkbox")) | ((count("items") > 0) & ~of("ranking", "card_sort")) | ((count("categories") > 0) & ~of("card_sort")) | (given & ~of("rating")),
    })
