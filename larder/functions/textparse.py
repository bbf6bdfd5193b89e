"""Parsers for model replies as Column expressions.

Every parser is total: malformed text yields NULLs or the documented
default, never an error (``try_parse_json``, PERMISSIVE ``from_json``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()`` (all surrounding whitespace)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _nz(c: Column) -> Column:
    return F.when(c == "", F.lit(None)).otherwise(c)


# Plan headings (case-insensitive) and kcal patterns.
PLAN_SPLIT = r"(?i)\*\*Meal Plan \d+\*\*|Meal Plan \d+:|MEAL PLAN \d+"
KCAL = r"(?i)(\d+(?:\.\d+)?)\s*kcal"
TOTAL_KCAL = r"(?i)Total Calories?:?\s*(\d+(?:\.\d+)?)\s*kcal"
PLAN_MIN, PLAN_MAX = 1000.0, 4000.0


def extract_plan_calories(response: Column) -> Column:
    """Up to three plan totals: per plan section (headings split, the
    first three sections after the text before the first heading) the
    largest ``N kcal`` within 1000..4000, else 0; a section with no kcal
    adds nothing; without headings the ``Total Calories: N kcal`` values in
    range; padded with 0 to three values. Each section is scanned once (the
    kcal list is produced by an inner transform and consumed by an outer
    one)."""
    sections = F.split(response, PLAN_SPLIT)
    kcal_lists = F.transform(F.slice(sections, 2, 3),
                             lambda s: F.transform(F.regexp_extract_all(s, F.lit(KCAL), 1), lambda x: x.cast("double")))
    per = F.transform(kcal_lists, lambda v: F.when(
        F.size(v) > 0, F.coalesce(F.array_max(F.filter(v, lambda c: (c >= PLAN_MIN) & (c <= PLAN_MAX))), F.lit(0.0))))
    headed = F.filter(per, lambda x: x.isNotNull())
    totals = F.filter(F.transform(F.regexp_extract_all(response, F.lit(TOTAL_KCAL), 1), lambda x: x.cast("double")),
                      lambda v: (v >= PLAN_MIN) & (v <= PLAN_MAX))
    vals = F.when(F.size(sections) > 1, headed).otherwise(totals)
    return F.slice(F.concat(vals, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))), 1, 3)


def with_calorie_error(df, cals: str, target: str, out: str = "e"):
    """D17 as two projections: one pass over the plan values (sum and count
    of the positive ones), then the error struct from that pair, so the
    parsed values are not recomputed per output field."""
    acc = F.aggregate(F.col(cals), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")),
                      lambda a, c: F.when(c > 0, F.struct((a["s"] + c).alias("s"), (a["n"] + 1).alias("n"))).otherwise(a))
    x = df.withColumn("_acc", acc)
    n, s, t = F.col("_acc.n"), F.col("_acc.s"), F.col(target)
    mean = s / n
    actual = F.when(n > 0, mean).otherwise(F.lit(0.0))
    err = F.when(n > 0, F.abs(mean - t)).otherwise(t.cast("double"))
    pct = F.when(n > 0, F.try_divide(F.abs(mean - t), t) * 100).otherwise(F.lit(100.0))
    return x.withColumn(out, F.struct(actual.alias("actual_calories"), err.alias("error_kcal"), pct.alias("error_pct"),
                                      (pct < 100).alias("success"))).drop("_acc")


def fenced_body(c: Column) -> Column:
    """Text inside a ```json (or plain ```) fence, else the text; stripped."""
    after_json = F.split(F.split(c, "```json", 2)[1], "```", 2)[0]
    after_plain = F.split(F.split(c, "```", 3)[1], "```", 2)[0]
    body = F.when(F.contains(c, F.lit("```json")), after_json) \
        .when(F.contains(c, F.lit("```")), after_plain).otherwise(c)
    return strip_ws(body)


def parse_judge_json(content: Column) -> Column:
    """Fenced JSON -> struct(accuracy, quality, reasoning, parsed);
    missing fields 0 / 'No reasoning provided'; unparsable -> 0, 0,
    'Judge Error'."""
    body = fenced_body(content)
    v = F.try_parse_json(body)
    ok = v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT")
    acc = F.coalesce(F.try_variant_get(v, "$.accuracy", "double"), F.lit(0.0))
    qual = F.coalesce(F.try_variant_get(v, "$.quality", "double"), F.lit(0.0))
    why = F.coalesce(F.try_variant_get(v, "$.reasoning", "string"), F.lit("No reasoning provided"))
    return F.struct(F.when(ok, acc).otherwise(F.lit(0.0)).alias("accuracy"),
                    F.when(ok, qual).otherwise(F.lit(0.0)).alias("quality"),
                    F.when(ok, why).otherwise(F.lit("Judge Error")).alias("reasoning"),
                    ok.alias("parsed"))


def arena_score(content: Column) -> Column:
    """D19 (arena variant): ``score`` from the JSON, else the first
    ``"score": N`` in the text, else 0."""
    body = fenced_body(content)
    v = F.try_parse_json(body)
    from_json_score = F.try_variant_get(v, "$.score", "int")
    rx = _nz(F.regexp_extract(body, r'"score":\s*(\d+)', 1)).try_cast("int")
    parsed = v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT")
    return F.when(parsed, from_json_score).otherwise(F.coalesce(rx, F.lit(0)))


def extract_json_from_text(raw: Column) -> Column:
    """The whole text, else the greedy ``[...]`` span, else the greedy
    ``{...}`` span; struct(stage, value variant)."""
    cleaned = strip_ws(raw)
    v1 = F.try_parse_json(cleaned)
    v2 = F.try_parse_json(_nz(F.regexp_extract(cleaned, r"(?s)\[.*\]", 0)))
    v3 = F.try_parse_json(_nz(F.regexp_extract(cleaned, r"(?s)\{.*\}", 0)))
    stage = (F.when(v1.isNotNull(), F.lit("whole")).when(v2.isNotNull(), F.lit("list"))
             .when(v3.isNotNull(), F.lit("object")).otherwise(F.lit("none")))
    return F.struct(stage.alias("stage"), F.coalesce(v1, v2, v3).alias("value"))


def repair_json_text(content: Column) -> Column:
    """Greedy object span, trailing commas removed; if that fails,
    ``//`` line comments and block comments are removed too. Only an
    object counts; struct(ok, value variant)."""
    span = _nz(F.regexp_extract(content, r"(?s)\{.*\}", 0))
    c = F.coalesce(span, content)
    c = F.regexp_replace(c, r",(\s*[}\]])", "$1")
    v1 = F.try_parse_json(c)
    c2 = F.regexp_replace(F.regexp_replace(c, r"//.*", ""), r"(?s)/\*.*?\*/", "")
    v = F.coalesce(v1, F.try_parse_json(c2))
    ok = v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT")
    return F.struct(ok.alias("ok"), F.when(ok, v).alias("value"))


TOOL_CALL = T.StructType([T.StructField("tool", T.StringType()), T.StructField("query", T.StringType())])


def tool_call_candidates(content: Column) -> Column:
    """Every non-nested ``{...}`` parsed as (tool, query); malformed
    candidates give NULL fields."""
    cands = F.regexp_extract_all(content, F.lit(r"(\{[^{}]*\})"), 1)
    return F.transform(cands, lambda x: F.from_json(x, TOOL_CALL, {"mode": "PERMISSIVE"}))


def clean_agent_text(c: Column) -> Column:
    """D23 cleanup: drop code fences and leaked ['thinking' ...] blocks."""
    c = F.regexp_replace(c, r"```json\s*", "")
    c = F.regexp_replace(c, r"```\s*", "")
    c = F.regexp_replace(c, r"(?s)\['thinking'.*?\]", "")
    return strip_ws(c)


def agent_text_blocks(blocks_json: Column) -> Column:
    """A list of agent blocks -> the answer text. Blocks with a
    thinking / tool_use / tool_result key are dropped; ``content`` (text or
    list of text items) and ``text`` blocks are joined with blank lines."""
    items = F.from_json(blocks_json, T.ArrayType(T.StringType()), {"mode": "PERMISSIVE"})

    def texts(x):
        keys = F.json_object_keys(x)
        skip = F.arrays_overlap(keys, F.array(F.lit("thinking"), F.lit("tool_use"), F.lit("tool_result")))
        content = F.get_json_object(x, "$.content")
        content_list = F.from_json(content, T.ArrayType(T.StringType()))
        from_list = F.filter(F.transform(content_list, lambda e: F.coalesce(
            F.get_json_object(e, "$.text"), F.when(~F.startswith(e, F.lit("{")), e))), lambda e: e.isNotNull())
        has_content = F.array_contains(keys, "content")
        has_text = F.array_contains(keys, "text")
        return (F.when(skip, F.array().cast("array<string>"))
                .when(has_content & content_list.isNotNull(), from_list)
                .when(has_content, F.array(content))
                .when(has_text, F.array(F.get_json_object(x, "$.text")))
                .otherwise(F.array().cast("array<string>")))

    parts = F.flatten(F.transform(items, texts))
    joined = F.when(F.size(parts) > 0, F.array_join(parts, "\n\n")).otherwise(F.lit("No clear response found"))
    return clean_agent_text(joined)
