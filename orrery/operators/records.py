"""Questions to conversation records: validation, fan-out by pipeline, message builders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.geometry import arcs, combine, last_wins, representative_points
from ..functions.numbers import fixed as fixed_text
from ..functions.numbers import json_number, json_text, rounded
from ..functions.text import normal_answer
from ..schemas import require_columns

REQUIRED = ("question_id", "question", "location_names", "geometries", "answer")
PIPELINES = (1, 2)
MESSAGES = "array<struct<role:string,content:string,tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>,name:string,tool_call_id:string>>"


def validated(questions: DataFrame) -> DataFrame:
    """questions with a normal answer, and malformed: under three geometries, or not as many names."""
    require_columns(questions, set(REQUIRED))
    size = F.coalesce(F.size("geometries"), F.lit(-1))
    bad = (size < 3) | (size != F.coalesce(F.size("location_names"), F.lit(-1)))
    return questions.withColumns({"question_id": F.col("question_id").cast("long"), "answer": normal_answer(F.col("answer")), "malformed": bad})


def fan_out(rows: DataFrame, pipelines: tuple[int, ...] = PIPELINES) -> DataFrame:
    """A row for each pipeline, with its system prompt and its tools as JSON."""
    out = rows.withColumn("pipeline", F.explode(F.array(*map(F.lit, pipelines))))
    return out.withColumns({"tools": tools_of(F.col("pipeline")), "system": system_of(F.col("pipeline"))})


def tools_of(pipeline: Column) -> Column:
    return F.when(pipeline == 1, F.lit(fixed.TOOLS[1])).otherwise(F.lit(fixed.TOOLS[2]))


def system_of(pipeline: Column) -> Column:
    return F.when(pipeline == 1, F.lit(fixed.SYSTEM_BASE + fixed.SYSTEM_REASON)).otherwise(F.lit(fixed.SYSTEM_BASE + fixed.SYSTEM_TOOL))


def message(role: str, content: Column | None = None, name: str | None = None, call: tuple[str, Column] | None = None) -> Column:
    """One message; absent parts are null."""
    calls = F.lit(None)
    if call:
        calls = F.array(F.struct(F.lit(None).cast("string").alias("id"), F.lit("function").alias("type"), F.struct(F.lit(call[0]).alias("name"), call[1].alias("arguments")).alias("function")))
    return F.struct(
        F.lit(role).alias("role"),
        (F.lit(None) if content is None else content).cast("string").alias("content"),
        calls.cast("array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>").alias("tool_calls"),
        F.lit(name).cast("string").alias("name"),
        F.lit(None).cast("string").alias("tool_call_id"),
    )


def number_texts(rows: DataFrame, rounding: Callable[[str, int], str] = rounded) -> DataFrame:
    """rows (points, labels, arcs) with the texts of their numbers: of coordinates by rounding to six places (geo_numbers) and unrounded
    (raw_numbers), and with two places of coordinates and of the vectors from the first point (shown), x and y in turn, and of determinants (dets)."""
    xy = lambda p: F.flatten(F.transform(p, lambda q: F.array(q["x"], q["y"])))
    first = F.get("points", F.lit(0))
    away = F.transform("points", lambda p: F.struct((p["x"] - first["x"]).alias("x"), (p["y"] - first["y"]).alias("y")))
    rows = rows.withColumns({"xy": xy(F.col("points")), "away": xy(away)})
    of = {"geo_numbers": ("xy", json_number(rounding("v", 6))), "raw_numbers": ("xy", json_number("v")), "shown": ("concat(xy, away)", fixed_text("v")), "dets": ("arcs.det", fixed_text("v"))}
    return rows.withColumns({name: F.expr(f"transform({values}, v -> {text})") for name, (values, text) in of.items()}).drop("xy", "away")


def reasoning_trace(names: Column, shown: Column, dets: Column, labels: Column, label: Column) -> Column:
    """Trace of the cross products of a path, from number_texts."""
    name = lambda i: F.get(names, i)
    at = lambda i, k: F.get(shown, 2 * i + k)
    pair = lambda i: F.concat(F.lit("("), at(i, 0), F.lit(", "), at(i, 1), F.lit(")"))
    size = F.size(labels) + 2  # the points
    head = _filled(fixed.TRACE_CENTER, name=name(F.lit(0)), point=pair(F.lit(0)))
    places = F.transform(F.sequence(F.lit(1), size - 1), lambda i: _filled(fixed.TRACE_WAYPOINT, i=i, name=name(i), point=pair(i)))
    far = lambda i, k: at(size + i, k)
    arc = lambda turn, i: _filled(fixed.TRACE_ARC, i=i + 1, j=i + 2, b=name(i + 1), c=name(i + 2), bx=far(i + 1, 0), by=far(i + 1, 1), cx=far(i + 2, 0), cy=far(i + 2, 1), det=F.get(dets, i), label=turn)
    end = _filled(fixed.TRACE_END, n=F.size(labels), label=label)
    return F.concat_ws("\n", F.array(F.lit(fixed.TRACE_HEAD), head), places, F.array(F.lit("")), F.transform(labels, arc), F.array(F.lit(""), end))


def geocode_json(names: Column, numbers: Column) -> Column:
    """From names as JSON strings, JSON of name -> longitude and latitude. Of equal names the last value counts, at the first one's place."""
    values = F.transform(names, lambda _, i: F.concat(F.lit('{"longitude": '), F.get(numbers, 2 * i), F.lit(', "latitude": '), F.get(numbers, 2 * i + 1), F.lit("}")))
    return F.concat(F.lit("{"), F.array_join(F.transform(last_wins(names, values), lambda e: F.concat(e["name"], F.lit(": "), e["value"])), ", "), F.lit("}"))


def names_json(names: Column) -> Column:
    """From names as JSON strings, the arguments of the geocode call."""
    return F.concat(F.lit('{"place_names": ['), F.array_join(names, ", ", "null"), F.lit("]}"))


def arc_arguments(numbers: Column) -> Column:
    """JSON arguments of the cyclic_order calls of a path, with unrounded numbers."""
    pair = lambda i: F.concat(F.lit("["), F.get(numbers, 2 * i), F.lit(", "), F.get(numbers, 2 * i + 1), F.lit("]"))
    one = lambda i: F.concat(F.lit('{"center": '), pair(F.lit(0)), F.lit(', "point_b": '), pair(i), F.lit(', "point_c": '), pair(i + 1), F.lit("}"))
    return F.when(F.size(numbers) > 4, F.transform(F.sequence(F.lit(1), F.greatest(F.size(numbers) / 2 - 2, F.lit(1)).cast("int")), one)).otherwise(F.array().cast("array<string>"))


def _filled(text: str, **parts: Column) -> Column:
    """A fixed text with columns for its named fields."""
    out, rest = [], text
    while "{" in rest:
        before, _, rest = rest.partition("{")
        field, _, rest = rest.partition("}")
        out += [F.lit(before), parts[field.partition(":")[0]].cast("string")]  # a column for a number with a format is its text
    return F.concat(*out, F.lit(rest))


def conversations(questions: DataFrame, pipelines: tuple[int, ...] = PIPELINES, rounding: Callable[[str, int], str] = rounded) -> DataFrame:
    """Records (question_id, pipeline, tools, messages, expected_answer, meta) of well-formed questions, and derived: the
    label from geometry. A stored answer that differs stays as the expected one. Geocoded coordinates are rounded as Python does, or by
    another function of functions.numbers. Points, arcs and all number texts
    are made once a question, before the fan-out; nothing is shuffled and no Python runs."""
    rows = validated(questions).where(~F.col("malformed"))
    rows = rows.withColumn("points", representative_points(F.col("geometries")))
    rows = rows.withColumn("arcs", arcs(F.col("points"))).withColumn("labels", F.col("arcs.label")).withColumn("derived", combine(F.col("labels")))
    rows = number_texts(rows, rounding).withColumn("quoted", F.expr(f"transform(location_names, t -> {json_text('t')})"))
    quoted = F.col("quoted")
    rows = rows.withColumns({"geo": geocode_json(quoted, F.col("geo_numbers")), "ask": names_json(quoted), "trace": reasoning_trace(F.col("location_names"), F.col("shown"), F.col("dets"), F.col("labels"), F.col("derived")), "args": arc_arguments(F.col("raw_numbers"))})
    rows = fan_out(rows, pipelines)
    name = lambda i: F.get("location_names", i if isinstance(i, Column) else F.lit(i))
    head = F.array(
        message("system", F.col("system")),
        message("user", F.col("question")),
        message("assistant", call=("geocode", F.col("ask"))),
        message("tool", F.col("geo"), "geocode"),
    )
    first = F.when(F.col("pipeline") == 1, F.array(message("assistant", F.col("trace")))).otherwise(F.array().cast(MESSAGES))
    steps = F.transform(
        F.arrays_zip(F.col("labels").alias("label"), F.col("args").alias("args")),
        lambda z, i: F.array(
            message(
                "assistant",
                F.when(i == 0, _filled(fixed.PREFACE_FIRST, b=name(i + 1), c=name(i + 2), a=name(0))).otherwise(_filled(fixed.PREFACE_NEXT, b=name(i + 1), c=name(i + 2), a=name(0))),
                call=("cyclic_order", z["args"]),
            ),
            message("tool", F.concat(F.lit('{"result": "'), z["label"], F.lit('"}')), "cyclic_order"),
        ),
    )
    summary = _filled(fixed.SUMMARY, n=F.size("labels"), a=name(0), labels=F.array_join("labels", ", "), whether=F.when(F.col("derived") != "neither", F.lit(fixed.AGREE)).otherwise(F.lit(fixed.DISAGREE)), label=F.col("derived"))
    second = F.concat(F.flatten(steps), F.array(message("assistant", summary)))
    messages = F.concat(head, F.when(F.col("pipeline") == 1, first).otherwise(second))
    meta = F.struct("location_names", "geometries", "answer")
    return rows.select("question_id", "pipeline", "tools", messages.alias("messages"), F.col("answer").alias("expected_answer"), meta.alias("meta"), "derived")


def audit(questions: DataFrame, pipelines: tuple[int, ...] = PIPELINES) -> DataFrame:
    """One row: total, malformed, mislabelled (derived differs), disagreements (mislabelled for each pipeline), inconsistent (malformed and disagreements)."""
    rows = validated(questions)
    label = combine(F.transform(arcs(representative_points(F.col("geometries"))), lambda a: a["label"]))
    wrong = F.when(F.col("malformed"), F.lit(False)).otherwise(F.coalesce(label != F.col("answer"), F.lit(True)))
    rows = rows.select("malformed", wrong.alias("wrong"))
    n = len(pipelines)
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if("malformed").alias("malformed"),
        F.count_if("wrong").alias("mislabelled"),
        (F.count_if("wrong") * n).alias("disagreements"),
        (F.count_if("malformed") + F.count_if("wrong") * n).alias("inconsistent"),
    )


def prompts(records: DataFrame, pipeline: int | None = None) -> DataFrame:
    """prompt (messages but the last), meta and expected_answer of records, of one pipeline if named."""
    rows = records.where(F.col("pipeline") == pipeline) if pipeline else records
    return rows.select(F.slice("messages", F.lit(1), F.greatest(F.size("messages") - 1, F.lit(0))).alias("prompt"), "meta", "expected_answer")


def rendered(messages: Column, tools: Column | None = None, generate: bool = True) -> Column:
    """Prompt text: `<|role|>` lines, tools as JSON in the first one, and an open assistant line if generate."""
    body = F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), F.coalesce(m["content"], F.lit("")), F.lit("\n"))), "")
    lead = F.lit("") if tools is None else F.concat(F.lit("<|tools|>\n"), tools, F.lit("\n"))
    return F.concat(lead, body, F.lit("<|assistant|>\n" if generate else ""))


def with_tool_list(messages: Column, pipeline: Column) -> Column:
    """Messages whose first one, if it is the system's, ends in the indented tool list: for templates that take no tools."""
    def more(m: Column) -> Column:
        text = F.when(pipeline == 1, F.lit(fixed.TOOL_LISTS[1])).otherwise(F.lit(fixed.TOOL_LISTS[2]))
        return m.withField("content", F.concat(F.coalesce(m["content"], F.lit("")), text))

    return F.transform(messages, lambda m, i: F.when((i == 0) & (m["role"] == "system"), more(m)).otherwise(m))


def displayed(messages: Column) -> Column:
    """Messages that a reader sees: user's and assistant's with content, as role and content."""
    return F.transform(F.filter(messages, lambda m: m["role"].isin("user", "assistant") & (F.coalesce(m["content"], F.lit("")) != "")), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
