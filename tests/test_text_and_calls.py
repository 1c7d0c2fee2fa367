"""Answers, coordinates, templates, tool calls."""

import json

import pytest
import regex
from pyspark.sql import functions as F

from orrery import fixed
from orrery.functions import text as t
from orrery.functions import toolcalls as c
from orrery.operators import scoring


def test_answers_and_rewards(spark):
    cases = [
        ("clockwise at first, finally **counterclockwise**", "counterclockwise", 1.25),
        ("COUNTERCLOCKWISE, or neither?", "neither", 0.25),
        ("it is counter-clockwise", "clockwise", 0.25),
        ("anticlockwise", None, 0.0),
        ("clockwise_", None, 0.0),
        ("", None, 0.0),
        (None, None, 0.0),
    ]
    df = spark.createDataFrame([(i, x) for i, (x, _, _) in enumerate(cases)], "i int, x string")
    a = t.extract_answer(F.col("x"))
    got = df.select(a.alias("a"), scoring.reward(a, F.lit("counterclockwise")).alias("r"), t.extract_answer(F.col("x"), strict=True).alias("s")).collect()
    assert [(r.a, r.r) for r in got] == [(a, r) for _, a, r in cases]
    assert got[2].s == "counterclockwise"


def test_coordinates(spark):
    cases = [
        ("[[1, 2], [3, 4, 5]]", [[1, 2], [3, 4]], None),
        ("[1, 2]", [[1, 2]], None),
        ("1, 2; 3 4", [[1, 2], [3, 4]], None),
        ("1 2\n3,4", [[1, 2], [3, 4]], None),
        ("1 2 3", None, "not a pair"),
        ("a b", None, "not a number"),
        ("  ", None, "empty"),
        (None, None, "empty"),
        (";;", None, "no pairs"),
        ("[[1]]", None, "not a pair"),
        ("-1.5e3 ,\t0.25 ;\n 3 4", [[-1500, 0.25], [3, 4]], None),
        ("1, 2;3, 4\n5, 6", [[1, 2], [3, 4], [5, 6]], None),
        ("1 2;", [[1, 2]], None),
        (".5 +6; 007 1.", [[0.5, 6], [7, 1]], None),
        ("1\n2", None, "not a pair"),
        ("1 2; 3 x", None, "not a number: 3 x"),
        ("1 2;" * 20_000, [[1, 2]] * 20_000, None),
    ]
    df = spark.createDataFrame([(i, x) for i, (x, _, _) in enumerate(cases)], "i int, x string")
    got = df.orderBy("i").select(t.parse_coords(F.col("x")).alias("p")).collect()
    for r, (x, coords, error) in zip(got, cases, strict=True):
        assert r.p.coords == coords, x
        assert (r.p.error or "").startswith(error or ""), x


def test_templates_do_not_scan_arguments(spark):
    got = spark.range(1).select(t.fill_template(F.lit("From {} to {}, {}?"), F.array(F.lit("{}"), F.lit("B"), F.lit(None))).alias("s")).first().s
    assert got == "From {} to B, ?"


CALLS = [
    ('hi <tool_call>{"name":"geocode","arguments":{"place_names":["A}"]}}</tool_call> bye', [("geocode", {"place_names": ["A}"]})], "hi  bye"),
    ('<tool_call>{"name":"f","parameters":{"k":1}}</tool_call>', [("f", {"k": 1})], ""),
    ('<tool_call>{"name":"f","arguments":"{\\"k\\":1}"}</tool_call>', [("f", {"k": 1})], ""),
    ('<tool_call>{"name":"f","arguments":"oops"}</tool_call>', [("f", {})], ""),
    ('<tool_call>{"x":1}</tool_call>', [], '<tool_call>{"x":1}</tool_call>'),
    ('<tool_call>{"name":"f"', [], '<tool_call>{"name":"f"'),
    ("<tool_call> none here", [], "<tool_call> none here"),
    ('a <tool_call>{"name":"f"}</tool_call> b <tool_call>\n{"name":"g"}\n</tool_call>', [("f", {}), ("g", {})], "a  b"),
]


def test_calls(spark):
    df = spark.createDataFrame([(i, x) for i, (x, _, _) in enumerate(CALLS)], "i int, x string")
    got = df.orderBy("i").select(c.extract_calls(F.col("x")).alias("g")).collect()
    for r, (x, calls, narration) in zip(got, CALLS, strict=True):
        assert [(k["name"], json.loads(k["arguments"])) for k in r.g.calls] == calls, x
        assert r.g.narration == narration


def test_markers():
    def render(messages):
        out = ""
        for m in messages:
            out += f"<{m['role']}>{m['content']}"
            for call in m.get("tool_calls", []):
                out += f"\n[CALL]{json.dumps(call['function'])}[END]"
            out += "</>"
        return out

    assert c.markers(render) == ("[CALL]", "[END]")
    assert c.markers(lambda m: "same") is None


def test_dispatch_and_registry(spark):
    args = json.dumps({"center": [0, 0], "point_b": [1, 0], "point_c": [0, 1]})
    df = spark.createDataFrame([("cyclic_order", args), ("cyclic_order", "{}"), ("fly", args)], "name string, arguments string")
    assert [json.loads(r.result) for r in c.call_results(df).collect()] == [{"result": "counterclockwise"}, {"error": "bad arguments: center is missing"}, {"error": "unknown tool fly"}]
    c.register(spark)
    assert spark.sql("select cyclic_order(0, 0, 0, 1, 1, 0) as a").first().a == "clockwise"


def test_tool_schemas_are_json():
    assert [x["function"]["name"] for x in json.loads(fixed.TOOLS[2])] == ["geocode", "cyclic_order"]


@pytest.mark.parametrize(("text", "end"), [("{}", 2), ('{"a":"}"}x', 9), ('{"a":"\\"}"}', 11), ("{", -1), ('{"a', -1), ("{" * 200 + "}" * 200 + "}", 400), ("{" * 50 + "}" * 49, -1)])
def test_braces(text, end):
    found = regex.match(c.OBJECT, text, regex.DOTALL)
    assert (found.end() if found else -1) == end


@pytest.mark.parametrize(
    ("text", "names", "narration"),
    [
        ('<tool_call>{"name":"f"} and so on', ["f"], "and so on"),
        ('<tool_call>{"name":"f"}' + " " * 31 + "</tool_call>.", ["f"], "."),
        ('<tool_call>{"name":"f"}' + "x" * 32 + "</tool_call>.", ["f"], "x" * 32 + "</tool_call>."),
        ('<tool_call>{bad}</tool_call> <tool_call>{"name":"g"}</tool_call>', ["g"], "<tool_call>{bad}</tool_call>"),
        ('<tool_call>{"name":3}</tool_call><tool_call>{"name":"g"}</tool_call>', ["g"], '<tool_call>{"name":3}</tool_call>'),
        ('<tool_call>{"name":"f" <tool_call>{"name":"g"}</tool_call>', [], '<tool_call>{"name":"f" <tool_call>{"name":"g"}</tool_call>'),
        ('<tool_call>\t{"name":"f","arguments":[1]}\n</tool_call>', ["f"], ""),
        ('<tool_call>[{"name":"f"}]</tool_call>', [], '<tool_call>[{"name":"f"}]</tool_call>'),
        ('{"name":"f"}', [], '{"name":"f"}'),
        ("", [], ""),
    ],
)
def test_odd_calls(text, names, narration):
    calls, rest = c.extract(text)
    assert [k["name"] for k in calls] == names and rest == narration
    assert all(k["arguments"] == "{}" for k in calls)


def test_other_markers():
    assert c.extract('a [C]{"name":"f"}[/C]', " [C]\n", "[/C]") == ([{"name": "f", "arguments": "{}"}], "a")
    assert c.extract('a [C]{"name":"f"} b', "[C]", "") == ([{"name": "f", "arguments": "{}"}], "a  b")


def test_call_tables(spark):
    """Calls as rows by LATERAL and batch by batch, nulls and texts without calls included."""
    rows = [(i, x) for i, (x, _, _) in enumerate(CALLS)] + [(100, None), (None, CALLS[0][0]), (7, CALLS[7][0])]
    c.register(spark)
    spark.createDataFrame(rows, "i long, x string").repartition(3).createOrReplaceTempView("texts_of_calls")
    want = sorted((str(i), k, *call, narration) for i, x in rows for k, call, narration in [(k, (call["name"], call["arguments"]), c.extract(x or "")[1]) for k, call in enumerate(c.extract(x or "")[0])])
    lateral = spark.sql("select i, t.* from texts_of_calls, lateral tool_calls(x) t").collect()
    batches = spark.sql("select * from tool_call_rows(table(select i, x from texts_of_calls))").collect()
    for got in (lateral, batches):
        assert sorted((str(r[0]), *r[1:]) for r in got) == want


VIOLATIONS = [
    ("geocode", '{"place_names": []}', None),
    ("geocode", '{"place_names": ["a", 1]}', "place_names holds an item that is no string"),
    ("geocode", '{"place_names": null}', "place_names is missing"),
    ("geocode", None, "arguments are no object"),
    ("cyclic_order", '{"center": [1, 2.5], "point_b": [1e300, 0], "point_c": [-1, 12345678901234567890]}', None),
    ("cyclic_order", '{"center": [1, null], "point_b": [1, 0], "point_c": [1, 0]}', "center holds an item that is no number"),
    ("cyclic_order", '{"center": [1, 2], "point_b": [], "point_c": [1, 0]}', "point_b has fewer than 2 items"),
    ("cyclic_order", '{"center": {"x": 1}, "point_b": [1, 0], "point_c": [1, 0]}', "center is no array"),
]


def test_schema_violations(spark):
    df = spark.createDataFrame([(i, a) for i, (_, a, _) in enumerate(VIOLATIONS)], "i int, a string")
    for tool, schema in c.SCHEMAS.items():
        got = {r.i: r.v for r in df.select("i", c.violation(F.col("a"), schema).alias("v")).collect()}
        assert {i: got[i] for i, (name, _, _) in enumerate(VIOLATIONS) if name == tool} == {i: v for i, (name, _, v) in enumerate(VIOLATIONS) if name == tool}
    other = {"properties": {"n": {"type": "integer"}, "s": {"type": "string"}}, "required": ["n"]}
    some = [('{"n": 1}', None), ('{"n": 1.5}', "n is no integer"), ('{"n": 1, "s": 2}', "s is no string"), ("{}", "n is missing")]
    got = spark.createDataFrame(some, "a string, want string").select("want", c.violation(F.col("a"), other).alias("v")).collect()
    assert [r.v for r in got] == [r.want for r in got]


def test_geocode_in_sql(spark):
    points = spark.createDataFrame([("Ab", 1, 1.0, 2.0, None), ("aB", 0, 3.0, 4.0, None), ("C", 2, None, None, "no coordinates")], "name string, seq long, longitude double, latitude double, error string")
    c.register(spark, points)
    got = spark.sql("select position, name, longitude, error from geocode(array('Ab', 'AB', 'c', 'x', 'Ab', null))").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(0, "Ab", 1.0, None), (1, "AB", 3.0, None), (2, "c", None, "no coordinates"), (3, "x", None, "unknown place x"), (4, None, None, None)], key=str)
