"""Records, scoring, store, monitor, generator, sources and streams."""

import json
import time

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery import fixed
from orrery.functions.geometry import path_label, representative_points
from orrery.operators import dialogue, generate, monitor, records, scoring, store
from orrery.plans.oracle import ORACLE
from orrery.plans.queries import QUERIES
from orrery.schemas import QUESTION, SAMPLE, STORED, require_columns
from orrery.sources import io
from orrery.streaming import peaks, progress, tokens


def point(x, y):
    return {"coordinates": [[float(x), float(y)]], "type": "point"}


@pytest.fixture(scope="module")
def questions(spark):
    rows = [
        (0, "q0", ["A", "B", "C"], [point(0, 0), point(1, 0), point(0, 1)], "  CounterClockwise\n"),
        (1, "q1", ["A", "B", "A", "D"], [point(0, 0), point(1, 0), point(0, 1.005), point(1, 1)], "clockwise"),
        (2, "short", ["A", "B"], [point(0, 0), point(1, 0)], "neither"),
        (3, "names", ["A", "B", "C"], [point(0, 0), point(1, 0), point(0, 1), point(1, 1)], "neither"),
        (4, "none", None, None, None),
    ]
    return spark.createDataFrame(rows, QUESTION)


def test_audit(questions):
    assert records.audit(questions).first().asDict() == {"total": 5, "malformed": 3, "mislabelled": 1, "disagreements": 2, "inconsistent": 5}


def test_conversations(questions):
    got = {(r.question_id, r.pipeline): r for r in records.conversations(questions).collect()}
    assert set(got) == {(0, 1), (0, 2), (1, 1), (1, 2)}
    assert [len(got[k].messages) for k in ((0, 1), (0, 2), (1, 1), (1, 2))] == [5, 7, 5, 9]
    r = got[1, 1]
    assert (r.expected_answer, r.derived) == ("clockwise", "neither")
    assert json.loads(r.messages[3].content) == {"A": {"longitude": 0.0, "latitude": 1.005}, "B": {"longitude": 1.0, "latitude": 0.0}, "D": {"longitude": 1.0, "latitude": 1.0}}
    lines = r.messages[4].content.split("\n")
    assert lines[0] == "Let me compute this from the coordinates." and lines[2] == "Center (A): A at (0.00, 0.00)"
    assert lines[4] == "Waypoint B2: A at (0.00, 1.00)"
    assert lines[7] == "Arc B1→B2 (B → A): vector A→B1 = (1.00, 0.00), vector A→B2 = (0.00, 1.00), cross = (1.00)(1.00) - (0.00)(0.00) = 1.00 → counterclockwise."
    assert lines[-1] == "All 2 arcs combined: the path is **neither**."
    m = got[1, 2].messages
    assert [x.role for x in m] == ["system", "user", "assistant", "tool", "assistant", "tool", "assistant", "tool", "assistant"]
    assert m[4].content == "I have the coordinates. Let me check the arc from B to A around A."
    assert m[6].content == "Now checking the arc from A to D around A."
    assert json.loads(m[6].tool_calls[0].function.arguments) == {"center": [0.0, 0.0], "point_b": [0.0, 1.005], "point_c": [1.0, 1.0]}
    assert m[-1].content == "The 2 pairwise arcs around A are: counterclockwise, clockwise. Since they disagree, the overall path is **neither**."
    assert got[0, 2].messages[0].content == fixed.SYSTEM_BASE + fixed.SYSTEM_TOOL
    assert len(json.loads(got[0, 1].tools)) == 1


def test_messages_round_ties_as_sql(spark, tmp_path):
    """Coordinates half-way between two numbers of six places, as odd multiples of 1/128 are: every message is that of the query's SQL."""
    path = f"{tmp_path}/embeddings.parquet"
    duckdb.sql(f"COPY (SELECT v AS vec_id, list_transform(range(64), lambda i: ((v * 64 + i) * 37 % 4001 - 2000) / 128)::FLOAT[] AS embedding FROM range(60) t(v)) TO '{path}'")
    columns = "question_id, pipeline, pos, role, content, name, call_name, call_arguments"
    got = [tuple(r) for r in QUERIES["record_messages"](spark, str(tmp_path)).select(*columns.split(", ")).collect()]
    sql = duckdb.sql(f"WITH embeddings AS (SELECT * FROM '{path}') SELECT {columns} FROM ({ORACLE['record_messages']})").fetchall()
    assert len(got) == len(sql) > 900 and sorted(got, key=lambda r: r[:3]) == sorted(sql, key=lambda r: r[:3])


def test_prompts_and_display(questions):
    made = records.conversations(questions)
    assert {len(r.prompt) for r in records.prompts(made, 1).collect()} == {4}
    shown = made.where("question_id = 0 and pipeline = 2").select(records.displayed(F.col("messages")).alias("m")).first().m
    assert [x.role for x in shown] == ["user", "assistant", "assistant"]


def test_json_lines_leave_out_absent_parts(spark, questions, tmp_path):
    io.write_jsonl(records.conversations(questions).drop("derived"), str(tmp_path / "out"), ["question_id", "pipeline"])
    lines = [json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()]
    assert len(lines) == 4 and "content" not in lines[0]["messages"][2] and "name" not in lines[0]["messages"][0]
    assert io.read_jsonl(spark, str(tmp_path / "out")).count() == 4


def test_broken_json_lines_fail(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"question_id": 1}\n\n{"quest')
    with pytest.raises(Exception, match="Malformed|MALFORMED|FAILFAST"):
        io.read_jsonl(spark, str(tmp_path / "a.json")).collect()


def test_required_columns(spark):
    with pytest.raises(ValueError, match=r"\['answer'\]"):
        require_columns(spark.range(1), {"id", "answer"})


def test_truth(spark):
    shapes = [point(0, 0), point(1, 0), point(0, 1)]
    df = spark.createDataFrame([(1, "unknown", shapes), (2, " Neither\n", shapes), (3, None, shapes)], "i int, a string, g array<struct<coordinates:array<array<double>>,type:string>>")
    assert [r.t for r in df.orderBy("i").select(scoring.ground_truth(F.col("a"), F.col("g")).alias("t")).collect()] == ["counterclockwise", "neither", "counterclockwise"]
    with pytest.raises(Exception, match="three geometries"):
        df.select(scoring.ground_truth(F.lit(None).cast("string"), F.slice("g", 1, 2))).collect()


def test_judging_joins_by_key(spark, questions):
    made = records.conversations(questions).withColumn("split", F.lit("val"))
    said = spark.createDataFrame([("val", 0, 1, "so: counterclockwise"), ("val", 1, 2, "hm"), ("other", 0, 1, "clockwise")], "split string, question_id long, pipeline int, completion string")
    got = {(r.question_id, r.pipeline): (r.truth, r.predicted, r.reward, r.n) for r in scoring.judged(made, said).collect()}
    assert got == {(0, 1): ("counterclockwise", "counterclockwise", 1.25, 3), (1, 2): ("clockwise", None, 0.0, 4)}


def test_scorecard_has_all_classes(spark):
    df = spark.createDataFrame([("clockwise", "clockwise", 3), ("clockwise", None, 4)], "truth string, predicted string, n long")
    card = scoring.scorecard(df)
    got = {(r.level, r.key): (r.total, r.correct, r.failures, r.accuracy) for r in card.collect()}
    assert got["all", ""] == (2, 1, 1, 0.5) and got["class", "neither"] == (0, 0, 0, None) and got["n", "4"] == (1, 0, 1, 0.0)
    text = scoring.report(card)
    assert "1/2 = 50.0%" in text and "0/0 (no examples)" in text
    empty = {(r.level, r.key): r.total for r in scoring.scorecard(df.limit(0)).collect()}
    assert empty["all", ""] == 0 and len(empty) == 4


def test_running_counts_cross_spans(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3 == 0).alias("right"))
    got = scoring.running(df, "id", F.col("right")).orderBy("total").collect()
    assert [r.total for r in got] == list(range(80, 1001, 80))
    assert all(r.correct == -(-r.total // 3) for r in got)


@pytest.fixture(scope="module")
def held(spark):
    c = [[1.0, 2.0]]
    return spark.createDataFrame([("Paris", 0, "point", c), ("PARIS", 1, "point", [[3.0, 4.0]]), ("Rome", 2, "point", [[5.0, 6.0]])], STORED)


def test_lookup(spark, held):
    df = spark.createDataFrame([("Paris",), ("PARIS",), ("paris",), ("Oslo",)], "wanted string")
    assert {r.wanted: r.found for r in store.lookup(df, held).collect()} == {"Paris": "Paris", "PARIS": "PARIS", "paris": "Paris", "Oslo": None}
    got = {r.wanted: (r.longitude, r.error) for r in store.geocoded(df, held).collect()}
    assert got["PARIS"] == (3.0, None) and got["Oslo"] == (None, "unknown place Oslo")


def test_additions(spark, held):
    c1, c2 = [[0.0, 0.0]], [[0.0, 0.0], [1.0, 1.0]]
    new = spark.createDataFrame([(" Bern ", 10, "auto", c1), ("Bern", 11, "auto", c2), ("Rome", 12, "auto", c1), (" ", 13, "auto", c1), ("x", 14, "blob", c1), ("y", 15, "polygon", c2), ("z", 16, "point", c2), ("w", 17, "line", c1)], STORED)
    got = {r.seq: (r.type, r.error) for r in store.checked(new, held).collect()}
    assert got[10] == ("point", None) and got[11] == ("line", "name is taken") and got[12][1] == "name is taken" and got[13][1] == "name is empty"
    assert [got[k][1] for k in (14, 15, 16, 17)] == ["unknown type", "a polygon has three pairs at least", "a point has one pair", "a line has two pairs at least"]
    assert store.added(held, new).count() == 4
    assert store.removed(held, "Rome").count() == 2
    with pytest.raises(ValueError, match="Oslo"):
        store.removed(held, "Oslo")


def test_store_file(spark, tmp_path):
    path = tmp_path / "store.json"
    assert io.read_store(spark, str(path)).count() == 0
    path.write_text('{"B": {"type": "line", "coordinates": [[0, 0], [2, 2]]}, "A": {"type": "point", "coordinates": [[1, 1]]}}')
    rows = store.listing(io.read_store(spark, str(path))).collect()
    assert [(r.name, r.type, r.n_points, r.x) for r in rows] == [("B", "line", 2, 1.0), ("A", "point", 1, 1.0)]
    for broken in ("[1]", "{"):
        path.write_text(broken)
        assert io.read_store(spark, str(path)).count() == 0


def test_verdicts(spark):
    df = spark.createDataFrame([(0, 9000.0), (0, 10.0), (1, 2000.0), (2, 600.0)], "gpu_idx int, used_mb double")
    got = monitor.verdicts(monitor.peaks(df), 2)
    assert {r.gpu_idx: (r.mean, r.verdict) for r in got.collect()} == {0: (5500.0, "high"), 1: (5500.0, "ok"), 2: (5500.0, "unexpected")}
    assert monitor.any_issue(got).first().issue
    spare = spark.createDataFrame([(3.0,), (2.0,), (0.0,)], "g double")
    assert [r.v for r in spare.select(monitor.headroom(F.col("g")).alias("v")).collect()] == ["safe", "tight", "oom"]
    lines = spark.createDataFrame([("0, 12.5",), ("junk",), ("x, 1",)], "value string")
    assert [(r.gpu_idx, r.used_mb) for r in monitor.samples_of_lines(lines).collect()] == [(0, 12.5)]


def test_headroom_of_all_statuses(spark, tmp_path):
    """Every status of orders has a row, and so has each that is asked for, with orders or without."""
    path = f"{tmp_path}/orders.parquet"
    orders = spark.createDataFrame([("F", 9e5), ("F", 1.0), ("P", 1.0), (None, 7e5)], "o_orderstatus string, o_totalprice double")
    for rows, want in ((orders, {"F": False, "O": True, "P": True, None: False, "none": True}), (orders.limit(0), {"F": True, "O": True, "none": True})):
        rows.coalesce(1).write.parquet(path, mode="overwrite")
        got = [tuple(r) for r in QUERIES["headroom_all"](spark, str(tmp_path)).select("status", "safe").collect()]
        sql = duckdb.sql(f"WITH orders AS (SELECT * FROM '{path}/*.parquet') SELECT status, safe FROM ({ORACLE['headroom_all']})").fetchall()
        assert len(got) == len(sql) == len(want) and dict(got) == dict(sql) == want


def test_streams(spark, tmp_path):
    rows = [(None, k % 3, float(k)) for k in range(30)]
    df = spark.createDataFrame(rows, SAMPLE).withColumn("ts", F.timestamp_seconds(F.col("used_mb") * 10))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = peaks.read_stream(spark, str(tmp_path / "in"), df.schema)
    got = {r.gpu_idx: r.peak for r in peaks.drain(peaks.running_peaks(stream, "gpu_idx", "used_mb"), "peaks_test").collect()}
    assert got == {r.gpu_idx: r.peak for r in monitor.peaks(df).collect()}
    wide = peaks.drain(peaks.windowed_peaks(peaks.read_stream(spark, str(tmp_path / "in"), df.schema), "gpu_idx", "used_mb"), "windows_test")
    assert wide.agg(F.max("peak")).first()[0] == 29.0
    sink = str(tmp_path / "metrics")
    for _ in range(2):  # the second time from the start again
        peaks.each_batch(stream, lambda d, i: io.append_metrics(d.groupBy().count(), sink, "run", i), str(tmp_path / f"cp{_}")).awaitTermination()
        assert io.read_metrics(spark, sink, "count long").agg(F.sum("count")).first()[0] == 30
    io.append_metrics(spark.createDataFrame([], "count long"), sink, "run", 0)
    assert io.read_metrics(spark, sink, "count long").where("batch = 0").isEmpty()


@pytest.fixture(scope="module")
def made(spark):
    names = spark.range(500).select(F.concat(F.lit("N"), F.col("id").cast("string")).alias("name"))
    grid = generate.balanced_grid(spark, 12, 6)
    return generate.questions(grid, names, generate.default_templates(spark)).cache(), names


def test_balanced_questions(made):
    rows = made[0].withColumn("derived", path_label(representative_points(F.col("geometries")))).collect()
    assert len(rows) == 12 + 3 * 12 and sorted(r.question_id for r in rows) == list(range(48))
    assert all(r.answer == r.derived for r in rows)
    assert all(len(set(r.location_names)) == len(r.geometries) for r in rows)
    assert all(name in r.question for r in rows for name in r.location_names)
    assert not [r for r in rows if len(r.geometries) == 3 and r.answer == "neither"]


def test_generator_is_stable_under_repartition(spark, made):
    rows, names = made
    again = generate.questions(generate.balanced_grid(spark, 12, 6).repartition(7), names, generate.default_templates(spark))
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))


def test_natural_questions_and_audit(spark, made):
    rows = generate.questions(generate.natural_grid(spark, 5, 5), made[1], generate.default_templates(spark), seed=9)
    got = rows.withColumn("derived", path_label(representative_points(F.col("geometries")))).collect()
    assert len(got) == 15 and all(r.answer == r.derived for r in got)
    types = {(r.answer, r.type) for r in generate.type_audit(made[0]).collect()}
    assert ("clockwise", "line") not in types


def test_templates_file(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"3": [["From {} to {} at {}", [1, 2, 0]]], "4": [["x {}{}{}{}{}", [0, 1, 2, 2, 3]]]}')
    got = generate.templates_of_json(spark, str(tmp_path / "t.json")).orderBy("n").collect()
    assert [(r.n, r.template_id, r.ord) for r in got] == [(3, 0, [1, 2, 0]), (4, 0, [0, 1, 2, 2, 3])]


def test_splits(spark, made, tmp_path):
    for split in ("train", "val"):
        made[0].where("question_id < 6").write.parquet(str(tmp_path / split))
    io.build_splits(spark, {s: str(tmp_path / s) for s in ("train", "val")}, str(tmp_path / "out"))
    got = spark.read.json(str(tmp_path / "out")).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 12, "val": 12}


def test_csv_names(spark, tmp_path):
    (tmp_path / "n.csv").write_text("name\nA\nB\n")
    assert [r.name for r in io.read_csv(spark, str(tmp_path / "n.csv")).collect()] == ["A", "B"]


def test_live_samples(spark, tmp_path):
    """A command's lines as a stream; a command that fails gives none."""
    from orrery.sources import samples

    (tmp_path / "say").write_text("printf '0, 10\\n1, 20.5\\nbroken\\n\\n'")
    stream = samples.device_samples(spark, f"sh {tmp_path}/say", 0.01)
    assert {r.gpu_idx: r.peak for r in peaks.drain(peaks.running_peaks(stream, "gpu_idx", "used_mb"), "live").collect()} == {0: 10.0, 1: 20.5}
    assert peaks.drain(peaks.running_peaks(samples.device_samples(spark, "false"), "gpu_idx", "used_mb"), "dead").count() == 0


def test_shared_folder_must_be_named_on_clusters(monkeypatch):
    from types import SimpleNamespace

    from orrery.session import shared_dir

    conf = SimpleNamespace(get=lambda k, d=None: d, set=lambda k, v: None)
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))


def test_ordered_lines(spark, tmp_path):
    """A total order over several files, ties and nulls included; files of a size that is read in parts."""
    rows = spark.range(5000).select(F.when(F.col("id") % 97 > 0, F.col("id") * 7919 % 1000).alias("k"), F.col("id").alias("v"), F.repeat(F.lit("x"), 50).alias("t"))
    io.write_jsonl(rows.repartition(9), str(tmp_path / "out"), ["k", "v"])
    assert len(list((tmp_path / "out").glob("part-*.json"))) == 4
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = io.read_ordered_jsonl(spark, str(tmp_path / "out"), rows.schema).orderBy("line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert [r.line for r in got] == list(range(5000))
    assert [(r.k, r.v) for r in got] == sorted(((r.k, r.v) for r in rows.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    io.write_jsonl(rows.limit(0), str(tmp_path / "none"), ["k"])
    assert io.read_ordered_jsonl(spark, str(tmp_path / "none"), rows.schema).count() == 0


def test_progress_rows(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    stream = peaks.read_stream(spark, str(tmp_path / "in"), spark.range(1).schema)
    progress.with_progress(spark, str(tmp_path / "m"), lambda: peaks.drain(stream.groupBy().count(), "told"))
    rows = io.read_metrics(spark, str(tmp_path / "m"), progress.BATCH).collect()
    assert sum(r.rows for r in rows) == 10 and len({(r.run, r.batch) for r in rows}) == len(rows) and all(r.trigger_ms >= 0 for r in rows)


def test_growing_texts(spark, tmp_path):
    """Pieces early, again, after the end, with the marker in one piece, cut, or twice; threads that fall silent; null pieces."""
    tokens.rocks(spark)
    batches = [
        [("cut", 0, "he", 0), ("cut", 1, "llo <en", 0), ("mute", 0, "never", 0), ("whole", 0, "a<end>b<end>", 0), ("odd", 1, "y", 0), ("odd", None, "q", 0)],
        [("cut", 3, "late", 60), ("cut", 2, "d> more", 60), ("mute", 1, " ends", 60), ("mute", 0, "again", 60), ("odd", 0, None, 60), ("whole", 1, "c", 60), ("gap", 1, "x", 60)],
        [("clock", 0, "", 7200)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, "thread string, seq long, piece string, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s").coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
        time.sleep(0.05)
    stream = peaks.read_stream(spark, str(tmp_path / "p"), T.StructType.fromDDL("thread string, seq long, piece string, ts timestamp"))
    got = peaks.drain(tokens.growing_texts(stream, "<end>"), "grown", "update").where("thread <> 'clock'").collect()
    ended = {(r.thread, r.pieces, r.text, r.ended) for r in got if r.ended}
    assert ended == {("cut", 3, "hello <end>", "marker"), ("whole", 1, "a<end>", "marker"), ("mute", 2, "never ends", "silence"), ("odd", 2, "y", "silence"), ("gap", 0, "", "silence")}
    assert {(r.thread, r.text) for r in got if not r.ended} == {("cut", "hello <en"), ("mute", "never"), ("mute", "never ends"), ("odd", "y")}


def test_threads_are_not_lost(spark):
    """Null and repeated keys, null messages, completions that are null, missing or said twice, several calls at once."""
    def say(*content):
        return [("user", c, None, None, None) for c in content]

    threads = spark.createDataFrame([(1, say("a")), (None, say("b")), (1, say("c")), (2, None), (3, say("d")), (4, say("e"))], f"conv_id long, messages {records.MESSAGES}")
    store = spark.createDataFrame([("P", 0, "point", [[0.1234565, 2.0]])], STORED)
    call = '<tool_call>{"name":"geocode","arguments":{"place_names":["p"]}}</tool_call>'

    def model(asked):
        first = F.when(F.col("conv_id") == 3, F.lit(None)).when(F.col("conv_id") == 4, F.lit(f"x {call} y {call}")).when(F.size("messages") == 0, F.lit("empty")).otherwise(F.concat(F.lit("to "), F.get("messages", F.lit(0))["content"]))
        said = asked.where("turn = 0").select("thread", first.alias("completion"))
        return said.unionAll(said.where("completion = 'to a'").select("thread", F.lit("zz")))

    got = dialogue.tool_loop(threads, model, store, max_turns=3).collect()
    told = sorted((str(r.conv_id), r.outcome, r.turns, [m.content for m in r.messages]) for r in got)
    entry = '{"p":{"longitude":0.123456,"latitude":2.0}}'
    assert told == [
        ("1", "answered", 1, ["a", "to a"]),
        ("1", "answered", 1, ["c", "to c"]),
        ("2", "answered", 1, ["empty"]),
        ("3", "no completion", 1, ["d"]),
        ("4", "no completion", 2, ["e", "x  y", entry, entry]),
        ("None", "answered", 1, ["b", "to b"]),
    ]
