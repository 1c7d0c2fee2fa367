"""op6, op7, op8 and the pipeline."""

import hashlib
import json
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orrery.llm import chat, decontam, secrets

from .conftest import prose

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def base_spans(text):
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    order = ("assign", "access", "hex")
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda s: (s[1], order.index(s[0]))))


def test_base_spans(spark, docs, none):
    rng = random.Random(3)
    bits = ["password", "Token", "api_key", "APIKEY", "secret", '"', "'", " ", "  ", ":", "=", "é", "\U0001F600", "abcdef12", "AKIA", "AKIAABCDEFGH1234", "0123456789abcdef", "f" * 20, "\n", "x", "A/b+c=", "\t"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(400)] + [(500, None)]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "kind": F.lit("k")})).collect()
    assert len(got) == len(rows)
    by = dict(rows)
    for r in got:
        want = base_spans(by[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), by[r.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(want.count(k + ":") for k in ("assign", "access", "hex"))
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
    assert secrets.scan(docs).count() == docs.count() and secrets.scan(none).count() == 0


def test_weak_parts_need_their_complement(spark):
    blob, host = "Zz9/" * 10, "https://db.example.org:8443/x"
    cases = [
        (f"id AKIAABCDEFGH12345 and {blob} at {host}", {"access", "blob", "endpoint"}),
        (f"id AKIAABCDEFGH12345 {'w ' * 200} {blob}", {"access"}),
        (f"only {blob} at {host}", set()),
        ("ASIAABCDEFGH12345 password=abcdefgh1", {"keyid", "assign"}),
        ("ASIAABCDEFGH12345 alone", set()),
        (f"AKIAABCDEFGH12345 {host}", {"access"}),
    ]
    got = secrets.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string"))
    for r in got.collect():
        text, kinds = cases[r.doc_id]
        parts = [s.split(":") for s in r.spans.split(",") if s]
        assert {k for k, _, _ in parts} == kinds
        assert all(text[int(a) : int(b)] for _, a, b in parts)


CONVERSATIONS = [
    (1, 0, "user", "hi <|im_end|>\n [INST] ␛A ␛"),
    (1, 1, "assistant", "</s>[INST] ok [/INST]<|im_end|"),
    (1, 2, "assistant", ""),
    (2, 0, "system", None),
    (2, 1, None, "x"),
    (2, 1, "assistant", "a\nb"),
    (2, 1, "assistant", "a\nb"),
    (3, None, "odd\nrole<s>", "é\U0001F600"),
    (None, 0, "human", "z"),
]


def test_round_trip(spark):
    rows = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string").withColumns({"formatted": F.lit(1), "turns": F.lit(2), "t": F.lit(0)})
    done = chat.format_turn_rows(rows)
    got = {r.conv_id: r for r in chat.digest(done).collect()}
    raw = {r.conv_id: r.formatted for r in done.collect()}
    for conv in (1, 2, 3, None):
        turns = sorted(((t, r or "", x or "") for c, t, r, x in CONVERSATIONS if c == conv), key=lambda z: (z[0] is not None, *z[:1], *z[1:]) if z[0] is not None else (False,))
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        said = "".join(x for _, r, x in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert r.formatted_chars == len(raw[conv]) and raw[conv].count("<|im_end|>\n") == len(turns)
    assert chat.format_turn_rows(rows.limit(0)).count() == 0
    with pytest.raises(ValueError, match="layout"):
        chat.format_turn_rows(rows.drop("role"))


def test_layouts(spark):
    records = [
        ({"prompt": "p", "completion": "c", "id": 3}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
        ({"instruction": "i", "input": "n", "output": "o"}, "instruction_input", [("user", "i"), ("user", "n"), ("assistant", "o")]),
        ({"output": "o", "instruction": None}, "instruction", [("assistant", "o")]),
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, "messages", [("user", "a"), ("assistant", "")]),
        ({"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, "conversations", [("user", "h"), ("assistant", "g")]),
        ({"question": "q", "answer": "a"}, "question_answer", [("user", "q"), ("assistant", "a")]),
        ({"what": 1}, None, []),
        ({"messages": [{"role": "user"}, {"content": "b", "tool_calls": [{"id": 1}]}, {"role": "assistant", "content": "c"}], "prompt": "p", "system": "s"}, "messages", [("user", ""), ("", "b"), ("assistant", "c")]),
        ({"system": "s", "instruction": "i", "input": "n", "output": "o", "answer": "a"}, "system_instruction_input", [("system", "s"), ("user", "i"), ("user", "n"), ("assistant", "o")]),
        ({"system": "s", "prompt": "p", "response": "r"}, "system_prompt_response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ({"dialogue": {"id": 1, "turns": [{"speaker": {"role": "bot"}, "text": "x"}, {"speaker": None, "text": "y"}]}}, "dialogue_turns", [("assistant", "x"), ("", "y")]),
        ({"dialogue": {"turns": "none"}}, None, []),
        ({"messages": []}, None, []),
    ]
    rows = [(i, json.dumps(j)) for i, (j, _, _) in enumerate(records)] + [(90, None), (91, "{"), (92, "")]
    got = {r.conv_id: (r.layout, [(t.role, t.text) for t in r.turns]) for r in chat.turns_of_json(spark.createDataFrame(rows, "k long, j string"), "j", "k").collect()}
    for i, (_, layout, turns) in enumerate(records):
        assert got[i] == (layout, turns)
    assert got[90] == got[91] == got[92] == (None, [])


def test_row_layouts(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "b", "x"), (1, 0, "user", "a", "y")], "conversation_id long, position int, role string, content string, prompt string")
    got = chat.turns_of_rows(rows).collect()
    assert [(r.conv_id, r.layout, [tuple(t) for t in r.turns]) for r in got] == [(1, "message_rows", [("user", "a"), ("assistant", "b")])]


def test_many_turns_and_spans_in_one_text(spark):
    """Time grows about as the number of turns and spans, not as its square."""
    n = 20_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    got = chat.digest(chat.format_turn_rows(rows)).first()
    said = "".join(f"t{i}" for i in range(1, n, 2))
    assert got.n_turns == n and (got.loss_chars, got.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    text = " ".join(f"token=abcdef{i:05d}" for i in range(n))
    r = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    want = ",".join(f"assign:{18 * i}:{18 * i + 17}" for i in range(n))
    assert r.n_assign == n and r.spans == want


def test_time_grows_as_the_number_of_spans(spark):
    """Links, too: twice the weak parts of a text take less than three times the time."""

    def seconds(n):
        df = spark.createDataFrame([(1, " ".join(f"ASIA{i:012d}X https://h{i}.io secret=abcdefgh{i}" for i in range(n)))], "doc_id long, text string")
        took = []
        for _ in range(3):
            began = time.perf_counter()
            assert secrets.scan(df).first().n_assign == n
            took.append(time.perf_counter() - began)
        return min(took)

    seconds(7_000)
    few, many = seconds(7_000), seconds(14_000)
    assert many < 3 * few


def test_scope_is_a_gap(spark):
    long = "password=" + "Zz9." * 200
    cases = [(long + " ASIAABCDEFGH12345", 2), ("ASIAABCDEFGH12345 " + long, 2), (long + " " * 256 + "ASIAABCDEFGH12345", 2), (long + " " * 257 + "ASIAABCDEFGH12345", 1), ("secret=x" + long + "/ASIAABCDEFGH12345" + "z" * 600, 2)]
    got = secrets.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string"))
    assert {r.doc_id: len(r.spans.split(",")) for r in got.collect()} == {i: n for i, (_, n) in enumerate(cases)}


def edits(item, text, anywhere=True):
    row = [0 if anywhere else j for j in range(len(text) + 1)]
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row) if anywhere else row[-1]


def test_leaks(spark, docs, none):
    rng = random.Random(9)
    items = [(i, prose(3000 + i, 14)) for i in range(12)] + [(20, None), (21, ""), (22, "short"), (None, prose(5000, 14)), (3, prose(3003, 14))]
    rows = []
    for i in range(60):
        t = items[i % 12][1]
        for _ in range(rng.choice([0, 0, 1, 3, 5, 9])):
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice(["", "q", t[k] + "z"]) + t[k + 1 :]
        rows.append((i, prose(i, 30) + ("\n  " if i % 2 else " ") + (t.upper() if i % 3 else t) + " " + prose(i + 700, 30)))
    rows += [(100, prose(100, 50)), (None, items[0][1]), (101, items[1][1] + " and " + items[1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"item_id": F.lit(1), "start": F.lit(2)})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    norm = lambda t: " ".join(t.lower().split()).encode()
    want = {(str(d), str(i)) for d, t in rows for i, x in items if x and edits(norm(x), norm(t)) <= int(0.05 * len(norm(x)))}
    got = decontam.find_leaks(df, bench).collect()
    assert {(str(r.doc_id), str(r.item_id)) for r in got} == want
    texts = {str(d): norm(t) for d, t in rows}
    for r in got:
        by = {str(i): norm(x or "") for i, x in items}
        assert edits(by[str(r.item_id)], texts[str(r.doc_id)][r.start : r.end]) == r.edits
    assert sum(r.doc_id == 101 and r.item_id == 1 for r in got) == 2
    kept = decontam.decontaminate(df, bench)
    assert kept.columns == df.columns and {str(r.doc_id) for r in kept.collect()} == {str(d) for d, _ in rows} - {d for d, _ in want}
    assert decontam.decontaminate(docs, bench).count() == docs.count()
    for b in (bench.limit(0), bench):
        assert decontam.find_leaks(none, b).count() == 0
    assert decontam.find_leaks(df, bench.limit(0)).count() == 0


def test_band_against_whole_table():
    rng = random.Random(12)
    for _ in range(300):
        item = bytes(rng.choice(b"abc ") for _ in range(rng.randint(1, 24)))
        text = bytearray(bytes(rng.choice(b"abc ") for _ in range(rng.randint(0, 12))) + item + bytes(rng.choice(b"abc ") for _ in range(rng.randint(0, 12))))
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(text) + 1)
            text[k : k + rng.randint(0, 1)] = rng.choice([b"", b"x", b"ab"])
        a, b = np.frombuffer(item, np.uint8), np.frombuffer(bytes(text), np.uint8)
        for budget in (0, 2, 6):
            want = edits(item, bytes(text))
            got, end = decontam.align(a, b, budget, -len(item) - 1, len(text) + 1, True)
            assert got == min(want, budget + 1)
            if want <= budget:
                back, start = decontam.align(a[::-1], b[:end][::-1], budget, -budget, budget, False)
                part = bytes(text)[end - start : end]
                assert back == want == edits(item, part, False)


def test_short_items(spark):
    """Items whose edits leave no gram of the common length, and those too short for any gram."""
    items = [(1, "abcdefghij klmnopqrst"), (2, "zebra cow"), (3, "yak"), (4, "q"), (5, "twelve bytes"), (6, "twentythree bytes long!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [
        (0, "x abcdefghijXklmnopqrst y"), (1, "abcdefghij klmnpqrst"), (2, "abcdeXfghij klmnopqrsXt"), (3, "a zebra  COW."), (4, "a Zebra cow b zebra cow"), (5, "kayak yaks"), (6, "the yak."),
        (7, "yak"), (8, "q q"), (9, "qu"), (10, "TWELVE\nbytes"), (11, "twelve byte"), (12, "twentythree bytes long"), (13, "twenty three bytes lon!"),
    ]
    got = {(r.doc_id, r.item_id, r.edits) for r in decontam.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(0, 1, 1), (1, 1, 1), (3, 2, 0), (4, 2, 0), (6, 3, 0), (7, 3, 0), (8, 4, 0), (10, 5, 0), (12, 6, 1)}


def test_blocks_of_the_benchmark(spark):
    items = [(i, prose(3000 + i, 3000)) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(7, "x " + items[7][1]), (8, "y")], "doc_id long, text string")
    got = decontam.find_leaks(df, bench, block_mb=1).collect()
    assert [(r.doc_id, r.item_id, r.start, r.edits) for r in got] == [(7, 7, 2, 0)]


def test_stages(spark, docs, none, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(0, prose(2, 30))], "item_id long, text string")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (docs, none):
        now = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, str(tmp_path))
            assert k == 4 or out.columns == docs.columns
            out.write.mode("overwrite").parquet(path := str(tmp_path / f"{k}-{start is none}"))
            now = spark.read.parquet(path)
        if start is docs:
            ids = {r.doc_id for r in now.collect()}
            assert 1 in ids or None in ids
            assert 4 not in ids and 8 in ids
        else:
            assert now.count() == 0


def test_run(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert "sequence_id" in got.columns and got.count() > 0
