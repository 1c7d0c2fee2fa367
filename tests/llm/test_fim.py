"""op13: against a loop over code points, and exact round trips."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.llm import fim


def brute(doc_id, text, rate=90, spm=20):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    p, m, s = text[:i], text[i:j], text[j:]
    if h[3] % 100 < spm:
        return doc_id, n, "spm", i, j - i, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", i, j - i, f"<P>{p}<S>{s}<M>{m}"


def told(rows):
    return sorted(map(repr, rows))


def test_code_points_and_round_trip(spark, docs):
    extra = spark.createDataFrame([(100 + k, t) for k, t in enumerate(["<P>", "a<S>b", "<M", "x<", "<<<", "S>P>", "\U0001f600\U0001f601é‍", "﻿a", "a\x00b"] * 30)], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(extra).withColumns({"n": F.lit(1), "form": F.lit("x"), "h1": F.lit(2), "output": F.lit(3)})
    made = fim.transform(every, unit="codepoint")
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect()]
    assert told(got) == told(brute(r.doc_id, r.text) for r in every.collect())
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = fim.digest(made).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert told((r.doc_id, r.restored_sha256) for r in back) == told((r.doc_id, sha(r.text or "")) for r in every.collect())
    assert told((r.doc_id, r.output_sha256) for r in back) == told((r[0], sha(r[5])) for r in got)


def test_cuts_stand_between_classes(spark, docs):
    made = fim.transform(docs, unit="class").join(docs.select("doc_id", "text").where("doc_id is not null").distinct(), "doc_id").where("form <> 'plain'").collect()
    kind = lambda c: 2 if c.isascii() and c.isspace() else 1 if c.isascii() and c.isdigit() else 0 if not c.isascii() or c.isalpha() else 3
    assert len(made) > 4
    for r in made:
        for at in (r.prefix_chars, r.prefix_chars + r.middle_chars):
            assert at in (0, len(r.text)) or kind(r.text[at - 1]) != kind(r.text[at])
    back = fim.digest(fim.transform(docs)).select("restored_sha256").collect()
    assert told(r[0] for r in back) == told(r[0] for r in docs.select(F.sha2(F.coalesce("text", F.lit("")), 256)).collect())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1 .é", max_size=40), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1), st.integers(1, 9), st.sampled_from(fim.UNITS))
def test_steps_do_not_matter(text, h1, h2, step, unit):
    x = np.frombuffer(text.encode("utf-32-le"), "<u4")
    assert fim.cuts(x, unit, (h1, h2), step) == fim.cuts(x, unit, (h1, h2))
    assert starts_of(text, unit) == [int(v) for a in range(0, len(x), step) for v in fim.starts(x, unit, a, a + step)]


def starts_of(text, unit):
    kind = lambda c: 2 if c == " " else 1 if c == "1" else 3 if c == "." else 0
    return [i for i, c in enumerate(text) if not i or unit == "codepoint" or kind(c) != kind(text[i - 1])]


def test_empty_table_and_wrong_unit(none):
    assert fim.transform(none).count() == 0
    with pytest.raises(ValueError):
        fim.transform(none, unit="word")
