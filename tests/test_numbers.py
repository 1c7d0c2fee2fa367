"""Number and JSON texts against Python's own, over ties, short and long decimals, powers, float32 values and odd bits."""

import json

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.functions import numbers

ODD = [0.0, -0.0, float("nan"), float("inf"), -float("inf"), 1e-4, 9.999999999999999e-5, 1e15, 1e16, 9999999999999998.0, 1e22, 123456789012345.67, 0.1234565, 2.5e-06, 1.005, 0.125, 70368744177664.125, 9.5367431640625e-07, 2e-3, -0.001, -5e-7, 0.5e-6, 4.35, 9007199254740993.0, 9.1e13, 12345678901234570.0, 1e36]


def values(n):
    rng = np.random.default_rng(3)
    some = [rng.uniform(-2000, 2000, n), np.round(rng.uniform(-1000, 1000, n), 4), rng.integers(-(10**7), 10**7, n) / 8, (rng.integers(-(10**6), 10**6, n) + 0.5) / 1e6, (rng.integers(-(10**6), 10**6, n) * 2 + 1) / 200]
    some += [rng.standard_normal(n).astype(np.float32).astype(float), 10.0 ** rng.uniform(-5.9, 16.9, n) * rng.choice([-1, 1], n), 2.0 ** rng.integers(-19, 56, n), rng.integers(0, 2**53, n) / 2.0 ** rng.integers(0, 30, n), np.array(ODD)]
    return np.concatenate(some)


@pytest.fixture(scope="module")
def doubles(spark):
    return spark.createDataFrame(pa.table({"x": values(6000)}))


@pytest.mark.parametrize(("sql", "python"), [(numbers.rounded("x", 6), lambda x: repr(round(x, 6))), (numbers.rounded("x", 2), lambda x: repr(round(x, 2))), (numbers.fixed("x", 2), lambda x: f"{x:.2f}"), (numbers.fixed("x", 4), lambda x: f"{x:.4f}"), (numbers.json_number("x"), json.dumps)], ids=["round6", "round2", "fixed2", "fixed4", "json"])
def test_as_python(doubles, sql, python):
    got = [(r.x, r.y if isinstance(r.y, str) else repr(r.y)) for r in doubles.select("x", F.expr(sql).alias("y")).collect()]
    assert len(got) > 50_000 and [(x, y, python(x)) for x, y in got if y != python(x)] == []


@pytest.mark.parametrize("digits", [2, 6])
def test_rounded_away_as_duckdb(doubles, digits):
    """Ties go away from zero, and doubles whose product with the power of ten is none as that product does."""
    got = [(repr(r.x), repr(r.y)) for r in doubles.select("x", F.expr(numbers.rounded_away("x", digits)).alias("y")).collect()]
    held = pa.table({"x": values(6000)})  # noqa: F841
    want = [(repr(x), repr(y)) for x, y in duckdb.sql(f"SELECT x, round(x, {digits}) FROM held").fetchall()]
    assert sorted(got) == sorted(want) and any(y != repr(round(float(x), digits)) for x, y in got)


def test_whatever_the_bits(spark):
    """Any double is rounded and formatted as Python does; beyond the stated range its JSON text reads back the same."""
    rng = np.random.default_rng(4)
    bits = rng.integers(0, 2**63, 4000).astype(np.uint64).view(float)
    df = spark.createDataFrame(pa.table({"x": bits[np.abs(bits) < 1e36]}))
    for x, r, f, j in df.select("x", F.expr(numbers.rounded("x", 6)), F.expr(numbers.fixed("x")), F.expr(numbers.json_number("x"))).collect():
        assert (repr(r), f) == (repr(round(x, 6)), f"{x:.2f}") and float(j) == x


def test_json_texts(spark):
    some = ["plain", 'a"b\\c', "é", "\n\t\r\f\b\x01\x1f\x7f", "\U0001f600x", "", "日本 語", "/", " ", "a'b", " ", "tail\n", "{}"]
    got = spark.createDataFrame([(t,) for t in some], "t string").select("t", F.expr(numbers.json_text("t")).alias("j")).collect()
    assert [(r.t, r.j) for r in got] == [(t, json.dumps(t)) for t in some]


def test_nulls(spark):
    row = spark.sql(f"select {numbers.rounded('x', 6)}, {numbers.fixed('x')}, {numbers.json_number('x')}, {numbers.json_text('t')} from (select cast(null as double) as x, cast(null as string) as t)").first()
    assert list(row) == [None] * 4
