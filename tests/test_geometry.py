"""Path labels, representative points and arrangements."""

import math
import random

import pytest
from pyspark.sql import functions as F

from orrery.functions import geometry as g

PATHS = [
    ([(0, 0), (1, 0), (0, 1)], [1.0], "counterclockwise"),
    ([(0, 0), (0, 1), (1, 0)], [-1.0], "clockwise"),
    ([(0, 0), (1, 0), (0, 1), (1, 1)], [1.0, -1.0], "neither"),
    ([(0, 0), (1, 1), (2, 2)], [0.0], "clockwise"),
    ([(1, 1), (2, 1), (1, 3), (-1, 1), (1, 0)], [2.0, 4.0, 2.0], "counterclockwise"),
    ([(0, 0), (1, 0), (2, 0), (0, 1)], [0.0, 2.0], "neither"),
    ([(0, 0), (math.nan, 0), (0, 1)], [math.nan], "clockwise"),
]


def frame(spark, paths):
    rows = [(i, [(float(x), float(y)) for x, y in p]) for i, p in enumerate(paths)]
    return spark.createDataFrame(rows, f"i int, points {g.POINTS}")


def test_labels_and_determinants(spark):
    df = frame(spark, [p for p, _, _ in PATHS])
    got = df.select("i", g.path_label(F.col("points")).alias("label"), F.transform(g.arcs(F.col("points")), lambda a: a["det"]).alias("det")).orderBy("i").collect()
    for row, (_, det, label) in zip(got, PATHS, strict=True):
        assert row.label == label
        assert [str(x) for x in row.det] == [str(x) for x in det]


def test_short_paths_have_no_label(spark):
    df = frame(spark, [[(0, 0), (1, 1)], []])
    assert [r.label for r in df.select(g.path_label(F.col("points")).alias("label")).collect()] == [None, None]


def test_combining_nothing_is_an_error(spark):
    with pytest.raises(Exception, match="one arc"):
        spark.range(1).select(g.combine(F.array().cast("array<string>"))).collect()


def test_reversal_and_translation(spark):
    rng = random.Random(5)
    paths = [[(rng.randint(-9, 9), rng.randint(-9, 9)) for _ in range(rng.randint(3, 7))] for _ in range(200)]
    back = [[p[0], *p[:0:-1]] for p in paths]
    moved = [[(x + 1024, y - 512) for x, y in p] for p in paths]
    labels = [[r.label for r in frame(spark, ps).orderBy("i").select(g.path_label(F.col("points")).alias("label")).collect()] for ps in (paths, back, moved)]
    swap = {"clockwise": "counterclockwise", "counterclockwise": "clockwise", "neither": "neither"}

    def dets(p):
        a = p[0]
        return [(b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) for b, c in zip(p[1:], p[2:], strict=False)]

    assert labels[0] == labels[2]
    for p, there, again in zip(paths, labels[0], labels[1], strict=True):
        if all(dets(p)):
            assert swap[there] == again


POINTS = [
    ("point", [[3, 4]], (3, 4)),
    ("point", [[3, 4], [9, 9]], (3, 4)),
    ("LINE", [[0, 0], [2, 4]], (1, 2)),
    ("polygon", [[0, 0], [2, 0], [2, 2], [0, 2]], (1, 1)),
    ("polygon", [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]], (1, 1)),
    ("polygon", [[5, 5]], (5, 5)),
    ("line", [[0, 0], [3, 0], [0, 0]], (1, 0)),
    ("other", [[0, 0], [4, 8]], (2, 4)),
    ("line", [[0.1, 0.1]] * 10, (0.1, 0.1)),
]


def test_representative_points(spark):
    rows = [(i, k, [[float(v) for v in p] for p in c]) for i, (k, c, _) in enumerate(POINTS)]
    df = spark.createDataFrame([*rows, (99, "line", []), (100, None, None)], "i int, kind string, c array<array<double>>")
    got = {r.i: r.p for r in df.select("i", g.representative_point(F.col("kind"), F.col("c")).alias("p")).collect()}
    for i, (_, _, want) in enumerate(POINTS):
        assert (got[i].x, got[i].y) == want
    assert got[99] is None and got[100] is None
    plain = df.where("i = 8").select(g.representative_point(F.col("kind"), F.col("c"), exact=False)["x"]).first()[0]
    assert plain == 0.09999999999999999


def test_last_value_wins_at_the_first_place(spark):
    got = spark.range(1).select(g.last_wins(F.array(*map(F.lit, "ABA")), F.array(F.lit(1), F.lit(2), F.lit(3))).alias("e")).first().e
    assert [(e.name, e.value) for e in got] == [("A", 3), ("B", 2)]


def test_star_order_and_gaps(spark):
    df = frame(spark, [[(1, 1), (-1, -1), (1, -1), (-1, 1)]])
    got = df.select(g.star_order(F.col("points")).alias("p")).first().p
    assert [(p.x, p.y) for p in got] == [(-1, -1), (1, -1), (1, 1), (-1, 1)]
    assert spark.range(1).select(g.gaps(F.array(F.lit(1.0), F.lit(3.0), F.lit(2.0))).alias("d")).first().d == [2.0, -1.0]
