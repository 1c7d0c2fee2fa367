"""Geometry as column expressions: representative points, arcs around a centre, path labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"


def bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value evaluated once, however often it is used: a lambda's argument is not expanded again."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def points_of_pairs(flat: Column, n: Column) -> Column:
    """The first n points of a flat array x0, y0, x1, y1, ...; parts are doubles before any arithmetic."""
    return F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.struct(F.get(flat, 2 * i).cast("double").alias("x"), F.get(flat, 2 * i + 1).cast("double").alias("y")))


def pairs_of_points(points: Column) -> Column:
    """Points as coordinate pairs."""
    return F.transform(points, lambda p: F.array(p["x"], p["y"]))


def determinant(a: Column, b: Column, c: Column) -> Column:
    """Cross product of a->b and a->c; points are structs of x and y."""
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def turn(det: Column) -> Column:
    """counterclockwise for a positive determinant; zero and NaN (which Spark orders above all numbers) are clockwise."""
    return F.when((det > 0) & ~F.isnan(det), F.lit("counterclockwise")).otherwise(F.lit("clockwise"))


def cyclic_order(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Turn from b to c seen from a, from six numbers."""
    return turn((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def arcs(points: Column) -> Column:
    """For points centre, B1, B2, ...: structs of arc (from 1), det and label for each (Bi, Bi+1). Null below three points."""

    def every(p: Column) -> Column:
        det = F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - 2, F.lit(1))), lambda i: determinant(F.get(p, F.lit(0)), F.get(p, i), F.get(p, i + 1)))
        return F.when(F.size(p) >= 3, F.transform(det, lambda d, i: F.struct((i + 1).alias("arc"), d.alias("det"), turn(d).alias("label"))))

    return bind(points, every)


def combine(labels: Column) -> Column:
    """One label for a path: that of all arcs, or neither; an error for no arcs, null for null."""
    def one(v: Column) -> Column:
        return (
            F.when(v.isNull(), F.lit(None).cast("string"))
            .when(F.size(v) == 0, F.raise_error(F.lit("a path needs one arc at least")).cast("string"))
            .when(F.forall(v, lambda x: x == "clockwise"), F.lit("clockwise"))
            .when(F.forall(v, lambda x: x == "counterclockwise"), F.lit("counterclockwise"))
            .otherwise(F.lit("neither"))
        )

    return bind(labels, one)


def path_label(points: Column) -> Column:
    """Label of a path of points around the first one. Null below three points."""
    return combine(F.transform(arcs(points), lambda a: a["label"]))


def _sum(values: Column, exact: bool) -> Column:
    """Sum in order; exact: with Neumaier's compensation, as Python sums floats from 3.12 on."""
    if not exact:
        return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)

    def step(acc: Column, v: Column) -> Column:
        t = acc["s"] + v
        lost = F.when(F.abs(acc["s"]) >= F.abs(v), (acc["s"] - t) + v).otherwise((v - t) + acc["s"])
        return F.struct(t.alias("s"), (acc["c"] + lost).alias("c"))

    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))
    return F.aggregate(values, start, step, lambda acc: F.when(F.isnan(acc["c"]) | (F.abs(acc["c"]) == float("inf")), acc["s"]).otherwise(acc["s"] + acc["c"]))


def representative_point(kind: Column, coordinates: Column, exact: bool = True) -> Column:
    """Point of a geometry: its first pair for a point, else the mean of its pairs, of a polygon without a closing
    vertex that repeats the first. Types are matched in any case; other types count as lines. Null for no pairs."""
    kind = F.lower(kind)

    def of(c: Column) -> Column:
        closed = (kind == "polygon") & (F.size(c) > 1) & (F.get(c, F.lit(0)) == F.element_at(c, -1))
        ring = F.when(closed, F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0)))).otherwise(c)
        mean = lambda r, j: _sum(F.transform(r, lambda p: F.get(p, F.lit(j)).cast("double")), exact) / F.size(r)
        first = lambda j: F.get(F.get(c, F.lit(0)), F.lit(j)).cast("double")
        point = F.struct(first(0).alias("x"), first(1).alias("y"))
        return F.when(F.size(c) > 0, F.when(kind == "point", point).otherwise(bind(ring, lambda r: F.struct(mean(r, 0).alias("x"), mean(r, 1).alias("y")))))

    return bind(coordinates, of)


def representative_points(geometries: Column, exact: bool = True) -> Column:
    """Points of an array of geometries."""
    return F.transform(geometries, lambda g: representative_point(g["type"], g["coordinates"], exact))


def infer_type(coordinates: Column) -> Column:
    """point for one pair, line for two, else polygon."""
    return F.when(F.size(coordinates) == 1, F.lit("point")).when(F.size(coordinates) == 2, F.lit("line")).otherwise(F.lit("polygon"))


def star_order(points: Column) -> Column:
    """Points in order of their angle around their mean: a polygon that does not cross itself. Ties by x, then y."""
    n = F.size(points)
    mx = F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p["x"]) / n
    my = F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p["y"]) / n
    keyed = F.transform(points, lambda p: F.struct(F.atan2(p["y"] - my, p["x"] - mx).alias("angle"), p["x"].alias("x"), p["y"].alias("y")))
    return F.transform(F.array_sort(keyed), lambda k: F.struct(k["x"].alias("x"), k["y"].alias("y")))


def gaps(values: Column) -> Column:
    """Differences of neighbours."""
    return F.when(F.size(values) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(values) - 1, F.lit(1))), lambda i: F.get(values, i) - F.get(values, i - 1))).otherwise(F.array().cast("array<double>"))


def last_wins(names: Column, values: Column) -> Column:
    """Entries (name, value) of a mapping: names at their first place with their last value; the shorter input counts."""
    size = F.least(F.size(names), F.size(values))
    held = F.slice(names, F.lit(1), size)
    return F.transform(F.array_distinct(held), lambda n: F.struct(n.alias("name"), F.get(values, size - F.array_position(F.reverse(held), n).cast("int")).alias("value")))
