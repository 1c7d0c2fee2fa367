"""Seeded synthetic questions: each row has a random stream of its own, so the partitioning never matters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fill_template, gather

GEOMETRIES = "array<struct<coordinates:array<array<double>>,type:string>>"


def uniform(seed: int, *of: Column) -> Column:
    """In [0, 1), from a hash of the columns."""
    return F.pmod(F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 11), F.lit(1 << 53)).cast("double") / float(1 << 53)


def polygon(draw: np.random.Generator, n: int, span: float) -> np.ndarray:
    """n uniform pairs within the span in order of their angle around their mean, to four places."""
    pairs = draw.uniform(-span, span, (n, 2))
    away = pairs - pairs.mean(axis=0)
    return np.round(pairs[np.argsort(np.arctan2(away[:, 1], away[:, 0]))], 4)


def random_geometries(draw: np.random.Generator, n: int, span: float) -> list[dict]:
    """n geometries of random types: points, lines and polygons of 3 to 10 pairs."""
    sizes = [(kind, (1, 2, int(draw.integers(3, 11)))[kind]) for kind in draw.integers(0, 3, n).tolist()]
    return [{"coordinates": polygon(draw, size, span).tolist(), "type": ("point", "line", "polygon")[kind]} for kind, size in sizes]


def turning_geometries(draw: np.random.Generator, n: int, span: float, clockwise: bool) -> list[dict]:
    """A centre and n - 1 points around it in one direction, with no gap of half a turn between neighbours."""
    turns = np.array([0.0, 1.0])
    while np.diff(turns).max() >= 0.5:
        turns = np.sort(draw.random(n - 1))
    angle = 2 * np.pi * (turns[::-1] if clockwise else turns)
    centre = np.round(draw.uniform(-span, span, 2), 4)
    places = centre + draw.uniform(0, span, n - 1)[:, None] * np.stack([np.cos(angle), np.sin(angle)], axis=1)
    return [{"coordinates": [p], "type": "point"} for p in [centre.tolist(), *places.tolist()]]


def label_of(geometries: list[dict]) -> str:
    """Label of a path; zero determinants are clockwise."""
    mean = np.array([np.mean(g["coordinates"], axis=0) for g in geometries])
    v = mean[1:] - mean[0]
    left = v[:-1, 0] * v[1:, 1] - v[:-1, 1] * v[1:, 0] > 0
    return "counterclockwise" if left.all() else "neither" if left.any() else "clockwise"


def geometries_of(draw: np.random.Generator, n: int, kind: str | None, span: float) -> list[dict]:
    """Geometries of a kind of path; None: as they come."""
    if kind in ("clockwise", "counterclockwise"):
        return turning_geometries(draw, n, span, kind == "clockwise")
    while True:
        made = random_geometries(draw, n, span)
        if kind is None or label_of(made) == kind:
            return made


def templates_of_json(spark: SparkSession, path: str) -> DataFrame:
    """n, template_id, fmt, ord of a JSON file {n: [[text, order], ...]}."""
    text = spark.read.text(path, wholetext=True)
    entries = F.explode(F.from_json("value", "map<string,array<string>>"))
    rows = text.select(entries.alias("n", "list")).select(F.col("n").cast("int"), F.posexplode("list").alias("template_id", "pair"))
    pair = F.from_json("pair", "array<string>")
    return rows.select("n", "template_id", F.get(pair, F.lit(0)).alias("fmt"), F.from_json(F.get(pair, F.lit(1)), "array<int>").alias("ord"))


def default_templates(spark: SparkSession, max_n: int = 10) -> DataFrame:
    """Two templates for each n, made by rule."""
    rows = []
    for n in range(3, max_n + 1):
        path = " to ".join(["{}"] * (n - 1))
        rows += [(n, 0, f"Around {{}}, which way does the path {path} turn?", list(range(n))), (n, 1, f"Which way does the path {path} turn, seen from {{}}?", [*range(1, n), 0])]
    return spark.createDataFrame(rows, "n int, template_id int, fmt string, ord array<int>")


def balanced_grid(spark: SparkSession, per_n: int, max_n: int) -> DataFrame:
    """question_id, n, kind: as many of each answer for each n (no neither for n = 3, whose paths have one arc)."""
    cells = [(n, kind, per_n // (2 if n == 3 else 3)) for n in range(3, max_n + 1) for kind in ("clockwise", "counterclockwise", "neither")[: 2 if n == 3 else 3]]
    offsets, total = [], 0
    for n, kind, size in cells:
        offsets.append((total, n, kind, size))
        total += size
    grid = spark.createDataFrame(offsets, "first long, n int, kind string, size long")
    return grid.select("n", "kind", F.explode(F.when(F.col("size") > 0, F.sequence(F.col("first"), F.col("first") + F.col("size") - 1))).alias("question_id"))


def natural_grid(spark: SparkSession, per_n: int, max_n: int) -> DataFrame:
    """question_id, n: per_n questions for each n."""
    return spark.range(per_n * (max_n - 2)).select(F.col("id").alias("question_id"), (F.floor(F.col("id") / per_n) + 3).cast("int").alias("n"))


def sampled(names: DataFrame, size: int = 8000, seed: int = 1) -> DataFrame:
    """At most `size` distinct names, those with the least seeded hashes: the pool of a generator run."""
    return names.where("name is not null").select("name").distinct().orderBy(F.xxhash64(F.lit(seed), "name"), "name").limit(size)


def questions(grid: DataFrame, names: DataFrame, templates: DataFrame, seed: int = 1, span: float = 1000.0, pool: int = 8000) -> DataFrame:
    """D1 questions of a grid (question_id, n and, if balanced, kind): geometry, label, names and filled template.

    Drawing again until a path has its kind is a loop, so geometry comes from an Arrow batch function; a row's stream
    is named by seed and question_id. Of names (one column, name) a sample of `pool` is drawn, which bounds the array that
    is broadcast; templates, a table of fixed size, are grouped by n. Names of a question differ in their place in the
    pool. No shuffle of questions.
    """
    q = F.col("question_id")
    kind = F.col("kind") if "kind" in grid.columns else F.lit(None).cast("string")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = [geometries_of(np.random.Generator(np.random.Philox(key=[seed, i])), n, k, span) for i, n, k in zip(part.question_id.tolist(), part.n.tolist(), part.kind.tolist(), strict=True)]
            answer = [k or label_of(g) for k, g in zip(part.kind.tolist(), made, strict=True)]
            yield pd.DataFrame({"question_id": part.question_id, "n": part.n, "geometries": made, "answer": answer})

    rows = grid.select("question_id", "n", kind.alias("kind")).mapInPandas(run, f"question_id long, n int, geometries {GEOMETRIES}, answer string")
    drawn = sampled(names, pool, seed).agg(F.array_sort(F.collect_list("name")).alias("pool"))
    by_n = templates.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("template_id", "fmt", "ord"))).alias("forms"))
    rows = rows.crossJoin(F.broadcast(drawn)).join(F.broadcast(by_n), "n")
    size = F.size("pool")
    start, step = whole_of(seed, size, q, "start"), whole_of(seed, F.floor(size / 11).cast("int"), q, "step") + 1
    picked = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("pool", F.pmod(start + i * step, size)))
    rows = rows.withColumn("location_names", picked).withColumn("form", F.get("forms", whole_of(seed, F.size("forms"), q, "form")))
    text = fill_template(F.col("form.fmt"), gather(F.col("location_names"), F.col("form.ord")))
    return rows.select("question_id", text.alias("question"), "location_names", "geometries", "answer")


def splits(spark: SparkSession, names: DataFrame, templates: DataFrame, train: int = 4000, balanced: int = 1000, natural: int = 1000, max_n: int = 10, span: float = 1000.0, seed: int = 1) -> DataFrame:
    """The three question files of a run as one table with split: train and val_balanced with as many of each answer for
    each n, val_natural as geometry comes. Ids start at 0 in each split, whose draws have a seed of their own."""
    grids = {"train": balanced_grid(spark, train, max_n), "val_balanced": balanced_grid(spark, balanced, max_n), "val_natural": natural_grid(spark, natural, max_n)}
    made = [questions(grid, names, templates, seed + k, span).select(F.lit(split).alias("split"), "*") for k, (split, grid) in enumerate(grids.items())]
    return made[0].unionByName(made[1]).unionByName(made[2])


def whole_of(seed: int, below: Column, key: Column, what: str) -> Column:
    """A whole number from 0 below a column."""
    return F.floor(uniform(seed, key, F.lit(what)) * F.greatest(below, F.lit(1))).cast("int")


def type_audit(made: DataFrame) -> DataFrame:
    """answer, type, geometries: how much a geometry's type tells of the label."""
    return made.select("answer", F.explode("geometries.type").alias("type")).groupBy("answer", "type").agg(F.count("*").alias("geometries"))
