"""A store of named geometries as a table (name, seq, type, coordinates): checks, changes, listing, lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import infer_type, representative_point
from ..functions.numbers import rounded
from ..schemas import GEOMETRY_TYPES


def trimmed(name: Column) -> Column:
    return F.regexp_replace(name, r"^\s+|\s+$", "")


def error_of(name: Column, taken: Column, kind: Column, size: Column) -> Column:
    """What is wrong with a new geometry, the first of: name empty, name taken, unknown type, number of pairs; null if nothing."""
    return (
        F.when(F.coalesce(name, F.lit("")) == "", F.lit("name is empty"))
        .when(taken, F.lit("name is taken"))
        .when(~F.coalesce(kind.isin(*GEOMETRY_TYPES), F.lit(False)), F.lit("unknown type"))
        .when((kind == "point") & (size != 1), F.lit("a point has one pair"))
        .when((kind == "line") & (size < 2), F.lit("a line has two pairs at least"))
        .when((kind == "polygon") & (size < 3), F.lit("a polygon has three pairs at least"))
    )


def checked(new: DataFrame, store: DataFrame) -> DataFrame:
    """new (name, seq, type, coordinates) with trimmed names, types inferred for auto, and error; a name counts as taken
    in the store or by an earlier new row that was itself free of errors."""
    rows = new.withColumns({"name": trimmed(F.col("name")), "type": F.when(F.col("type") == "auto", infer_type(F.col("coordinates"))).otherwise(F.col("type"))})
    names = store.select(F.col("name").alias("__taken")).distinct()
    rows = rows.join(names, rows.name == F.col("__taken"), "left")
    size = F.coalesce(F.size("coordinates"), F.lit(0))
    own = error_of(F.col("name"), F.col("__taken").isNotNull(), F.col("type"), size)
    rows = rows.withColumn("error", own)
    first = rows.where("error is null").groupBy("name").agg(F.min("seq").alias("__first"))
    rows = rows.join(first, "name", "left")
    late = F.col("error").isNull() & (F.col("seq") > F.col("__first"))
    return rows.withColumn("error", F.when(late, F.lit("name is taken")).otherwise(F.col("error"))).select("name", "seq", "type", "coordinates", "error")


def added(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store with the new rows that have no error."""
    columns = ["name", "seq", "type", "coordinates"]
    return store.select(*columns).unionByName(checked(new, store).where("error is null").select(*columns))


def removed(store: DataFrame, name: str) -> DataFrame:
    """The store without a name; ValueError if it is not there."""
    if store.where(F.col("name") == name).isEmpty():
        raise ValueError(f"no geometry is named {name!r}")
    return store.where(F.col("name") != name)


def listing(store: DataFrame) -> DataFrame:
    """name, type, n_points, x, y (the representative point), error for geometries without one, a row each in no order; seq is the order."""
    point = representative_point(F.col("type"), F.col("coordinates"))
    rows = store.withColumn("p", point)
    return rows.select("seq", "name", "type", F.coalesce(F.size("coordinates"), F.lit(0)).cast("long").alias("n_points"), F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.when(F.col("p").isNull(), F.lit("no coordinates")).alias("error"))


def lookup(requests: DataFrame, store: DataFrame, wanted: str = "wanted") -> DataFrame:
    """requests with found: the stored name equal to the wanted one, else the first stored one that is equal in any
    case, else null. Two equi-joins; the second side has one row for each lower-case name."""
    names = store.select(F.col("name").alias("__exact")).distinct()
    lowered = store.groupBy(F.lower("name").alias("__lower")).agg(F.min_by("name", "seq").alias("__any"))
    rows = requests.join(names, F.col(wanted) == F.col("__exact"), "left").join(lowered, F.lower(wanted) == F.col("__lower"), "left")
    return rows.withColumn("found", F.coalesce("__exact", "__any")).drop("__exact", "__any", "__lower")


def geocoded(requests: DataFrame, store: DataFrame, wanted: str = "wanted") -> DataFrame:
    """requests with longitude and latitude, rounded to six places by their exact values, or error."""
    points = store.select(F.col("name").alias("found"), representative_point(F.col("type"), F.col("coordinates")).alias("__p"))
    rows = lookup(requests, store, wanted).join(points, "found", "left")
    return rows.withColumns(
        {"longitude": F.expr(rounded("__p.x", 6)), "latitude": F.expr(rounded("__p.y", 6)), "error": F.when(F.col("__p").isNull(), F.concat(F.lit("unknown place "), F.col(wanted)))}
    ).drop("__p", "found")
