"""Types of the tables that the engine reads and writes, and the answer domain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

ANSWERS = ("clockwise", "counterclockwise", "neither")
GEOMETRY_TYPES = ("point", "line", "polygon")

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
GEOMETRY = T.StructType([T.StructField("coordinates", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("type", T.StringType())])
QUESTION = T.StructType(
    [
        T.StructField("question_id", T.LongType()),
        T.StructField("question", T.StringType()),
        T.StructField("location_names", T.ArrayType(T.StringType())),
        T.StructField("geometries", T.ArrayType(GEOMETRY)),
        T.StructField("answer", T.StringType()),
    ]
)
TOOL_CALL = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("function", T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType())])),
    ]
)
MESSAGE = T.StructType(
    [
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("tool_calls", T.ArrayType(TOOL_CALL)),
        T.StructField("name", T.StringType()),
        T.StructField("tool_call_id", T.StringType()),
    ]
)
META = T.StructType([T.StructField("location_names", T.ArrayType(T.StringType())), T.StructField("geometries", T.ArrayType(GEOMETRY)), T.StructField("answer", T.StringType())])
RECORD = T.StructType(
    [
        T.StructField("question_id", T.LongType()),
        T.StructField("pipeline", T.IntegerType()),
        T.StructField("tools", T.StringType()),
        T.StructField("messages", T.ArrayType(MESSAGE)),
        T.StructField("expected_answer", T.StringType()),
        T.StructField("meta", META),
    ]
)
TEMPLATE = T.StructType(
    [
        T.StructField("n", T.IntegerType()),
        T.StructField("template_id", T.IntegerType()),
        T.StructField("fmt", T.StringType()),
        T.StructField("ord", T.ArrayType(T.IntegerType())),
    ]
)
STORED = T.StructType([T.StructField("name", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("type", T.StringType()), T.StructField("coordinates", T.ArrayType(T.ArrayType(T.DoubleType())))])
COMPLETION = T.StructType([T.StructField("split", T.StringType()), T.StructField("question_id", T.LongType()), T.StructField("pipeline", T.IntegerType()), T.StructField("completion", T.StringType())])
SAMPLE = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("gpu_idx", T.IntegerType()), T.StructField("used_mb", T.DoubleType())])


def require_columns(df: DataFrame, names: list[str] | set[str]) -> DataFrame:
    """df, or ValueError naming the missing and the present columns in order; checked before any job."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}; found {sorted(df.columns)}")
    return df
