"""Readers and writers: Parquet, CSV, JSON, JSON lines, split by split."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.records import REQUIRED, conversations
from ..schemas import QUESTION, RECORD, STORED, require_columns
from ..session import written


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A question table; ValueError if columns are missing."""
    return require_columns(spark.read.parquet(path), set(REQUIRED)).select(*[F.col(f.name).cast(f.dataType) for f in QUESTION])


def read_csv(spark: SparkSession, path: str, schema: str = "name string") -> DataFrame:
    """CSV with a header, by an explicit schema; a quote inside quotes is doubled."""
    return spark.read.schema(schema).option("escape", '"').csv(path, header=True)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """JSON lines; blank lines are skipped and a broken one fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """A store file {name: {type, coordinates}} as a table; a missing or broken one, or one that is no object, is empty."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], STORED)
    text = spark.read.text(path, wholetext=True)
    kind = "map<string,struct<type:string,coordinates:array<array<double>>>>"
    names = F.json_object_keys("value")
    rows = text.select(F.posexplode(F.coalesce(names, F.array().cast("array<string>"))).alias("seq", "name"), F.from_json("value", kind).alias("held"))
    return rows.select("name", F.col("seq").cast("long"), F.col("held")[F.col("name")]["type"].alias("type"), F.col("held")[F.col("name")]["coordinates"].alias("coordinates"))


def write_store(store: DataFrame, path: str) -> None:
    """Replaces a store file {name: {type, coordinates}}, names in order of seq; a reader sees the old file or the new one.

    A store is what one user has drawn and one JSON object, so one task holds it. It is written beside the place and
    then renamed, which is one step on HDFS and local disks.
    """
    spark = store.sparkSession
    one = F.struct("seq", F.concat(F.regexp_extract(F.to_json(F.struct(F.col("name").alias("n"))), r"(?s)^\{\"n\":(.*)\}$", 1), F.lit(":"), F.to_json(F.struct("type", "coordinates"))).alias("entry"))
    body = store.agg(F.array_sort(F.collect_list(one)).alias("all")).select(F.concat(F.lit("{"), F.array_join(F.transform("all", lambda e: e["entry"]), ","), F.lit("}")).alias("value"))
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    body.coalesce(1).write.mode("overwrite").text(f"{path}.new")
    part = next(f.getPath() for f in fs.listStatus(at(f"{path}.new")) if f.getPath().getName().startswith("part-"))
    if not fs.rename(part, at(path)):  # some file systems do not rename onto a file
        fs.delete(at(path), False)
        fs.rename(part, at(path))
    fs.delete(at(f"{path}.new"), True)


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """JSON lines; in a total order, if one is given, as ranges of it in as many files as shuffles have partitions: the order of the
    files' names is that of their ranges, and lines are in order within. No task holds more than a range."""
    if order:
        df = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    df.write.mode("overwrite").json(path)


def read_ordered_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines of files in order of their names, with line, the number of each line from 0 over all files.

    Lines are counted within each file, and files by a row each, which is broadcast: there are as many as tasks wrote.
    """
    place = [F.col("_metadata.file_name").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id")]
    rows = written(read_jsonl(spark, path, schema).select("*", *place), "lines")
    files = rows.groupBy("__file").agg(F.count("*").alias("__n"))
    before = files.select("__file", F.coalesce(F.sum("__n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__file").orderBy("__block", "__id")
    rows = rows.withColumn("__at", F.row_number().over(within) - 1).join(F.broadcast(before), "__file")
    return rows.withColumn("line", (F.col("__before") + F.col("__at")).cast("long")).drop("__file", "__block", "__id", "__at", "__before")


def write_parquet(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def preview(df: DataFrame, order: list[str], k: int = 5) -> DataFrame:
    """The first k rows of a total order."""
    return df.orderBy(*order).limit(k)


def build_splits(spark: SparkSession, inputs: dict[str, str], out: str, pipelines: tuple[int, ...] = (1, 2)) -> None:
    """Conversation records of each split's question table, in one job, as JSON lines under out/split=..."""
    frames = [conversations(read_questions(spark, path), pipelines).withColumn("split", F.lit(split)) for split, path in inputs.items()]
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    every.drop("derived").write.mode("overwrite").partitionBy("split").json(out)


def append_metrics(metrics: DataFrame, path: str, run: str, batch: int) -> None:
    """Metric rows of a run's batch to a growing table: a batch that is sent again replaces its own rows, none of them included."""
    metrics.write.mode("overwrite").parquet(f"{path}/run={quote(run, safe='')}/batch={batch}")


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All metric rows with run (string) and batch (long)."""
    return spark.read.schema(f"{schema}, run string, batch long").parquet(path)
