"""Rewards and accuracy of completions against records, joined by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import path_label, representative_points
from ..functions.text import extract_answer, normal_answer
from ..schemas import ANSWERS
from ..session import written

KEY = ["split", "question_id", "pipeline"]


def ground_truth(answer: Column, geometries: Column) -> Column:
    """The stored answer if it is one of the domain, else the label of the geometries; an error below three of them."""
    stored = normal_answer(answer)
    return F.when(stored.isin(*ANSWERS), stored).otherwise(
        F.when(F.size(geometries) >= 3, path_label(representative_points(geometries))).otherwise(F.raise_error(F.lit("a truth needs three geometries at least")).cast("string"))
    )


def correctness(predicted: Column, truth: Column) -> Column:
    """1 if right, else 0; no prediction is 0 whatever the truth."""
    return F.when(predicted.isNull(), F.lit(0.0)).when(predicted == truth, F.lit(1.0)).otherwise(F.lit(0.0))


def well_formed(predicted: Column) -> Column:
    """A quarter for any answer at all."""
    return F.when(predicted.isNotNull(), F.lit(0.25)).otherwise(F.lit(0.0))


def reward(predicted: Column, truth: Column) -> Column:
    return correctness(predicted, truth) + well_formed(predicted)


def judged(records: DataFrame, completions: DataFrame) -> DataFrame:
    """KEY, n (geometries), truth, predicted, reward for each completion of a record. One shuffle on the key, or none
    where AQE finds a side small."""
    rows = records.select(*KEY, F.col("meta.answer").alias("answer"), F.col("meta.geometries").alias("geometries"))
    rows = rows.join(completions.select(*KEY, "completion"), KEY)
    out = rows.select(*KEY, F.size("geometries").cast("long").alias("n"), ground_truth(F.col("answer"), F.col("geometries")).alias("truth"), extract_answer(F.col("completion")).alias("predicted"))
    return out.withColumn("reward", reward(F.col("predicted"), F.col("truth")))


def scorecard(rows: DataFrame, truth: str = "truth", predicted: str = "predicted", n: str = "n") -> DataFrame:
    """level, key, total, correct, failures, accuracy: over all, by class and by n, in one pass of grouping sets.

    All three classes are there, with 0 rows if need be; accuracy is null for none.
    """
    marked = rows.select(F.col(truth).alias("t"), F.col(n).alias("n"), (F.col(predicted) == F.col(truth)).alias("right"), F.col(predicted).isNull().alias("failed"))
    sets = marked.groupingSets([[], ["t"], ["n"]], "t", "n").agg(F.grouping_id().alias("g"), F.count("*").alias("total"), F.count_if("right").alias("correct"), F.count_if("failed").alias("failures"))
    level = F.when(F.col("g") == 3, F.lit("all")).when(F.col("g") == 1, F.lit("class")).otherwise(F.lit("n"))
    key = F.when(F.col("g") == 3, F.lit("")).when(F.col("g") == 1, F.col("t")).otherwise(F.col("n").cast("string"))
    found = sets.select(level.alias("level"), key.alias("key"), "total", "correct", "failures")
    domain = found.sparkSession.createDataFrame([("all", ""), *(("class", a) for a in ANSWERS)], "level string, key string")
    every = domain.join(found, ["level", "key"], "full_outer")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "correct", "failures")]
    return every.select("level", "key", *counts, F.try_divide("correct", "total").alias("accuracy")).where("level <> 'class' or key in ('clockwise', 'counterclockwise', 'neither')")


def running(rows: DataFrame, key: str, right: Column, batch: int = 8, every: int = 10) -> DataFrame:
    """batches, total, correct, accuracy at the end of every tenth batch, in the order of a key without ties.

    Two levels, so that no task sees all rows: rows are dealt to ranges of the key, as many as shuffles have partitions,
    in a written table; totals of the ranges, a row each, are summed up before each range, and a window runs within it.
    """
    cut = rows.select(F.col(key).alias("k"), F.coalesce(right, F.lit(False)).cast("long").alias("right"))
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = written(cut.repartitionByRange(ranges, "k").withColumn("span", F.spark_partition_id()), "ranges")
    sums = cut.groupBy("span").agg(F.count("*").alias("n"), F.sum("right").alias("r"))
    before = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("r").over(before), F.lit(0)).alias("r0"))
    within = Window.partitionBy("span").orderBy("k")
    seen = cut.withColumn("n", F.row_number().over(within)).withColumn("r", F.sum("right").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    seen = seen.join(F.broadcast(sums), "span").select((F.col("n0") + F.col("n")).cast("long").alias("total"), (F.col("r0") + F.col("r")).cast("long").alias("correct"))
    return seen.where(F.col("total") % (batch * every) == 0).select((F.col("total") / batch).cast("long").alias("batches"), "total", "correct", (F.col("correct") / F.col("total")).alias("accuracy"))


def first_rows(rows: DataFrame, order: list[str], k: int = 50) -> DataFrame:
    """The first k rows of a total order: k rows of each task, then of those."""
    return rows.orderBy(*order).limit(k)


def report(card: DataFrame) -> str:
    """Text of a scorecard: its few rows come to the driver."""
    rows = {(r.level, r.key): r for r in card.collect()}
    share = lambda r: f"{r.correct}/{r.total} = {r.accuracy:.1%}" if r.total else "0/0 (no examples)"
    everything = rows["all", ""]
    lines = ["-" * 40, f"total     {everything.total}", f"accuracy  {share(everything) if everything.total else 'N/A'}", f"no answer {everything.failures}"]
    lines += [f"  {a:<17}{share(rows['class', a])}" for a in ANSWERS]
    lines += [f"  n = {k:<13}{share(rows['n', k])}" for k in sorted((k for level, k in rows if level == "n"), key=int)]
    return "\n".join(lines)
