"""What the operators of this subpackage share: shared storage, width of shuffles, components of a link graph."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir

try:
    LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    LIBC = None


#: Shuffle files of a query go when it ends, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, packed: bool = False, once: bool = False) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: its lineage ends there, and it outlives executors.
    packed: its columns are compressed as they are, and compressing large values again only takes memory beside the heap.
    once: df runs here only, so its shuffle files go as soon as it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    held = spark.conf.get(CLEANUP, "false")
    if once:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression="none" if packed else None)
    finally:
        if once:
            spark.conf.set(CLEANUP, held)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like materialise, in a bucket of the key for each partition of a shuffle: groups of the key, and cogroups with other
    tables, read it in place. The catalog holds the table only until it is read back; its files stay in the shared folder."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(width(df), key).option("path", f"{shared_dir(spark)}/{table}").option("compression", "none").format("parquet").saveAsTable(table)
    back = spark.read.table(table)
    spark.sql(f"DROP TABLE {table}")
    return back


def discard(*tables: DataFrame) -> None:
    """Removes the folders of tables that materialise has written and that nothing reads any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            spark = df.sparkSession.sparkContext
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def width(df: DataFrame) -> int:
    """Partitions of a shuffle, as the session sets them for the size of the job."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of the undirected links (a, b): node, component (the least node reachable).

    Each round takes the least label among neighbours and then the label of that label, so a chain
    shortens geometrically; each round's labels are a written table, which goes when the next one is written.
    Only whether a row has changed comes to the driver. Null ends are left out; no links give no rows.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    both = materialise(both.union(both.select("y", "x")).distinct(), "links")
    labels = materialise(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("label")), "labels")
    while True:
        labels = labels.select("node", "label")
        near = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("label").alias("m"))
        low = labels.join(near, labels.node == near.x, "left").select("node", F.least("label", F.coalesce("m", "label")).alias("low"), F.col("label").alias("was"))
        up = low.select(F.col("node").alias("n2"), F.col("low").alias("low2"))
        new = low.join(up, low.low == up.n2, "left").select("node", F.least("low", F.coalesce("low2", "low")).alias("label"), "was")
        new = materialise(new, "labels")
        discard(labels)
        if new.where("label <> was").isEmpty():
            return new.select("node", F.col("label").alias("component"))
        labels = new


def bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value evaluated once, however often it is used: a lambda's argument is not expanded again."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def in_blocks(values: Column, each: Callable[[Column], Column]) -> Column:
    """An array cut into blocks of about the root of its size, with each(block) in the place of each; empty for empty."""

    def cut(v: Column) -> Column:
        side = F.ceil(F.sqrt(F.size(v))).cast("int")
        blocks = lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(v) - 1) / n), F.lit(0)).cast("int")), lambda b: each(F.slice(v, b * n + 1, n)))
        return bind(F.greatest(side, F.lit(1)), blocks)

    return bind(values, lambda v: F.filter(cut(v), lambda _: F.size(v) > 0))


def sums_before(values: Column) -> Column:
    """For each number of an array the sum of those before it.

    An aggregate copies the array it makes at every step, so one over all n values takes n squared steps. Sums are made
    within blocks of about the root of n values, and over the blocks' totals: n to the power 1.5.
    """
    zero = F.lit(0).cast("long")

    def plain(v: Column) -> Column:
        start = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(v, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def join(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, x: acc + x))
        return F.flatten(F.zip_with(blocks, plain(totals), lambda b, t: F.transform(plain(b), lambda x: x + t)))

    return bind(in_blocks(F.transform(values, lambda x: x.cast("long")), lambda b: b), join)


def pieces(text: Column, spans: Column) -> Column:
    """Parts of a text at spans (start from 0, length) in order of start. A substring is sought from the text's beginning, so
    each block of spans is cut out first and its spans within that."""

    def of(block: Column) -> Column:
        first, last = F.get(block, F.lit(0)), F.get(block, F.size(block) - 1)
        whole = F.substring(text, (first["start"] + 1).cast("int"), (last["start"] + last["length"] - first["start"]).cast("int"))
        return bind(whole, lambda w: F.transform(block, lambda s: F.substring(w, (s["start"] - first["start"] + 1).cast("int"), s["length"].cast("int"))))

    return F.flatten(in_blocks(spans, lambda b: bind(b, of)))


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the system: workers stay on for later stages."""
    pa.default_memory_pool().release_unused()
    if LIBC is not None:
        LIBC.malloc_trim(0)


def bound_batches(df: DataFrame, mb: int = 8) -> None:
    """Holds the Arrow batches that Python workers of this session get to about `mb` MB, whatever their rows hold. This is
    a setting of the session and stays: a batch of the default size holds up to 64 MB."""
    conf = df.sparkSession.conf
    now = conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")
    if not now.isdigit() or int(now) > mb << 20:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def steps_of(batches: Iterator[pa.RecordBatch], text: int, step: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batches whose texts, in the column of that number, have about `step` bytes; a longer text is a part of its own."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + step, "right")))
            yield batch.slice(a, b - a)
            a = b


def gram_hashes(x: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each q bytes of x; q from 8 to 16."""
    n = len(x) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    w = x.astype(np.uint64)
    w = w[:-1] | (w[1:] << np.uint64(8))
    w = w[:-2] | (w[2:] << np.uint64(16))
    w = w[:-4] | (w[4:] << np.uint64(32))  # eight bytes from each place on
    h = w[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += w[q - 8 : q - 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h
