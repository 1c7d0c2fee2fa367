"""Nearest neighbours by a block matrix join: int8 product tiles with error bounds, float recomputation, heaps."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bound_batches, materialise, width

#: Slack for the rounding of the bounds themselves, far above what float32 products of unit vectors lose.
SLACK = 1e-5


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """row (a number of its own), id, v (array<double>): finite, nonzero, without null parts."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)).select(F.monotonically_increasing_id().alias("row"), "id", "v")


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit rows, their step, and the norm of what the codes lose."""
    step = np.abs(x).max(axis=1, keepdims=True) / 127
    codes = np.rint(x / step).astype(np.int8)
    return codes, step[:, 0], np.linalg.norm(x - codes * step, axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def serial_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise products summed from the first part to the last, so that equal rows give equal bits anywhere."""
    total = a[:, 0] * b[:, 0]
    for t in range(1, a.shape[1]):
        total = total + a[:, t] * b[:, t]
    return total


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return serial_dot(a, b) / (np.sqrt(serial_dot(a, a)) * np.sqrt(serial_dot(b, b)))


def tile(query_rows: np.ndarray, queries: np.ndarray, numbers: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, step: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k nearest rows of each query in one tile but its own: place of the query, id, exact cosine; `step` queries at a time.

    query_rows and numbers (sorted) are the rows' own numbers, by which a query knows itself.
    """
    c, c_step, c_lost = quantised(unit(rows))
    exact = np.float32 if c.shape[1] * 127 * 127 < 1 << 24 else np.float64  # a product of codes is a whole number below 2 to the 24th
    codes = np.ascontiguousarray(c.T.astype(exact))
    for a in range(0, len(queries), step):
        part = queries[a : a + step]
        q, q_step, q_lost = quantised(unit(part))
        near = (q.astype(exact) @ codes) * (q_step[:, None] * c_step[None, :]).astype(exact)
        off = (q_lost[:, None] + (1 + q_lost[:, None]) * c_lost[None, :] + SLACK).astype(exact)
        at = np.minimum(np.searchsorted(numbers, query_rows[a : a + step]), len(numbers) - 1)
        own = np.nonzero(numbers[at] == query_rows[a : a + step])[0]
        low = near - off
        low[own, at[own]] = -np.inf
        if low.shape[1] > k:
            floor = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k, None]
        else:
            floor = np.full((len(low), 1), -np.inf, exact)
        near += off
        near[own, at[own]] = -np.inf
        alive = (near >= floor) & (near > -np.inf)
        counts = np.concatenate([[0], np.cumsum(alive.sum(axis=1))])
        b = 0
        while b < len(alive):  # runs of queries with a bounded number of survivors
            e = max(b + 1, int(np.searchsorted(counts, counts[b] + 100_000, "right")) - 1)
            x, y = np.nonzero(alive[b:e])
            x += b
            score = np.concatenate([cosine(part[x[i : i + 100_000]], rows[y[i : i + 100_000]]) for i in range(0, len(x), 100_000)] or [np.empty(0)])
            order = np.lexsort((ids[y], -score, x))
            x, y, score = x[order], y[order], score[order]
            keep = np.arange(len(x)) - np.searchsorted(x, x) < k
            yield x[keep] + a, ids[y[keep]], score[keep]
            b = e


Heaps = dict[tuple[int, int], list[tuple[float, int]]]


def push(heaps: Heaps, k: int, query: tuple[int, int], score: float, vec: int) -> None:
    """Keeps the k best of a query: greatest score, then least id."""
    heap = heaps.setdefault(query, [])
    (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (score, -vec))


def batches_of(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], most: int = 50_000) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds, strict=True)], names)


def nearest(vectors: DataFrame, is_query: Column | str, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 8192, query_block: int = 16384, live: int = 65536) -> DataFrame:
    """For each query, its k nearest other rows by cosine: query_id, rank (from 1), vec_id, score; ties to the lesser id.

    is_query: a condition on the column "id". Queries and candidates are cut into blocks, and every pair of blocks
    is one tile, made by an equi-join on the tile's number. A tile multiplies int8 codes, bounds what quantisation
    may have changed, recomputes in doubles the pairs that may be among the k best, and keeps k for a query. A
    worker merges its tiles by heaps, of at most `live` queries (or one block's) at a time, and heaps once more merge the
    workers, query by query: nothing is approximate, and no heaps are held for all queries.

    Null ids, and vectors that are null, zero, empty or hold null or non-finite parts, take no part. Each row is a
    candidate, and a query if its id is one: rows that repeat an id are found by each other, and each gives results
    of its own. Vectors of different lengths are never compared. Fewer than k candidates: all of them. No vectors or
    no queries: no rows. Other columns are not read.
    """
    bound_batches(vectors)
    parts = T.FloatType() if isinstance(vectors.schema[vec_col].dataType, T.ArrayType) and isinstance(vectors.schema[vec_col].dataType.elementType, T.FloatType) else T.DoubleType()
    kind = "<f4" if isinstance(parts, T.FloatType) else "<f8"
    rows = materialise(usable(vectors, id_col, vec_col).withColumn("dim", F.size("v")), "vectors")
    query = F.expr(is_query) if isinstance(is_query, str) else is_query
    n, n_query = rows.select(F.count("*"), F.count_if(query)).first()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-n_query // query_block))

    def gather(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row")
        numbers, ids = (part[c].to_numpy().astype("<i8").tobytes() for c in ("row", "id"))
        return pd.DataFrame({"dim": part.dim[:1].to_numpy(), "block": part.block[:1].to_numpy(), "numbers": [numbers], "ids": [ids], "blob": [np.stack(part.v.to_list()).astype(kind).tobytes()]})

    def blobs(df: DataFrame, count: int) -> DataFrame:
        dealt = df.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(count)).cast("int"))
        return dealt.groupBy("dim", "block").applyInPandas(gather, "dim int, block int, numbers binary, ids binary, blob binary")

    left = blobs(rows.where(query), query_blocks).select("dim", F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("j"), F.col("numbers").alias("query_rows"), F.col("ids").alias("query_ids"), F.col("blob").alias("queries"))
    right = blobs(rows, blocks).select("dim", F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("i"), "numbers", "ids", "blob")
    tiles = left.hint("shuffle_hash").join(right, ["dim", "i", "j"]).select("dim", "query_rows", "query_ids", "queries", "numbers", "ids", "blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: Heaps = {}
        flat = lambda: batches_of(((*q, -vec, score) for q, heap in heaps.items() for score, vec in heap), ["query_row", "query_id", "vec_id", "score"], [pa.int64(), pa.int64(), pa.int64(), pa.float64()])
        for batch in batches:
            for dim, *blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                query_rows, query_ids, numbers, ids = (np.frombuffer(blob[j], "<i8") for j in (0, 1, 3, 4))
                queries, held = (np.frombuffer(blob[j], kind).reshape(-1, dim).astype(float) for j in (2, 5))
                own = list(zip(query_rows.tolist(), query_ids.tolist(), strict=True))
                for got in tile(query_rows, queries, numbers, ids, held, k):
                    for at, vec, score in zip(*(x.tolist() for x in got), strict=True):
                        push(heaps, k, own[at], score, vec)
                if len(heaps) > live - len(own):  # another tile might pass the bound
                    yield from flat()
                    heaps.clear()
        yield from flat()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def best() -> Iterator[tuple[int, int, int, float]]:
            rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for (_, query_id), found in groupby(rows, key=lambda row: row[:2]):
                heaps: Heaps = {}
                for _, _, vec, score in found:
                    push(heaps, k, (0, query_id), score, vec)
                yield from ((query_id, rank, -vec, score) for heap in heaps.values() for rank, (score, vec) in enumerate(sorted(heap, reverse=True), 1))

        yield from batches_of(best(), ["query_id", "rank", "vec_id", "score"], [pa.int64(), pa.int32(), pa.int64(), pa.float64()])

    local = tiles.mapInArrow(run, "query_row long, query_id long, vec_id long, score double")
    return local.repartition(width(vectors), "query_row").sortWithinPartitions("query_row").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")
