"""Merkle manifest of a dataset: a leaf for each row, a tree of sixteen for each group of rows, one over the groups' roots.

The lower levels run in DuckDB on the executors, over Arrow tables that hold whole buckets of consecutive leaves, as
ordered string_agg and sha256 level by level. Spark combines the buckets' roots and joins each bucket with its outer proof.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bound_batches, materialise, release, width

#: Nodes of a run; levels of a bucket, which holds FANOUT ** INNER consecutive leaves of a group.
FANOUT, INNER = 16, 2
#: Characters of a digest.
HEX = 64
#: Rows that DuckDB gets at a time, but for a bucket that reaches beyond.
ROWS = 1 << 14


def field(value: Column) -> Column:
    """A field of a leaf: `-` for null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def numbered(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """rows with at, the place of each from 0 among those of its key in the order; rows that tie in it must be alike.

    Two levels, so that no task sees a whole key: rows are dealt to ranges of key and order, in a written table, and
    counted within; what stands before a range comes from the ranges' counts. Only a key that reaches over several
    ranges has something before it, so what is broadcast has no more rows than there are partitions.
    """
    spans = materialise(rows.repartitionByRange(width(rows), key, *order).withColumn("span", F.spark_partition_id()), name)
    counts = spans.groupBy("span", key).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("span").alias("__span"), F.col(key).alias("__key"), F.sum("n").over(earlier).alias("__before")).where("__before is not null")
    within = Window.partitionBy("span", key).orderBy(*order)
    placed = spans.withColumn("at", F.row_number().over(within) - 1)
    placed = placed.join(F.broadcast(before), (F.col("span") == F.col("__span")) & F.col(key).eqNullSafe(F.col("__key")), "left")
    return placed.withColumn("at", (F.col("at") + F.coalesce("__before", F.lit(0))).cast("long")).drop("span", "__span", "__key", "__before")


def trees(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """For nodes (key, i, h), numbered from 0 within each key: key, i, top (the root over the key's nodes) and path.

    While a key has several nodes, every `fanout` consecutive ones become the digest of their digests; the last run may
    hold one. path has a text for each level, the digests left and right of the node's own, parted by a bar. One
    grouping and one join a level; a key's levels grow with the logarithm of its nodes.
    """
    levels = []
    nodes = materialise(nodes.select("key", "i", "h"), "nodes")
    while not nodes.where("i > 0").isEmpty():
        run = F.array_sort(F.collect_list(F.struct("i", "h")))
        runs = nodes.groupBy("key", F.floor(F.col("i") / fanout).cast("long").alias("i")).agg(run.alias("run"))
        alone = (F.col("i") == 0) & (F.size("run") == 1)  # the one node of its key: others share run 0 with a second one
        runs = runs.select("key", "i", alone.alias("alone"), F.array_join(F.transform("run", lambda x: x["h"]), "").alias("s"))
        runs = materialise(runs.withColumn("h", F.when(F.col("alone"), F.col("s")).otherwise(F.sha2("s", 256))), "runs")
        levels.append((nodes, runs))
        nodes = runs.select("key", "i", "h")
    found = nodes.select("key", "i", F.col("h").alias("top"), F.array().cast("array<string>").alias("path"))
    for below, runs in reversed(levels):
        up = runs.select(F.col("key").alias("k"), F.col("i").alias("up"), "alone", "s").join(found.select(F.col("key").alias("k2"), F.col("i").alias("up2"), "top", "path"), F.col("k").eqNullSafe(F.col("k2")) & (F.col("up") == F.col("up2")))
        place = (F.col("i") % fanout).cast("int")
        beside = F.concat(F.substring("s", F.lit(1), place * HEX), F.lit("|"), F.substring("s", place * HEX + HEX + 1, F.length("s")))
        path = F.when(F.col("alone"), F.col("path")).otherwise(F.concat(F.array(beside), F.col("path")))
        found = below.join(up.select("k", "up", "alone", "s", "top", "path"), F.col("key").eqNullSafe(F.col("k")) & (F.floor(F.col("i") / fanout).cast("long") == F.col("up"))).select("key", "i", "top", path.alias("path"))
        found = materialise(found, "paths")
    return found


def _levels(inner: int, fanout: int) -> str:
    """SQL of the levels within buckets: height of each bucket, and for each level its runs (g) and nodes (n). A bucket that
    is not its group's first has all levels, as the group goes on; the first one's rows tell."""
    height = f"CASE WHEN bucket > 0 THEN {inner} " + " ".join(f"WHEN count(*) <= {fanout**k} THEN {k}" for k in range(inner)) + f" ELSE {inner} END"
    parts = [f"n0 AS (SELECT b, i, leaf AS h FROM leaves), height AS (SELECT b, {height} AS height FROM leaves GROUP BY b, bucket)"]
    for k in range(1, inner + 1):
        parts.append(f"g{k} AS (SELECT b, i // {fanout} AS i, string_agg(h, '' ORDER BY i) AS s FROM n{k - 1} JOIN height USING (b) WHERE height >= {k} GROUP BY b, i // {fanout})")
        parts.append(f"n{k} AS (SELECT b, i, sha256(s) AS h FROM g{k})")
    return ",\n".join(parts)


_NUMBERED = "t AS (SELECT *, dense_rank() OVER (ORDER BY grp NULLS FIRST, bucket) AS b FROM rows)"


def roots_sql(inner: int, fanout: int) -> str:
    """DuckDB SQL: the root of each bucket."""
    top = " UNION ALL ".join(f"SELECT b, h FROM n{k} JOIN height USING (b) WHERE height = {k}" for k in range(inner + 1))
    return f"WITH {_NUMBERED}, leaves AS (SELECT * FROM t),\n{_levels(inner, fanout)},\ntop AS ({top}), named AS (SELECT DISTINCT b, grp, bucket FROM t)\nSELECT grp, bucket, h FROM top JOIN named USING (b)"


def proofs_sql(inner: int, fanout: int, siblings: bool) -> str:
    """DuckDB SQL: for each leaf the digest of its proof, and what it, or the claim in its place, folds to."""
    joins, proof, folded = [], [], "coalesce(claimed, leaf)"
    stages = []
    for k in range(1, inner + 1):
        joins.append(f"LEFT JOIN g{k} ON g{k}.b = leaves.b AND g{k}.i = leaves.i // {fanout**k}")
        place = f"{HEX} * ((leaves.i // {fanout ** (k - 1)}) % {fanout})"
        stages.append(f"coalesce(substr(g{k}.s, 1, {place}), '') AS left{k}, coalesce(substr(g{k}.s, {place} + {HEX + 1}), '') AS right{k}, g{k}.s IS NOT NULL AS has{k}")
        proof.append(f"left{k} || right{k}")
    steps = ["f0 AS (SELECT *, " + f"{folded} AS fold0 FROM beside)"]
    steps += [f"f{k} AS (SELECT *, CASE WHEN has{k} THEN sha256(left{k} || fold{k - 1} || right{k}) ELSE fold{k - 1} END AS fold{k} FROM f{k - 1})" for k in range(1, inner + 1)]
    full = f"{' || '.join(proof)} || replace(array_to_string(path, ''), '|', '')"
    outer = f"list_reduce(path, lambda acc, x: sha256(split_part(x, '|', 1) || acc || split_part(x, '|', 2)), fold{inner})"
    return f"""
WITH {_NUMBERED}, leaves AS (SELECT * FROM t WHERE leaf IS NOT NULL), head AS (SELECT b, path, subroot, root FROM t WHERE root IS NOT NULL),
{_levels(inner, fanout)},
beside AS (SELECT leaves.doc_id, leaves.leaf, leaves.claimed, head.path, head.subroot, head.root, {", ".join(stages)} FROM leaves JOIN head ON head.b = leaves.b {" ".join(joins)}),
{", ".join(steps)},
done AS (SELECT doc_id, leaf, subroot, root, {full} AS proof, {outer} AS folded_root FROM f{inner})
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified{", proof" if siblings else ""} FROM done"""


def whole_buckets(batches: Iterator[pa.RecordBatch], least: int = ROWS) -> Iterator[pa.Table]:
    """Tables of about `least` rows that hold whole buckets; rows come in order of spot, a hash of their bucket."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= least:
            table = pa.Table.from_batches(held)
            spot = table.column("spot").to_numpy()
            cut = int(np.searchsorted(spot, spot[-1]))  # the last bucket may go on
            if cut:
                yield table.slice(0, cut)
            held, n = table.slice(cut).to_batches(), table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def in_buckets(rows: DataFrame, sql: str, schema: str) -> DataFrame:
    """sql over rows (grp, bucket, ...), which DuckDB sees as `rows`, all of a bucket at once. Rows are shuffled by bucket."""
    bound_batches(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1})
        for table in whole_buckets(batches):
            con.register("rows", table)
            yield from con.sql(sql).to_arrow_reader(ROWS)
            con.unregister("rows")
        con.close()
        release()

    rows = rows.withColumn("spot", F.xxhash64("grp", "bucket"))
    return rows.repartition(width(rows), "spot").sortWithinPartitions("spot").mapInArrow(run, schema)


def audit(
    docs: DataFrame,
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    claim: tuple[Column, dict[str, Column]] | None = None,
    group_col: str = "source",
    id_col: str = "doc_id",
    fanout: int = FANOUT,
    inner: int = INNER,
    siblings: bool = False,
) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row; proof, too, if siblings.

    A leaf is the digest of a row's fields. Leaves of a group stand in order of id (null first; of one id by leaf), and
    while there are several, each `fanout` consecutive ones become their digest: subroot. Subroots in order of their
    group (null first, by UTF-8 bytes) become root in the same way. A proof is the digests beside the leaf's way up,
    level by level, left to right. claim: a condition and other values of fields: where it holds, the leaf of
    these is folded with the recorded proof in place of the recorded one; verified tells whether that gives root.

    Nulls in any field are told from empty values; a null condition claims nothing. Repeated rows are leaves of their own. A
    row alone in its group is its subroot, a group alone its root. An empty table gives no rows. Other columns are not
    read. A hot group is numbered by ranges and hashed by buckets of fanout ** inner leaves, so no task holds it.
    """
    column = {f: F.col(f"`{f}`") for f in fields}
    claimed = F.lit(None).cast("string")
    if claim is not None:
        claimed = F.when(claim[0], leaf_of([claim[1].get(f, column[f]) for f in fields]))
    leaves = docs.select(F.col(f"`{group_col}`").cast("string").alias("grp"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), leaf_of(list(column.values())).alias("leaf"), claimed.alias("claimed"))
    leaves = numbered(materialise(leaves, "leaves"), "grp", ["doc_id", "leaf"], "leaf-ranges")
    size = fanout**inner
    leaves = leaves.select("grp", F.floor(F.col("at") / size).cast("long").alias("bucket"), (F.col("at") % size).alias("i"), "doc_id", "leaf", "claimed")
    leaves = materialise(leaves, "numbered-leaves")
    roots = in_buckets(leaves.select("grp", "bucket", "i", "leaf"), roots_sql(inner, fanout), "grp string, bucket long, h string")
    by_group = trees(roots.select(F.col("grp").alias("key"), F.col("bucket").alias("i"), "h"), fanout)
    groups = by_group.where("i = 0").select(F.lit(0).alias("all"), F.col("key").alias("grp"), F.col("top").alias("h"))
    groups = materialise(numbered(groups, "all", ["grp"], "group-ranges"), "numbered-groups")
    over = trees(groups.select(F.lit("all").alias("key"), F.col("at").alias("i"), "h"), fanout)
    over = groups.join(over, F.col("at") == F.col("i")).select("grp", F.col("top").alias("root"), F.col("path").alias("above"))
    heads = by_group.join(over, F.col("key").eqNullSafe(F.col("grp"))).select("grp", F.col("i").alias("bucket"), F.concat("path", "above").alias("path"), F.col("top").alias("subroot"), "root")
    every = leaves.unionByName(materialise(heads, "heads"), allowMissingColumns=True)
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return in_buckets(every, proofs_sql(inner, fanout, siblings), schema + ", proof string" * siblings)
