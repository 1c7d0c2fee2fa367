"""SimHash near-duplicates: fingerprints of word shingles compared exactly in tiles, by exclusive-or and bit counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, components, materialise, release, steps_of, width


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of one text: bit set if it is set in over half of the shingles' XXH64; 0 for no words."""
    from xxhash import xxh64_intdigest

    split = text.lower().split()  # bytes: A-Z only, and white space is x20 and x09-x0D
    if not split:
        return 0
    if len(split) <= words:
        return xxh64_intdigest(b" ".join(split), seed)
    joined = b" ".join(split)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1)
    starts = np.concatenate([[0], ends[: -words]])
    hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)], "<u8")
    count = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 16_384):
        count += np.unpackbits(hashes[k : k + 16_384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, fp (the 64 bits as a signed long), for each row of docs. Null text counts as empty."""

    bound_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((fingerprint(t.as_py() or b"", words) for t in batch.column(1).cast(pa.binary())), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], ["doc", "fp"])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc", f"`{text_col}` as text").mapInArrow(run, "doc long, fp long")


def forest(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins the ends of the links (u, v) in labels, in place: each label is the least node joined so far."""
    while True:
        a, b = labels[u], labels[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def tile_links(a: np.ndarray, b: np.ndarray, radius: int, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of a x b within the radius, as pairs of values; never all pairs."""
    same = len(a) == len(b) and bool((a == b).all())
    n = len(a)
    labels = np.arange(n if same else n + len(b))
    rows = max(1, step // max(1, len(b)))
    for k in range(0, n, rows):
        near = np.bitwise_count(a[k : k + rows, None] ^ b[None, k if same else 0 :]) <= radius
        u, v = np.nonzero(near)
        if len(u):
            forest(labels, u + k, v + (k if same else n))
    values = a if same else np.concatenate([a, b])
    low = np.nonzero(labels != np.arange(len(labels)))[0]
    return values[low], values[labels[low]]


def tile_pairs(rows: DataFrame, columns: list[str], near: Callable[[Column], Column], block: int) -> DataFrame:
    """Pairs of tiles (blob_a, blob): of each cell with each one of near(cell), itself among them, every pair once.

    rows: cell (int, not negative) and the long columns, which a tile holds one after another, sorted by the first. A
    cell of more than `block` rows is dealt out in blocks by a hash. There are as many cells as counts or sizes allow,
    some hundreds, which bounds the broadcast table of their sizes.
    """
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = rows.join(F.broadcast(sizes), "cell").select(*columns, "cell", F.pmod(F.xxhash64(*columns), F.col("blocks")).cast("int").alias("block"))

    def gather(part: pd.DataFrame) -> pd.DataFrame:
        held = part[columns].to_numpy(np.int64)
        return pd.DataFrame({"cell": part.cell[:1], "block": part.block[:1], "blob": [np.ascontiguousarray(held[np.lexsort(held.T[::-1])].T).tobytes()]})

    blobs = materialise(dealt.groupBy("cell", "block").applyInPandas(gather, "cell int, block int, blob binary"), "tiles")
    left = blobs.select(F.col("cell").alias("cell_a"), F.col("block").alias("block_a"), F.col("blob").alias("blob_a"), F.explode(near(F.col("cell"))).alias("to"))
    pairs = left.join(blobs, F.col("to") == F.col("cell")).where("cell_a < cell or (cell_a = cell and block_a <= block)")
    pairs = pairs.select("blob_a", "blob", F.xxhash64("cell_a", "block_a", "cell", "block").alias("pair"))
    return pairs.repartition(4 * width(rows), "pair").select("blob_a", "blob")


def near_links(classes: DataFrame, radius: int, block: int = 8192) -> DataFrame:
    """Links (a, b) that join every two values of classes.fp within the radius, in spanning forests of tiles.

    A cell holds the values with the same population counts in the upper and the lower 32 bits; cells whose counts
    differ by more than the radius are never compared.
    """
    cell = F.bit_count(F.shiftrightunsigned("fp", 32)) * 64 + F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    steps = [(p, q) for p in range(-radius, radius + 1) for q in range(abs(p) - radius, radius - abs(p) + 1)]

    def near(c: Column) -> Column:
        at = lambda p, q: F.when((F.floor(c / 64) + p).between(0, 32) & (c % 64 + q).between(0, 32), c + 64 * p + q)
        return F.array(*[at(p, q) for p, q in steps])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                a, b = tile_links(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return tile_pairs(classes.select("fp", cell.cast("int").alias("cell")), ["fp"], near, block).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable over links of at most `radius` bits).

    Texts are lower-cased (A-Z) and split at ASCII white space; shingles of `words` words, repeats included. Fewer
    words: the whole sequence is the shingle; null, empty and blank texts: fingerprint 0, linked like any other.
    Documents with one fingerprint are one node, so copies are never expanded into pairs. Repeated rows give
    repeated result rows. Null ids keep their row; they take part as links but never name a component unless no id
    of theirs is known (null then). An empty table gives no rows. Other columns of docs are not read.
    """
    prints = materialise(fingerprints(docs, words, id_col, text_col), "fingerprints")
    classes = materialise(prints.groupBy("fp").agg(F.min("doc").alias("least")), "classes")
    member = components(near_links(classes, radius), "a", "b")
    named = classes.join(member, classes.fp == member.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialise(named.select("fp", "component").join(least, "component").select("fp", "component_id"), "named")  # so that AQE can split a hot fingerprint's rows
    return prints.join(named, "fp").select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def mixed(h: np.ndarray) -> np.ndarray:
    """Another 64 bits from hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' shingles one after another, and how many each text has; repeats included.

    A-Z are lowered and texts cut at ASCII white space. A shingle's hash mixes the XXH64 of its words, each distinct
    word hashed once. Fewer words: the whole sequence is the shingle; no words, null texts: none.
    """
    from xxhash import xxh64_intdigest

    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = split.flatten().dictionary_encode()
    distinct = flat.dictionary.cast(pa.binary()).to_pylist()
    code, at = np.fromiter(map(xxh64_intdigest, distinct), np.uint64, len(distinct)), flat.indices.to_numpy()
    real = np.fromiter(map(bool, distinct), bool, len(distinct))[at]
    cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(), dtype=np.int64)])
    n = np.diff(np.concatenate([[0], np.cumsum(real)])[cuts])
    start, w = np.cumsum(n) - n, code[at[real]]
    sizes = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
    first = np.cumsum(sizes) - sizes
    out, h = np.empty(int(sizes.sum()), np.uint64), np.zeros(len(w) + 1, np.uint64)
    for k in range(1, words + 1):
        h = mixed((h[: len(w) - k + 1] + w[k - 1 :]) * np.uint64(0x9E3779B97F4A7C15))
        short = (n == k) if k < words else np.zeros(len(n), bool)
        out[first[short]] = h[start[short]]
    whole = n >= words
    long = sizes[whole]
    out[np.repeat(first[whole] - (np.cumsum(long) - long), long) + np.arange(long.sum())] = h[np.repeat(start[whole] - (np.cumsum(long) - long), long) + np.arange(long.sum())]
    return out, sizes


def wide_print(held: np.ndarray) -> np.ndarray:
    """128-bit SimHash, in two words, of a set of shingle hashes: a bit is set if it is in over half of them."""
    both = np.column_stack([held, mixed(held ^ np.uint64(0x5851F42D4C957F2D))])
    count = np.zeros(128, np.int64)
    for k in range(0, len(both), 8192):
        count += np.unpackbits(both[k : k + 8192].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * count > len(held), bitorder="little").view("<u8")


def shingle_sets(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """A table of each row's set of distinct shingles: doc, name (a hash of the set, 0 for none), n (shingles), s0 and s1
    (the set's 128-bit SimHash), held (32 bits of each hash, sorted)."""
    bound_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for part in steps_of(batches, 1):
            flat, sizes = shingles(part.column(1), words)
            rows = []
            for a, b in zip((np.cumsum(sizes) - sizes).tolist(), np.cumsum(sizes).tolist(), strict=True):
                held = np.unique(flat[a:b])
                if len(held):
                    rows.append((xxh64_intdigest(held.tobytes()), len(held), *wide_print(held).tolist(), (held >> np.uint64(32)).astype("<u4").tobytes()))
                else:
                    rows.append((0, 0, 0, 0, b""))
            name, n, s0, s1, held = zip(*rows, strict=True)
            words_of = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), words_of(name), pa.array(n, pa.int64()), words_of(s0), words_of(s1), pa.array(held, pa.binary())], ["doc", "name", "n", "s0", "s1", "held"])
        release()

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return materialise(rows.mapInArrow(run, "doc long, name long, n long, s0 long, s1 long, held binary"), "shingles")


#: Words of a set's parity bits.
PARITY = 16


def parity(held: np.ndarray) -> np.ndarray:
    """64 * PARITY bits of a set of 32-bit hashes, each the parity of those that fall on it. Two sets' bits differ in no more
    places than the sets do in elements, as each element of one set only turns one bit."""
    return np.packbits(np.bincount(held % np.uint32(64 * PARITY), minlength=64 * PARITY) & 1, bitorder="little").view("<u8")


class Tile:
    """Sets of one tile, by size: n, name, s0, s1 and, if they are known yet, degree, part and the words of parity."""

    COLUMNS = ("n", "name", "s0", "s1", "degree", "part", *(f"p{k}" for k in range(PARITY)))

    def __init__(self, blob: bytes, columns: int):
        self.n, self.name, s0, s1, *more = np.frombuffer(blob, np.int64).reshape(columns, -1)
        self.s0, self.s1 = s0.view(np.uint64), s1.view(np.uint64)
        self.degree, self.part, *self.parity = more or (None, None)

    def near(self, other: Tile, radius: int, least: float, step: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place here, place there) of the pairs of different sets within the radius whose sizes allow the similarity, all
        of a run of rows here at a time."""
        a = 0
        while a < len(self.n):
            low = int(np.searchsorted(other.n, least * self.n[a] - 1e-9))
            b = min(len(self.n), a + max(1, step // max(1, len(other.n) - low)))
            high = int(np.searchsorted(other.n, self.n[b - 1] / least + 1e-9, "right"))
            apart = np.bitwise_count(self.s0[a:b, None] ^ other.s0[None, low:high])
            apart += np.bitwise_count(self.s1[a:b, None] ^ other.s1[None, low:high])
            u, v = np.nonzero(apart <= radius)
            u, v = u + a, v + low
            n, m = self.n[u], other.n[v]
            fits = (np.minimum(n, m) >= least * np.maximum(n, m) - 1e-9) & (self.name[u] != other.name[v])
            yield u[fits], v[fits]
            a = b

    def edges(self, other: Tile, radius: int, least: float, few: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Names of sets here and near ones there, of other parts, whose parity bits allow the similarity; and names of sets
        here that have more of them. Each set's near ones stand in two orders, nearest first and those with the most near
        sets first, of which the first `few` are taken."""
        for u, v in self.near(other, radius, least):
            keep = self.part[u] != other.part[v]
            u, v = u[keep], v[keep]
            apart = np.zeros(len(u), np.int64)
            for x, y in zip(self.parity, other.parity, strict=True):
                apart += np.bitwise_count(x.view(np.uint64)[u] ^ y.view(np.uint64)[v])
            keep = apart <= (1 - least) / (1 + least) * (self.n[u] + other.n[v]) + 1e-9
            u, v, apart = u[keep], v[keep], apart[keep]
            taken = np.zeros(len(u), bool)
            for by in (apart, -other.degree[v]):
                order = np.lexsort((other.name[v], by, u))
                place = np.arange(len(u)) - np.searchsorted(u[order], u[order])
                taken[order[place < few]] = True
            yield self.name[u[taken]], other.name[v[taken]], np.unique(self.name[u[~taken]])


def similar_tiles(sets: DataFrame, least: float, columns: int, block: int) -> DataFrame:
    """Pairs of tiles of sets whose sizes may be within the similarity: cells of sizes that grow by 1 / least."""
    cell = F.floor(F.log("n") / F.lit(log(1 / least)) + 1e-9).cast("int")
    return tile_pairs(sets.select(*Tile.COLUMNS[:columns], cell.alias("cell")), list(Tile.COLUMNS[:columns]), lambda c: F.array(c, c + 1), block)


def near_sets(sets: DataFrame, radius: int, least: float, block: int) -> DataFrame:
    """name and degree of the sets that have near ones: as many as there are within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = Tile(x, 4), Tile(y, 4)
                here, there = np.zeros(len(a.n), np.int64), np.zeros(len(b.n), np.int64)
                for u, v in a.near(b, radius, least):
                    here += np.bincount(u, minlength=len(here))
                    there += np.bincount(v, minlength=len(there))
                names, degrees = (a.name, here) if x == y else (np.concatenate([a.name, b.name]), np.concatenate([here, there]))
                if degrees.any():
                    yield pa.RecordBatch.from_arrays([pa.array(names[degrees > 0]), pa.array(degrees[degrees > 0])], ["name", "degree"])

    return similar_tiles(sets, least, 4, block).mapInArrow(run, "name long, degree long").groupBy("name").agg(F.sum("degree").alias("degree"))


def near_edges(sets: DataFrame, radius: int, least: float, few: int, block: int) -> DataFrame:
    """Pairs (a, b) of names, a < b, that Tile.edges takes for each set in each pair of tiles, and (a, null) for each set that has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = Tile(x, len(Tile.COLUMNS)), Tile(y, len(Tile.COLUMNS))
                for one, two in [(a, b)] if x == y else [(a, b), (b, a)]:
                    for u, v, more in one.edges(two, radius, least, few):
                        if len(u):
                            low, high = pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))
                            yield pa.RecordBatch.from_arrays([pa.concat_arrays([low, pa.array(more)]), pa.concat_arrays([high, pa.nulls(len(more), pa.int64())])], ["a", "b"])

    return similar_tiles(sets, least, len(Tile.COLUMNS), block).mapInArrow(run, "a long, b long").distinct()


def with_parity(sets: DataFrame) -> DataFrame:
    """sets (whose last column is held) with the words of parity in its place."""
    columns = sets.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.array([parity(np.frombuffer(x.as_py(), np.uint32)) for x in batch.column(len(columns))], np.uint64).reshape(-1, PARITY)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(np.ascontiguousarray(w).view(np.int64)) for w in words.T)], [*columns, *Tile.COLUMNS[-PARITY:]])

    return sets.mapInArrow(run, ", ".join(f"{c} long" for c in (*columns, *Tile.COLUMNS[-PARITY:])))


def small_links(rows: DataFrame, least: float, most: int) -> DataFrame:
    """Links (a, b) that join all sets of at most `most` shingles that have the similarity, exactly: SimHash tells too little there.

    Two such sets share a part that is at least the similarity's share of either. So each set is listed under all of its parts
    so large (some dozens), and of a part's sets each is linked to the smallest one where the part makes them similar.
    Any two that it makes similar are then joined by that one, as no other is smaller.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import combinations

        from xxhash import xxh64_intdigest

        for batch in batches:
            out = []
            for name, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(held, np.uint32).tolist()
                for k in range(max(1, int(np.ceil(least * len(x) - 1e-9))), len(x) + 1):
                    out += [(xxh64_intdigest(np.array(part, "<u4").tobytes()), k, len(x), name) for part in combinations(x, k)]
            key, k, n, name = zip(*out, strict=True) if out else ([],) * 4
            yield pa.RecordBatch.from_arrays([pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(k, pa.int64()), pa.array(n, pa.int64()), pa.array(name, pa.int64())], ["key", "k", "n", "name"])

    listed = materialise(rows.where(f"n between 1 and {most}").groupBy("name").agg(F.min("held").alias("held")).mapInArrow(run, "key long, k long, n long, name long"), "parts-of-sets")
    least_of = materialise(listed.groupBy("key", "k").agg(F.min(F.struct("n", "name")).alias("c"), F.count("*").alias("sets")).where("sets > 1"), "smallest")
    found = listed.join(least_of, ["key", "k"]).where((F.col("name") != F.col("c.name")) & (F.col("n") + F.col("c.n") <= F.col("k") * (1 + 1 / least) + 1e-9))
    return found.select(F.least("name", "c.name").alias("a"), F.greatest("name", "c.name").alias("b")).distinct()


def verified(pairs: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) of names whose sets have the Jaccard similarity; held: name, held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = len(np.intersect1d(x, y))
                keep[k] = both >= least * (len(x) + len(y) - both) - 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    one, two = (held.select(F.col("name").alias(c), F.col("held").alias(f"held_{c}")) for c in ("a", "b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "held_a", "held_b").mapInArrow(run, "a long, b long")


def similar_parts(rows: DataFrame, least: float, radius: int, few: int, block: int, small: int) -> DataFrame | None:
    """Parts (node, component) of the names in a table of shingle_sets that links join; None for no links.

    Sets of at most `small` shingles are linked exactly (small_links). Else a first pass over all tiles tells which sets have
    near ones. The next ones take these only, and find the near pairs of different parts whose parity bits allow the
    similarity; of each set, in each pair of tiles, the `few` nearest and the `few` with the most near sets are
    verified, and parts are made of all links so far. A set all of whose pairs were taken is through. The others go on,
    with twice as many pairs a set, until none is left: every pair within the radius was verified, could not be similar
    by its parity bits, or was joined by others. A large group of near copies becomes one part by its hubs and nearest
    sets, so a pass verifies a number of pairs in proportion to the sets; passes grow with the logarithm of a set's pairs.
    """
    links = materialise(small_links(rows, least, small), "links")
    parts = None if links.isEmpty() else components(links, "a", "b")
    sets = materialise(rows.where("n > 0").groupBy("name").agg(*[F.min(c).alias(c) for c in ("n", "s0", "s1")]), "sets")
    busy = materialise(sets.join(near_sets(sets, radius, least, block), "name"), "near")
    if busy.isEmpty():
        return parts
    held = materialise(rows.select("name", "held").join(busy.select("name"), "name", "left_semi").groupBy("name").agg(F.min("held").alias("held")), "held")
    left = materialise(with_parity(busy.join(held, "name").select("n", "name", "s0", "s1", "degree", "held")), "parity")
    tried = None
    while True:
        if parts is None:
            placed = left.withColumn("part", F.col("name"))
        else:
            placed = left.join(parts, left.name == parts.node, "left").withColumn("part", F.coalesce("component", "name"))
        got = materialise(near_edges(placed, radius, least, few, block), "edges")
        edges = got.where("b is not null")
        new = edges if tried is None else edges.join(tried, ["a", "b"], "left_anti")
        found = materialise(verified(new, held, least), "links")
        if not found.isEmpty():
            links = links.unionAll(found)
            parts = components(links, "a", "b")
        more = got.where("b is null").select(F.col("a").alias("name"))
        if more.isEmpty():
            return parts
        left = materialise(left.join(more, "name", "left_semi"), "parity")
        tried = edges if tried is None else tried.unionAll(edges)
        few *= 2


def keep_one(docs: DataFrame, least: float = 0.8, words: int = 5, radius: int = 34, few: int = 4, small: int = 14, id_col: str = "doc_id", text_col: str = "text", block: int = 8192) -> DataFrame:
    """Rows of docs that name their component, the least id of each, with all their columns.

    Components are of texts linked by a Jaccard similarity of `least` or more between their sets of `words`-word
    shingles. Candidates are pairs within `radius` of the 128 bits of the sets' SimHash, found by comparing tiles;
    each link is then verified by both sets (32 bits of each hash). A similarity of 0.8 differs in 17 to 21 bits on
    average, with a deviation of 4, so the default radius misses less than one such pair in a thousand (5 of 10,000 in
    trials), and fewer above. Sets of at most `small` shingles, for which that does not hold, are linked exactly instead.

    Null, empty and blank texts are one component. Rows of one id stay or go together; null ids stay where no id of
    their component is known. An empty table gives no rows.
    """
    rows = shingle_sets(docs, words, id_col, text_col)
    member = similar_parts(rows, least, radius, few, block, small)
    classes = rows.groupBy(F.col("name").alias("set")).agg(F.min("doc").alias("least"))
    if member is None:
        part = classes.withColumn("component", F.col("set"))
    else:
        part = classes.join(member, classes.set == member.node, "left").select("set", "least", F.coalesce("component", "set").alias("component"))
    part = materialise(part, "classes")
    ids = part.groupBy("component").agg(F.min("least").alias("component_id"))
    stay = materialise(part.join(ids, "component").where(F.col("least").eqNullSafe(F.col("component_id"))).select("set", "component_id"), "stay")
    named = rows.select("doc", "name").join(stay, F.col("name") == F.col("set")).where(F.col("doc").eqNullSafe(F.col("component_id")))
    kept = materialise(named.select(F.col("doc").alias("__named")).distinct(), "named").hint("shuffle_hash")  # one plan at any size: the ids kept grow with the input
    return docs.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col("__named")), "left_semi")
