"""Benchmark decontamination: q-gram lemma in diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, gram_hashes, release

#: Bytes of the shortest grams.
GRAM = 8


def normal(text: bytes) -> bytes:
    """A-Z lowered and runs of ASCII white space as one space."""
    return b" ".join(text.lower().split())


def align(item: np.ndarray, text: np.ndarray, budget: int, low: int, high: int, free_start: bool) -> tuple[int, int]:
    """Least edits of item against a part of text that ends anywhere (and starts anywhere, if free_start; else at 0), on
    the diagonals from low to high (place in text less place in item), and where that ends.

    Row by row over the band, so len(item) x (high - low) steps. Above the budget: (budget + 1, 0).
    """
    m, n, far = len(item), len(text), budget + 1
    d = np.arange(high - low + 1, dtype=np.int32)
    at = d + low  # bytes of text used up on each diagonal, before the first byte of item
    row = np.where((at >= 0) & (at <= n), 0 if free_start else at, far).astype(np.int32)
    padded = np.full(m + len(d) + 1, 256, np.int16)  # text from place low on, and what lies outside of it
    a, b = max(0, -low), min(len(padded), n - low)
    if a < b:
        padded[a:b] = text[low + a : low + b]
    for i in range(m):
        new = row + (padded[i : i + len(d)] != item[i])
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])
        new -= d
        np.minimum.accumulate(new, out=new)
        new += d
        end = i + 1 + low
        if end < 0:
            new[:-end] = far
        if end + len(d) - 1 > n:
            new[max(0, n - end + 1) :] = far
        np.minimum(new, far, out=row)
        if row.min() > budget:
            return far, 0
    best = int(row.argmin())
    return int(row[best]), m + low + best


@dataclass
class Grams:
    """q-grams of the items that use grams of one length, sorted by hash."""

    q: int
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    maybe: np.ndarray

    @classmethod
    def of(cls, q: int, texts: list[np.ndarray], which: list[int]) -> Grams:
        hashes = [gram_hashes(texts[i], q) for i in which]
        size = np.array([len(h) for h in hashes], np.int64)
        flat = np.concatenate(hashes)
        order = np.argsort(flat, kind="stable")
        place = np.arange(len(flat), dtype=np.int32) - np.repeat((np.cumsum(size) - size).astype(np.int32), size)
        maybe = np.zeros(1 << 20, bool)
        maybe[flat >> np.uint64(44)] = True
        return cls(q, flat[order], np.repeat(np.array(which, np.int32), size)[order], place[order], maybe)

    def hits(self, x: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in x, item, place in it) of each shared q-gram, about `most` at a time."""
        h = gram_hashes(x, self.q)
        p = np.nonzero(self.maybe[h >> np.uint64(44)])[0]
        a = np.searchsorted(self.hashes, h[p])
        n = np.searchsorted(self.hashes, h[p], "right") - a
        p, a, n = p[n > 0], a[n > 0], n[n > 0]
        ends, k = np.cumsum(n), 0
        while k < len(p):
            e = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + most, "right")))
            some = n[k:e]
            at = np.repeat(a[k:e], some) + np.arange(int(some.sum())) - np.repeat(np.cumsum(some) - some, some)
            yield np.repeat(p[k:e], some), self.item[at], self.place[at]
            k = e


@dataclass
class Items:
    """Benchmark items, what edits each may have, and how they are sought.

    An item of m bytes and e edits keeps m - q + 1 - q e of its q-grams, so grams of q bytes ask for one at least where
    m >= q (e + 1). Items that are too short for the common q use shorter grams; those under GRAM bytes are sought by
    an automaton, as they are.
    """

    ids: list[int | None]
    texts: list[np.ndarray]
    budgets: np.ndarray
    needed: np.ndarray
    grams: list[Grams]
    short: ahocorasick.Automaton | None

    @classmethod
    def of(cls, rows: list[tuple[int | None, bytes]], rate: float, q: int) -> Items:
        rows = [(i, t) for i, t in rows if t]
        texts = [np.frombuffer(t, np.uint8) for _, t in rows]
        size = np.array([len(t) for t in texts], np.int64)
        budgets = (size * rate).astype(np.int64)
        own = np.minimum(q, size // (budgets + 1))
        grams = [Grams.of(int(k), texts, np.nonzero(own == k)[0].tolist()) for k in np.unique(own[own >= GRAM])]
        short = None
        if (own < GRAM).any():
            short = ahocorasick.Automaton()
            for i in np.nonzero(own < GRAM)[0].tolist():
                word = rows[i][1].decode("latin-1")
                short.add_word(word, [*short.get(word, []), i])
            short.make_automaton()
        return cls([i for i, _ in rows], texts, budgets, size - own + 1 - own * budgets, grams, short)

    def regions(self, x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits) of the items found in texts that lie from starts to ends in x."""
        out: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for g in self.grams:
            for t, i, c, shift in self.cells(g, x, starts):
                e, begin, end = int(self.budgets[i]), int(starts[t]), int(ends[t])
                low = c * 2 * (e + 1) - shift * (e + 1) - (1 << 20)  # of the cell's diagonals, by places in x
                a, b = max(begin, low - e), min(end, low + 2 * (e + 1) + len(self.texts[i]) + e)
                if got := self.verify(i, x[a:b], e, low - e - a, low + 2 * e + 1 + e - a):
                    s, f, edits = got
                    out.setdefault((t, i), []).append((edits, s + a - begin, f + a - begin))
        if self.short is not None:
            for t, (begin, end) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                text = x[begin:end].tobytes().decode("latin-1")
                for last, which in self.short.iter(text):
                    for i in which:
                        first = last + 1 - len(self.texts[i])
                        if not any(c.isalnum() or c > "\x7f" for c in text[max(0, first - 1) : first] + text[last + 1 : last + 2]):
                            out.setdefault((t, i), []).append((0, first, last + 1))
        rows = []
        for (t, i), found in out.items():
            kept: list[tuple[int, int, int]] = []
            for edits, s, e in sorted(set(found)):
                if all(e <= a or s >= b for _, a, b in kept):
                    kept.append((edits, s, e))
            rows += [(t, i, s, e, edits) for edits, s, e in kept]
        return sorted(rows)

    def cells(self, g: Grams, x: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, cell, grid) of the diagonal bands with as many shared q-grams as the item's edits leave. There are two
        grids of bands 2 (e + 1) wide, half a band apart, so that any e + 1 diagonals side by side lie in one cell."""
        n, width = len(self.texts), (len(x) + (1 << 20)) // 2 + 2
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        for p, item, place in g.hits(x):
            text, e = np.searchsorted(starts, p, "right") - 1, self.budgets[item] + 1
            for shift in (0, 1):
                cell = (p - place + (1 << 20) + shift * e) // (2 * e)
                found[shift].append(np.unique((text * n + item) * width + cell, return_counts=True))
        for shift, parts in enumerate(found):
            if not parts:
                continue
            key, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            count = np.bincount(inverse, np.concatenate([c for _, c in parts]), len(key))
            pair, cell = key // width, key % width
            enough = count >= self.needed[pair % n]
            yield from zip((pair[enough] // n).tolist(), (pair[enough] % n).tolist(), cell[enough].tolist(), [shift] * int(enough.sum()), strict=True)

    def verify(self, i: int, window: np.ndarray, budget: int, low: int, high: int) -> tuple[int, int, int] | None:
        """(start, end, edits) of the item in the window on diagonals from low to high, if its edits are within the budget."""
        item = self.texts[i]
        at = window.tobytes().find(item.tobytes())
        if at >= 0:
            return at, at + len(item), 0
        if not budget:
            return None
        edits, end = align(item, window, budget, low, high, True)
        if edits > budget:
            return None
        _, back = align(item[::-1], window[:end][::-1], budget, -budget, budget, False)
        return end - back, end, edits


def found_in(index: Items, column: pa.Array, step: int = 2 << 20) -> Iterator[tuple[int, int, int, int, int]]:
    """Finds in the texts of an Arrow column, about `step` bytes at a time: (row, item, start, end, edits)."""
    column, a = column.cast(pa.binary()), 0
    while index.ids and a < len(column):
        texts, total, b = [], 0, a
        while b < len(column) and total < step:
            texts.append(normal(column[b].as_py() or b""))
            total += len(texts[-1]) + 1
            b += 1
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        for t, *rest in index.regions(np.frombuffer(b"\n".join(texts), np.uint8), np.concatenate([[0], ends[:-1] + 1]), ends):
            yield a + t, *rest
        a = b


def blocks_of(benchmark: DataFrame, rate: float, q: int, item_col: str, item_text: str, block_mb: int) -> Iterator[Items]:
    """The benchmark in blocks of about block_mb MB; only one block at a time is on the driver."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("t")).where("t is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // (block_mb << 20)))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(blocks)) == b).orderBy("item_id", "t").collect()
        yield Items.of([(r.item_id, normal(r.t.encode())) for r in part], rate, q)


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, q: int = 12, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_mb: int = 4) -> DataFrame:
    """Where whole benchmark items occur in documents with at most rate x length edits: doc_id, item_id, start, end, edits.

    Both sides are normalised (A-Z lowered, white space as one space); start and end are bytes of the normalised
    text. An item of m bytes with e edits keeps m - q + 1 - q e of its q-grams, all on diagonals within e of each
    other: bands with fewer shared q-grams are dropped, the others are aligned within the band. Items too short for
    the lemma to ask for one q-gram use shorter grams, down to 8 bytes; shorter ones have no edits and are sought as
    whole words, as a few letters inside a word are no leak. Of overlapping finds of one item the one with the fewest edits
    counts. The benchmark is taken in blocks of about block_mb MB, one broadcast and one pass over the documents each.

    Null and empty texts hold nothing; null, empty and blank items take no part; repeated items count once. Null ids are kept. Repeated documents give repeated rows. No finds, empty tables: no rows.
    Other columns are not read.
    """
    bound_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())

    def search(held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index: Items = held.value
            for batch in batches:
                if found := list(found_in(index, batch.column(1))):
                    t, i, s, e, edits = zip(*found, strict=True)
                    columns = ([batch.column(0)[k].as_py() for k in t], [index.ids[k] for k in i], s, e, edits)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "start", "end", "edits"])

        return rows.mapInArrow(run, "doc_id long, item_id long, start long, end long, edits int")

    passes = [search(docs.sparkSession.sparkContext.broadcast(index)) for index in blocks_of(benchmark, rate, q, item_col, item_text, block_mb)]
    out = passes[0]
    for p in passes[1:]:
        out = out.unionAll(p)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, q: int = 12, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_mb: int = 4) -> DataFrame:
    """Rows of docs in which find_leaks finds nothing, with all their columns. Each row is judged by its own text, so
    null ids and repeated rows need no rule; null texts stay."""
    bound_batches(docs)
    at = docs.columns.index(text_col)
    for index in blocks_of(benchmark, rate, q, item_col, item_text, block_mb):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[f[0] for f in found_in(held.value, batch.column(at))]] = False
                yield batch.filter(pa.array(clean))
            release()

        docs = docs.mapInArrow(run, docs.schema)
    return docs
