"""Substring dedup: suffix arrays of shards, common prefixes, and the least document that holds each string."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, bucketed, gram_hashes, materialise, release, width

#: Bytes of the grams whose least hash names a window's shard, and low bits of a hash that give way to a place.
GRAM = 16
PLACE = np.uint64((1 << 18) - 1)
#: Parts of the names whose segments are dealt out one after the other.
PASSES = 2
FIRST = np.iinfo(np.int64).min  # a null id: before all others


def words_at(x: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, most significant first; zeros past the end."""
    w = np.concatenate([x, np.zeros(8, np.uint8)]).astype(np.uint64)
    w = (w[:-1] << np.uint64(8)) | w[1:]
    w = (w[:-2] << np.uint64(16)) | w[2:]
    return ((w[:-4] << np.uint64(32)) | w[4:])[: len(x)]


def suffix_array(x: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffixes of x in order of their first `depth` bytes at least (all bytes, if None), ties by place.

    Larsson and Sadakane: sort by a prefix, number the groups, then sort within each group that is not single by the
    group number of what follows, doubling the prefix each time; sorted groups are never touched again. The first
    prefix is eight bytes, and a suffix that ends earlier comes before its extensions.
    """
    n = len(x)
    key = words_at(x)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    short = np.minimum(n - order, 8)  # a suffix that ends and one that goes on with zero bytes are no group
    fix = np.nonzero(short < 8)[0]
    if len(fix):
        low, high = np.searchsorted(ordered, ordered[fix]), np.searchsorted(ordered, ordered[fix], "right")
        for a, b in {(int(a), int(b)) for a, b in zip(low, high, strict=True)}:
            order[a:b] = order[a:b][np.argsort(short[a:b], kind="stable")]
        short = np.minimum(n - order, 8)
    first = np.concatenate([[True], (ordered[1:] != ordered[:-1]) | (short[1:] != short[:-1])]) if n else np.empty(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    h = 8
    while depth is None or h < depth:
        single = first & np.concatenate([first[1:], [True]]) if n else first
        open_ = np.nonzero(~single)[0]
        if not len(open_):
            break
        at = order[open_]
        after = np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
        group = start[open_]
        by = np.argsort((group << np.int64(32)) | after, kind="stable") if n < 1 << 31 else np.lexsort((after, group))
        order[open_] = at[by]
        group, after = group[by], after[by]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        first[open_] = new
        start[open_] = np.maximum.accumulate(np.where(new, open_, 0))
        rank[order[open_]] = start[open_]
        h *= 2
    return order


def common_prefixes(x: np.ndarray, order: np.ndarray, cap: int, stride: int = 32) -> np.ndarray:
    """Length of the common prefix of each suffix in order and the one before it, at most cap; 0 for the first.

    Kasai's bound: from one place of the text to the next the length falls by one at most. Places a stride apart go
    together, each step from the bound that the step before left.
    """
    n = len(x)
    if not n:
        return np.empty(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    words = np.concatenate([words_at(x), np.zeros(1, np.uint64)])
    length, last = np.zeros(n, np.int64), np.zeros(-(-n // stride), np.int64)
    for r in range(stride):
        i = np.arange(r, n, stride)
        got = np.maximum(last[: len(i)] - 1, 0)
        j = before[i]
        got[j < 0] = 0
        live = np.nonzero((j >= 0) & (got < cap))[0]
        while len(live):
            a, b = i[live] + got[live], j[live] + got[live]
            room = n - np.maximum(a, b)
            differ = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
            same = np.where(differ == 0, 8, 0)
            odd = np.nonzero(differ)[0]
            same[odd] = (63 - np.floor(np.log2(differ[odd].astype(np.longdouble))).astype(np.int64)) // 8
            step = np.minimum(np.minimum(same, room), cap - got[live])
            got[live] += step
            live = live[(step == 8) & (got[live] < cap)]
        length[i] = got
        last[: len(i)] = got
    return length[order]


def least_holder(segments: list[bytes], holders: np.ndarray, length: int) -> list[np.ndarray]:
    """For each window of `length` bytes of each segment, the least holder of a segment that has the same window."""
    x = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    ends = np.cumsum(sizes)
    order = suffix_array(x)  # all of it: the bound below holds for a full order only
    prefix = common_prefixes(x, order, length)
    of = np.searchsorted(ends, order, "right")
    whole = order + length <= ends[of]
    number = np.cumsum(prefix < length) - 1  # suffixes with the same first `length` bytes stand together
    least = np.full(int(number[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, number[whole], holders[of[whole]])
    out = np.zeros(len(x), np.int64)
    out[order] = least[number]
    return [out[e - s : e - length + 1] for s, e in zip(sizes, ends, strict=True)]


def meeting(segments: list[bytes], length: int) -> np.ndarray:
    """For each of distinct segments, whether it can share a window of `length` bytes with another one.

    All windows of a segment hold its least gram, and so half of their other bytes at least, rounded up, on one side of it:
    segments that share a window agree in that half and the gram. Hashes that differ rule this out; equal ones only may.
    """
    x = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    grams = gram_hashes(x, GRAM)
    at = starts + (grams[starts[:, None] + np.arange(length - GRAM + 1)] & ~PLACE).argmin(1)  # the first, as in minima
    half = (length - GRAM + 1) // 2
    met = np.zeros(len(segments), bool)
    for first in (at - half, at):
        has = np.nonzero((first >= starts) & (first + half + GRAM <= ends))[0]
        side = np.zeros(len(has), np.uint64)
        for off in (*range(0, half, GRAM), half):
            side = (side ^ grams[first[has] + off]) * np.uint64(0x9E3779B97F4A7C15)
            side ^= side >> np.uint64(31)
        _, inverse, count = np.unique(side, return_inverse=True, return_counts=True)
        met[has] |= count[inverse] > 1
    return met


def minima(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, step: int = 1 << 17) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows (first, last, name): all windows of `length` bytes within texts, by the least hash of their grams.

    A window's name depends on its bytes alone, so equal windows have equal names in any text. A run ends where the
    name or the place of its (first) gram changes, so it has length - GRAM + 1 windows at most, and text that repeats
    itself gives equal runs. step: below 1 << 18 by 2 x length at least.
    """
    n = len(x) - length + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    name = np.empty(n, np.uint64)
    for s in range(0, n, step):
        e = min(n, s + step)
        m, wide = gram_hashes(x[s : e + length - 1], GRAM), 1
        m = (m & ~PLACE) | np.arange(len(m), dtype=np.uint64)
        while 2 * wide <= length - GRAM + 1:
            m = np.minimum(m[:-wide], m[wide:])
            wide *= 2
        rest = length - GRAM + 1 - wide
        name[s:e] = np.minimum(m[: e - s], m[rest : rest + e - s])
    inside = np.zeros(n + 1, np.int8)
    long = ends - starts >= length
    inside[starts[long]] += 1
    inside[ends[long] - length + 1] -= 1
    inside = np.cumsum(inside[:n], dtype=np.int8).astype(bool)
    change = np.concatenate([[True], name[1:] != name[:-1]])
    first = inside & (change | ~np.concatenate([[False], inside[:-1]]))
    last = inside & (np.concatenate([change[1:], [True]]) | ~np.concatenate([inside[1:], [False]]))
    a, b = np.nonzero(first)[0], np.nonzero(last)[0]
    return a, b, (name[a] & ~PLACE) * np.uint64(0x9E3779B97F4A7C15)  # least hashes are small; names fill all ranges


def chunked(docs: DataFrame, id_col: str, text_col: str, mb: int = 6) -> DataFrame:
    """A table of chunks of about `mb` MB of text: chunk, docs, sizes (bytes), body (zstd of the texts); bucketed by chunk, so
    that texts are read where they lie, and not shuffled, when replies come to them."""
    bound_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, count, ids, texts, size = TaskContext.get().partitionId() << 32, 0, [], [], 0

        def close() -> pa.RecordBatch:
            body = b"".join(texts)
            return pa.RecordBatch.from_arrays([pa.array([base + count]), pa.array([ids], pa.list_(pa.int64())), pa.array([list(map(len, texts))], pa.list_(pa.int64())), pa.array([pa.compress(body, "zstd", asbytes=True)], pa.binary())], ["chunk", "docs", "sizes", "body"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                ids.append(doc)
                texts.append(text.as_py() or b"")
                size += len(texts[-1])
                if size >= mb << 20:
                    yield close()
                    count, ids, texts, size = count + 1, [], [], 0
        if ids:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return bucketed(rows.mapInArrow(run, "chunk long, docs array<long>, sizes array<long>, body binary"), "chunks", "chunk")


class Chunk:
    """Texts of one chunk and their runs of windows."""

    def __init__(self, docs: list[int | None], sizes: list[int], body: bytes, length: int):
        self.ids, self.sizes = docs, np.array(sizes, np.int64)
        self.docs = np.array([FIRST if d is None else d for d in docs], np.int64)
        self.body = pa.decompress(body, int(self.sizes.sum()), "zstd", asbytes=True)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.first, self.last, self.name = minima(np.frombuffer(self.body, np.uint8), self.starts, self.ends, length)
        self.holder = self.docs[np.searchsorted(self.ends, self.first, "right")]
        self.length = length

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct names, and whether texts of several ids have them."""
        order = np.lexsort((self.holder, self.name))
        name, holder = self.name[order], self.holder[order]
        new = np.nonzero(np.concatenate([[True], name[1:] != name[:-1]]))[0] if len(name) else np.empty(0, np.int64)
        end = np.append(new[1:], len(name)) - 1
        return name[new], holder[new] != holder[end] if len(new) else np.empty(0, bool)

    def shared(self, active: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Of the runs with active names: their numbers, which distinct segment each is, the segments, their least holders and names."""
        names, _ = self.names()
        runs = np.nonzero(active[np.searchsorted(names, self.name)])[0] if len(names) else np.empty(0, np.int64)
        number: dict[bytes, int] = {}
        body, length = self.body, self.length
        of = np.fromiter((number.setdefault(body[a : b + length], len(number)) for a, b in zip(self.first[runs].tolist(), self.last[runs].tolist(), strict=True)), np.int64, len(runs))
        least = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(least, of, self.holder[runs])
        name = np.zeros(len(number), np.uint64)
        name[of] = self.name[runs]
        return runs, of, list(number), least, name


def _place(name: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each name, and its place in the bucket's range in 32 bits: in order of names, and rarely the same for two."""
    at = (name >> np.uint64(18)) * np.uint64(buckets)
    return (at >> np.uint64(46)).astype(np.int64), ((at >> np.uint64(14)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _slices(bucket: np.ndarray, low: int, high: int) -> Iterator[tuple[int, slice]]:
    """Ranges of sorted bucket numbers from low until high: (bucket, its slice)."""
    cuts = np.searchsorted(bucket, np.arange(low, high + 1))
    for b in range(high - low):
        if cuts[b] < cuts[b + 1]:
            yield low + b, slice(cuts[b], cuts[b + 1])


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of one length by planes of their bytes, as zstd: high bytes, which are much alike, come together."""
    raw = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns)
    return len(columns[0]).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(packed: bytes, *kinds: type) -> list[np.ndarray]:
    n, wide, out = int.from_bytes(packed[:8], "little"), [np.dtype(k).itemsize for k in kinds], []
    raw, at = np.frombuffer(pa.decompress(packed[8:], n * sum(wide), "zstd", asbytes=True), np.uint8), 0
    for k, w in zip(kinds, wide, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(k).ravel())
        at += n * w
    return out


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))


def dedup_substrings(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Whole texts short of every byte that lies in a string of `length` bytes which also starts in a lesser id's text.

    Result, a row for each row of docs: doc_id, n_bytes, n_removed, n_spans (maximal runs), kept_sha256 (and kept, the
    bytes left, if with_text). Texts are UTF-8 bytes; strings are those of the input and never cross texts.

    The corpus becomes chunks in a table bucketed by chunk, so that replies are shuffled to the texts and no text to replies.
    A window of `length` bytes is named by the least hash of its grams, and windows side by side with one name are one
    segment. Chunks send their sorted distinct names, 32 bits each, to ranges of names, where runs are merged by binary
    search; only names of several ids come back. For those a chunk sends its distinct segments, each with its least id, to
    the name's shard, a part of the names at a time: the shuffle of a part goes when its replies are written. A shard takes
    segments that can share no window with another wording as they are, and builds suffix arrays of all others, of about
    6 MB at most, by Larsson-Sadakane refinement and their common prefixes by Kasai's bound: suffixes that share `length`
    bytes give each window the least id that holds it. Equal windows have equal names, so no match lies between shards.
    Copies in a chunk are one segment, so a hot passage costs a shard one row a chunk.

    Null and empty texts: no bytes. A null id comes before all others; rows of one id never remove each other's bytes.
    An empty table gives no rows. Other columns are not read. A text longer than a chunk is a chunk of its own, which
    one worker holds. length: 24 at least.
    """
    if length < GRAM + 8:
        raise ValueError(f"length must be {GRAM + 8} at least")
    buckets = min(2 * width(docs), 1 << 17)  # ranges of names
    chunks = chunked(docs, id_col, text_col)

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name, several = Chunk(row["docs"], row["sizes"], row["body"], length).names()
                bucket, key = _place(name, buckets)
                rows = [(b, row["chunk"], key[s].tobytes(), np.packbits(several[s]).tobytes()) for b, s in _slices(bucket, 0, buckets)]
                yield from _batch(rows, {"bucket": pa.int32(), "chunk": pa.int64(), "names": pa.binary(), "several": pa.binary()})
        release()

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(b, np.uint32) for b in part.names]
        every = np.sort(np.concatenate(keys))
        rows = []
        for chunk, bucket, key, own in zip(part.chunk, part.bucket, keys, part.several, strict=True):
            several = np.searchsorted(every, key, "right") - np.searchsorted(every, key) > 1
            several |= np.unpackbits(np.frombuffer(own, np.uint8), count=len(key)).astype(bool)
            rows.append((0, int(bucket), int(chunk), np.packbits(several).tobytes()))
        return pd.DataFrame(rows, columns=["kind", "bucket", "chunk", "reply"])

    reply = "kind int, bucket int, chunk long, reply binary"
    asked = chunks.mapInArrow(names, "bucket int, chunk long, names binary, several binary")
    active = materialise(asked.groupBy("bucket").applyInPandas(merge, reply), "names", once=True)

    def read(chunk: pd.DataFrame, got: pd.DataFrame, low: int = 0, high: int = buckets) -> tuple[Chunk, np.ndarray]:
        c = Chunk([None if pd.isna(d) else int(d) for d in chunk["docs"].iloc[0]], list(chunk["sizes"].iloc[0]), chunk["body"].iloc[0], length)
        name, _ = c.names()
        by = {int(b): r for k, b, r in zip(got.kind, got.bucket, got.reply, strict=True) if k == 0}
        bits = np.zeros(len(name), bool)
        for b, s in _slices(_place(name, buckets)[0], low, high):
            bits[s] = np.unpackbits(np.frombuffer(by[b], np.uint8), count=s.stop - s.start)
        return c, bits

    def sent(low: int, high: int) -> DataFrame:
        """Segments of names of several ids in buckets from low until high, a row for each chunk and bucket."""

        def segments(chunk: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
            c, bits = read(chunk, got, low, high)
            _, _, found, least, name = c.shared(bits)
            order, rows = np.argsort(name, kind="stable"), []
            bucket, key = _place(name[order], buckets)
            for b, s in _slices(bucket, low, high):
                mine = [found[k] for k in order[s].tolist()]
                body = b"".join(mine)
                side = _pack(key[s], np.fromiter(map(len, mine), np.uint32, len(mine)), least[order[s]])
                rows.append((b, int(chunk.chunk.iloc[0]), side, len(body), pa.compress(body, "zstd", asbytes=True)))
            del c, found
            release()
            return pd.DataFrame(rows, columns=["bucket", "chunk", "side", "bytes", "body"])

        mine = active.where(F.col("bucket").between(low, high - 1))
        return chunks.groupBy("chunk").cogroup(mine.groupBy("chunk")).applyInPandas(segments, "bucket int, chunk long, side binary, bytes long, body binary")

    def answers(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, bytes, np.ndarray]], cuts: list[np.ndarray], r: int) -> Iterator[np.ndarray]:
        """For each row, the least ids of its windows in range r of the keys: the shard."""
        number: dict[bytes, int] = {}
        of, least, name = [], [], []
        for (key, _, mins, body, ends), cut in zip(rows, cuts, strict=True):
            s = slice(cut[r], cut[r + 1])
            stops = ends[s].tolist()
            starts = [int(ends[s.start - 1]) if s.start else 0, *stops[:-1]]
            of.append(np.fromiter((number.setdefault(body[a:b], len(number)) for a, b in zip(starts, stops, strict=False)), np.int64, len(stops)))
            least.append(mins[s])
            name.append(key[s])
        found, flat = list(number), np.concatenate(of)
        del number
        holder = np.full(len(found), np.iinfo(np.int64).max)
        np.minimum.at(holder, flat, np.concatenate(least))
        called = np.zeros(len(found), np.uint32)
        called[flat] = np.concatenate(name)
        _, inverse, count = np.unique(called, return_inverse=True, return_counts=True)
        several = np.nonzero(count[inverse] > 1)[0]
        if len(several):
            several = several[meeting([found[k] for k in several.tolist()], length)]
        windows = np.fromiter(map(len, found), np.int64, len(found)) - length + 1
        first = np.cumsum(windows) - windows
        value = np.repeat(holder, windows)
        if len(several):
            for k, v in zip(several.tolist(), least_holder([found[k] for k in several.tolist()], holder[several], length), strict=True):
                value[first[k] : first[k] + len(v)] = v
        del found
        for o in of:
            n = windows[o]
            yield value[np.repeat(first[o] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def shard(part: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for side, n, body in zip(part.side, part.bytes, part.body, strict=True):
            key, sizes, least = _unpack(side, np.uint32, np.uint32, np.int64)
            rows.append((key, sizes, least, pa.decompress(body, int(n), "zstd", asbytes=True), np.cumsum(sizes, dtype=np.int64)))
        ranges = max(1, -(-int(part.bytes.sum()) // (6 << 20)))  # one suffix array at a time, of about 6 MB at most
        cuts = [np.searchsorted((key.astype(np.uint64) * np.uint64(ranges)) >> np.uint64(32), np.arange(ranges + 1)) for key, *_ in rows]
        out: list[list[np.ndarray]] = [[] for _ in rows]
        for r in range(ranges):
            for mine, line in zip(out, answers(rows, cuts, r), strict=True):
                new = np.nonzero(np.concatenate([[True], line[1:] != line[:-1]]))[0] if len(line) else np.empty(0, np.int64)
                mine.append(np.stack([np.diff(np.append(new, len(line))), line[new]]))
        replies = []
        for bucket, chunk, mine in zip(part.bucket, part.chunk, out, strict=True):
            times, ids = np.concatenate(mine, axis=1)
            replies.append((1, int(bucket), int(chunk), _pack(times.astype(np.uint32), ids)))
        del rows, out
        release()
        return pd.DataFrame(replies, columns=["kind", "bucket", "chunk", "reply"])

    replies = active
    for k in range(PASSES):  # the segments of one part of the names at a time lie on disk
        low, high = buckets * k // PASSES, buckets * (k + 1) // PASSES
        replies = replies.union(materialise(sent(low, high).groupBy("bucket").applyInPandas(shard, reply), "holders", once=True))

    def finish(chunk: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        c, bits = read(chunk, got)
        runs, of, found, _, name = c.shared(bits)
        by = {int(b): r for k, b, r in zip(got.kind, got.bucket, got.reply, strict=True) if k == 1}
        windows = np.fromiter(map(len, found), np.int64, len(found)) - length + 1
        at = np.zeros(len(found), np.int64)  # where each segment's windows begin in line
        lines, total = [], 0
        order = np.argsort(name, kind="stable")
        for b, s in _slices(_place(name[order], buckets)[0], 0, buckets):
            i = order[s]
            times, ids = _unpack(by[b], np.uint32, np.int64)
            line = np.repeat(ids, times)
            at[i] = total + np.cumsum(windows[i]) - windows[i]
            lines.append(line)
            total += len(line)
        line = np.concatenate(lines) if lines else np.empty(0, np.int64)
        mark = np.zeros(len(c.body) + 1, np.int32)
        for a in range(0, len(runs), 20_000):
            r, o = runs[a : a + 20_000], of[a : a + 20_000]
            n = windows[o]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            gone = line[np.repeat(at[o], n) + step] < np.repeat(c.holder[r], n)
            place = (np.repeat(c.first[r], n) + step)[gone]
            mark += np.bincount(place, minlength=len(mark)).astype(np.int32)
            mark -= np.bincount(place + length, minlength=len(mark)).astype(np.int32)
        dead = np.cumsum(mark[:-1]) > 0
        body, rows = np.frombuffer(c.body, np.uint8), []
        for doc, a, b in zip(c.ids, c.starts.tolist(), c.ends.tolist(), strict=True):
            d = dead[a:b]
            n = int(d.sum())
            kept = body[a:b][~d].tobytes() if n else c.body[a:b]
            spans = int((d[1:] & ~d[:-1]).sum() + d[0]) if n else 0
            rows.append((doc, b - a, n, spans, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
        release()
        out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])])
        return out.assign(doc_id=out.doc_id.astype("Int64"))

    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
