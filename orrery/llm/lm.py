"""LM scoring by context-tree weighting: binary-decomposed bytes, Krichevsky-Trofimov estimates mixed over all depths."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, materialise, release, steps_of, width
from .quality import held_out

#: The byte that ends a text and stands before it, and the key of the end token; words are hashed to other keys.
END, END_KEY = 10, 0
LN2 = float(np.log(2))
#: Bytes that are numbered at once.
STEP = 1 << 20


@dataclass
class Grams:
    """Distinct (context, byte) strings of some bytes, nearest context byte first, and where each scored byte has its own."""

    keys: np.ndarray  # sorted, depth + 1 bytes each in a whole number
    at: np.ndarray  # for each scored byte, the index of its key
    text: np.ndarray  # number of the text that each run of scored bytes is from
    sizes: np.ndarray  # scored bytes of each run


def runs_of(bodies: list[bytes], depth: int, step: int = STEP) -> Iterator[list[tuple[int, bytes, int]]]:
    """Bodies and their end bytes in runs (number of the text, bytes with the context before them, scored bytes), about
    `step` bytes at a time; a longer text is cut into several runs."""
    some, total, pad, end = [], 0, bytes([END]) * depth, bytes([END])
    for k, body in enumerate(bodies):
        whole = pad + body + end
        for a in range(0, len(body) + 1, step):
            part = whole[a : a + depth + step]
            some.append((k, part, len(part) - depth))
            total += len(part)
            if total >= step:
                yield some
                some, total = [], 0
    if some:
        yield some


def groups_of(bodies: list[bytes], step: int = 4 * STEP) -> Iterator[list[bytes]]:
    """Bodies in groups of about `step` bytes."""
    some, total = [], 0
    for body in bodies:
        some.append(body)
        total += len(body)
        if total >= step:
            yield some
            some, total = [], 0
    if some:
        yield some


def grams(runs: list[tuple[int, bytes, int]], depth: int, table: int = 1 << 22) -> Grams:
    """Prefixes get numbers, byte by byte; where the next byte would take more than `table` numbers, those in use are
    numbered anew. No sort is needed. Keys may hold a few strings over the end of a run, which nothing refers to."""
    x = np.frombuffer(b"".join(r for _, r, _ in runs), np.uint8)
    sizes = np.array([n for _, _, n in runs], np.int64)
    used = np.unique(x)
    dense = np.zeros(256, np.int32)
    dense[used] = np.arange(len(used))
    y, n, a = dense[x], len(x) - depth, len(used)
    number, keys, since = np.zeros(n, np.int32), np.zeros(1, np.uint64), 0
    for k, back in enumerate((*range(1, depth + 1), 0)):
        if k and len(keys) * a ** (since + 1) > table:
            number, keys, since = *renumbered(number, keys, used, since), 0
        since += 1
        wide = np.int32 if len(keys) * a**since < 1 << 31 else np.int64
        number = number.astype(wide) * wide(a) + y[depth - back : depth - back + n]
    number, keys = renumbered(number, keys, used, since)
    scored = np.arange(int(sizes.sum()), dtype=np.int32) + np.repeat(np.arange(len(runs), dtype=np.int32) * np.int32(depth), sizes)
    return Grams(keys, number[scored], np.array([k for k, _, _ in runs], np.int64), sizes)


def renumbered(number: np.ndarray, keys: np.ndarray, used: np.ndarray, since: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of those that occur, in the same order, and their keys: number // len(used) ** since tells the key so far."""
    size = len(keys) * len(used) ** since
    if size > 1 << 25:
        found, number = np.unique(number, return_inverse=True)
        number = number.astype(np.int32)
    else:  # a bit for each number that occurs; its place is the count of bits before it
        seen = np.zeros(-(-size // 64) * 64, bool)
        seen[number] = True
        found = np.nonzero(seen)[0]
        bits = np.packbits(seen, bitorder="little").view("<u8")
        before = np.cumsum(np.bitwise_count(bits), dtype=np.int32) - np.bitwise_count(bits)
        word, low = number >> 6, (np.uint64(1) << (number & 63).astype(np.uint64)) - np.uint64(1)
        number = before[word] + np.bitwise_count(bits[word] & low).astype(np.int32)
    more = np.zeros(len(found), np.uint64)
    for k in range(since):
        more |= used[(found // len(used) ** k) % len(used)].astype(np.uint64) << np.uint64(8 * k)
    return number, (keys[found // len(used) ** since] << np.uint64(8 * since)) | more


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted run of keys with the sums of their counts."""
    if len(runs) == 1:
        return runs[0]
    keys = np.concatenate([k for k, _ in runs] or [np.empty(0, np.uint64)])
    order = np.argsort(keys, kind="stable")  # which merges runs that are sorted
    keys, counts = keys[order], np.concatenate([n for _, n in runs] or [np.empty(0, np.int64)])[order]
    first = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def gathered(runs: Iterator[tuple[np.ndarray, np.ndarray]], most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """As merged, of runs that come one by one; about `most` keys wait for the next merge."""
    some: list[tuple[np.ndarray, np.ndarray]] = []
    for run in runs:
        some.append(run)
        if sum(len(k) for k, _ in some[1:]) > most:
            some = [merged(some)]
    return merged(some)


def packed(x: np.ndarray, rising: bool = False) -> bytes:
    """Numbers of 64 bits, compressed byte by byte of each; rising ones as steps."""
    x = np.diff(x, prepend=x.dtype.type(0)) if rising else x
    planes = np.ascontiguousarray((x if x.dtype == np.float64 else x.astype("<u8")).view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpacked(blob: bytes, rising: bool = False) -> np.ndarray:
    planes = pa.decompress(memoryview(blob)[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    x = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8")[:, 0]
    return np.cumsum(x, dtype=np.uint64) if rising else x


def lgamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x > 0 by Stirling's series from x + 8 on."""
    y = x + 8
    low = np.log(x) + np.log((x + 1) * (x + 2)) + np.log((x + 3) * (x + 4)) + np.log((x + 5) * (x + 6)) + np.log(x + 7)
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - low


#: ln gamma of n + 1/2 and of n + 1 for small n, which most counts are.
HALVES, WHOLES = (lgamma(np.arange(1 << 14) + more) for more in (0.5, 1.0))


def lgamma_of_counts(n: np.ndarray, more: float) -> np.ndarray:
    """ln gamma of n + more, one half or one, for counts n (whole numbers)."""
    known = HALVES if more == 0.5 else WHOLES
    out = known[np.minimum(n, len(known) - 1).astype(np.int64)]
    large = np.nonzero(n >= len(known))[0]
    out[large] = lgamma(n[large] + more)
    return out


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return lgamma_of_counts(n0, 0.5) + lgamma_of_counts(n1, 0.5) - lgamma_of_counts(n0 + n1, 1.0) - float(np.log(np.pi))


class Tree:
    """Contexts of depth 2 to `depth` of some two-byte contexts, with all eight binary decisions of a byte."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int):
        self.keys, self.depth, self.levels, inverse = keys, depth, {}, None
        x, n = keys & np.uint64(255), counts.astype(np.float64)
        for d in range(depth, 1, -1):
            of = ((keys >> np.uint64(8 * (depth + 1 - d))) << np.uint64(8)) | x
            level, inverse = np.unique(of, return_inverse=True)
            self.levels[d] = (level, np.bincount(inverse, n, len(level)), inverse)

    def run(self) -> tuple[list[dict[int, tuple]], list[np.ndarray]]:
        """For each bit: at each depth the group of each entry, counts and ln P_w; and ln P_w and node at depth 2."""
        nodes = []
        for k in range(8):
            at: dict[int, tuple] = {}
            for d in range(self.depth, 1, -1):
                level, n, inverse = self.levels[d]
                group = level >> np.uint64(8 - k)
                first = np.concatenate([[True], group[1:] != group[:-1]])
                starts = np.nonzero(first)[0]
                number = np.cumsum(first) - 1
                bit = ((level >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)
                n1 = np.add.reduceat(np.where(bit, n, 0), starts)
                n0 = np.add.reduceat(np.where(bit, 0, n), starts)
                own = log_kt(n0, n1)
                if d == self.depth:
                    weighted = own
                else:
                    deeper = self.levels[d + 1]
                    up = np.zeros(len(deeper[0]), np.int64)  # entry of depth d + 1 -> entry of depth d
                    up[deeper[2]] = inverse
                    _, _, _, _, below, below_starts, _ = at[d + 1]
                    below_sum = np.bincount(number[up[below_starts]], below, len(starts))
                    weighted = np.logaddexp(own, below_sum) - LN2
                at[d] = (number[inverse], n0, n1, own, weighted, starts, group[starts])
            nodes.append(at)
        return nodes

    def bits(self) -> np.ndarray:
        return ((self.keys[:, None] >> np.arange(7, -1, -1, dtype=np.uint64)) & np.uint64(1)).astype(bool)

    def predictions(self) -> tuple[np.ndarray, np.ndarray]:
        """(entries, 8): probability of each entry's bit in its two-byte context, and whether that context is known."""
        bits, out, known = self.bits(), np.empty((len(self.keys), 8)), np.empty((len(self.keys), 8), bool)
        for k, at in enumerate(self.run()):
            p = seen = None
            for d in range(self.depth, 1, -1):
                of, n0, n1, own, weighted, _, _ = at[d]
                n = (n0 + n1)[of]
                kt = (np.where(bits[:, k], n1[of], n0[of]) + 0.5) / (n + 1)
                if p is None:
                    p = kt
                else:
                    w = np.exp(own - LN2 - weighted)[of]
                    p = np.where(seen, w * kt + (1 - w) * p, kt)
                seen = n > 0
            out[:, k], known[:, k] = p, seen
        return out, known


def summary(keys: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a part of the tree, by nearest context byte: (256, 256) counts of bytes, and sums of ln P_w at depth 2 by node.

    A node of a byte's decisions is 1 << k | its first k bits."""
    near = (keys >> np.uint64(8 * depth)).astype(np.int64)
    x = (keys & np.uint64(255)).astype(np.int64)
    of = np.bincount(near * 256 + x, counts, 65536).reshape(256, 256)
    sums = np.zeros(65536)
    for k, at in enumerate(Tree(keys, counts, depth).run()):
        _, _, _, _, weighted, starts, group = at[2]
        c1 = (group >> np.uint64(8 + k)).astype(np.int64)
        node = (1 << k) | (group & np.uint64((1 << k) - 1)).astype(np.int64)
        sums += np.bincount(c1 * 256 + node, weighted, 65536)
    return of, sums.reshape(256, 256)


@dataclass
class Top:
    """Depths 0 and 1: the estimate of a one at each node, its weight, and whether anything was counted there."""

    one1: np.ndarray
    w1: np.ndarray
    seen1: np.ndarray
    one0: np.ndarray
    w0: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, sums: np.ndarray) -> Top:
        ones, zeros = np.zeros((256, 256)), np.zeros((256, 256))
        for k in range(8):
            for node in range(1 << k, 2 << k):
                low = (node - (1 << k)) << (8 - k)
                half = 1 << (7 - k)
                zeros[:, node] = counts[:, low : low + half].sum(axis=1)
                ones[:, node] = counts[:, low + half : low + 2 * half].sum(axis=1)
        own1 = log_kt(zeros, ones)
        weighted1 = np.logaddexp(own1, sums) - LN2
        z0, o0 = zeros.sum(axis=0), ones.sum(axis=0)
        own0 = log_kt(z0, o0)
        weighted0 = np.logaddexp(own0, weighted1.sum(axis=0)) - LN2
        return cls((ones + 0.5) / (ones + zeros + 1), np.exp(own1 - LN2 - weighted1), ones + zeros > 0, (o0 + 0.5) / (o0 + z0 + 1), np.exp(own0 - LN2 - weighted0))

    def log10(self, keys: np.ndarray, counts: np.ndarray, depth: int) -> np.ndarray:
        """log10 of the probability of each key's byte in its context."""
        tree = Tree(keys, counts, depth)
        p2, known = tree.predictions()
        bits, near, total = tree.bits(), (keys >> np.uint64(8 * depth)).astype(np.int64), np.zeros(len(keys))
        x = (keys & np.uint64(255)).astype(np.int64)
        for k in range(8):
            node = (1 << k) | (x >> (8 - k))
            right = lambda one: np.where(bits[:, k], one, 1 - one)  # noqa: B023, E731
            kt1, kt0 = right(self.one1[near, node]), right(self.one0[node])
            w1, w0, seen1 = self.w1[near, node], self.w0[node], self.seen1[near, node]
            p1 = np.where(known[:, k], w1 * kt1 + (1 - w1) * p2[:, k], kt1)
            total += np.log10(np.where(seen1, w0 * kt0 + (1 - w0) * p1, kt0))
        return total


def chunked(docs: DataFrame, id_col: str, text_col: str, mb: int = 32) -> DataFrame:
    """A table of chunks of about `mb` MB: chunk, docs, held (arrays), body (zstd of the normalised texts, a line each)."""
    bound_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, count, held, size, zstd = TaskContext.get().partitionId() << 32, 0, ([], [], []), 0, pa.Codec("zstd", 6)

        def close() -> pa.RecordBatch:
            nonlocal count, held, size
            body = b"\n".join(held[2])
            blob = len(body).to_bytes(8, "little") + zstd.compress(body)
            out = pa.RecordBatch.from_arrays([pa.array([base + count]), pa.array([held[0]], pa.list_(pa.int64())), pa.array([held[1]], pa.list_(pa.bool_())), pa.array([blob], pa.binary())], ["chunk", "docs", "held", "body"])
            count, held, size = count + 1, ([], [], []), 0
            return out

        for part in steps_of(batches, 2):
            words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(part.column(2), ""))))
            bodies = pc.binary_join(words, " ").cast(pa.binary()).to_pylist()
            for doc, out, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), bodies, strict=True):
                held[0].append(doc)
                held[1].append(out)
                held[2].append(body)
                size += len(body)
                if size >= mb << 20:
                    yield close()
        if held[0]:
            yield close()
        release()

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), held_out(id_col, fold=1).alias("held"), F.col(text_col).alias("text"))
    return materialise(rows.mapInArrow(run, "chunk long, docs array<long>, held array<boolean>, body binary"), "chunks", True)


def bodies_of(blob: bytes) -> list[bytes]:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True).split(b"\n")


def dealt(buckets: int, of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions of its keys), bucket by bucket; positions keep their order."""
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(buckets + 1))
    for b in range(buckets):
        if cuts[b] < cuts[b + 1]:
            yield b, order[cuts[b] : cuts[b + 1]]


def gram_bucket(keys: np.ndarray, buckets: int, depth: int) -> np.ndarray:
    """All contexts with the same two nearest bytes meet."""
    pair = keys >> np.uint64(8 * (depth - 1))
    return (((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)


def word_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys % np.uint64(buckets)).astype(np.int32)


@dataclass
class Words:
    """Words of some bodies: sorted keys of the distinct ones and the end token, each word's place there, words of each body."""

    keys: np.ndarray
    at: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, bodies: list[bytes]) -> Words:
        from xxhash import xxh64_intdigest

        split = pc.split_pattern(pa.array(bodies, pa.binary()).cast(pa.string()), " ")
        flat = split.flatten().dictionary_encode()
        distinct = flat.dictionary.cast(pa.binary()).to_pylist()
        code = np.fromiter((END_KEY, *((xxh64_intdigest(w) or 1) if w else END_KEY for w in distinct)), np.uint64, len(distinct) + 1)
        keys, place = np.unique(code, return_inverse=True)
        empty = np.fromiter((not w for w in distinct), bool, len(distinct))
        at = flat.indices.to_numpy(zero_copy_only=False)
        real = ~empty[at]  # an empty body is one empty word
        cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
        return cls(keys, place[1:][at[real]].astype(np.int32), np.diff(np.concatenate([[0], np.cumsum(real)])[cuts]))


RUN = "kind int, bucket int, part int, chunk long, keys binary, counts binary"
KINDS = {"kind": pa.int32(), "bucket": pa.int32(), "part": pa.int32(), "chunk": pa.int64(), "keys": pa.binary(), "counts": pa.binary()}


def score(docs: DataFrame, depth: int = 6, id_col: str = "doc_id", text_col: str = "text", gather: int = 256) -> DataFrame:
    """log10 probability of each whole text by a context tree and by a word-unigram base, learnt outside the held-out fold.

    Result: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte, a row for each row.
    A text is its words (A-Z lowered, cut at ASCII white space) joined by single spaces, and an end byte; bits_per_byte
    divides by these bytes. Each byte is eight binary decisions, each of which has contexts of 0 to `depth` bytes before it;
    a context's estimate is mixed with its deeper one by the weights of context-tree weighting; contexts never seen
    leave the word to the shallower one. depth: from 2 to 7. A byte more costs about twice as many contexts; on 2.5 MB of
    text depths 5, 6 and 7 gave held-out texts 2.174, 2.143 and 2.124 bits a byte, on 25 MB 2.105, 2.044 and 2.005.

    The corpus becomes chunks in a written table. Chunks send sorted runs of their distinct contexts and words with
    counts to buckets. About `gather` chunks are one part, and a bucket's runs are added up part by part before they are
    added up in all, so no group holds more than so many runs, or the distinct contexts of a bucket. Each part of a
    bucket then gives its chunks the values of their own contexts. So what is counted grows with the input, and no table is
    broadcast but the 256 x 256 top of the tree. A worker holds a chunk, or the distinct contexts of a bucket, which all
    contexts of one pair of bytes share; and each part gets all that its bucket has learnt, so what is shuffled grows
    faster than the input from a second part on.

    Null and empty texts: the end token alone. A null id counts as training; repeated rows count and are returned
    each. No training text: every estimate is one half a bit. Empty table: no rows. Other columns are not read. A very
    long text is one chunk; its contexts are numbered some MB at a time.
    """
    if not 2 <= depth <= 7:
        raise ValueError("depth must be from 2 to 7")
    chunks = chunked(docs, id_col, text_col)
    buckets = width(docs)
    parts = -(-chunks.count() // gather) or 1

    def learnt_words(bodies: list[bytes], learn: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        a = 0
        for group in groups_of(bodies):
            w, own = Words.of(group), learn[a : a + len(group)]
            n = np.bincount(w.at[np.repeat(own, w.sizes)], minlength=len(w.keys))
            n[0] += own.sum()
            yield w.keys, n
            a += len(group)

    def learnt_grams(bodies: list[bytes], learn: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for runs in runs_of(bodies, depth):
            g = grams(runs, depth)
            yield g.keys, np.bincount(g.at[np.repeat(learn[g.text], g.sizes)], minlength=len(g.keys)).astype(np.int32)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, held, body in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                bodies, learn, part = bodies_of(body), ~np.array(held, bool), ((chunk >> 32) + (chunk & 0xFFFFFFFF) * 7919) % parts
                keys, n = gathered(learnt_words(bodies, learn))
                rows = [(0, b, part, chunk, packed(keys[i], True), packed(n[i])) for b, i in dealt(buckets, word_bucket(keys, buckets))]
                keys, n = gathered(learnt_grams(bodies, learn))
                rows += [(1, b, part, chunk, packed(keys[i], True), packed(n[i])) for b, i in dealt(buckets, gram_bucket(keys, buckets, depth))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS.values(), strict=True)], list(KINDS))
                del rows, keys, n, bodies
        release()

    def read(part: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(unpacked(k, True), unpacked(n).astype(np.int64)) for k, n in zip(part["keys"], part["counts"], strict=True)]

    def add(part: pd.DataFrame) -> pd.DataFrame:
        """One run of a group's learnt keys."""
        keys, n = merged([(k[n > 0], n[n > 0]) for k, n in read(part)])
        return pd.DataFrame({"kind": part["kind"].iloc[:1], "bucket": part["bucket"].iloc[:1], "part": part["part"].iloc[:1], "chunk": [-1], "keys": [packed(keys, True)], "counts": [packed(n)]})

    counted = materialise(chunks.select("chunk", "held", "body").mapInArrow(tally, RUN), "counts", True)
    learnt = materialise(counted.groupBy("kind", "bucket", "part").applyInPandas(add, RUN).groupBy("kind", "bucket").applyInPandas(add, RUN), "learnt", True)

    def sized(part: pd.DataFrame) -> pd.DataFrame:
        n = np.concatenate([n for _, n in read(part)])
        return pd.DataFrame({"n": [int(n.sum())], "known": [len(n)]})

    words = learnt.where("kind = 0").groupBy("bucket").applyInPandas(sized, "n long, known long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("known"), F.lit(0)).alias("known")).first()
    n_train, n_known = words.n, words.known

    def summed(part: pd.DataFrame) -> pd.DataFrame:
        keys, n = merged(read(part))
        of, sums = summary(keys, n, depth) if len(keys) else (np.zeros((256, 256)), np.zeros((256, 256)))
        cell = np.nonzero((of != 0) | (sums != 0))
        return pd.DataFrame({"cell": cell[0] * 256 + cell[1], "n": of[cell], "w": sums[cell]})

    cells = learnt.where("kind = 1").groupBy("bucket").applyInPandas(summed, "cell int, n double, w double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).collect()  # 65,536 rows at most
    of, sums = np.zeros(65536), np.zeros(65536)
    for r in cells:
        of[r.cell], sums[r.cell] = r.n, r.w
    top = docs.sparkSession.sparkContext.broadcast(Top.of(of.reshape(256, 256), sums.reshape(256, 256)))

    def answer(known: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """For each asking chunk: counts of its words, or log10 of the probability of its bytes in their contexts."""
        wanted = [unpacked(k, True) for k in asked["keys"]]
        have, n = merged(read(known)) if len(known) else (np.empty(0, np.uint64), np.empty(0, np.int64))
        every, inverse = np.unique(np.concatenate([have, *wanted]), return_inverse=True)
        counts = np.zeros(len(every), np.int64)
        counts[inverse[: len(have)]] = n
        words = not len(asked) or asked["kind"].iloc[0] == 0
        value = counts.astype(np.float64) if words else top.value.log10(every, counts, depth)
        cuts = np.cumsum([len(have), *map(len, wanted)])
        blobs = [packed(value[inverse[cuts[j] : cuts[j + 1]]]) for j in range(len(wanted))]
        return pd.DataFrame({"kind": asked["kind"], "bucket": asked["bucket"], "chunk": asked["chunk"], "keys": asked["keys"], "value": blobs})

    spread = learnt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    by = ["kind", "bucket", "part"]
    replies = spread.groupBy(*by).cogroup(counted.drop("counts").groupBy(*by)).applyInPandas(answer, "kind int, bucket int, chunk long, keys binary, value binary")

    def finish(chunk: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        bodies, held, doc = bodies_of(chunk["body"].iloc[0]), list(chunk["held"].iloc[0]), list(chunk["docs"].iloc[0])

        def values(kind: int) -> tuple[np.ndarray, np.ndarray]:
            """Sorted keys of the chunk and what was answered for each."""
            mine = got[got["kind"] == kind]
            keys = np.concatenate([unpacked(k, True) for k in mine["keys"]])
            order = np.argsort(keys, kind="stable")
            return keys[order], np.concatenate([unpacked(v).view(np.float64) for v in mine["value"]])[order]

        keys, n = values(0)
        log = np.log10((n + 0.5) / (n_train + 0.5 * (n_known + 1)))
        words, known, base = [], [], []
        for group in groups_of(bodies):
            w = Words.of(group)
            own, of = np.searchsorted(keys, w.keys), np.repeat(np.arange(len(group)), w.sizes)
            words.append(w.sizes + 1)
            known.append(np.bincount(of, (n[own] > 0)[w.at], len(group)).astype(np.int64) + int(n[0] > 0))
            base.append(np.bincount(of, log[own][w.at], len(group)) + log[0])
        out = pd.DataFrame({"n_tokens": np.concatenate(words), "n_known": np.concatenate(known), "base_score": np.concatenate(base)})
        keys, value = values(1)
        scores = np.zeros(len(bodies))
        for runs in runs_of(bodies, depth):
            g = grams(runs, depth)
            own = value[np.minimum(np.searchsorted(keys, g.keys), len(keys) - 1)]
            np.add.at(scores, g.text, np.add.reduceat(own[g.at], np.cumsum(g.sizes) - g.sizes))
        size = np.fromiter(map(len, bodies), np.int64, len(bodies)) + 1
        out = out.assign(doc_id=pd.array(doc, "Int64"), held_out=held, train_tokens=n_train, score=scores, bits_per_byte=-scores / np.log10(2) / size)[SCORED]
        del keys, value, bodies
        release()
        return out

    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(finish, ", ".join(f"{c} {t}" for c, t in zip(SCORED, ("long", "boolean", "long", "long", "long", "double", "double", "double"), strict=True)))


SCORED = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
