"""Packing along a space-filling curve: hashed document vectors, few dimensions, Hilbert keys, range sort, cuts."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._common import bound_batches, materialise, release, steps_of, width

#: Entries of a worker's store of tokenised words; beyond that it starts anew.
STORED_WORDS = 1_500_000
#: Words that the normaliser leaves as they are and the splitter never cuts: lower-case letters that nothing composes with.
PLAIN = "[a-zß-öø-ÿ]"
#: Marks that the splitter always parts from a letter before them.
MARKS = "[.,;:!?*$%&#|]"
# The normaliser and the splitter of tokenizer files whose texts may be cut at ASCII white space first.
NORMALISER = ["NFC", "Replace", "Lowercase"]
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_workers: dict[str, Tokens] = {}


class Tokens:
    """Ids of whole texts by a tokenizer file.

    If its normaliser and splitter are those above, they never look across ASCII white space: a text is then lowered
    and cut there and between a plain letter and a mark, each distinct word is encoded once a worker, and texts gather
    their words' ids. A plain word is one piece, so many of them go to the encoder as one text, and the ends of words
    in its ids part them again. All other words are encoded by themselves with the whole file. Texts that hold a special
    token's opening keep their case, as such tokens are matched before the normaliser lowers it, and their marks in
    place. Other files encode each text as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.encoder = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.encoder.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        file = json.loads(self.encoder.to_str())
        kinds = [n["type"] for n in (file["normalizer"] or {}).get("normalizers", [])]
        splits = [s.get("pattern", {}).get("Regex") for s in (file["pre_tokenizer"] or {}).get("pretokenizers", [])]
        suffix = file["model"].get("end_of_word_suffix")
        self.by_word = kinds == NORMALISER and splits == [SPLITTER, None] and bool(suffix)
        if self.by_word:
            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = None
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.final = np.zeros(self.encoder.get_vocab_size(), bool)
            self.final[[i for t, i in file["model"]["vocab"].items() if t.endswith(suffix)]] = True
            self.clear()

    def clear(self) -> None:
        """Words, where their ids begin in the pool and how many they are; the empty word has none."""
        self.words, self.pool = pa.array([""]), np.empty(0, self.dtype)
        self.starts, self.lengths = np.zeros(1, np.int32), np.zeros(1, np.int32)

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after another, each encoded by itself, and how many each has."""
        got = [e.ids for e in self.encoder.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(got), self.dtype), np.fromiter(map(len, got), np.int32, len(got))

    def joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of plain words, encoded together."""
        ids = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.nonzero(self.final[ids])[0]
        if len(ends) != len(words) or ends[-1] != len(ids) - 1:  # a vocabulary that lacks the end of some letter
            return self.each(words)
        return ids, np.diff(ends, prepend=-1).astype(np.int32)

    def learn(self, new: pa.Array, group: int = 1000) -> None:
        """Adds words that are not stored yet."""
        plain = pc.match_substring_regex(new, f"^{PLAIN}+$")
        for some, encode in ((new.filter(plain), self.joined), (new.filter(pc.invert(plain)), self.each)):
            words = some.to_pylist()
            got = [encode(words[k : k + group]) for k in range(0, len(words), group)]
            if got:
                ids, sizes = (np.concatenate(c) for c in zip(*got, strict=True))
                self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes, dtype=np.int32) - sizes])
                self.lengths, self.pool = np.concatenate([self.lengths, sizes]), np.concatenate([self.pool, ids])
                self.words = pa.concat_arrays([self.words, some])

    def numbers(self, distinct: pa.Array) -> np.ndarray:
        """Places in the store of distinct words, which are learnt if need be."""
        at = pc.index_in(distinct, value_set=self.words)
        if at.null_count:
            if len(self.words) + at.null_count > STORED_WORDS:
                self.clear()
                at = pc.index_in(distinct, value_set=self.words)
            known = len(self.words)
            new = distinct.filter(pc.is_null(at))
            self.learn(new)
            at = pc.if_else(pc.is_null(at), pc.add(pc.index_in(distinct, value_set=self.words[known:]), known), at)
        return at.to_numpy(zero_copy_only=False).astype(np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and how many each has. Null texts are empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.by_word or not len(texts):
            return self.each(texts.to_pylist())
        low = pc.replace_substring_regex(pc.ascii_lower(texts), f"({PLAIN})({MARKS})", r"\1 \2")
        split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, low))
        cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
        words = split.flatten().dictionary_encode()
        at = self.numbers(words.dictionary)[words.indices.to_numpy()]
        sizes = self.lengths[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.pool[np.repeat(self.starts[at] - ends[:-1].astype(np.int32), sizes) + np.arange(ends[-1], dtype=np.int32)]
        return ids, np.diff(ends[cuts])


def tokens_of(path: str) -> Tokens:
    """One per worker process."""
    return _workers.setdefault(path, Tokens(path)) if path not in _workers else _workers[path]


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (n, d) with `bits` bits an axis, by Skilling's transform (2004)."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_key(ids: np.ndarray, sizes: np.ndarray, buckets: int, dims: int, bits: int) -> np.ndarray:
    """Hilbert keys of documents, whose ids stand one after another: token ids hashed to signed buckets, root counts, a
    fixed projection, equal steps."""
    mix = np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    slot, sign = ((mix >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32), np.where((mix >> np.uint64(63)) > 0, 1, -1).astype(np.int8)
    vectors, ends = np.zeros((len(sizes), buckets)), np.cumsum(sizes)
    for k, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
        low = ids[a:b] & 0xFFFF
        vectors[k] = np.bincount(slot[low], weights=sign[low], minlength=buckets)
    vectors = np.sign(vectors) * np.sqrt(np.abs(vectors))
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    axes = np.random.default_rng(20).standard_normal((buckets, dims))
    steps = np.clip((np.tanh(vectors @ axes) + 1) / 2 * (1 << bits), 0, (1 << bits) - 1)
    return hilbert(steps.astype(np.int64), bits)


def tokenised(docs: DataFrame, tokenizer: str, eos: int, id_col: str = "doc_id", text_col: str = "text", buckets: int = 256, dims: int = 3, bits: int = 12) -> DataFrame:
    """curve (Hilbert key), doc, n (tokens), ids (little-endian, as wide as the vocabulary needs, with eos last); a row for each row of docs."""
    bound_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk = tokens_of(tokenizer)
        end = np.array([eos], tk.dtype)
        for part in steps_of(batches, 1):
            ids, sizes = tk.encode(part.column(1))
            keys = curve_key(ids, sizes, buckets, dims, bits)
            ends = np.cumsum(sizes)
            blobs = [np.concatenate([ids[b - n : b], end]).tobytes() for n, b in zip(sizes.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys), part.column(0), pa.array(sizes + 1), pa.array(blobs, pa.binary())], ["curve", "doc", "n", "ids"])
        release()

    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc", f"`{text_col}` as text").mapInArrow(run, "curve long, doc long, n long, ids binary")


def pack(docs: DataFrame, tokenizer: str, length: int = 4096, eos: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Packs whole documents into sequences of at most `length` tokens, neighbours on the curve together.

    Documents are range-sorted by (Hilbert key, id), and each range is one stream cut every `length` tokens. The
    last, incomplete sequence of a range is cut into powers of two, so no sequence needs padding. Copies have one
    key; ties are ordered by id, so a range may end inside a group of copies.

    Null and empty texts: one token, the end token. Null ids come first and are kept. Repeated rows: each row is a
    document of its own. An empty table gives no rows. Other columns of docs are not read.
    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if with_ids), a row a piece.
    """
    wide = tokens_of(tokenizer).dtype
    table = materialise(tokenised(docs, tokenizer, eos, id_col, text_col), "tokens")
    sorted_ = table.repartitionByRange(width(docs), "curve", "doc").sortWithinPartitions("curve", "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, count = TaskContext.get().partitionId() << 32, 0
        open_: list[tuple] = []  # pieces of the open sequence: doc, start, ids, all tokens of the document
        filled = 0
        rows: list[tuple] = []

        def close(pieces: list[tuple]) -> None:
            nonlocal count
            offset = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, base + count, offset, ids))
                offset += len(ids)
            count += 1

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in cols[7]], pa.list_(pa.int32())))
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, NAMES + ["ids"] * with_ids)

        for batch in batches:
            for doc, blob in zip(*(batch.column(c).to_pylist() for c in (1, 3)), strict=True):
                ids, at = np.frombuffer(blob, wide), 0
                while at < len(ids):
                    take = min(length - filled, len(ids) - at)
                    open_.append((doc, at, ids[at : at + take], len(ids)))
                    at, filled = at + take, filled + take
                    if filled == length:
                        close(open_)
                        open_, filled = [], 0
            if rows:
                yield batch_of()
        while open_:
            room, pieces, rest = 1 << (filled.bit_length() - 1), [], []
            filled -= room
            for doc, start, ids, total in open_:
                take = min(room, len(ids))
                if take:
                    pieces.append((doc, start, ids[:take], total))
                if take < len(ids):
                    rest.append((doc, start + take, ids[take:], total))
                room -= take
            close(pieces)
            open_ = rest
        if rows:
            yield batch_of()

    return sorted_.mapInArrow(run, ", ".join(f"{n} long" for n in NAMES) + ", ids array<int>" * with_ids)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
