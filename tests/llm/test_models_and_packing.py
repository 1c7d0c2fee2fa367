"""op4 and op5."""

import os
import zlib
from collections import Counter
from math import exp, lgamma, log, log10, pi

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orrery.llm import lm, packing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def test_hilbert_is_a_curve():
    for d, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
        key = packing.hilbert(grid, bits)
        assert sorted(key.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("length", [64, 4096])
def test_pieces_round_trip(docs, none, length):
    rows = docs.select("doc_id", "text").collect()
    encoder = Tokenizer.from_file(VOCABULARY)
    want = Counter()  # of every id of every row: its document, all tokens there, its place
    for r in rows:
        ids = [*encoder.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.update((r.doc_id, len(ids), k, i) for k, i in enumerate(ids))
    pieces = packing.pack(docs, VOCABULARY, length, with_ids=True).collect()
    sequences = {}
    for p in pieces:
        assert p.length == len(p.ids) > 0 and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        sequences.setdefault(p.sequence_id, []).append(p)
    for s in sequences.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == [0, *np.cumsum([p.length for p in s])[:-1]]
        total = sum(p.length for p in s)
        assert total <= length and total & (total - 1) == 0
    assert want == Counter((p.doc_id, p.doc_tokens, p.start + k, i) for p in pieces for k, i in enumerate(p.ids))
    assert packing.pack(none, VOCABULARY).count() == 0


def tree_of(texts, depth):
    """Counts of every context and binary decision, and ln P_w of it."""
    counts, children, weighted = {}, {}, {}
    for s in texts:
        s = b"\n" * depth + s
        for j in range(depth, len(s)):
            for d in range(depth + 1):
                for k in range(8):
                    counts.setdefault((s[j - d : j], k, s[j] >> (8 - k)), [0, 0])[s[j] >> (7 - k) & 1] += 1
    for key in counts:
        if key[0]:
            children.setdefault((key[0][1:], *key[1:]), []).append(key)

    def kt(a, b):
        return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - log(pi)

    def pw(key):
        if key not in weighted:
            own = kt(*counts[key])
            weighted[key] = own if len(key[0]) == depth else np.logaddexp(own, sum(map(pw, children[key]))) - log(2)
        return weighted[key]

    def bit(s, j, k, d=0):
        key = (s[j - d : j], k, s[j] >> (8 - k))
        if key not in counts:
            return None
        n = counts[key]
        here = (n[s[j] >> (7 - k) & 1] + 0.5) / (sum(n) + 1)
        deeper = bit(s, j, k, d + 1) if d < depth else None
        if deeper is None:
            return here
        w = exp(kt(*n) - log(2) - pw(key))
        return w * here + (1 - w) * deeper

    def score(s):
        s = b"\n" * depth + s
        return sum(log10(bit(s, j, k) or 0.5) for j in range(depth, len(s)) for k in range(8))

    return score


def test_scores_are_those_of_the_tree(spark, docs, none):
    df = docs.where("doc_id is null or doc_id not in (8, 11)").select("doc_id", "text", "score", "chunk")
    df = df.unionByName(spark.createDataFrame([(16, "Unseen zebra con"), (17, "bata coven \x1c é")], "doc_id long, text string").withColumns({"score": F.lit(""), "chunk": F.lit("")}))
    rows = df.collect()
    norm = lambda t: b" ".join(bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split())
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    train = [norm(r.text) for r in rows if not held(r.doc_id)]
    words = Counter(w for t in train for w in [*t.split(), b"\n"])
    n, v = sum(words.values()), len(words)
    score = tree_of([t + b"\n" for t in train], 6)
    want, seen = {}, set()
    for r in rows:
        t = norm(r.text)
        tokens = [*t.split(), b"\n"]
        base = sum(log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        want[str(r.doc_id), len(tokens), sum(words[w] > 0 for w in tokens)] = (base, score(t + b"\n"), len(t) + 1)
        seen.add(held(r.doc_id))
    assert seen == {True, False}
    got = lm.score(df).collect()
    assert len(got) == len(rows)
    for r in got:
        base, total, size = want[str(r.doc_id), r.n_tokens, r.n_known]
        assert r.train_tokens == n and r.held_out == held(r.doc_id)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(total, rel=1e-9)
        assert r.bits_per_byte == pytest.approx(-total / log10(2) / size, rel=1e-9)
    assert lm.score(none).count() == 0
    parted = lm.score(df.repartition(7), gather=2).collect()  # several parts of a bucket
    assert sorted((str(r.doc_id), r.n_tokens, round(r.score, 6), round(r.base_score, 6)) for r in parted) == sorted((str(r.doc_id), r.n_tokens, round(r.score, 6), round(r.base_score, 6)) for r in got)


@pytest.mark.parametrize("depth", [2, 4, 7])
def test_depths(spark, depth):
    texts = [(i, f"ab abc {i} abcd{'x' * (i % 3)} bcd") for i in range(12)]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    score = tree_of([t.encode() + b"\n" for i, t in texts if not held(i)], depth)
    for r in lm.score(spark.createDataFrame(texts, "doc_id long, text string"), depth=depth).collect():
        assert r.score == pytest.approx(score(dict(texts)[r.doc_id].encode() + b"\n"), rel=1e-9)
    with pytest.raises(ValueError, match="depth"):
        lm.score(spark.createDataFrame(texts, "doc_id long, text string"), depth=8)


def test_runs_join_to_whole_texts():
    rng = np.random.default_rng(5)
    bodies = [bytes(rng.choice(list(b"abc "), n).astype(np.uint8)) for n in (0, 1, 7, 500, 30, 0, 64)]
    for depth in (2, 6):
        want = {}
        for k, b in enumerate(bodies):
            x = b"\n" * depth + b + b"\n"
            want[k] = [int.from_bytes(x[j - depth : j][::-1] + x[j : j + 1], "big") for j in range(depth, len(x))]
        for step in (16, 100, 10_000):
            got = {}
            for runs in lm.runs_of(bodies, depth, step):
                g = lm.grams(runs, depth, table=64)
                assert (np.diff(g.keys.astype(object)) > 0).all()
                for k, part in zip(g.text.tolist(), np.split(g.keys[g.at], np.cumsum(g.sizes)[:-1]), strict=True):
                    got.setdefault(k, []).extend(part.tolist())
            assert got == want
    x = np.sort(rng.integers(0, 1 << 62, 1000)).astype(np.uint64)
    assert (lm.unpacked(lm.packed(x, True), True) == x).all() and len(lm.unpacked(lm.packed(x[:0]))) == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_tree_beats_the_base_on_held_out_text(spark):
    got = lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score").alias("tree"), F.sum("base_score").alias("base")).first()
    assert got.tree > got.base


def test_only_held_out_text(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1]
    df = spark.createDataFrame([(i, "ab cd") for i in ids], "doc_id long, text string")
    for r in lm.score(df).collect():
        assert (r.n_known, r.train_tokens) == (0, 0) and r.score == pytest.approx(6 * 8 * log10(0.5), rel=1e-6)


def test_lgamma():
    x = np.array([0.5, 1, 1.5, 7, 1000.5, 1e9])
    assert np.allclose(lm.lgamma(x), [lgamma(v) for v in x], rtol=1e-12, atol=1e-11)
