"""op3, op9, op10 against brute force."""

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from orrery.llm import lines, simhash, suffixes

from .conftest import prose


def simprint(text, k=4):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, radius=4):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    every = sorted(set(prints))
    for i, a in enumerate(every):
        for b in every[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {p: find(p) for p in every}


def test_simhash_components(docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [simprint(r.text) for r in rows]
    of = groups(prints)
    least = {}
    for r, p in zip(rows, prints, strict=True):
        if r.doc_id is not None:
            least[of[p]] = min(r.doc_id, least.get(of[p], r.doc_id))
    want = sorted((str(r.doc_id), f"{p:016x}", str(least.get(of[p]))) for r, p in zip(rows, prints, strict=True))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == want


def test_tiles_against_all_pairs(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(60)] + [0, 2**64 - 1]
    values = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) if i % 2 else b for i, b in enumerate(base * 12)}
    values = {v & (2**64 - 1) for v in values}
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    df = spark.createDataFrame(signed, "fp long")
    links = [(a.a % 2**64, a.b % 2**64) for a in simhash.near_links(df, 4, block=32).collect()]
    assert all(0 < (a ^ b).bit_count() for a, b in links)
    want, have = groups(values), groups([])
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        root[find(a)] = find(b)
    have = {v: find(v) for v in values}
    pairs = lambda d: {frozenset(v for v in d if d[v] == r) for r in set(d.values())}
    assert pairs(want) == pairs(have)


def test_one_of_each_stays(docs, none):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert 1 in ids and 2 not in ids and 4 in ids and ids.count(12) == 2 and 13 not in ids
    assert simhash.keep_one(none).count() == 0 and simhash.near_duplicates(none).count() == 0


def brute_lines(rows, w):
    """Texts without lines of windows that stand earlier."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    first, out = {}, {}
    for n, (i, text) in enumerate(order):
        if text is None:
            out[n] = (i, None)
            continue
        parts = text.split("\n")
        full = [k for k, p in enumerate(parts) if p.strip(" ")]
        gone = set()
        for j in range(len(full) - w + 1):
            key = tuple(parts[k].strip(" ") for k in full[j : j + w])
            if first.setdefault(key, (i, text, j)) != (i, text, j):
                gone.update(full[j : j + w])
        out[n] = (i, "\n".join(p for k, p in enumerate(parts) if k not in gone))
    return sorted(out.values(), key=repr)


@pytest.mark.parametrize("w", [1, 2, 3])
def test_lines(spark, docs, w):
    rng = random.Random(w)
    pool = [prose(900 + k, 3) for k in range(6)] + ["", " "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(40)] + [(40, None), (41, "\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("low", F.lit(1))
    got = lines.dedup_lines(df, w)
    assert got.columns == df.columns
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=repr) == brute_lines(rows, w)


def test_lines_odd_rows(docs, none):
    got = lines.dedup_lines(docs, counts=True).collect()
    assert len(got) == docs.count() and lines.dedup_lines(none).count() == 0
    by = {r.doc_id: r for r in got if r.doc_id not in (None, 12)}
    assert by[5].text is None and by[6].text == "" and by[9].n_deleted == 0
    assert by[10].n_deleted == 4 and by[10].text.count("\n") == 2
    assert [r.text for r in got if r.doc_id == 12] == ["one", "one"]


def test_runs_are_maximal(spark):
    block = [prose(k, 4) for k in range(5)]
    rows = [(1, "\n".join(block)), (2, "\n".join(["x", *block, "y"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    runs = lines.repeated_runs(lines.repeated_windows(df, 2), 2).collect()
    assert [(r.doc, r.start, r.lines, r.from_doc, r.from_start) for r in runs] == [(2, 2, 5, 1, 1)]


def brute_bytes(rows, length):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    least = {}
    for i, text in order:
        b = (text or "").encode()
        key = -1 if i is None else i
        for j in range(len(b) - length + 1):
            least.setdefault(b[j : j + length], key)
    out = []
    for i, text in order:
        b, key = (text or "").encode(), -1 if i is None else i
        dead = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if least[b[j : j + length]] < key:
                dead[j : j + length] = b"\1" * length
        kept = bytes(c for c, d in zip(b, dead, strict=True) if not d)
        spans = sum(d and not (k and dead[k - 1]) for k, d in enumerate(dead))
        out.append((str(i), len(b), sum(dead), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_substrings(spark, docs, none):
    rng = random.Random(6)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").where("doc_id is null or doc_id <> 8").collect()]
    passage = prose(77, 12)
    for i in range(100, 140):
        a = rng.randint(0, 40)
        rows.append((i, prose(i, 20) + passage[a : a + rng.randint(30, 80)] + "ab" * rng.randint(0, 60) + prose(i % 7, 15)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = suffixes.dedup_substrings(df.withColumns({"chunk": F.lit(1), "body": F.lit("x")}))
    assert sorted((str(r.doc_id), *r[1:]) for r in got.collect()) == brute_bytes(rows, 50)
    assert suffixes.dedup_substrings(none).count() == 0
    long = suffixes.dedup_substrings(docs, with_text=True).where("doc_id = 8").first()
    assert long.n_removed == 0 and len(long.kept) == long.n_bytes


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"ab\0", bytes(range(256))])
def test_suffix_arrays(alphabet):
    rng = random.Random(len(alphabet))
    for _ in range(40):
        s = bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 90)))
        x = np.frombuffer(s, np.uint8)
        order = suffixes.suffix_array(x)
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        common = suffixes.common_prefixes(x, order, 200, stride=rng.choice([1, 5, 32]))
        for k in range(1, len(s)):
            a, b = s[order[k - 1] :], s[order[k] :]
            assert common[k] == next((m for m, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))


def test_equal_windows_have_equal_names():
    rng = random.Random(8)
    text = bytes(rng.choice(b"abcd ") for _ in range(400))
    a, b = b"x" * 70 + text, text + b"y" * 33
    named = []
    for t in (a, b):
        first, last, name = suffixes.minima(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]), 50, step=64)
        named.append({i: n for f, e, n in zip(first, last, name, strict=True) for i in range(f, e + 1)})
    assert all(named[0][70 + i] == named[1][i] for i in range(351))


def test_segments_that_can_meet():
    rng = random.Random(9)
    base = [bytes(rng.choice(b"abcdefgh ") for _ in range(200)) for _ in range(4)]
    pieces = set()
    for t in [*base, *(b[:k] + b"#" + b[k + 1 :] for b in base for k in (60, 95, 130)), bytes(rng.choice(b"xyz") for _ in range(150))]:
        first, last, _ = suffixes.minima(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]), 50)
        pieces |= {t[a : b + 50] for a, b in zip(first, last, strict=True)}
    pieces = sorted(pieces)
    windows = [{s[i : i + 50] for i in range(len(s) - 49)} for s in pieces]
    shares = [any(w & v for j, v in enumerate(windows) if j != i) for i, w in enumerate(windows)]
    met = suffixes.meeting(pieces, 50)
    assert any(shares) and not met.all() and all(m for m, s in zip(met, shares, strict=True) if s)


def test_texts_are_read_in_place(spark, docs, capsys):
    """Replies come to the chunks' table by its buckets; texts are not shuffled to them, and shuffles go when they were read."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    left = lambda: {n for n in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in n}
    before = left()
    got = suffixes.dedup_substrings(docs)
    for _ in range(50):
        if not left() - before:
            break
        time.sleep(0.1)
    assert not left() - before
    got.explain()
    plan = capsys.readouterr().out
    assert plan.count("Bucketed: true") == 1 and plan.count("Exchange hashpartitioning") == 1
