"""Repeated single lines of many words, in the pipeline's line dedup."""

import random

import corpus_pipeline
from orrery.llm import lines

from .conftest import prose


def test_planted_passage(spark):
    """A passage on one line goes from all documents but the first; shorter single lines stay."""
    passage, short = prose(700, 50), prose(701, 49)
    rows = [(1, f"a\n{passage}\nb"), (2, f"c\n  {passage} \nd"), (3, passage), (4, f"e\n{short}"), (5, f"f\n{short}\ng"), (6, f"{passage}\nh\n{passage}"), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, df, "").collect()}
    assert got == {**dict(rows), 2: "c\nd", 3: "", 6: "h"}
    counted = {r.doc_id: r.n_deleted for r in lines.dedup_lines(df, counts=True, long_words=50).collect()}
    assert counted == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0, 6: 2, 7: 0, 8: 0}
    assert {r.doc_id: r.text for r in lines.dedup_lines(df).collect()} == dict(rows)


def test_both_rules(spark):
    """Against brute force, where long lines stand in repeated runs and alone."""
    rng = random.Random(4)
    pool = [prose(800 + k, rng.choice([3, 49, 50, 90])) for k in range(9)] + ["", " "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(30)]
    first, want = {}, {}
    for i, text in rows:
        parts = text.split("\n")
        full, gone = [k for k, p in enumerate(parts) if p.strip(" ")], set()
        for w in (1, 2):
            for j in range(len(full) - w + 1):
                key = tuple(parts[k].strip(" ") for k in full[j : j + w])
                if (w == 2 or len(key[0].split()) >= 50) and first.setdefault(key, (i, j)) != (i, j):
                    gone.update(full[j : j + w])
        want[i] = "\n".join(p for k, p in enumerate(parts) if k not in gone)
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), long_words=50)
    assert {r.doc_id: r.text for r in got.collect()} == want


def test_many_lines_in_one_text(spark):
    """Time grows as the number of lines, not as its square."""
    n = 20_000
    text = "\n".join(f"line {i}" for i in range(n))
    df = spark.createDataFrame([(1, text), (2, text + "\nend"), (3, "\n".join(f"line {i if i % 3 else -i}" for i in range(n)))], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_deleted, r.text) for r in lines.dedup_lines(df, counts=True).collect()}
    assert got[1] == (n, 0, text) and got[2] == (n + 1, n, "end")
    kept = got[3][2].split("\n")
    assert got[3][1] == n - len(kept) and set(kept) == {f"line -{i}" for i in range(3, n, 3)} | {f"line {n - 1}"}


def test_fingerprints_are_window_minima(spark):
    rng = random.Random(5)
    text = "\n".join(rng.choice(["a", "b", "c", "", "d", "e"]) for _ in range(60))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    full = [p for p in text.split("\n") if p]
    hashes = [r.h for r in spark.createDataFrame([(i, p) for i, p in enumerate(full)], "i int, p string").selectExpr("i", "xxhash64(p) as h").orderBy("i").collect()]
    for w in (1, 2, 4):
        want = {}
        for i in range(len(full) - w + 1):
            pos = max(range(i, i + w), key=lambda k: (-hashes[k], k))
            want.setdefault(pos + 1, []).append(i + 1)
        got = {r.pos: r for r in lines.fingerprints(df, w).collect()}
        assert {p: (r.low, r.first, len(r.lines) - w + 1) for p, r in got.items()} == {p: (hashes[p - 1], v[0], len(v)) for p, v in want.items()}
