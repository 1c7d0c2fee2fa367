"""op11: against a tree built in a loop."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from orrery.llm import manifest

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, **other):
    told = [other.get(f, row[f]) for f in FIELDS]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in told))


def fold(nodes, at, value, fanout):
    """Siblings of a node on its way to the root, and what a value in its place folds to."""
    beside = []
    while len(nodes) > 1:
        first = at // fanout * fanout
        run = nodes[first : first + fanout]
        left, right = run[: at - first], run[at - first + 1 :]
        beside += left + right
        value = sha("".join([*left, value, *right]))
        nodes = [sha("".join(nodes[k : k + fanout])) for k in range(0, len(nodes), fanout)]
        at //= fanout
    return beside, value, nodes[0]


def brute(rows, fanout, lowered):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    held = {s: sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for s in names}
    subroots = [fold([leaf(r) for r in held[s]], 0, "", fanout)[2] for s in names]
    out = []
    for nr, s in enumerate(names):
        leaves = [leaf(r) for r in held[s]]
        for at, r in enumerate(held[s]):
            own = leaf(r, text=lowered(r["text"])) if r["text"] is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 else leaves[at]
            a, value, _ = fold(leaves, at, own, fanout)
            b, value, root = fold(subroots, nr, value, fanout)
            out.append((r["doc_id"], leaves[at], subroots[nr], root, sha("".join(a + b)), value, value == root))
    return sorted(map(repr, out))


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def audited(docs, **how):
    claim = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, {"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")})
    return sorted(repr(tuple(r)) for r in manifest.audit(docs, claim=claim, **how).collect())


@pytest.mark.parametrize(("fanout", "inner"), [(16, 2), (3, 1), (2, 3)])
def test_trees(spark, fanout, inner):
    sizes = {None: 3, "": 1, "hot": 700, "Hot": 16, "é": 17, "z": 2, "b": 257, "c": 256, **{f"s{k}": 1 + k % 4 for k in range(25)}}
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            i += 1
            rows.append(((i * 7919) % 5003, s, None if i % 11 == 0 else "en", None if i % 13 == 0 else i, None if i % 17 == 0 else "" if i % 19 == 0 else f"Text É {i % 40}"))
    rows += [rows[5]] * 3 + [(rows[5][0], rows[5][1], "x", 1, "other"), (None, "hot", "en", 1, "No Id"), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    want = brute([r.asDict() for r in docs.collect()], fanout, lower)
    got = audited(docs.withColumns({c: F.lit(1) for c in ("grp", "bucket", "at", "i", "leaf", "b", "h", "span")}), fanout=fanout, inner=inner)
    assert got == want
    assert any("False" in r for r in got) and any("True" in r for r in got)


def test_odd_rows(docs):
    assert audited(docs) == brute([r.asDict() for r in docs.select(*FIELDS).collect()], 16, lower)


def test_proofs_are_the_siblings(docs):
    for r in manifest.audit(docs, siblings=True).collect():
        assert r.verified and r.folded_root == r.root and sha(r.proof) == r.proof_sha256


def test_one_row_and_none(docs, none):
    one = docs.where("doc_id = 1")
    got = manifest.audit(one).collect()
    assert [(r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in got] == [(got[0].leaf,) * 3 + (sha(""), True)]
    assert manifest.audit(none).count() == 0
