"""op12: the index against all cosines, votes by hand, held-out accuracy."""

import os
import zlib
from collections import Counter
from math import log

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.llm import toxicity

from .conftest import prose

BAD = ["vuorgo", "vuormi", "zlatek", "zlaton"]


def text_of(i):
    """Every fourth text holds bad words, one in forty words or more."""
    words = prose(3000 + i, 40 + i % 60).split()
    if i % 4 == 0:
        for k in range(0, len(words), 20):
            words[k] = BAD[(i // 4 + k) % 4].upper() if k % 3 else f"{BAD[(i + k) % 4]}!"
    return " ".join(words)


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.createDataFrame([(i, text_of(i)) for i in range(400)], "doc_id long, text string").repartition(4)
    labels = [(i, 0, int(i % 4 == 0)) for i in range(400)]
    return docs, spark.createDataFrame([*labels, (None, 0, 1), (3, 0, None), (4, 0, 7), (8, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def model(labelled):
    return toxicity.fit(*labelled, sample=200)


def test_held_out_accuracy_evidence_and_odd_rows(spark, docs, labelled, model):
    known, labels = labelled
    got = toxicity.classify(known, labels, sample=200).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 50 and all(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    assert all(r.evidence[0].toxic == 1 and any(t[1:4] in ("vuo", "zla") for t in r.terms) for r in held if r.predicted)
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 and r.predicted == 0 for r in odd)
    assert not any(r.held_out for r in odd if r.doc_id is None)
    assert len({r.score for r in odd if r.doc_id in (5, 6, 7)}) == 1
    long = spark.createDataFrame([(1, prose(7, 20_000) + " vuorgo" * 900), (2, "x" * 300_000 + " ZLATEK.")], "doc_id long, text string").withColumns({"score": F.lit(1), "terms": F.lit(2)})
    assert [r.predicted for r in toxicity.score(long, model).orderBy("doc_id").collect()] == [1, 1]


def slow_vector(model, text):
    """Weights of a text's terms by name; `` for all other words."""
    weights = dict(zip(model.lexicon.names.to_pylist(), model.lexicon.weights.tolist(), strict=True))
    words = [w for w in ("".join(c for c in t if c.isalpha()) for t in text.lower().split()) if w]
    counts = Counter()
    for w in words:
        held = [t for t in ["=" + w, *("^" + w[:n] for n in toxicity.HEADS if len(w) >= n)] if t in weights]
        counts.update(held or [""])
    if not set(counts) - {""}:
        return {}
    weights[""] = toxicity.OTHER * float(np.mean(model.lexicon.weights))
    v = {t: log(1 + toxicity.PARTS * n / len(words)) * weights[t] for t, n in counts.items()}
    norm = sum(x * x for x in v.values()) ** 0.5
    return {t: x / norm for t, x in v.items()}


def test_votes_by_hand(labelled, model):
    known, labels = labelled
    y = {r.doc_id: r.toxic for r in labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).collect()}
    learnt = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    assert sorted(model.ids.tolist()) == sorted([*[i for i in learnt if y[i]], *model.ids[model.labels == 0].tolist()]) and (model.labels == 0).sum() == 200
    share = [sum(y[i] == c for i in learnt) / (model.labels == c).sum() for c in (0, 1)]
    every = {int(i): slow_vector(model, text_of(int(i))) for i in model.ids}
    names = [*model.lexicon.names.to_pylist(), ""]
    for i in [k for k in range(0, 400, 7)]:
        start, term, weight = model.lexicon.vectors(pa.array([text_of(i)]))
        v = slow_vector(model, text_of(i))
        assert {names[t]: pytest.approx(w, abs=1e-12) for t, w in zip(term, weight, strict=True)} == v
        if not v:
            continue
        cosine = {j: round(sum(x * u.get(t, 0) for t, x in v.items()), 12) for j, u in every.items()}
        best = sorted((j for j in cosine if cosine[j] > 0), key=lambda j: (-cosine[j], j))[: model.k]
        raw, found, near = model.vote(term, weight)
        assert model.ids[found].tolist() == best and near == pytest.approx([cosine[j] for j in best], abs=1e-9)
        votes = [(cosine[j] ** model.power * share[y[j]], y[j]) for j in best]
        assert raw == pytest.approx(sum(a for a, b in votes if b) / sum(a for a, _ in votes))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 400), st.integers(1, 12), st.integers(1, 30))
def test_block_bounds_lose_nothing(seed, n, n_terms, k):
    rng = np.random.default_rng(seed)
    dense = np.where(rng.random((n, n_terms)) < 0.3, rng.integers(1, 4, (n, n_terms)), 0).astype(float)
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
    of, term = np.nonzero(dense)
    ids = rng.permutation(n).astype(np.int64)
    index = toxicity.Index(np.searchsorted(of, np.arange(n + 1)), term, dense[of, term], ids, n_terms)
    q = np.where(rng.random(n_terms) < 0.5, rng.random(n_terms), 0)
    but = int(rng.integers(-1, n))
    found, cosine = index.nearest(np.flatnonzero(q), q[q > 0], k, but)
    want = dense @ q
    if but >= 0:
        want[but] = 0
    best = sorted((j for j in range(n) if want[j] > 0), key=lambda j: (-round(want[j], 12), ids[j]))[:k]
    assert found.tolist() == best and np.allclose(cosine, want[best])


def test_calibration_rises_and_fits():
    x, y = np.array([0.0, 0.1, 0.1, 0.5, 0.6, 0.9, 1.0]), np.array([0, 0, 1, 1, 0, 1, 1])
    knots, levels = toxicity.rising(x, y, np.ones(7), 0.1, 0.0)
    assert (np.diff(levels) >= 0).all() and np.interp(x, knots, levels) == pytest.approx([0, 0.5, 0.5, 0.5, 0.5, 1, 1])


def test_copies_are_one_example(spark, labelled):
    """A page with hundreds of copies, all toxic, does not make its own words telling."""
    known, labels = labelled
    page = prose(77, 30) + " quexalo"
    copies = spark.createDataFrame([(1000 + i, page) for i in range(300)], known.schema)
    told = spark.createDataFrame([(1000 + i, 0, 1) for i in range(300)], labels.schema)
    model = toxicity.fit(known.unionByName(copies), labels.unionByName(told), sample=200)
    assert "=quexalo" not in model.lexicon.names.to_pylist() and "=vuorgo" in model.lexicon.names.to_pylist()


def test_no_labels_no_documents(docs, none, labelled):
    known, labels = labelled
    assert toxicity.classify(none, labels).count() == 0
    assert {r.score for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert all(r.score < 0.5 for r in toxicity.classify(known.limit(20), labels.where("toxic = 0")).collect())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the driver's tables")
def test_held_out_documents_of_the_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.classify(docs, labels).where("held_out").join(labels, "doc_id").select("toxic", "score", "predicted").collect()
    yes, no = ([r.score for r in got if r.toxic == q] for q in (1, 0))
    area = sum((g > b) + 0.5 * (g == b) for g in yes for b in no) / (len(yes) * len(no))
    print(len(got), area, sum(r.predicted == r.toxic for r in got) / len(got))
    assert area >= 0.96 and sum(r.predicted == r.toxic for r in got) >= 0.985 * len(got)
