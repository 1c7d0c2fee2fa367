"""Toxicity by nearest labelled examples: exact TF-IDF cosines from a block-max inverted index, weighted votes, evidence."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bound_batches, materialise, release
from .quality import held_out

#: Lengths of the word beginnings that are terms beside whole words.
HEADS = (3, 4, 5, 6, 7, 8)
#: A term's frequency counts as ln(1 + PARTS x its share of the words); all other words are one term, whose weight is OTHER times the mean.
PARTS, OTHER = 300, 3
#: Examples of a block of the index.
BLOCK = 64


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of texts, the word of each token (-1 for none), and the text of each token. Words are in lower case,
    parted by ASCII white space, and only their letters count."""
    split = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    flat = split.flatten().dictionary_encode()
    plain = pc.replace_substring_regex(flat.dictionary, r"\PL+", "").dictionary_encode()
    words = plain.dictionary
    code = plain.indices.to_numpy()[flat.indices.to_numpy()] if len(flat) else np.empty(0, np.int64)
    blank = pc.index(words, "").as_py()
    code = np.where(code == blank, -1, code) if blank >= 0 else code
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    return words, code.astype(np.int64), text


def terms(words: pa.Array) -> Iterator[pa.Array]:
    """The terms of each word, an array for each kind: the whole word behind `=`, beginnings behind `^`, null if a word is shorter."""
    yield pc.binary_join_element_wise("=", words, "")
    long = pc.utf8_length(words)
    for n in HEADS:
        yield pc.if_else(pc.greater_equal(long, n), pc.binary_join_element_wise("^", pc.utf8_slice_codeunits(words, 0, n), ""), pa.scalar(None, words.type))


def frequencies(texts: pa.Array, label: np.ndarray) -> pa.RecordBatch:
    """term, toxic, clean: in how many of the texts of either label each term stands."""
    words, code, text = tokens(texts)
    pair = np.unique(code[code >= 0] * len(texts) + text[code >= 0])  # each word once a text
    word, text = pair // max(len(texts), 1), pair % max(len(texts), 1)
    out = []
    for kind in terms(words):
        held = kind.dictionary_encode()
        at = pc.fill_null(held.indices, -1).to_numpy()[word]
        each = np.unique(at[at >= 0].astype(np.int64) * len(texts) + text[at >= 0])
        yes = label[each % max(len(texts), 1)] == 1
        n = len(held.dictionary)
        counts = [np.bincount(each[m] // max(len(texts), 1), minlength=n) for m in (yes, ~yes)]
        out.append((held.dictionary, *counts))
    return pa.RecordBatch.from_arrays([pa.concat_arrays([t for t, _, _ in out]), *(pa.array(np.concatenate([o[k] for o in out]), pa.int64()) for k in (1, 2))], ["term", "toxic", "clean"])


@dataclass
class Lexicon:
    """Terms that tell the labels apart, with their weights."""

    names: pa.Array
    weights: np.ndarray

    def vectors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit TF-IDF vectors of whole texts: where each one's entries begin, their terms in order, their weights. Words
        that are in none of the terms count as one last term together; texts of such words only have no vector."""
        words, code, text = tokens(texts)
        many, real = len(self.names) + 1, code >= 0
        found, other = [], real.copy()
        for kind in terms(words):
            at = pc.fill_null(pc.index_in(kind, value_set=self.names), -1).to_numpy(zero_copy_only=False)
            here = np.where(real, at[code], -1) if len(code) else code
            other &= here < 0
            found.append(text[here >= 0] * many + here[here >= 0])
        entry, n = np.unique(np.concatenate(found), return_counts=True)
        rest = np.bincount(text[other], minlength=len(texts))
        more = np.unique(entry // many)
        more = more[rest[more] > 0]
        entry, n = np.concatenate([entry, more * many + many - 1]), np.concatenate([n, rest[more]])
        order = np.argsort(entry)
        of, term, n = entry[order] // many, entry[order] % many, n[order]
        size = np.bincount(text[real], minlength=len(texts))
        weights = np.append(self.weights, OTHER * self.weights.mean() if len(self.weights) else 0.0)
        w = np.log1p(PARTS * n / size[of]) * weights[term]
        norm = np.sqrt(np.bincount(of, w * w, minlength=len(texts)))
        return np.searchsorted(of, np.arange(len(texts) + 1)), term, w / norm[of] if len(of) else w


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for size[0] numbers, then those of the next, one after another."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Index:
    """Postings of the examples' terms in blocks of examples, with the greatest weight of each term in each block."""

    def __init__(self, start: np.ndarray, term: np.ndarray, weight: np.ndarray, ids: np.ndarray, n_terms: int):
        n = len(ids)
        strongest = np.array([term[a:b][np.argmax(weight[a:b])] if b > a else n_terms for a, b in zip(start[:-1], start[1:], strict=True)], np.int64)
        order = np.lexsort((ids, strongest))  # like examples share blocks, which makes their bounds tight
        order = order[strongest[order] < n_terms]
        place = np.full(n, -1)
        place[order] = np.arange(len(order))
        self.example, self.ids, self.place = order, ids[order], place
        self.blocks = -(-len(order) // BLOCK)
        at = place[np.repeat(np.arange(n), np.diff(start))]
        cell = term * max(self.blocks, 1) + at // BLOCK
        by = np.lexsort((at, cell))
        self.at, self.weight = at[by], weight[by]
        self.first = np.searchsorted(cell[by], np.arange(n_terms * self.blocks + 1)).astype(np.int64)
        self.most = np.zeros(n_terms * self.blocks)
        np.maximum.at(self.most, cell, weight)
        self.most = self.most.reshape(n_terms, self.blocks)

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, but: int = -1, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Examples (their numbers) with the k greatest positive cosines, greatest first, ties to the lesser id, and the cosines.

        Blocks are taken in order of their bounds, `step` and then twice as many at a time, until the next bound is below the k-th cosine: no example
        that could be among them is left out. but: the number of an example that takes no part.
        """
        bound = weight @ self.most[term] if self.blocks else np.empty(0)
        queue = np.argsort(-bound, kind="stable")
        queue = queue[bound[queue] > 0]
        scores, kth, a = np.zeros(self.blocks * BLOCK), 0.0, 0
        while a < len(queue) and bound[queue[a]] >= kth - 1e-12:
            blocks = queue[a : a + step]
            cell = (term[:, None] * self.blocks + blocks).ravel()
            size = self.first[cell + 1] - self.first[cell]
            at = ranges(self.first[cell], size)
            scores += np.bincount(self.at[at], np.repeat(np.repeat(weight, len(blocks)), size) * self.weight[at], len(scores))
            if but >= 0:
                scores[self.place[but]] = 0
            a, step = a + step, 2 * step
            kth = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else 0.0
        found = np.flatnonzero(scores > 0)
        best = found[np.lexsort((self.ids[found], -np.round(scores[found], 12)))[:k]]
        return self.example[best], scores[best]


def rising(x: np.ndarray, y: np.ndarray, w: np.ndarray, prior: float, doubt: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a function that never falls and fits the mean of y, weighted by w, at x: adjacent means that fall are pooled.
    `doubt` examples of the prior's share stand in each pool."""
    pools: list[list[float]] = []
    for v in np.unique(x):
        here = x == v
        pools.append([float(v), float(v), float((w * y)[here].sum()), float(w[here].sum())])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, high, wy, ww = pools.pop()
            pools[-1][1:] = [high, pools[-1][2] + wy, pools[-1][3] + ww]
    knots = [(at, (wy + doubt * prior) / (ww + doubt)) for low, high, wy, ww in pools for at in (low, high)]
    return np.array([a for a, _ in knots]), np.maximum.accumulate(np.array([b for _, b in knots])) if knots else np.empty(0)


@dataclass
class Model:
    """Lexicon, index of the examples with their ids, labels and the weight of each one's vote, and what makes votes scores."""

    lexicon: Lexicon
    index: Index | None
    ids: np.ndarray
    labels: np.ndarray
    votes: np.ndarray
    knots: np.ndarray
    levels: np.ndarray
    base: float
    k: int
    power: float

    @classmethod
    def fit(cls, lexicon: Lexicon, start: np.ndarray, term: np.ndarray, weight: np.ndarray, ids: np.ndarray, labels: np.ndarray, prior: dict[int, int], k: int, power: float) -> Model:
        """prior: labelled rows of each class, of which the examples are a sample. Votes are made scores by what the examples get
        from all others."""
        share = np.array([prior[c] / max(1, int((labels == c).sum())) for c in (0, 1)])
        votes = share[labels] if len(labels) else np.empty(0)
        every = sum(prior.values())
        known = prior[1] / every if every else 0.5
        without = np.diff(start) == 0
        base = (float((votes * labels)[without].sum()) + known) / (float(votes[without].sum()) + 1)
        model = cls(lexicon, None, ids, labels, votes, np.empty(0), np.empty(0), base, k, power)
        if len(ids) and not without.all():
            model.index = Index(start, term, weight, ids, len(lexicon.names) + 1)
            own = np.flatnonzero(~without)
            raw = np.array([model.vote(term[start[i] : start[i + 1]], weight[start[i] : start[i + 1]], int(i))[0] for i in own])
            told = ~np.isnan(raw)
            model.knots, model.levels = rising(raw[told], labels[own][told], votes[own][told], known)
        return model

    def vote(self, term: np.ndarray, weight: np.ndarray, but: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        """Share of toxic ones in the votes of the nearest examples (nan for none), these, and their cosines."""
        near, cosine = self.index.nearest(term, weight, self.k, but)
        vote = cosine**self.power * self.votes[near]
        return (float((vote * self.labels[near]).sum() / vote.sum()) if len(near) else float("nan")), near, cosine

    def scores(self, texts: pa.Array, shown: int = 3) -> tuple[np.ndarray, list[list[dict]], list[list[str]]]:
        """Scores of whole texts, and for each its nearest examples and the terms that weigh most."""
        start, term, weight = self.lexicon.vectors(texts)
        out, near, told = np.full(len(texts), self.base), [[] for _ in range(len(texts))], [[] for _ in range(len(texts))]
        for i in np.flatnonzero(np.diff(start) > 0) if self.index is not None else ():
            t, w = term[start[i] : start[i + 1]], weight[start[i] : start[i + 1]]
            raw, found, cosine = self.vote(t, w)
            if len(found):
                out[i] = np.interp(raw, self.knots, self.levels) if len(self.knots) else raw
            near[i] = [{"doc_id": int(self.ids[j]), "toxic": int(self.labels[j]), "cosine": float(c)} for j, c in zip(found[:shown], cosine[:shown], strict=True)]
            named = t < len(self.lexicon.names)
            told[i] = self.lexicon.names.take(pa.array(t[named][np.argsort(-w[named], kind="stable")[:shown]])).to_pylist()
        return np.clip(out, 0, 1), near, told


def choose(counts: DataFrame, examples: dict[int, int], least: int, most: int, odds_ratio: float) -> Lexicon:
    """The terms of `counts` (term, toxic, clean) whose counts differ between the labels beyond chance, and by much.

    A term stays if its log-likelihood ratio is over 2 ln of the number of terms in `least` examples or more, at which
    about one term in all would stay by chance, and the 95 % interval of its odds ratio is beyond `odds_ratio`: with many
    examples the words of a language that has a few toxic texts more would stay, too. Its weight is its inverse
    document frequency times the lower end of the interval of its log odds ratio. Of more than `most`, those with the greatest ratios stay: the bound of what comes to the driver.
    """
    yes, no = examples[1], examples[0]
    a, c = F.col("toxic"), F.col("clean")
    tell = lambda n, e: F.when(n > 0, n * F.log(n / e)).otherwise(F.lit(0.0))
    expected = lambda total: (a + c) * (total / (yes + no))
    absent = lambda total: (F.lit(yes + no) - a - c) * (total / (yes + no))
    ratio = 2 * (tell(a, expected(yes)) + tell(c, expected(no)) + tell(F.lit(yes) - a, absent(yes)) + tell(F.lit(no) - c, absent(no)))
    rows = counts.where((a + c >= least) & (a + c < yes + no))
    n = max(rows.count(), 2)
    odds = F.log(((a + 0.5) * (F.lit(no + 0.5) - c)) / ((c + 0.5) * (F.lit(yes + 0.5) - a)))
    error = F.sqrt(1 / (a + 0.5) + 1 / (c + 0.5) + 1 / (F.lit(yes + 0.5) - a) + 1 / (F.lit(no + 0.5) - c))
    low = F.abs(odds) - 1.96 * error
    weight = (F.log(F.lit(yes + no + 1.0) / (a + c + 1)) + 1) * low
    rows = rows.where(low > log(odds_ratio)).select("term", ratio.alias("ratio"), weight.alias("weight")).where(F.col("ratio") > 2 * log(n))
    kept = sorted((r.term, r.weight) for r in rows.orderBy(F.desc("ratio"), "term").limit(most).collect())
    return Lexicon(pa.array([t for t, _ in kept], pa.string()), np.array([w for _, w in kept], np.float64))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, most: int = 4096, least: int = 4, odds_ratio: float = 3.0, k: int = 15, power: float = 2.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from at most `sample` distinct labelled texts of each class outside the held-out fold, those with the least hashes.

    `sample` and `most` terms bound the model, which is broadcast: at most 2 x sample examples of most entries each, and
    in practice some MB. One task makes it from the examples' vectors, so the driver gets the model and the lexicon alone. The
    share of each class in all labelled rows weights its votes. Labels other than 0 and 1 and null ids are left out; an
    id labelled twice counts with its greatest label; a text that several rows share is one example for each label.
    """
    bound_batches(docs)
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = materialise(known.where(~held_out("id")).groupBy("id").agg(F.max("y").alias("y")), "labels")
    prior = {0: 0, 1: 0} | {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    distinct = materialise(rows.select("id", F.xxhash64("text").alias("hash")).join(known, "id").groupBy("hash", "y").agg(F.min("id").alias("id")), "labelled")
    picked = [distinct.where(F.col("y") == y).orderBy("hash", "id").limit(sample) for y in (0, 1)]
    own = F.broadcast(picked[0].union(picked[1]))  # at most 2 x sample rows
    examples = rows.join(own, (rows.id == own.id) & (F.xxhash64("text") == own.hash)).select(rows.id, "y", "hash", "text").dropDuplicates(["id", "y"])
    examples = materialise(examples, "examples")
    size = {0: 0, 1: 0} | {r.y: r.n for r in examples.groupBy("y").agg(F.count("*").alias("n")).collect()}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield frequencies(batch.column("text"), batch.column("y").to_numpy())
        release()

    counts = examples.select("text", "y").mapInArrow(counted, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    lexicon = choose(materialise(counts, "terms"), size, least, most, odds_ratio) if all(size.values()) else Lexicon(pa.array([], pa.string()), np.empty(0))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, term, weight = lexicon.vectors(batch.column("text"))
            of = lambda v, kind: pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(v, kind))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), of(term, pa.int32()), of(weight, pa.float64())], ["id", "y", "term", "weight"])
        release()

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        schema = [("id", pa.int64()), ("y", pa.int32()), ("term", pa.list_(pa.int32())), ("weight", pa.list_(pa.float64()))]
        table = pa.Table.from_batches(held).combine_chunks() if held else pa.schema(schema).empty_table()
        size = pc.fill_null(pc.list_value_length(table.column("term")), 0).to_numpy()
        flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        model = Model.fit(lexicon, start, flat("term").astype(np.int64), flat("weight"), table.column("id").to_numpy(), table.column("y").to_numpy().astype(np.int64), prior, k, power)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])
        release()

    vectors = examples.select("id", "y", "text").mapInArrow(described, "id long, y int, term array<int>, weight array<double>")
    made = vectors.repartition(1).sortWithinPartitions("id", "y").mapInArrow(fitted, "model binary").collect()  # one task, at most 2 x sample vectors
    if made:
        return pickle.loads(made[0].model)
    none = np.empty(0, np.int64)
    return Model.fit(lexicon, np.zeros(1, np.int64), none, np.empty(0), none, none, prior, k, power)


def score(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (nearest examples) and terms of each row; see classify."""
    bound_batches(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)
    near = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got, examples, told = held.value.scores(batch.column(2))
            columns = [batch.column(0), batch.column(1), pa.array(got, pa.float64()), pa.array((got >= threshold).astype(np.int32)), pa.array(examples, near), pa.array(told, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", "evidence", "terms"])
        release()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id:long,toxic:int,cosine:double>>, terms array<string>")


def classify(docs: DataFrame, labels: DataFrame, **of_fit: float) -> DataFrame:
    """Toxicity of every whole text: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on), evidence and terms, a row for each row.

    A text's vector has the TF-IDF weights of the terms that tell the labels apart, and of all its other words as one; a score is the share of toxic ones
    among the k nearest labelled examples, by cosine to a power, mapped to what such a share meant among the examples
    themselves. evidence: the three nearest ones, with label and cosine; terms: the text's own that weigh most.

    Null and empty texts and those without such terms: the share of toxic ones among labelled examples without them.
    Null ids keep their row; repeated rows give repeated results. No labels, or of one class only: the share of
    toxic ones (0.5 for none). Empty documents: no rows. Other columns are not read, and a score comes from the text alone.
    """
    return score(docs, fit(docs, labels, **of_fit))
