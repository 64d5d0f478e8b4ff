"""Toxicity of whole texts by a factorization machine over hashed terms."""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from growthpanel.llm.shared import Shelf, in_slices

#: most labelled rows that a fit reads, taken by label and a hash of the doc_id: toxic rows first, up to half if clean ones fill the rest
SAMPLE = 20_000
#: a term is a word of letters, or its first letters in these numbers, so that inflected forms share what is learned
PREFIXES = (4, 5, 6)
FACTORS, EPOCHS, BATCH, RATE, SPARSE, SHRINK = 8, 6, 128, 0.15, 2e-4, 1e-4
#: terms in fewer labelled rows, or with a smaller chi-square against the label, are left out
LEAST_ROWS, LEAST_CHI2 = 3, 6.0
REJECT = 0.7
#: words that a worker remembers
_KNOWN = 200_000

_letters = re.compile(r"[^\W\d_]+")


def terms(word: str) -> list[int]:
    """Hashes of a word and of its beginnings, as signed 32-bit integers."""
    parts = [word, *(f"^{word[:n]}" for n in PREFIXES if len(word) > n)]
    return [(crc32(p.encode()) ^ 0x80000000) - 0x80000000 for p in parts]


def words(text: str) -> set[str]:
    return set(_letters.findall(text.lower()))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _terms(texts: pa.Array) -> pa.Array:
    known: dict[str, list[int]] = {}
    out = []
    for text in in_slices(texts):
        found: set[int] = set()
        for word in words(text or ""):
            hashes = known.get(word)
            if hashes is None:
                if len(known) >= _KNOWN:
                    known.clear()
                hashes = known[word] = terms(word)
            found.update(hashes)
        out.append(sorted(found))
    return pa.array(out, pa.list_(pa.int32()))


@dataclass
class Machine:
    """score = sigmoid(scale * (z - middle) + logit(REJECT)), or below REJECT by z where middle is infinite; z = bias + sum of w + pairwise products of factors.

    The factors of a text of n known terms are divided by the root of n, so that pairs do not outgrow the rest.
    """

    terms: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    bias: float
    middle: float = 0.0
    scale: float = 1.0

    def raw(self, places: np.ndarray) -> float:
        if not len(places):
            return self.bias
        factors = self.factors[places]
        pairs = (factors.sum(0) ** 2).sum() - (factors**2).sum()
        return float(self.bias + self.weights[places].sum() + 0.5 * pairs / len(places))

    def score(self, places: np.ndarray) -> float:
        if np.isposinf(self.middle):  # no cut parts the classes: the order of z, below the limit
            return REJECT * (0.499 + float(np.arctan(self.raw(places))) / np.pi * 0.998)
        z = self.scale * (self.raw(places) - self.middle) + np.log(REJECT / (1 - REJECT))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _places(rows: list[np.ndarray], vocabulary: np.ndarray) -> list[np.ndarray]:
    out = []
    for row in rows:
        at = np.minimum(np.searchsorted(vocabulary, row), max(0, len(vocabulary) - 1))
        out.append(at[vocabulary[at] == row] if len(vocabulary) else at[:0])
    return out


def telling_terms(terms: np.ndarray, rows: np.ndarray, toxic: np.ndarray, n: int, n_toxic: int) -> np.ndarray:
    """The terms, sorted, that are in enough rows and whose chi-square against the label is large enough."""
    spread = np.maximum(rows * (n - rows) * float(n_toxic) * (n - n_toxic), 1e-9)
    chi2 = n * (toxic * float(n) - rows * float(n_toxic)) ** 2 / spread
    return np.sort(terms[(rows >= LEAST_ROWS) & (chi2 >= LEAST_CHI2)])


def parts(labels: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Rows to set the cut on and rows to learn from: a fifth of each class and the rest, or all for both if a class is too small."""
    order = rng.permutation(len(labels))
    classes = [order[labels[order] == c] for c in (0, 1)]
    if len(labels) < 50 or min(map(len, classes)) < 5:
        return order, order.copy()
    held = np.isin(order, np.concatenate([c[: len(c) // 5] for c in classes]))
    return order[held], order[~held]


def fit(rows: list[np.ndarray], labels: np.ndarray, vocabulary: np.ndarray, seed: int = 42, weights: tuple[float, float] = (1.0, 1.0)) -> Machine:
    """A machine from the term hashes and 0/1 labels of some texts. With one class alone, every score is that class's.

    Adagrad steps; linear weights are pulled to zero (terms that say nothing add nothing to long texts), factors are
    shrunk. A fifth of each class is not learned from: on it the cut is set, midway in the widest range of the best F1.
    With fewer than 50 rows, or 5 of a class, the cut is set on all rows, which are all learned from. ``weights`` says
    how many labelled rows a clean and a toxic one of the sample stand for. Where no cut parts the classes, nothing is rejected.
    """
    labels = np.asarray(labels, float)
    if not len(rows) or labels.min() == labels.max():
        sure = -40.0 if not len(rows) or labels.max() == 0 else 40.0
        return Machine(np.empty(0, np.int64), np.empty(0), np.empty((0, FACTORS)), sure)
    places = _places(rows, vocabulary)
    rng = np.random.default_rng(seed)
    held, taught = parts(labels, rng)
    m = len(vocabulary)
    w, v, bias = np.zeros(m), rng.normal(0, 0.01, (m, FACTORS)), float(np.log((labels.mean() + 1e-3) / (1.001 - labels.mean())))
    w2, v2 = np.full(m, 1e-6), np.full(m, 1e-6)
    for _ in range(EPOCHS):
        rng.shuffle(taught)
        for i in range(0, len(taught), BATCH):
            batch = [places[k] for k in taught[i : i + BATCH]]
            lengths = np.array([len(p) for p in batch])
            flat = np.concatenate(batch)
            if not len(flat):
                continue
            row = np.repeat(np.arange(len(batch)), lengths)
            n = np.maximum(lengths, 1)
            vf = v[flat]
            sums = np.zeros((len(batch), FACTORS))
            np.add.at(sums, row, vf)
            squares = np.bincount(row, (vf**2).sum(1), len(batch))
            z = bias + np.bincount(row, w[flat], len(batch)) + 0.5 * ((sums**2).sum(1) - squares) / n
            error = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[taught[i : i + BATCH]]
            bias -= RATE * 0.1 * error.mean()
            u, inverse = np.unique(flat, return_inverse=True)
            gw = np.bincount(inverse, error[row], len(u)) / len(batch)
            gv = np.zeros((len(u), FACTORS))
            np.add.at(gv, inverse, (error / n)[row, None] * (sums[row] - vf))
            gv = gv / len(batch) + SHRINK * v[u]
            w2[u] += gw**2
            v2[u] += (gv**2).mean(1)
            step = RATE / np.sqrt(w2[u])
            new = w[u] - step * gw
            w[u] = np.sign(new) * np.maximum(np.abs(new) - step * SPARSE, 0)
            v[u] -= (RATE / 3 / np.sqrt(v2[u]))[:, None] * gv
    used = (np.abs(w) > 1e-6) | (np.abs(v).max(1, initial=0) > 0.02)
    machine = Machine(vocabulary[used], w[used].astype(np.float32), v[used].astype(np.float32), bias)
    z = np.array([machine.raw(p) for p in _places([rows[k] for k in held], machine.terms)])
    machine.middle = _cut(z, labels[held], weights)
    if machine.middle == np.inf:
        return machine
    machine.scale = float(np.clip(6 / max(1e-6, np.percentile(np.abs(z - machine.middle), 50)), 0.5, 4))
    return machine


def _cut(z: np.ndarray, labels: np.ndarray, weights: tuple[float, float] = (1.0, 1.0)) -> float:
    """Where to part the classes: the best F1; among equals the middle of the widest gap.

    Infinity where no cut between two rows is better than to call all of them toxic.
    """
    order = np.argsort(-z, kind="stable")
    z, toxic = z[order], labels[order] > 0
    weight = np.where(toxic, weights[1], weights[0])
    hits = np.cumsum(weight * toxic)
    f1 = 2 * hits / (np.cumsum(weight) + hits[-1])
    below, every = z[1:], f1[-1]
    f1 = np.where(z[:-1] == below, -1, f1[:-1])  # no cut within ties
    if f1.max(initial=-1) <= every + 1e-12:
        return float("inf")
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = best[np.argmax(z[best] - below[best])]
    return float((z[k] + below[k]) / 2)


def shares(n_clean: int, n_toxic: int, sample: int) -> tuple[int, int]:
    """How many clean and toxic rows a sample takes: toxic rows first, but no more than half unless clean ones are few."""
    toxic = min(n_toxic, max(sample // 2, sample - n_clean))
    return min(n_clean, sample - toxic), toxic


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine from at most ``sample`` rows that may be learned from: crc32 of the doc_id modulo 3 is not 1.

    A larger table gives toxic rows first, up to half of the sample or as many as clean rows leave room for; the cut
    weighs the rows by what they stand for. ``sample`` bounds what is broadcast (16 bytes a row) and what the driver gets: the counts of the terms that are in
    several rows, and of each row the terms that tell. Rows with a null doc_id or label are not learned from; a doc_id
    with several labels counts as toxic if any says so.
    """
    shelf = Shelf(docs.sparkSession)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    there = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    there = [there.get(c, 0) for c in (0, 1)]
    drawn = shares(*there, sample)
    clean, toxic = (known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(k) for c, k in enumerate(drawn))
    chosen = clean.unionByName(toxic)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", _terms("text").alias("terms"))
    rows = shelf.keep(rows, "sample")
    n, n_toxic = rows.agg(F.count("toxic"), F.sum("toxic")).first()
    each = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("toxic").alias("rows"), F.sum("toxic").alias("toxic"))
    each = each.where(F.col("rows") >= LEAST_ROWS).toPandas()
    vocabulary = telling_terms(*(each[c].to_numpy(np.int64) for c in ("term", "rows", "toxic")), n, n_toxic or 0)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def telling(terms: pa.Array) -> pa.Array:
        return pa.array([np.intersect1d(np.array(t, np.int64), vocabulary) for t in terms.to_pylist()], pa.list_(pa.int32()))

    taken = rows.select("doc_id", "toxic", telling("terms").alias("terms")).toPandas().sort_values("doc_id", kind="stable")
    shelf.forget(rows)
    return fit([np.asarray(t, np.int64) for t in taken.terms], taken.toxic.to_numpy(float), vocabulary, weights=tuple(n / max(1, k) for n, k in zip(there, drawn)))


def scorer(machine: Machine, docs: DataFrame):
    """A column function from text to score; the machine is broadcast, its size bounded by the sample's terms."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        machine = shared.value
        place = getattr(machine, "_place", None)
        if place is None:
            machine._place = place = dict(zip(machine.terms.tolist(), range(len(machine.terms))))
            machine._known = {}
        known: dict[str, tuple] = machine._known
        out = np.empty(len(texts))
        for i, text in enumerate(in_slices(texts)):
            found: set[int] = set()
            for word in words(text or ""):
                at = known.get(word)
                if at is None:
                    if len(known) >= _KNOWN:
                        known.clear()
                    at = known[word] = tuple(place[t] for t in terms(word) if t in place)
                if at:
                    found.update(at)
            out[i] = machine.score(np.fromiter(found, np.int64, len(found)))
        return pa.array(out)

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text; further columns are ignored).

    Scores come from the text alone. ``held_out`` rows, crc32 of the doc_id modulo 3 being 1, are never learned from;
    a null doc_id is not held out. Null and empty texts get the score of a text without known terms. Without labels,
    or with labels of one class, every row gets that class (none: not toxic).
    """
    machine = train(docs, labels, sample)
    score = scorer(machine, docs)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    scored = docs.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= REJECT).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that score below the limit, with all columns."""
    score = scorer(train(docs, labels, sample), docs)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, score("text").alias("score")).where(F.col("score") < REJECT).select("row.*")

