"""Toxicity: a logistic classifier that identity terms may not sway.

The model sees which words and word beginnings a whole text contains. Sentences of labelled texts
that mention a group are written anew with other terms of the same kind (counterfactuals); both
are scored, and training adds the mean squared change of the score to the loss. A neutral mention
of one group then weighs as little as that of any other, and group terms cannot stand for toxicity.

Fitting uses at most ``sample_rows`` labelled rows and ``sample_sentences`` of their sentences,
taken by hash (so a larger table gives a sample of the same size); counting features, choosing
them and fitting them are bounded by these numbers. Scoring covers every row and needs no shuffle.
Rows of ``documents`` that share an id teach as one: the one whose text is least.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import drop_table, enter, leave, materialize

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")
_BEGINNINGS = (4, 5, 6)
#: A feature is kept from this log-likelihood ratio on: weaker ones are noise in small samples.
MIN_STRENGTH = 8.0

#: Group terms by kind; terms of one kind stand in for each other (fixed lists).
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys", "mothers", "fathers", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "muslime", "christen", "juden", "musulmans", "chrétiens", "juifs", "musulmanes", "cristianos", "judíos"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "natives", "foreigners", "migranten", "flüchtlinge", "immigrés", "réfugiés", "inmigrantes", "refugiados"),
    ("americans", "mexicans", "chinese", "russians", "germans", "french", "indians", "turks", "arabs"),
    ("deaf", "blind", "disabled", "autistic"),
    ("old", "young", "elderly", "teenage"),
)
_KIND = {t: kind for kind in IDENTITY_TERMS for t in kind}


def swap(term: str, by: int = 1) -> str:
    """Another term of the same kind, ``by`` places on; a term of no kind stays."""
    kind = _KIND.get(term)
    return kind[(kind.index(term) + by) % len(kind)] if kind else term


def features_of(word: str) -> tuple[str, ...]:
    if word in _KIND:
        return (word,)
    return (word, *(f"{word[:k]}*" for k in _BEGINNINGS if len(word) > k))


def features(text: str) -> set[str]:
    return {f for w in set(_WORD.findall(text.lower())) for f in features_of(w)}


def counterfactuals(text: str) -> list[tuple[str, str]]:
    """(sentence, sentence with every group term swapped) of each sentence of the text that has one.

    A sentence's own hash tells which terms of the kind stand in, so that over many sentences all of them do.
    """
    found = []
    for sentence in _SENTENCE.findall(text.lower()):
        if any(w in _KIND for w in _WORD.findall(sentence)):
            by = zlib.crc32(sentence.encode())
            found.append((sentence, _WORD.sub(lambda m: swap(m[0], 1 + by % (len(_KIND[m[0]]) - 1)) if m[0] in _KIND else m[0], sentence)))  # noqa: B023
    return found


@dataclass
class Model:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str) -> float:
        return self.score_features(features(text))

    def score_features(self, found: set[str]) -> float:
        z = self.bias + sum(sorted(self.weights[f] for f in found if f in self.weights))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


class _Rows:
    """Sets of feature numbers, and their scores under weights."""

    def __init__(self, rows: list):
        self.n = len(rows)
        self.flat = np.concatenate([np.asarray(r, np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
        self.of = np.repeat(np.arange(self.n), [len(r) for r in rows])

    def scores(self, b: float, w: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(b + np.bincount(self.of, w[self.flat], self.n), -30, 30)))

    def pull(self, g: np.ndarray, width: int) -> np.ndarray:
        """The weights' gradient if ``g`` is that of each row's logit."""
        return np.bincount(self.flat, g[self.of], width)


def fit_matrix(rows: list, labels: np.ndarray, width: int, pairs: list[tuple], l2: float, fairness: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Minimise mean log-loss + l2 |w|^2 + fairness * mean (score of a - score of b)^2 over the pairs (a, b) of sentences.

    Rows and sentences are sets of feature numbers. Adam on the full batch: the same rows give the same model.
    """
    x, one, other = _Rows(rows), _Rows([a for a, _ in pairs]), _Rows([b for _, b in pairs])
    prior = (labels.sum() + 1) / (x.n + 10)
    w, b = np.zeros(width), math.log(prior / (1 - prior))
    if not x.n or not width:
        return b, w
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, steps + 1):
        g = (x.scores(b, w) - labels) / x.n
        gw, gb = x.pull(g, width) + 2 * l2 * w, g.sum()
        if pairs and fairness:
            p, q = one.scores(b, w), other.scores(b, w)
            d = 2 * fairness * (p - q) / len(pairs)
            gp, gq = d * p * (1 - p), -d * q * (1 - q)
            gw += one.pull(gp, width) + other.pull(gq, width)
            gb += gp.sum() + gq.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2, rate = 1 - 0.9**t, 1 - 0.999**t, 0.1 * (1 - 0.9 * t / steps)
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / (math.sqrt(vb / c2) + 1e-8)
    return b, w


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = 8192, sample_sentences: int = 16384, max_features: int = 4096, l2: float = 1e-5, fairness: float = 10.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of ``label_col`` (0 or 1; null rows are left out) from at most ``sample_rows`` rows of ``labels``.

    An id that is labelled twice counts with its larger label. Without any labelled text the
    model is the prior 0.1 for every text.
    """
    spark = documents.sparkSession
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    held = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))  # broadcast: at most sample_rows rows
    sample = materialize(held, "toxicity-sample")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted(features(t.as_py())) for t in b.column(1)], pa.list_(pa.string()))], ["y", "f"])

    total = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = total.get(1, 0), total.get(0, 0)
    if not pos + neg:
        return Model(math.log(0.1 / 0.9))
    counts = sample.select("y", "text").mapInArrow(extract, "y int, f array<string>").select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    p, q, least = F.col("p"), F.col("q"), max(3, (pos + neg) // 1000)

    def term(k, total_k, share):
        return F.when(k > 0, k * F.log(k / (F.lit(float(total_k)) * share))).otherwise(0.0)

    share, absent = (p + q) / F.lit(float(pos + neg)), 1 - (p + q) / F.lit(float(pos + neg))
    strength = term(p, pos, share) + term(q, neg, share) + term(F.lit(pos) - p, pos, absent) + term(F.lit(neg) - q, neg, absent) if pos and neg else F.lit(0.0)
    seen = counts.where(p + q >= least).where(strength >= MIN_STRENGTH)
    vocabulary = [r.f for r in seen.orderBy(F.desc(strength), "f").limit(max_features).select("f").collect()]
    vocabulary += sorted(set(_KIND) - set(vocabulary))
    index = {f: k for k, f in enumerate(vocabulary)}
    sent = spark.sparkContext.broadcast(index)  # at most max_features and the identity terms

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        known = sent.value
        for b in batches:
            found = [t.as_py() for t in b.column(2)]
            rows = [sorted(known[f] for f in features(t) if f in known) for t in found]
            pairs = [[{k: sorted(known[f] for f in features(s) if f in known) for k, s in zip("ab", pair, strict=True)} for pair in counterfactuals(t)] for t in found]
            kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.list_(pa.int32())), pa.array(pairs, kind)], ["id", "y", "row", "pairs"])

    encoded = materialize(sample.mapInArrow(encode, "id long, y int, row array<int>, pairs array<struct<a:array<int>,b:array<int>>>"), "toxicity-features")
    got = sorted(encoded.select("id", "y", "row").collect())
    two = encoded.select(F.explode("pairs").alias("p")).where("p.a <> p.b").groupBy("p").agg(F.count("*").alias("n"))
    pairs = sorted((r.p.a, r.p.b) for r in two.orderBy(F.xxhash64("p.a", "p.b"), "p").limit(sample_sentences).collect())
    drop_table(spark, sample, encoded)
    bias, w = fit_matrix([r.row for r in got], np.array([r.y for r in got], float), len(vocabulary), pairs, l2, fairness)
    return Model(float(bias), {f: float(x) for f, x in zip(vocabulary, w, strict=True) if abs(x) > 1e-4})


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; null and empty texts get the model's prior. Rows are looked at one by one."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        scorer = _Scorer(sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scorer.score(t.as_py()) for t in b.column(1)], pa.float64())], ["doc_id", "score"])
        del scorer
        leave()

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


class _Scorer:
    """A model's scores with the words' features remembered, at most 150,000 words."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def score(self, text: str | None) -> float:
        found: set[str] = set()
        for w in set(_WORD.findall((text or "").lower())):
            own = self.known.get(w)
            if own is None:
                if len(self.known) > 150_000:
                    self.known.clear()
                own = self.known[w] = tuple(f for f in features_of(w) if f in self.model.weights)
            if own:
                found.update(own)
        return self.model.score_features(found)


def keep_below(documents: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` that score below ``threshold``, in their columns and without shuffle."""
    at = documents.columns.index(text_col)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        scorer = _Scorer(sent.value)
        for b in batches:
            yield b.filter(pa.array([scorer.score(t.as_py()) < threshold for t in b.column(at)], pa.bool_()))
        del scorer
        leave()

    return documents.mapInArrow(run, documents.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that never teach the model: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, **fitting) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document, by a model fitted on the rows not held out."""
    model = fit(documents, labels.where(~held_out()), **fitting)
    return score(documents, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
