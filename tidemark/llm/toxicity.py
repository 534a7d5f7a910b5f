"""Toxicity by a classifier that is trained not to hear who is spoken of.

A text is a bag of words, A-Z in lower case; a word stands for itself and for its beginnings, so that inflected and compound words share
what they start with.  A logistic model weighs how often these occur in a thousand words.  Where a labelled sentence names a group,
the sentence is written again with other groups in its place, and the training loss adds the square of each change of the score: what
the labels happen to say about a group is unlearnt, what they say about insults stays.

The model is small: it is fitted on the driver from at most SAMPLE labelled documents of each label, in the space of the FEATURES
beginnings and words that tell the labels apart best, counted by Spark over these documents.  Every document is scored as a whole.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_stash, few_files, stash, text_of

#: Bounds of the fit: documents of either label, features, and counterfactual sentences of a document.
SAMPLE, FEATURES, SENTENCES = 6_000, 4_000, 8
#: Characters of a word's beginnings, with the mark before its first.
STARTS = (4, 5, 6)
#: Documents that must have a feature, and by how many deviations its share must differ between the labels.
LEAST_DOCS, DEVIATIONS = 4, 2.5
#: Weight of the squared weights and of the squared changes of score; steps of the fit.
SHRINK, COUNTER, STEPS = 1.0, 4.0, 400
#: Words that a task keeps the weights of.
KNOWN_WORDS = 200_000
THRESHOLD = 0.7

#: Terms that name groups of people, by the kind of group; a term is exchanged within its kind.  Fixed values; a parameter of fit().
IDENTITY_TERMS: dict[str, tuple[str, ...]] = {
    "faith": ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "catholic", "protestant", "atheist"),
    "faiths": ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "catholics", "protestants", "atheists"),
    "origin": ("african", "american", "arab", "asian", "chinese", "european", "french", "german", "indian", "japanese", "mexican", "polish", "russian", "turkish"),
    "skin": ("black", "white", "brown"),
    "gender": ("woman", "man"),
    "genders": ("women", "men"),
    "orientation": ("gay", "lesbian", "bisexual", "straight", "queer"),
    "body": ("blind", "deaf", "disabled", "autistic"),
    "status": ("immigrants", "refugees", "foreigners", "citizens"),
}

#: Bytes of ASCII letters (A-Z in lower case) and of all that is outside ASCII stay; others part words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SENTENCES = re.compile(rb"[.!?\n]+")


def words_of(body: bytes) -> list[bytes]:
    return body.translate(_WORDS).split()


def features_of(word: bytes) -> list[str]:
    """The word itself and its beginnings, which a mark sets apart."""
    text = word.decode("utf-8", "replace")
    return ["=" + text, *{("^" + text)[:n] for n in STARTS if len(text) + 1 >= n}]


def _value(count: float, words: int) -> float:
    """Of a feature: the logarithm of how often it comes in a thousand words; short texts count as somewhat longer."""
    return math.log1p(1000.0 * count / (words + 20))


class Space:
    """The chosen features and their places; words are looked up once."""

    def __init__(self, features: Iterable[str]):
        self.place = {f: i for i, f in enumerate(features)}
        self.seen: dict[bytes, tuple[int, ...]] = {}

    def of_word(self, word: bytes) -> tuple[int, ...]:
        places = self.seen.get(word)
        if places is None:
            places = tuple(p for f in features_of(word) if (p := self.place.get(f)) is not None)
            if len(self.seen) >= KNOWN_WORDS:
                self.seen.clear()
            self.seen[word] = places
        return places

    def vector(self, words: list[bytes]) -> dict[int, float]:
        sums: dict[int, int] = {}
        seen = self.seen
        for word, n in Counter(words).items():
            places = seen.get(word)
            for p in self.of_word(word) if places is None else places:
                sums[p] = sums.get(p, 0) + n
        return {p: _value(n, len(words)) for p, n in sums.items()}


def swaps(body: bytes, kinds: dict[bytes, tuple[bytes, ...]], most: int = SENTENCES) -> list[tuple[list[bytes], list[bytes]]]:
    """Sentences of a text that name a group, as words, each with a version that names another one of its kind.

    Every term of a sentence is exchanged at once; the versions run through the kind's other terms, `most` of them at most for a text."""
    out: list[tuple[list[bytes], list[bytes]]] = []
    for sentence in _SENTENCES.split(body):
        words = words_of(sentence)
        named = [w for w in words if w in kinds]
        if not named:
            continue
        for turn in range(1, max(len(kinds[w]) for w in named)):
            if len(out) >= most:
                return out
            other = [kinds[w][(kinds[w].index(w) + turn) % len(kinds[w])] if w in kinds else w for w in words]
            if other != words:
                out.append((words, other))
    return out


def _kinds(identity_terms: dict[str, tuple[str, ...]]) -> dict[bytes, tuple[bytes, ...]]:
    return {t.encode(): tuple(x.encode() for x in terms) for terms in identity_terms.values() for t in terms}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(body, toxic) to (feature, bad, good): documents of either label that have the feature."""
    found = (Counter(), Counter())

    def send() -> pa.RecordBatch:
        names = list(found[0].keys() | found[1].keys())
        out = [pa.array(names, pa.string()), pa.array([found[1][n] for n in names], pa.int64()), pa.array([found[0][n] for n in names], pa.int64())]
        for f in found:
            f.clear()
        return pa.RecordBatch.from_arrays(out, ["feature", "bad", "good"])

    for batch in batches:
        for body, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            found[toxic].update({f for w in set(words_of(body.as_py())) for f in features_of(w)})
            if len(found[0]) + len(found[1]) > 500_000:
                yield send()
    yield send()


_VECTORS = "toxic int, places array<int>, numbers array<double>"


def _vectors(features: list[str], kinds: dict[bytes, tuple[bytes, ...]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(body, toxic) to the document's vector and, with toxic null, the changes that exchanged groups make to its sentences' vectors."""
    space = Space(features)
    for batch in batches:
        toxic: list[int | None] = []
        vectors: list[dict[int, float]] = []
        for body, label in zip(batch.column(0), batch.column(1).to_pylist()):
            text = body.as_py()
            vectors.append(space.vector(words_of(text)))
            toxic.append(label)
            for words, other in swaps(text, kinds):
                change = Counter(space.vector(other))
                change.subtract(space.vector(words))
                vectors.append({p: x for p, x in change.items() if x})
                toxic.append(None)
        yield pa.RecordBatch.from_arrays(
            [pa.array(toxic, pa.int32()), pa.array([list(v) for v in vectors], pa.list_(pa.int32())), pa.array([list(v.values()) for v in vectors], pa.list_(pa.float64()))],
            ["toxic", "places", "numbers"],
        )


@dataclass
class Sparse:
    """Rows of a sparse matrix, for products with a vector from either side."""

    n: int
    row: np.ndarray
    place: np.ndarray
    number: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[list[int], list[float]]]) -> Sparse:
        row = np.repeat(np.arange(len(rows)), [len(p) for p, _ in rows]).astype(np.int64)
        flat = lambda k, kind: np.fromiter(itertools.chain.from_iterable(r[k] for r in rows), kind)
        return cls(len(rows), row, flat(0, np.int64), flat(1, np.float64))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.number * weights[self.place], self.n)

    def back(self, values: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.place, self.number * values[self.row], size)


def train(docs: Sparse, toxic: np.ndarray, weight: np.ndarray, changes: Sparse, features: int, shrink: float = SHRINK, counter: float = COUNTER, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic model by Adam's steps over all rows, which shorten towards the end.

    The loss is the mean log loss of the documents, plus shrink/2 times the squared weights over their number, plus counter/2 times the
    mean squared change of score that exchanging the groups makes."""
    n, share = weight.sum(), float((weight * toxic).sum() / weight.sum())
    w = np.zeros(features + 1)
    w[-1] = np.log(share / (1 - share))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        off = weight * (1 / (1 + np.exp(-np.clip(docs.dot(w) + w[-1], -500, 500))) - toxic) / n
        slope = docs.back(off, features + 1) + shrink * w / n
        slope[-1] = off.sum()
        if changes.n:
            slope += counter * changes.back(changes.dot(w), features + 1) / changes.n
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        # steps shorten over the second half, to nothing
        w -= 0.05 * min(1.0, 2 - 2 * step / steps) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return w[:-1], float(w[-1])


@dataclass
class Model:
    features: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = 0.0

    def score(self, body: bytes, space: Space) -> float:
        total = self.intercept + sum(x * self.weights[p] for p, x in space.vector(words_of(body)).items())
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", sample: int = SAMPLE, features: int = FEATURES,
    identity_terms: dict[str, tuple[str, ...]] = IDENTITY_TERMS, counter: float = COUNTER,
) -> Model:
    """A model from the labelled documents whose crc32(doc_id as text) isn't 1 in threes.

    Labels other than 0 and 1, null ones and null doc_ids are not read; a doc_id with several labels has the greatest, and of documents that repeat a
    doc_id one is learnt from.  Of either label about `sample` doc_ids are drawn by their hash, and of them those that have a document;
    each counts for as many labels as it stands for.  Without documents of both labels the model has only an intercept.
    """
    told = labels.where(~held_out(doc_id)).select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    told = told.groupBy("id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in told.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(sizes) < 2:
        return Model(intercept=0.0 if not sizes else 6.0 if 1 in sizes else -6.0)
    # by a threshold for the hash: nothing is sorted, and a label with fewer is taken whole
    reach = F.when(F.col("toxic") == 1, F.lit(sample / sizes[1])).otherwise(F.lit(sample / sizes[0]))
    drawn_ids = told.where(F.pmod(F.xxhash64("id", F.lit(12)), F.lit(1 << 30)) < reach * F.lit(float(1 << 30)))
    own = docs.where(~held_out(doc_id)).select(F.col(doc_id).cast("long").alias("id"), text_of(text).alias("body"))
    met = own.join(F.broadcast(drawn_ids), "id")  # twice `sample` ids, about
    met = met.groupBy("id", "toxic").agg(F.min(F.struct(F.xxhash64("body").alias("order"), "body"))["body"].alias("body"))
    taken = stash(few_files(met.select(F.col("body").cast("binary").alias("body"), "toxic")), "labelled")
    drawn = {r["toxic"]: r["n"] for r in taken.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(drawn) < 2:
        drop_stash(taken)
        return Model(intercept=0.0 if not drawn else 6.0 if 1 in drawn else -6.0)

    bad, good, both = F.col("bad"), F.col("good"), F.col("bad") + F.col("good")
    counts = taken.mapInArrow(_count, "feature string, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    share = (both + 1) / F.lit(float(sum(drawn.values()) + 2))
    apart = ((bad + 0.5) / (drawn[1] + 1) - (good + 0.5) / (drawn[0] + 1)) / F.sqrt(share * (1 - share) * (1 / drawn[0] + 1 / drawn[1]))
    best = counts.where(both >= LEAST_DOCS).withColumn("apart", apart).where(F.col("apart") > DEVIATIONS).orderBy(F.desc("apart"), "feature").limit(features)
    names = [r["feature"] for r in best.select("feature").collect()]  # `features` of them at most

    kinds = _kinds(identity_terms)
    rows = taken.mapInArrow(lambda batches: _vectors(names, kinds, batches), _VECTORS).toArrow().to_pydict()  # sparse, `sample` rows and their sentences at most
    drop_stash(taken)
    all_rows = list(zip(rows["toxic"], rows["places"], rows["numbers"]))
    labelled = sorted(r for r in all_rows if r[0] is not None)  # in an order of their own, whatever order tasks end in
    changes = sorted((r[1], r[2]) for r in all_rows if r[0] is None)
    toxic = np.array([r[0] for r in labelled], float)
    weight = np.where(toxic == 1, sizes[1] / drawn[1], sizes[0] / drawn[0])
    weights, intercept = train(Sparse.of([r[1:] for r in labelled]), toxic, weight, Sparse.of(changes), len(names), counter=counter)
    return Model(names, weights, intercept)


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from `threshold` on) for every row; the score depends on the text alone.

    A null or empty text has the score of no words.  A null doc_id isn't held out.  Rows may repeat; each is scored.  No rows, no result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(model.features)
        for batch in batches:
            found = [model.score(body.as_py(), space) for body in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), text_of(text).cast("binary").alias("body"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def fit_and_score(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    return score(docs, fit(docs, labels, text, doc_id, label), text, doc_id)
