"""A toxicity classifier that is regularised with counterfactuals.

Features are the words of a text and the beginnings of its longer words, present or absent.  Those
that go along with toxic labels in the training sample are chosen by counts, then weighed by
logistic regression.  For every training text that names a group of people a counterfactual is
made, in which each such term is swapped for another of its kind; the loss has a penalty on the
squared change of the score between the two.  So a term of this kind can't carry weight on its
own, and neutral mentions of groups that often stand in toxic texts aren't flagged.

The sample is bounded (``TRAIN_DOCS``); counting and feature lists are Spark jobs, the fit works on
a few numbers per sampled text.  Scoring goes over all texts in place, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augurlog.llm import textcore as tc
from augurlog.llm.labelled import bucket, training_sample
from augurlog.session import materialise

#: Labelled documents the classifier is fitted on, at most, and features chosen, at most.
TRAIN_DOCS, FEATURES = 20_000, 1024
#: Sampled toxic texts that a feature must be in, and how many times likelier it is in them.
LEAST_TOXIC, LEAST_RATIO = 3, 4.0
PREFIXES = (4, 5, 6)
STEPS, RATE, RIDGE, PENALTY = 400, 0.2, 2e-5, 1.0

# Terms for groups of people, by kind; a term is swapped for the next of its kind.
GROUPS = {
    "religion": ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"],
    "religions": ["muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"],
    "orientation": ["gay", "straight", "lesbian", "bisexual", "homosexual", "heterosexual", "queer", "transgender"],
    "gender": ["woman", "man"],
    "genders": ["women", "men"],
    "colour": ["black", "white", "asian", "latino", "african", "european", "arab", "hispanic"],
    "nation": ["american", "chinese", "mexican", "russian", "turkish", "polish", "indian", "german", "french", "spanish"],
    "state": ["disabled", "blind", "deaf", "elderly", "young", "old", "immigrant", "refugee"],
    "states": ["immigrants", "refugees", "foreigners", "migrants"],
    "de": ["muslime", "christen", "juden", "frauen", "männer", "türken", "polen", "ausländer", "flüchtlinge", "schwule", "lesben"],
    "fr": ["musulmans", "chrétiens", "juifs", "femmes", "hommes", "arabes", "noirs", "blancs", "immigrés", "réfugiés"],
    "es": ["musulmanes", "cristianos", "judíos", "mujeres", "hombres", "gitanos", "negros", "blancos", "inmigrantes", "refugiados"],
}


def _hash_words(terms: list[str]) -> np.ndarray:
    return np.concatenate([tc.words(d, b, tc.LETTER_OR_DIGIT)[0] for _, _, d, b in tc.pieces(pa.array(terms, pa.string()))])


def _swaps(groups: dict[str, list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All terms, and the hashes of all in order and of what each is swapped for."""
    terms = [t for kind in groups.values() for t in kind]
    other = [kind[(i + 1) % len(kind)] for kind in groups.values() for i in range(len(kind))]
    return other, _hash_words(terms), _hash_words(other)


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, end row, then hash and row of every feature mention, and hash and row of every word."""
    for lo, hi, data, bounds in tc.pieces(column):
        starts, ends, row = tc.runs(data, bounds, tc.LETTER_OR_DIGIT)
        word = tc.span_hashes(data, starts, ends)
        found, rows = [word], [row]
        for size in PREFIXES:
            long = np.flatnonzero(ends - starts > size)
            found.append(tc.mix(tc.span_hashes(data, starts[long], starts[long] + size) + np.uint64(size)))
            rows.append(row[long])
        yield lo, hi, np.concatenate(found), np.concatenate(rows), word, row


def _term_features(terms: list[str]) -> list[np.ndarray]:
    """The feature hashes of each single term."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(terms)
    for lo, hi, found, rows, _, _ in features(pa.array(terms, pa.string())):
        for i in range(hi - lo):
            out[lo + i] = found[rows == i]
    return out


class Chosen:
    """The chosen features, looked up through a table over the first 20 bits of their hashes."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.sort(hashes.astype(np.uint64))
        self.first = np.zeros(1 << 20, bool)
        self.first[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def find(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of chosen features among ``found``, and which they are."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        likely = np.flatnonzero(self.first[(found >> np.uint64(44)).astype(np.int64)])
        which = np.minimum(np.searchsorted(self.hashes, found[likely]), len(self.hashes) - 1)
        same = self.hashes[which] == found[likely]
        return likely[same], which[same]


def _pairs(rows: np.ndarray, which: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature)."""
    both = np.unique(rows * max(width, 1) + which)
    return both // max(width, 1), both % max(width, 1)


class Classifier:
    def __init__(self, chosen: Chosen, weights: np.ndarray, bias: float) -> None:
        self.chosen, self.weights, self.bias = chosen, weights, bias

    def score(self, column: pa.Array) -> np.ndarray:
        z = np.full(len(column), self.bias)
        for lo, hi, found, rows, _, _ in features(column):
            at, which = self.chosen.find(found)
            row, feature = _pairs(rows[at], which, len(self.weights))
            z[lo:hi] += np.bincount(row, self.weights[feature], hi - lo)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(y: np.ndarray, text: tuple[np.ndarray, np.ndarray], swapped: tuple[np.ndarray, np.ndarray], width: int, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias from distinct (document, feature) pairs of the texts and their counterfactuals.

    A document that names no group has its own pairs in ``swapped`` too, and no penalty then.
    """
    n = max(len(y), 1)
    prior = min(max(float(y.mean()) if len(y) else 0.0, 1e-3), 1 - 1e-3)
    theta, first, second = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    theta[-1] = np.log(prior / (1 - prior))
    if not len(y) or y.min() == y.max():
        return theta[:-1], float(theta[-1])
    for step in range(1, steps + 1):
        w = theta[:-1]
        z = np.bincount(text[0], w[text[1]], len(y)) + theta[-1]
        other = np.bincount(swapped[0], w[swapped[1]], len(y)) + theta[-1]
        slope = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / n
        change = 2 * penalty * (z - other) / n
        gradient = np.append(np.bincount(text[1], (slope + change)[text[0]], width) - np.bincount(swapped[1], change[swapped[0]], width) + RIDGE * w, slope.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        theta += -RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 3, held_out: int = 1, limit: int = TRAIN_DOCS, width: int = FEATURES, groups: dict[str, list[str]] = GROUPS, penalty: float = PENALTY) -> Classifier:
    """Chooses the features and fits their weights on a bounded sample of labelled documents."""
    sample = materialise(training_sample(docs, labels, label, parts, held_out, limit), "toxic_sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False) > 0
            for lo, _, found, rows, _, _ in features(batch.column(0)):
                order = np.lexsort((found, rows))
                new = np.ones(len(order), bool)
                new[1:] = (found[order][1:] != found[order][:-1]) | (rows[order][1:] != rows[order][:-1])
                hashes, inverse = np.unique(found[order][new], return_inverse=True)
                hit = toxic[lo + rows[order][new]]
                bad, good = np.bincount(inverse[hit], minlength=len(hashes)), np.bincount(inverse[~hit], minlength=len(hashes))
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(bad), pa.array(good)], names=["feature", "bad", "good"])

    sizes = sample.agg(F.coalesce(F.sum((F.col("y") > 0).cast("long")), F.lit(0)).alias("bad"), F.count("*").alias("n")).first()
    bad, good = sizes.bad, sizes.n - sizes.bad
    counts = sample.mapInArrow(count, "feature long, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    ratio = ((F.col("bad") + 0.5) / (bad + 1)) / ((F.col("good") + 0.5) / (good + 1))
    best = counts.where(F.col("bad") >= LEAST_TOXIC).withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO)
    rows = best.orderBy((F.col("bad") * F.log("ratio")).desc(), "feature").select("feature").limit(width).collect()
    chosen = Chosen(np.array([r.feature for r in rows], np.int64).view(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast(chosen)
    other_terms, terms, _ = _swaps(groups)
    order = np.argsort(terms)
    new_features = _term_features(other_terms)
    own_features = _term_features([t for kind in groups.values() for t in kind])

    def present(column: pa.Array) -> list:
        """Chosen features of each text, and of its counterfactual."""
        both: list[list] = [[[] for _ in range(len(column))] for _ in range(2)]
        for lo, _, found, rows, word, word_row in features(column):
            place = np.minimum(np.searchsorted(terms[order], word), len(order) - 1)
            named = np.flatnonzero(terms[order][place] == word) if len(order) else np.zeros(0, np.int64)
            at, which = shared.value.find(found)
            pairs = _pairs(rows[at], which, width)
            for r, f in zip(*pairs, strict=True):
                both[0][lo + r].append(int(f))
            # A swapped term takes away its own features and brings those of the other term.
            term = order[place[named]]
            gone = {(int(r), int(f)) for r, t in zip(word_row[named], term, strict=True) for f in shared.value.find(own_features[t])[1]}
            brought = {(int(r), int(f)) for r, t in zip(word_row[named], term, strict=True) for f in shared.value.find(new_features[t])[1]}
            for r, f in sorted(({(int(r), int(f)) for r, f in zip(*pairs, strict=True)} - gone) | brought):
                both[1][lo + r].append(f)
        return [pa.array(x, pa.list_(pa.int64())) for x in both]

    many = T.ArrayType(T.LongType())
    fitted = tc.with_columns(sample, "text", present, [("own", many), ("swapped", many)], ["y"]).collect()
    fitted.sort(key=lambda r: (r.y, r.own, r.swapped))  # the fit doesn't depend on the order of arrival
    y = np.array([float(r.y > 0) for r in fitted])
    flat = lambda name: (np.repeat(np.arange(len(fitted)), [len(r[name]) for r in fitted]), np.array([f for r in fitted for f in r[name]], np.int64))
    weights, bias = fit(y, flat("own"), flat("swapped"), len(chosen.hashes), penalty)
    return Classifier(chosen, weights, bias)


def score(docs: DataFrame, classifier: Classifier, keep: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """``keep`` columns and the chance of "toxic" for every document.

    Null texts and texts without words score as one without any chosen feature.  Equal texts score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    return tc.with_columns(docs, text, lambda column: [shared.value.score(column)], [(name, T.DoubleType())], keep)


def judged(docs: DataFrame, labels: DataFrame, parts: int = 3, held_out: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; a null doc_id is not held out.

    Without usable labels, or with one label only, every document scores the share of toxic labels.
    """
    out = score(docs, train(docs, labels, parts=parts, held_out=held_out), ["doc_id"])
    fold = F.coalesce(bucket("doc_id", parts) == held_out, F.lit(False))
    return out.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
