"""Document quality from a linear-chain conditional random field over lines.

Every line gets the state bad or good.  Its score comes from its own features and those of the
lines before and after it; a further weight rewards equal states of neighbours.  Forward-backward
gives the chance that each line is good, and their mean weighted by line length is the quality of
the document.

The field is fitted on a bounded sample of labelled documents (``TRAIN_DOCS``), every line taking
the label of its document; all documents are then scored in place, without a shuffle.
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

#: Labelled documents the field is fitted on, at most.
TRAIN_DOCS = 4000
STEPS, RATE, RIDGE = 150, 0.1, 1e-3

_NOT_NEWLINE = ~tc.byte_set((0x0A, 0x0A))
_CLASSES = [
    tc.byte_set((0x41, 0x5A)),  # capitals
    tc.byte_set((0x61, 0x7A)),  # small letters
    tc.byte_set((0x30, 0x39)),  # digits
    tc.byte_set((0x20, 0x20), (0x09, 0x0D)),  # space
    tc.byte_set((0x21, 0x21), (0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F)),  # ! , . : ; ?
    tc.byte_set((0x21, 0x21)),
    tc.byte_set((0x7C, 0x7C)),
    tc.byte_set((0x23, 0x2B), (0x2D, 0x2D), (0x2F, 0x2F), (0x3C, 0x3E), (0x40, 0x40), (0x5B, 0x60), (0x7B, 0x7E)),  # other signs
    tc.byte_set((0x80, 0x9F)),  # second bytes of most accented capitals
    tc.byte_set((0xA0, 0xFF)),
]
_ENDS = tc.byte_set((0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F))
OWN = 9 + len(_CLASSES)
WIDTH = 3 * OWN + 3


def line_features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, end row, lines per row, features of every line, bytes of every line."""
    for lo, hi, data, bounds in tc.pieces(column):
        starts, ends, row = tc.runs(data, bounds, _NOT_NEWLINE)
        per_row = np.bincount(row, minlength=hi - lo)
        size = (ends - starts).astype(np.float64)
        n = len(starts)
        own = np.zeros((n, OWN), np.float32)
        if n:
            total = np.zeros(len(data) + 1, np.int32)
            for k, members in enumerate(_CLASSES):
                np.cumsum(members[data], out=total[1:])
                own[:, k] = (total[ends] - total[starts]) / size
            word_start, word_end, _ = tc.runs(data, bounds, tc.NOT_SPACE)
            line = np.searchsorted(starts, word_start, "right") - 1
            word = tc.span_hashes(data, word_start, word_end)
            n_words = np.bincount(line, minlength=n)
            same = np.zeros((2, len(word)), bool)
            for back in (1, 2):
                same[back - 1, back:] = (word[back:] == word[:-back]) & (line[back:] == line[:-back])
            k = len(_CLASSES)
            own[:, k] = np.log1p(size)
            own[:, k + 1] = np.log1p(n_words)
            own[:, k + 2] = size / np.maximum(n_words, 1) / 10
            own[:, k + 3] = np.bincount(line[same[0]], minlength=n) / np.maximum(n_words, 1)
            own[:, k + 4] = np.bincount(line[same[1]], minlength=n) / np.maximum(n_words, 1)
            own[:, k + 5] = _ENDS[data[ends - 1]]
            own[:, k + 6] = _CLASSES[0][data[starts]] | (data[starts] == 0xC3)
            digest = tc.span_hashes(data, starts, ends, tc.EXACT)
            again = np.zeros(n, bool)
            again[1:] = (digest[1:] == digest[:-1]) & (row[1:] == row[:-1])
            own[:, k + 7] = again
            own[:-1, k + 8] = again[1:]
        full = np.zeros((n, WIDTH), np.float32)
        full[:, :OWN] = own
        joined = np.zeros(max(0, n - 1), bool)
        joined[:] = row[1:] == row[:-1] if n else False
        full[1:, OWN : 2 * OWN][joined] = own[:-1][joined]
        full[:-1, 2 * OWN : 3 * OWN][joined] = own[1:][joined]
        full[:, -3:-1] = 1
        full[1:, -3][joined] = 0  # first line
        full[:-1, -2][joined] = 0  # last line
        full[:, -1] = 1
        yield lo, hi, per_row, full, size


class Chains:
    """Chains of different lengths laid out so that one step of all is one array operation."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.order = np.argsort(-lengths, kind="stable")
        begin = (np.cumsum(lengths) - lengths)[self.order]
        sorted_lengths = lengths[self.order]
        longest = int(sorted_lengths[0]) if len(lengths) else 0
        active = np.searchsorted(-sorted_lengths, -np.arange(longest), "left")
        #: Line numbers of the t-th line of all chains that have one.
        self.steps = [begin[:m] + t for t, m in enumerate(active)]


def _soft(x: np.ndarray, stay: float) -> np.ndarray:
    """The log odds that a state passes on to its neighbour."""
    return np.logaddexp(x + stay, 0) - np.logaddexp(x, stay)


def forward_backward(emission: np.ndarray, stay: float, chains: Chains) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of "good" from the lines up to each line, and from the lines after it."""
    ahead, behind = np.array(emission, np.float64), np.zeros(len(emission))
    for before, now in zip(chains.steps, chains.steps[1:], strict=False):
        ahead[now] += _soft(ahead[before[: len(now)]], stay)
    for now, after in zip(chains.steps[-2::-1], chains.steps[:0:-1], strict=False):
        behind[now[: len(after)]] = _soft(emission[after] + behind[after], stay)
    return ahead, behind


class Field:
    """Weights of a fitted field."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, stay: float, prior: float) -> None:
        self.mean, self.scale, self.weights, self.stay, self.prior = mean, scale, weights, stay, prior

    def qualities(self, per_row: np.ndarray, features: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Length-weighted mean chance of "good" per document; 0 for one without lines."""
        out = np.zeros(len(per_row))
        if len(features):
            emission = ((features - self.mean) / self.scale) @ self.weights
            ahead, behind = forward_backward(emission, self.stay, Chains(per_row))
            good = 1 / (1 + np.exp(-np.clip(ahead + behind, -500, 500)))
            row = np.repeat(np.arange(len(per_row)), per_row)
            has = per_row > 0
            out[has] = (np.bincount(row, good * size, len(per_row)) / np.maximum(np.bincount(row, size, len(per_row)), 1))[has]
        return np.clip(out, 0, 1)


def fit(features: np.ndarray, lengths: np.ndarray, y: np.ndarray, steps: int = STEPS) -> Field:
    """Maximum conditional likelihood with a ridge, by Adam over the whole sample.

    Each chain counts as much as its lines; without documents of both labels the field is flat
    and every document scores the share of good labels (0.5 without any).
    """
    prior = float(y.mean()) if len(y) else 0.5
    mean, scale = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32)
    if not len(features) or not 0 < prior < 1:
        weights = np.zeros(WIDTH)
        weights[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
        return Field(mean, scale, weights, 0.0, prior)
    mean[:-1], scale[:-1] = features[:, :-1].mean(0), features[:, :-1].std(0) + 1e-3
    x = (features - mean) / scale
    chains = Chains(lengths)
    state = np.repeat(y, lengths)
    n = len(x)
    theta, first, second = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)
    pairs = max(1, int(np.maximum(lengths - 1, 0).sum()))
    for step in range(1, steps + 1):
        emission = x @ theta[:-1].astype(np.float32)
        stay = theta[-1]
        ahead, behind = forward_backward(emission, stay, chains)
        chance = 1 / (1 + np.exp(-np.clip(ahead + behind, -500, 500)))
        gradient = np.append(((state - chance).astype(np.float32) @ x) / n, 0.0)
        kept = 0.0
        for now, after in zip(chains.steps, chains.steps[1:], strict=False):
            a, r = ahead[now[: len(after)]], emission[after] + behind[after]
            equal = np.logaddexp(a + r + stay, stay)
            kept += float(np.exp(equal - np.logaddexp(equal, np.logaddexp(a, r))).sum())
        gradient[-1] = (pairs - kept) / pairs - 0.05 * stay
        gradient[:-2] -= RIDGE * theta[:-2]
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        theta += RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Field(mean, scale, theta[:-1], float(theta[-1]), prior)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, held_out: int = 2, limit: int = TRAIN_DOCS) -> Field:
    """Fits the field on a bounded sample; line features are made on the executors."""

    def compute(column: pa.Array) -> list:
        counts, raw = [], []
        for lo, hi, per_row, full, _ in line_features(column):
            ends = np.cumsum(per_row)
            for i in range(hi - lo):
                counts.append(int(per_row[i]))
                raw.append(full[ends[i] - per_row[i] : ends[i]].tobytes())
        return [pa.array(counts, pa.int64()), pa.array(raw, pa.binary())]

    sample = training_sample(docs, labels, label, parts, held_out, limit)
    rows = tc.with_columns(sample, "text", compute, [("n", T.LongType()), ("raw", T.BinaryType())], ["y"]).where("n > 0").collect()
    rows.sort(key=lambda r: (r.y, r.n, bytes(r.raw)))  # the fit doesn't depend on the order of arrival
    features = np.frombuffer(b"".join(bytes(r.raw) for r in rows), np.float32).reshape(-1, WIDTH)
    return fit(features, np.array([r.n for r in rows], np.int64), np.array([float(r.y > 0) for r in rows]))


def score(docs: DataFrame, field: Field, keep: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """``keep`` columns and the quality (0 to 1) of every document.

    Null and empty texts, and those of newlines only, score 0.  Equal texts score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def compute(column: pa.Array) -> list:
        out = np.zeros(len(column))
        for lo, hi, per_row, full, size in line_features(column):
            out[lo:hi] = shared.value.qualities(per_row, full, size)
        return [out]

    return tc.with_columns(docs, text, compute, [(name, T.DoubleType())], keep)


def judged(docs: DataFrame, labels: DataFrame, parts: int = 4, held_out: int = 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; a null doc_id is not held out."""
    out = score(docs, train(docs, labels, parts=parts, held_out=held_out), ["doc_id"])
    fold = F.coalesce(bucket("doc_id", parts) == held_out, F.lit(False))
    return out.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """``docs`` without those of a quality below ``threshold``, columns unchanged.

    ``labelled`` has the texts of the labelled documents (``docs`` itself unless given).
    """
    name = tc.unused("quality_score", docs.columns)
    field = train(docs if labelled is None else labelled, labels)
    return score(docs, field, docs.columns, name=name).where(F.col(name) >= threshold).select(docs.columns)
