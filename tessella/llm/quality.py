"""Weak-label quality model.

Overlapping heuristics vote on every document (good, bad or no opinion).  The
number of documents with each combination of votes, over all data, is all that
expectation-maximisation needs to estimate how accurate every heuristic is; its
posteriors then label a bounded sample, on which a hashed linear scorer is
trained.  The scorer decides about every document.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, ship, str_texts, text_scores
from .features import DIM, ngram_vector, shape_stream, squeezed, vectors

#: Names of the heuristics, in the order of their votes.
LABELLERS = ("symbols", "odd_words", "capitals", "double_marks", "repeated_words", "variety", "bare_tokens", "no_sentence", "plain_words")
_TRITS = 3 ** np.arange(len(LABELLERS))


_PLAIN = re.compile(r"[^\W\d_]+(?:[-'\u2019][^\W\d_]+)*[.,;:?!]?")


def measures(text: str) -> dict[str, float]:
    """Figures that the heuristics look at; of the whole text.  Shares of words count each distinct word by its frequency."""
    words = text.split()
    n = len(words)
    kinds = Counter(words)
    full = _PLAIN.fullmatch
    plain = bare = double = ends = symbols = letters = upper = 0
    for w, k in kinds.items():
        if full(w):
            plain += k
            a = len(w) if w.isalpha() else sum(map(str.isalpha, w))
        else:
            a = sum(map(str.isalpha, w))
            bare += k * (a == 0)
            symbols += k * (len(w) - a - sum(map(str.isdigit, w)) - (w[-1] in ".,;:?!"))
        last = w[-1]
        double += k * (last in "!?.,;:*#$%&" and len(w) > 1 and w[-2] == last)
        ends += k * (last in ".?!")
        letters += k * a
        if a and not w.islower():
            upper += k * sum(map(str.isupper, w))
    return {
        "words": n,
        "symbols": symbols / max(1, letters + symbols),
        "capitals": upper / max(1, letters),
        "double_marks": double / max(1, n),
        "repeated_words": sum(map(str.__eq__, words, words[1:])) / max(1, n - 1),
        "variety": len(kinds) / max(1, n),
        "bare_tokens": bare / max(1, n),
        "sentences": ends / max(1, n),
        "plain_words": plain / max(1, n),
    }


def votes(text: str) -> list[int]:
    """-1 bad, 0 no opinion, 1 good, for each of ``LABELLERS``.

    Most heuristics know only one kind of bad text and have no opinion about any other;
    those that need many words have none about short texts.
    """
    m = measures(text)
    if not m["words"]:
        return [-1, -1, 0, 0, 0, 0, -1, 0, -1]
    many = m["words"] >= 20

    def bad(x: bool) -> int:
        return -1 if x else 0

    return [
        1 if m["symbols"] <= 0.06 else bad(many and m["symbols"] >= 0.1),
        bad(many and m["plain_words"] <= 0.7),
        bad(m["words"] >= 4 and m["capitals"] >= 0.4),
        bad(m["words"] >= 4 and m["double_marks"] >= 0.2),
        bad(m["words"] >= 4 and m["repeated_words"] >= 0.25),
        bad(many and m["variety"] <= 0.25 * min(1.0, 400 / m["words"])),
        bad(many and m["bare_tokens"] >= 0.25),
        bad(many and m["sentences"] <= 0.004),
        1 if m["plain_words"] >= 0.8 else bad(many and m["plain_words"] <= 0.5),
    ]


def pattern(v: list[int]) -> int:
    return int((np.array(v) + 1) @ _TRITS)


def unpattern(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // _TRITS % 3


@dataclass
class LabelModel:
    """``prior`` of good, and ``p[y, labeller, vote]``."""

    prior: float
    p: np.ndarray

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        v = unpattern(np.asarray(codes))
        at = np.arange(v.shape[1])
        bad, good = (np.log(self.p[y][at, v]).sum(axis=1) for y in (0, 1))
        return 1 / (1 + np.exp(np.clip(np.log(1 - self.prior) + bad - np.log(self.prior) - good, -700, 700)))

    def accuracies(self) -> dict[str, float]:
        """Of each heuristic, where it votes: the estimated share of right votes."""
        w = np.array([1 - self.prior, self.prior])[:, None]
        right = w[0] * self.p[0][:, 0] + w[1] * self.p[1][:, 2]
        return dict(zip(LABELLERS, (right / (w * (self.p[:, :, 0] + self.p[:, :, 2])).sum(axis=0)).tolist(), strict=True))


def fit_labels(codes: np.ndarray, counts: np.ndarray, rounds: int = 500, strength: float = 2.0, expected: float = 0.0005) -> LabelModel:
    """Expectation-maximisation over vote patterns with their counts.

    It starts from heuristics that are right in most cases, so "good" keeps its
    meaning.  How often a heuristic calls a good document bad is estimated under a prior: ``expected``, with the weight
    of ``strength`` times the good documents, so it means the same for any number of documents.  Without it, a rare
    kind of bad text that one heuristic alone knows counts as an oddity of good ones; a heuristic that misfires on
    many good documents overrules it.  Counts of 0 documents give the starting model.
    """
    k = len(LABELLERS)
    p = np.empty((2, k, 3))
    p[0], p[1] = [0.4, 0.4, 0.2], [0.02, 0.4, 0.58]
    model = LabelModel(0.8, p)
    if not len(codes) or not counts.sum():
        return model
    v = unpattern(codes)
    n = counts.astype(float)
    for _ in range(rounds):
        q = model.posterior(codes)
        p = np.empty((2, k, 3))
        for y, w in ((0, (1 - q) * n), (1, q * n)):
            for x in range(3):
                p[y, :, x] = ((v == x) * w[:, None]).sum(axis=0)
            p[y] = (p[y] + 0.5) / (w.sum() + 1.5)
        bad = (p[1, :, 0] + strength * expected) / (1 + strength)
        p[1, :, 1:] *= ((1 - bad) / (1 - p[1, :, 0]))[:, None]
        p[1, :, 0] = bad
        prior = float(np.clip((q * n).sum() / n.sum(), 0.02, 0.98))
        p = np.maximum(p, 1e-6)
        done = abs(prior - model.prior) < 1e-9
        model = LabelModel(prior, p)
        if done:
            break
    return model


def vector(text: str, v: list[int]) -> np.ndarray:
    """Hashed features: shape n-grams, and the heuristics' opinions in hashed slots of their own."""
    x = ngram_vector(shape_stream(text))
    extra = np.zeros(DIM, np.float32)
    for i, o in enumerate(v):
        extra[(2654435761 * (3 * i + o + 2) & 0xFFFFFFFF) >> 20] += 0.5
    return x + extra


def train_scorer(x: np.ndarray, q: np.ndarray, epochs: int = 60, rate: float = 2.0, ridge: float = 1e-5, seed: int = 0) -> np.ndarray:
    """Logistic regression on soft labels; the last weight is the bias.  Only a batch at a time is copied."""
    w, total = np.zeros(x.shape[1] + 1, np.float32), np.full(x.shape[1] + 1, 1e-6, np.float32)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 128):
            b = order[i : i + 128]
            r = np.hstack([x[b], np.ones((len(b), 1), np.float32)])
            g = r.T @ (1 / (1 + np.exp(-np.clip(r @ w, -30, 30))) - q[b]).astype(np.float32) / len(b) + ridge * w
            total += g * g
            w -= rate * 0.1 * g / np.sqrt(total)
    return w


@dataclass
class Model:
    labels: LabelModel
    weights: np.ndarray

    def score(self, text: str, v: list[int]) -> float:
        m = float(vector(text, v) @ self.weights[:-1] + self.weights[-1])
        return float(1 / (1 + np.exp(-np.clip(m, -30, 30))))


def fit(docs: DataFrame, sample: int = 3000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Vote counts over all documents; the scorer's training texts are about ``sample``
    documents by a hash of id and text (that bound is all that reaches the driver).  No
    document gives a scorer without weights, which rates everything 0.5.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))

    def voter():
        return lambda text: [pa.array([pattern(votes(t)) for t in str_texts(text)], pa.int32())]

    got = map_rows(rows, ["text"], [("pattern", T.IntegerType())], voter, keep=[]).groupBy("pattern").count().toPandas()
    codes, counts = got["pattern"].to_numpy(np.int64), got["count"].to_numpy(np.int64)
    labels = fit_labels(codes, counts)
    n = int(counts.sum())
    u = F.pmod(F.xxhash64("id", "text", F.lit(6)), F.lit(1 << 30)) / float(1 << 30)

    def sampler():
        def f(text):
            each = [(v := votes(t), vector(t, v)) for t in str_texts(text)]
            return [pa.array([pattern(v) for v, _ in each], pa.int32()), pa.array([x.tobytes() for _, x in each], pa.binary())]

        return f

    rows = rows.where(u < sample / max(1, n))
    pdf = squeezed(map_rows(rows, ["text"], [("pattern", T.IntegerType()), ("v", T.BinaryType())], sampler, keep=[]).orderBy("pattern", F.xxhash64("v")), "v").toPandas()
    if pdf.empty:
        return Model(labels, np.zeros(DIM + 1, np.float32))
    x = vectors(list(pdf.v))
    return Model(labels, train_scorer(x, labels.posterior(pdf["pattern"].to_numpy(np.int64))))


def score(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("weak_label", "quality"), keep: list[str] | None = None) -> DataFrame:
    """Add the label model's posterior and the scorer's rating, both in [0, 1].  Null and empty texts are rated like any other (every heuristic that can speak votes bad).  Columns that already have these names are replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {n.lower() for n in names}]

    def make():
        def f(text):
            each = [(v := votes(t), model.score(t, v)) for t in str_texts(text)]
            q = model.labels.posterior(np.array([pattern(v) for v, _ in each], np.int64))
            return [pa.array(q), pa.array([s for _, s in each], pa.float64())]

        return f

    return map_rows(docs, [text_col], [(n, T.DoubleType()) for n in names], make, keep=keep)


def accepted(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` (its columns) that the scorer rates ``least`` or more.  Null and empty texts are rated like any other; no rows give none."""
    ship(docs.sparkSession)

    def make():
        return lambda text: pa.array([model.score(t, votes(t)) for t in str_texts(text)], pa.float64())

    return docs.where(text_scores(make, docs[text_col]) >= least)
