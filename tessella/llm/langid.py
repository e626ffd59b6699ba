"""Language identification in two steps: family, then language within it.

Both steps vote among one-versus-one linear support vector machines over hashed
character n-grams: first between families, then between the related languages of
the family that won.  Weights are fitted on a bounded sample of labelled
documents (``per_language`` of each language, chosen by a hash of the id).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, ship, str_texts, text_scores
from .features import DIM, letter_stream, ngram_vector, squeezed, vectors

#: Well-known families by ISO 639-1 code.  A language not listed
#: joins the family whose mean vector is nearest to its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "indic": ("hi", "bn", "ur", "mr", "ne", "pa", "gu"),
    "semitic": ("ar", "he", "mt", "am"),
    "dravidian": ("ta", "te", "kn", "ml"),
    "sinitic": ("zh",),
    "japonic": ("ja",),
    "koreanic": ("ko",),
}
UNKNOWN = "und"


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 4.0, epochs: int = 12, seed: int = 0) -> np.ndarray:
    """Linear SVM (squared hinge loss) by dual coordinate descent; y in {-1, 1}; the last weight is the bias.

    Rows become doubles one at a time: the driver holds one copy of the matrix, in its own type.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    diagonal = 0.5 / c
    q = np.array([(v * v).sum() for v in map(np.float64, x)]) + diagonal
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            v = x[i].astype(np.float64)
            g = y[i] * (v @ w) - 1 + diagonal * alpha[i]
            new = max(0.0, alpha[i] - g / q[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * v
                alpha[i] = new
    return w.astype(np.float32)


@dataclass
class Model:
    """``family_of`` each language; one machine for each pair of families, and of languages of one family."""

    languages: list[str]
    family_of: dict[str, str]
    machines: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def _vote(self, names: list[str], v: np.ndarray) -> tuple[str, float]:
        """The name that wins most duels (ties: larger sum of margins, then the first), and its least confidence."""
        if len(names) == 1:
            return names[0], 1.0
        wins, sums, sure = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)
        for a, b in combinations(names, 2):
            w = self.machines[a, b]
            m = float(v @ w[:-1] + w[-1])
            wins[a if m >= 0 else b] += 1
            p = 1 / (1 + np.exp(-4 * np.clip(m, -10, 10)))
            sums[a], sums[b] = sums[a] + m, sums[b] - m
            sure[a], sure[b] = min(sure[a], p), min(sure[b], 1 - p)
        best = max(names, key=lambda n: (wins[n], sums[n]))
        return best, float(sure[best])

    def predict(self, text: str) -> tuple[str, float]:
        cp = letter_stream(text)
        if not len(cp) or not self.languages:
            return UNKNOWN, 0.0
        v = ngram_vector(cp)
        family, p = self._vote(sorted(set(self.family_of.values())), v)
        language, q = self._vote([x for x in self.languages if self.family_of[x] == family], v)
        return language, float(min(1.0, max(0.0, p * q)))


def fit_vectors(x: np.ndarray, labels: list[str]) -> Model:
    languages = sorted(set(labels))
    labels_ = np.array(labels)
    known = {code: family for family, codes in FAMILIES.items() for code in codes}
    means = {lang: x[labels_ == lang].mean(axis=0) for lang in languages}
    family_of = {lang: known[lang] for lang in languages if lang in known}
    for lang in languages:
        if lang not in family_of:
            near = [(float(means[lang] @ means[o] / (np.linalg.norm(means[lang]) * np.linalg.norm(means[o]) + 1e-12)), o) for o in languages if o in known]
            family_of[lang] = known[max(near)[1]] if near else "other"
    model = Model(languages, family_of)
    family = np.array([family_of[lang] for lang in labels])
    for a, b in combinations(sorted(set(family_of.values())), 2):
        rows = (family == a) | (family == b)
        model.machines[a, b] = train_svm(x[rows], np.where(family[rows] == a, 1.0, -1.0))
    for f in set(family_of.values()):
        for a, b in combinations([lang for lang in languages if family_of[lang] == f], 2):
            rows = (labels_ == a) | (labels_ == b)
            model.machines[a, b] = train_svm(x[rows], np.where(labels_[rows] == a, 1.0, -1.0))
    return model


def held_out(id_col: Column) -> Column:
    """crc32(id as text) mod 4 is 2; null ids are not."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = 400, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    """Fit on about ``per_language`` labelled documents of each label, none of them held out.

    Sample shares come from counts of the distinct (id, text) of each label over all rows, and rows that repeat both
    count once, so what reaches the driver is bounded whatever the ids are (twice the expected sample is its hard
    limit); languages are assumed to be at most a few hundred.  A null id is an id like any other.  Rows without label,
    or without a letter, are not used; no usable row gives a model that knows no language.
    """
    rows = docs.where(~held_out(F.col(id_col)) & F.col(label_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"))
    rows = rows.withColumn("u", F.pmod(F.xxhash64("id", F.xxhash64("text"), F.lit(7)), F.lit(1 << 30)) / float(1 << 30))
    counts = {r[0]: r[1] for r in rows.groupBy("label").agg(F.approx_count_distinct("u", 0.02)).collect()}
    if not counts:
        return Model([], {})
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / max(1, n)))])
    sample = rows.where(F.col("u") < share[F.col("label")]).dropDuplicates(["label", "u"]).orderBy("u", "label").limit(2 * per_language * len(counts))

    def make():
        def f(text):
            return [pa.array([ngram_vector(letter_stream(t)).tobytes() for t in str_texts(text)], pa.binary())]

        return f

    got = squeezed(map_rows(sample, ["text"], [("v", T.BinaryType())], make, keep=["label"]).orderBy(F.xxhash64("v"), "label"), "v").toPandas()
    if got.empty:
        return Model([], {})
    x = vectors(list(got.v))
    some = x.any(axis=1)
    return fit_vectors(x[some], list(got.label[some])) if some.any() else Model([], {})


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Add the predicted language and a score in [0, 1] to every row.

    ``und`` with score 0 where the text is null or has no letter.  Only the text is an
    input of the prediction; whole texts count.  Columns that already have these names are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (lang_name.lower(), score_name.lower())]

    def make():
        def f(text):
            got = [model.predict(t) for t in str_texts(text)]
            return [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]

        return f

    return map_rows(docs, [text_col], [(lang_name, T.StringType()), (score_name, T.DoubleType())], make, keep=keep)


def accepted(docs: DataFrame, model: Model, languages: list[str] | None = None, least: float = 0.05, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` (its columns) in a language that is learned and wanted (default: any), with a score of ``least`` or more.  Texts that are null or without a letter go."""
    ship(docs.sparkSession)
    wanted = None if languages is None else frozenset(languages)

    def make():
        def rating(text: str) -> float:
            lang, score = model.predict(text)
            return score if lang != UNKNOWN and (wanted is None or lang in wanted) else -1.0

        return lambda text: pa.array(map(rating, str_texts(text)), pa.float64())

    return docs.where(text_scores(make, docs[text_col]) >= least)
