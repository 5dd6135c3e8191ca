"""Quality classifier: regularised quadratic discriminant over document statistics.

Statistics of the whole text are put on scales where they are roughly normal. Each class has a mean and a covariance; the
covariance is shrunk towards the pooled one and that towards a multiple of the identity, so it always has a Cholesky
factor. A document's score is the posterior of label 1 from the difference of the two log-densities, whose Mahalanobis
distances use the cached inverse factors.

Moments come from all labelled rows, as partial sums per task. A null or empty text has the statistics of no words and a
score like any other. Labels other than 0 and 1, null labels and labels without a document teach nothing; a document with
several labels counts once for each. If a class has fewer than two rows the model scores every text with the share of
label 1 (0.5 without labels). Repeated rows are scored alike; an empty table gives none.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import with_columns

FEATURES = (
    "words", "word_length", "symbols", "shouts", "capitals", "digits", "distinct_words", "same_again", "distinct_pairs",
    "repeated_lines", "line_length", "stops", "bars", "top_word",
)
_SYMBOLS, _SHOUTS, _DIGITS, _STOPS, _BARS = b"#*$%&<>@^~{}[]\\=+_", b"!?", b"0123456789", b".,;:", b"|"
_CAPITALS = bytes(range(65, 91))
#: Labels whose ids are broadcast (16 bytes each).
FEW = 2_000_000


def statistics(text: bytes | None) -> list[float]:
    raw = text or b""
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = sum(map(len, words))
    rows = [r for r in raw.split(b"\n") if r.strip()]
    seen = Counter(words)
    without = lambda these: chars and math.sqrt((len(raw) - len(raw.translate(None, these))) / chars)
    pairs = set(zip(words, words[1:]))
    again = sum(map(eq, words, words[1:]))
    return [
        math.log1p(n), math.log(chars / n), without(_SYMBOLS), without(_SHOUTS), without(_CAPITALS), without(_DIGITS),
        math.log(n / len(seen)), math.sqrt(again / n), math.log1p(n - 1) - math.log1p(len(pairs)),
        math.sqrt(1 - len(set(rows)) / len(rows)), math.log(n / len(rows)), without(_STOPS), without(_BARS),
        math.sqrt(max(seen.values()) / n),
    ]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``stats`` in place of the text."""
    return with_columns(docs, [text], lambda: lambda texts: [[statistics(t) for t in texts]], "stats array<double>", without=(text,))


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    mean: np.ndarray  # class, feature
    inverse: np.ndarray  # class, feature, feature: inverse Cholesky factors
    offset: np.ndarray  # class: log prior - log of the factor's determinant
    share: float | None = None  # the score if nothing could be learned

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if self.share is not None:
            return np.full(len(stats), self.share)
        x = (stats - self.centre) / self.scale
        log = [self.offset[c] - 0.5 * (((x - self.mean[c]) @ self.inverse[c].T) ** 2).sum(1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def _moments(labelled: DataFrame) -> dict[int, np.ndarray]:
    """Per label the sums of (1, x)(1, x)^T; each task sends one matrix per label."""
    width = len(FEATURES) + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, width - 1)
            x = np.hstack([np.ones((len(x), 1)), x])
            for c in np.unique(label):
                part = x[label == c]
                total[int(c)] = total.get(int(c), 0) + part.T @ part
        for c, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * m.size, pa.int32()), pa.array(range(m.size), pa.int32()), pa.array(m.ravel())],
                                             ["label", "cell", "value"])

    cells = labelled.mapInArrow(run, "label int, cell int, value double").groupBy("label", "cell").agg(F.sum("value").alias("value"))
    out: dict[int, np.ndarray] = {}
    for r in cells.collect():  # two labels, a fixed number of cells
        out.setdefault(r["label"], np.zeros(width * width))[r["cell"]] = r["value"]
    return {c: m.reshape(width, width) for c, m in out.items()}


def _known(labels: DataFrame, label: str, doc_id: str) -> DataFrame:
    return labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).where(F.col("_label").isin(0, 1))


def labelled(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", few: int = FEW) -> DataFrame:
    """The rows of ``docs`` that :func:`fit` learns from, found before texts are read in Python; all rows if the labels are more
    than ``few``, as only a broadcast join is cheaper than the statistics it saves."""
    known = _known(labels, label, doc_id)
    if known.limit(few + 1).count() > few:
        return docs
    return docs.join(F.broadcast(known.select("_id").distinct()), docs[doc_id] == F.col("_id"), "left_semi")


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", pooled: float = 0.15, ridge: float = 0.02,
        doc_id: str = "doc_id") -> Model:
    """Learns from the rows of ``stats`` (``doc_id, stats``) that have a label 0 or 1."""
    lab = _known(labels, label, doc_id)
    both = stats.join(lab, stats[doc_id] == lab["_id"]).select("_label", "stats")
    m = _moments(both)
    counts = {c: m[c][0, 0] if c in m else 0.0 for c in (0, 1)}
    if min(counts.values()) < 2:
        total = sum(counts.values())
        none = np.zeros(0)
        return Model(none, none, none, none, none, counts[1] / total if total else 0.5)
    total = m[0] + m[1]
    n = total[0, 0]
    centre = total[0, 1:] / n
    spread = np.sqrt(np.maximum(np.diag(total)[1:] / n - centre ** 2, 0))
    scale = np.where(spread > 1e-9, spread, 1.0)
    mean, cov = [], []
    for c in (0, 1):
        mu = m[c][0, 1:] / counts[c]
        mean.append((mu - centre) / scale)
        cov.append((m[c][1:, 1:] / counts[c] - np.outer(mu, mu)) / np.outer(scale, scale))
    within = (counts[0] * cov[0] + counts[1] * cov[1]) / n
    d = len(FEATURES)
    target = (1 - ridge) * within + ridge * max(np.trace(within) / d, 1e-3) * np.eye(d)
    inverse, offset = [], []
    for c in (0, 1):
        factor = np.linalg.cholesky((1 - pooled) * (1 - ridge) * cov[c] + (1 - (1 - pooled) * (1 - ridge)) * target)
        inverse.append(np.linalg.inv(factor))
        offset.append(math.log(counts[c] / n) - np.log(np.diag(factor)).sum())
    return Model(centre, scale, np.array(mean), np.array(inverse), np.array(offset))


def score(stats: DataFrame, model: Model) -> DataFrame:
    """Adds ``score`` to rows with ``stats``."""
    def make():
        return lambda rows: [model.scores(np.array(rows, float).reshape(-1, len(FEATURES)))]

    return with_columns(stats, ["stats"], make, "score double")


def score_texts(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Adds the score straight from the texts."""
    def make():
        return lambda texts: [model.scores(np.array([statistics(t) for t in texts], float).reshape(-1, len(FEATURES)))]

    return with_columns(docs, [text], make, f"`{name}` double")
