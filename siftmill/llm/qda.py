"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Class covariances are shrunk towards the pooled one and its diagonal; scores are differences of Gaussian log-densities,
with Mahalanobis terms from Cholesky factors that are computed once, when the model is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm import bytetext as bt

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&<>@^~_=+\\/")] = True
FEATURES = (
    "log_words", "word_length", "word_length_sd", "symbols", "bars", "exclaims", "capitals", "digits", "stops", "commas",
    "distinct", "repeat", "dup_lines", "line_words", "short_words", "markup", "non_ascii", "controls",
)


def statistics(data: bytes) -> list[float]:
    """Transformed statistics of one text, in the order of FEATURES; shares enter as square roots. Empty: zeros."""
    buf = bt.as_array(data)
    s, e = bt.word_spans(buf)
    n = len(s)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(buf, minlength=256)
    size = e - s
    h = bt.span_hashes(bt.LOWER[buf], s, e)
    three = bt.combine(h, 3)
    repeat = 1 - len(np.unique(three)) / len(three) if len(three) else 0.0
    lines = [x for x in data.split(b"\n") if x.strip()]
    upper = int(count[65:91].sum())
    letters = upper + int(count[97:123].sum())
    # distinct words against what a text of this length usually has
    distinct = np.log(len(np.unique(h))) / max(np.log(n), 1e-9) if n > 1 else 1.0
    root = lambda x: float(np.sqrt(max(x, 0.0)))
    return [
        float(np.log1p(n)), float(np.log(size.mean())), root(size.std() / size.mean()),
        root(count[_SYMBOL].sum() / n), root(count[124] / n), root(count[33] / n), root(upper / max(letters, 1)),
        root(count[48:58].sum() / len(buf)), root((count[46] + count[63]) / n), root(count[44] / n),
        float(distinct), root(repeat), root(1 - len(set(lines)) / len(lines)), float(np.log1p(n / len(lines))),
        root(np.count_nonzero(size <= 3) / n), root((count[60] + count[123] + count[91]) / n),
        root(count[128:].sum() / len(buf)), root(count[:9].sum() / len(buf)),
    ]


def featurise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, f array<double>): one row per input row; null text as empty; other columns are not read."""
    bt.small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t or b"") for t in bt.texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(rows, pa.list_(pa.float64()))], ["id", "f"])

    return src.mapInArrow(bt.tidied(run), f"id {src.schema['id'].dataType.simpleString()}, f array<double>").withColumnRenamed("id", id_col)


@dataclass
class Discriminant:
    """A fitted model: scaling, and per class mean, Cholesky factor of the inverse covariance, and constant."""

    centre: np.ndarray
    scale: np.ndarray
    classes: dict[int, tuple[np.ndarray, np.ndarray, float]]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """P(label 1) of each row."""
        if len(self.classes) < 2:
            return np.full(len(x), self.prior)
        z = (x - self.centre) / self.scale
        logs = {}
        for label, (mean, white, const) in self.classes.items():
            logs[label] = const - 0.5 * (((z - mean) @ white.T) ** 2).sum(1)
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -500, 500)))


def fit(features: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", shrink: float = 0.2, to_diagonal: float = 0.1, prior: bool = True) -> Discriminant:
    """Fits on every row of `features` that has a label 0 or 1 (all of them: sums need no sample).

    Each partition reduces its rows to per-class counts, sums and products; these are added up by class and
    position, so the driver gets 2 * (1 + d + d*d) numbers at any size. Rows with other or null labels are
    ignored; repeated label rows count as often as they occur. With fewer than two classes the model scores
    the share of label 1 (0.5 without rows).
    """
    d = len(FEATURES)
    j = features.select(F.col(id_col).alias("id"), "f").join(labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")), "id").select("y", "f")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for b in batches:
            y = b.column("y").to_numpy(zero_copy_only=False)
            x = b.column("f").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for c in (0, 1):
                v = x[y == c]
                total[c] += np.concatenate(([len(v)], v.sum(0), (v.T @ v).ravel()))
        pos = np.arange(total.size, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(pos), pa.array(total.ravel())], ["pos", "v"])

    total = np.zeros(2 * (1 + d + d * d))
    for r in j.mapInArrow(bt.tidied(sums), "pos int, v double").groupBy("pos").agg(F.sum("v").alias("v")).collect():
        total[r.pos] = r.v
    total = total.reshape(2, -1)
    n, s, p = total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d)
    share = float(n[1] / n.sum()) if n.sum() else 0.5
    if min(n) < 2:
        return Discriminant(np.zeros(d), np.ones(d), {}, share)
    centre = s.sum(0) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(p.sum(0)) / n.sum() - centre**2, 1e-6))
    mean = s / n[:, None]
    cov = [((p[c] / n[c]) - np.outer(mean[c], mean[c])) / np.outer(scale, scale) for c in (0, 1)]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    classes = {}
    for c in (0, 1):
        own = (1 - shrink) * cov[c] + shrink * pooled
        own = (1 - to_diagonal) * own + to_diagonal * np.diag(np.diag(pooled)) + 1e-2 * np.eye(d)
        chol = np.linalg.cholesky(own)
        const = -np.log(np.diag(chol)).sum() + (np.log(n[c] / n.sum()) if prior else 0.0)
        classes[c] = ((mean[c] - centre) / scale, np.linalg.inv(chol), float(const))
    return Discriminant(centre, scale, classes, share)


def score(features: DataFrame, model: Discriminant, id_col: str = "doc_id") -> DataFrame:
    """(id, score double, predicted int): score is P(label 1), predicted is score >= 0.5."""
    src = features.select(F.col(id_col).alias("id"), "f")
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("f").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(y), pa.array((y >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    return src.mapInArrow(bt.tidied(run), f"id {src.schema['id'].dataType.simpleString()}, score double, predicted int").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Discriminant, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that the model predicts label 1 for, all columns as they are; in one pass, without a shuffle."""

    bt.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                x = np.array([statistics(t or b"") for t in bt.texts(part.column(text_col))]).reshape(-1, len(FEATURES))
                yield part.filter(pa.array(model.score(x) >= 0.5))

    return docs.mapInArrow(bt.tidied(run), docs.schema)
