"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes are embedded, filtered at several widths, max-pooled over a fixed-length window and classified by
softmax. A text is read whole, as consecutive windows; its log-probabilities are the windows', weighted by
how many bytes of letters they hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm import bytetext as bt

WINDOW = 192
WIDTHS = (2, 3, 4)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
PAD = 0x20
#: Windows classified together.
BATCH = 4096


def windows(data: bytes, size: int = WINDOW) -> np.ndarray:
    """All bytes of a text, A-Z lowered, as rows of `size` bytes; the last row is padded with spaces."""
    n = max(1, -(-len(data) // size))
    out = np.full(n * size, PAD, np.uint8)
    out[: len(data)] = bt.LOWER[bt.as_array(data)]
    return out.reshape(n, size)


def has_letter(data: bytes) -> bool:
    buf = bt.as_array(data)
    if _LETTER[buf[buf < 128]].any():
        return True
    return bool((buf >= 128).any()) and any(c.isalpha() for c in data.decode("utf-8", "replace"))


@dataclass
class ByteCnn:
    langs: list[str]
    embed: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (width, d, f)
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> None:
        """Per width: responses to byte pairs and, at odd widths, to the last byte, so that filtering is looking up."""
        self.pairs, self.last = {}, {}
        for w, k in self.filters.items():
            one = np.einsum("bd,wdf->wbf", self.embed, k).astype(np.float32)
            self.pairs[w] = [(one[j][:, None, :] + one[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, w - 1, 2)]
            self.last[w] = one[w - 1] if w % 2 else None

    def pooled(self, x: np.ndarray) -> np.ndarray:
        got = []
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        for w in self.filters:
            n = x.shape[1] - w + 1
            z = self.pairs[w][0][pair[:, :n]]
            for i, t in enumerate(self.pairs[w][1:], 1):
                z += t[pair[:, 2 * i : 2 * i + n]]
            if self.last[w] is not None:
                z += self.last[w][x[:, w - 1 : w - 1 + n]]
            got.append(np.maximum(z.max(1) + self.bias[w], 0))
        return np.concatenate(got, 1)

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        if not hasattr(self, "pairs"):
            self.tables()
        out = np.empty((len(x), len(self.langs)))
        for i in range(0, len(x), 64):
            z = self.pooled(x[i : i + 64]) @ self.out + self.out_bias
            z = z - z.max(1, keepdims=True)
            out[i : i + 64] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return out

    def predict_all(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        """(language, probability) of each text; ("und", 0.0) for null, for texts without a letter and for a model without languages.

        Windows of many texts go through the network together, BATCH at a time, whatever the texts' lengths.
        """
        out, held = [("und", 0.0)] * len(texts), 0
        total, weight = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        parts: list[np.ndarray] = []
        owner: list[np.ndarray] = []

        def flush() -> None:
            nonlocal held
            x, own = np.concatenate(parts), np.concatenate(owner)
            w = _LETTER[x].sum(1)
            np.add.at(total, own, w[:, None] * self.log_probs(x))
            np.add.at(weight, own, w)
            parts.clear()
            owner.clear()
            held = 0

        open_ = [i for i, t in enumerate(texts) if self.langs and t and has_letter(t)]
        step = WINDOW * BATCH
        for i in open_:
            for at in range(0, len(texts[i]), step):  # bounded memory for very long texts
                x = windows(texts[i][at : at + step])
                parts.append(x)
                owner.append(np.full(len(x), i))
                held += len(x)
                if held >= BATCH:
                    flush()
        if held:
            flush()
        for i in open_:
            z = total[i] / max(weight[i], 1)
            p = np.exp(z - z.max())
            p /= p.sum()
            out[i] = (self.langs[int(p.argmax())], float(p.max()))
        return out

    def predict(self, data: bytes | None) -> tuple[str, float]:
        return self.predict_all([data])[0]


def loss_and_gradients(p: dict[str, np.ndarray], x: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean softmax cross-entropy of windows `x` whose languages have the numbers `target`, and its gradient by each of the parameters `p`."""
    n, per_width = len(x), len(p[f"b{WIDTHS[0]}"])
    emb = p["e"][x]  # n, L, d
    acts, tops = [], {}
    for w in WIDTHS:
        span = x.shape[1] - w + 1
        z = sum(emb[:, j : j + span] @ p[f"k{w}"][j] for j in range(w))
        tops[w] = z.argmax(1)  # n, f
        acts.append(np.take_along_axis(z, tops[w][:, None], 1)[:, 0] + p[f"b{w}"])
    a = np.concatenate(acts, 1)
    r = np.maximum(a, 0)
    z = r @ p["o"] + p["ob"]
    z = np.exp(z - z.max(1, keepdims=True))
    g = z / z.sum(1, keepdims=True)
    loss = float(-np.log(np.maximum(g[np.arange(n), target], 1e-30)).mean())
    g[np.arange(n), target] -= 1
    g /= n
    grad = {"o": r.T @ g, "ob": g.sum(0), "e": np.zeros_like(p["e"])}
    da = (g @ p["o"].T) * (a > 0)
    for i, w in enumerate(WIDTHS):
        d = da[:, i * per_width : (i + 1) * per_width]
        grad[f"b{w}"] = d.sum(0)
        grad[f"k{w}"] = np.empty_like(p[f"k{w}"])
        for j in range(w):
            byte = np.take_along_axis(x, tops[w] + j, 1)  # n, f: only the pooled position gets a gradient
            grad[f"k{w}"][j] = np.einsum("nfd,nf->df", p["e"][byte], d)
            np.add.at(grad["e"], byte, d[:, :, None] * p[f"k{w}"][j].T[None])
    return loss, grad


def train(x: np.ndarray, y: list[str], dim: int = 8, per_width: int = 16, epochs: int = 6, rate: float = 0.003, seed: int = 7) -> ByteCnn:
    """Trains on windows `x` (rows of bytes) with languages `y`, by Adam on softmax cross-entropy; deterministic."""
    langs = sorted(set(y))
    rng = np.random.default_rng(seed)
    p = {"e": rng.normal(0, 0.5, (256, dim)), "o": rng.normal(0, 0.1, (per_width * len(WIDTHS), len(langs))), "ob": np.zeros(len(langs))}
    for w in WIDTHS:
        p[f"k{w}"] = rng.normal(0, 1 / np.sqrt(w * dim), (w, dim, per_width))
        p[f"b{w}"] = np.zeros(per_width)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v2 = {k: np.zeros_like(v) for k, v in p.items()}
    target = np.array([langs.index(a) for a in y])
    step = 0
    for _ in range(epochs if len(langs) else 0):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 32):
            rows = order[at : at + 32]
            _, grad = loss_and_gradients(p, x[rows], target[rows])
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v2[k] = 0.999 * v2[k] + 0.001 * grad[k] ** 2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
                p[k] = p[k].astype(np.float32)
    return ByteCnn(langs, p["e"], {w: p[f"k{w}"] for w in WIDTHS}, {w: p[f"b{w}"] for w in WIDTHS}, p["o"], p["ob"])


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts_per_lang: int = 400, windows_per_text: int = 3, max_langs: int = 256) -> ByteCnn:
    """Trains on a bounded sample of the labelled rows.

    The bound: about `texts_per_lang` texts of each language, chosen by a hash of the id, and from each its
    first, middle and last windows (`windows_per_text`), so the driver gets at most about
    texts_per_lang * windows_per_text * languages windows of WINDOW bytes. Rows with null text or language are
    not used. More than `max_langs` languages raise. Without rows the model predicts "und". Repeated rows are examples of their own;
    rows of one id are chosen together; other columns are not read.
    """
    bt.small_batches(labelled.sparkSession)
    src = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = {r.lang: r.n for r in src.groupBy("lang").agg(F.count("*").alias("n")).limit(max_langs + 1).collect()}
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    if not counts:
        return ByteCnn([], np.zeros((256, 1)), {}, {}, np.zeros((0, 0)), np.zeros(0))
    million = 1_000_000
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(million, -(-texts_per_lang * million // n))))])
    chosen = src.where(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("sample")), F.lit(million)) < share[F.col("lang")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got, langs, ids = [], [], []
            for t, lang, i in zip(bt.texts(b.column("text")), b.column("lang").to_pylist(), b.column("id").cast(pa.string()).to_pylist(), strict=True):
                x = windows(t)
                for j in sorted({(len(x) - 1) * k // max(windows_per_text - 1, 1) for k in range(windows_per_text)}):
                    if _LETTER[x[j]].sum() >= 16:
                        got.append(x[j].tobytes())
                        langs.append(lang)
                        ids.append(f"{i}/{j}")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(got, pa.binary()), pa.array(langs, pa.string())], ["key", "x", "lang"])

    rows = sorted(chosen.mapInArrow(bt.tidied(cut), "key string, x binary, lang string").collect())
    if not rows:
        return ByteCnn([], np.zeros((256, 1)), {}, {}, np.zeros((0, 0)), np.zeros(0))
    return train(np.stack([np.frombuffer(bytes(r.x), np.uint8) for r in rows]), [r.lang for r in rows])


def predict(docs: DataFrame, model: ByteCnn, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred string, score double): one row per input row, every text read whole.

    Null, empty and letterless texts give ("und", 0.0). Repeated rows give repeated results; other columns
    are not read.
    """
    bt.small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = model.predict_all(list(bt.texts(b.column("text"))))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["id", "lang_pred", "score"])

    return src.mapInArrow(bt.tidied(run), f"id {src.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)
