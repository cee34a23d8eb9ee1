"""Language identification by a byte convolutional network, trained in numpy and applied to windows of bytes.

Bytes are embedded, convolved with filters of several widths, rectified, pooled by maximum over a window and
classified by softmax. A text is cut into overlapping windows of fixed length that cover all of it; its probabilities
are the means over its windows, weighted by their bytes. Training takes one window, at a place anywhere in the text
that its hash draws, from each of about SAMPLE labelled rows, the first of each language in hash order: all rows of a
rare language, and equally many of each of the others.

Edge cases: null texts and texts without a letter are 'und' with score 0, as is every text if no row is labelled. Null
labels teach nothing. Rows that repeat are each returned. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, keyed, pieces

WINDOW = 256
WIDTHS, FILTERS, DIM = (2, 3, 4), 12, 6
SAMPLE = 8000
#: Rows of each language at least, if it has them.
LEAST = 100
EPOCHS, BATCH = 10, 64
#: Windows that go through the network at once.
AT_ONCE = 64
STEP = WINDOW - max(WIDTHS) + 1


class ByteCNN:
    """Weights: embedding (256, DIM), one (width * DIM, FILTERS) matrix and bias per width, and the output layer."""

    def __init__(self, classes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.p = {"e": rng.normal(0, 0.5, (256, DIM)).astype(np.float32), "o": draw(len(WIDTHS) * FILTERS, classes), "ob": np.zeros(classes, np.float32)}
        for w in WIDTHS:
            self.p[f"c{w}"], self.p[f"b{w}"] = draw(w * DIM, FILTERS), np.zeros(FILTERS, np.float32)

    def _pooled(self, windows: np.ndarray, where: bool = False):
        flat = self.p["e"][windows].reshape(len(windows), -1)
        top, at = [], []
        for w in WIDTHS:
            n = windows.shape[1] - w + 1
            cut = np.lib.stride_tricks.as_strided(flat, (len(flat), n, w * DIM), (flat.strides[0], DIM * 4, 4))
            out = np.ascontiguousarray(cut).reshape(-1, w * DIM) @ self.p[f"c{w}"]
            out = out.reshape(len(flat), n, FILTERS)
            if where:
                at.append(out.argmax(1))
            top.append(out.max(1) + self.p[f"b{w}"])
        return np.concatenate(top, 1), at

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def predict(self, windows: np.ndarray) -> np.ndarray:
        top, _ = self._pooled(windows)
        return self._softmax(np.maximum(top, 0) @ self.p["o"] + self.p["ob"])

    def _gradients(self, windows: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        top, at = self._pooled(windows, where=True)
        hidden = np.maximum(top, 0)
        d = (self._softmax(hidden @ self.p["o"] + self.p["ob"]) - target) / len(windows)
        g = {"o": hidden.T @ d, "ob": d.sum(0), "e": np.zeros_like(self.p["e"])}
        back = (d @ self.p["o"].T) * (top > 0)
        rows = np.arange(len(windows))[:, None]
        for i, w in enumerate(WIDTHS):
            mine = back[:, i * FILTERS : (i + 1) * FILTERS]
            chars = windows[rows[..., None], at[i][..., None] + np.arange(w)]  # rows, filters, width
            seen = self.p["e"][chars].reshape(len(windows), FILTERS, w * DIM)
            g[f"c{w}"] = np.einsum("nfk,nf->kf", seen, mine)
            g[f"b{w}"] = mine.sum(0)
            to = (mine[..., None] * self.p[f"c{w}"].T[None]).reshape(-1, DIM)
            np.add.at(g["e"], chars.reshape(-1), to)
        return g

    def train(self, windows: np.ndarray, labels: np.ndarray, seed: int = 11) -> None:
        """Adam over shuffled batches; classes weigh alike."""
        rng = np.random.default_rng(seed)
        classes = self.p["ob"].size
        weight = 1 / np.maximum(np.bincount(labels, minlength=classes), 1)
        share = weight[labels] / weight[labels].sum()
        target = np.eye(classes, dtype=np.float32)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for t in range(1, EPOCHS * max(1, len(windows) // BATCH) + 1):
            pick = rng.choice(len(windows), BATCH, p=share)
            for k, g in self._gradients(windows[pick], target[labels[pick]]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] -= (0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


def windows_of(text: bytes) -> np.ndarray:
    """All windows of a text, the last padded with zero bytes."""
    n = max(1, -(-(len(text) - WINDOW) // STEP) + 1)
    padded = np.zeros((n - 1) * STEP + WINDOW, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP]


def _share(counts: list[int]) -> int:
    """Rows of each language at most, so that all together come to SAMPLE, or LEAST if that is more."""
    left, level = SAMPLE, 0
    for i, n in enumerate(sorted(counts)):
        level = left // (len(counts) - i)
        if n > level:
            break
        left -= n
    return max(level, LEAST)


def _sample(rows: DataFrame) -> tuple[list[str], pd.DataFrame]:
    """All languages of rows(order, lang, cut), and the first rows of each by hash, read as unsigned."""
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    most = _share(list(counts.values()))
    found = hashed_sample(rows, "order", dict.fromkeys(counts, most), by="lang").toPandas() if counts else pd.DataFrame(columns=rows.columns)
    return sorted(counts), found.sort_values(["order", "lang", "cut"])


def fit(docs: DataFrame, learn: Column) -> tuple[list[str], ByteCNN | None]:
    """The learned languages and the network, from rows of docs(doc_id, text, lang) for which learn holds."""
    order = F.xxhash64("doc_id", "text")
    start = F.pmod(order, F.greatest(F.length("text") - WINDOW // 2, F.lit(1))) + 1
    rows = docs.where(learn).where("text IS NOT NULL AND lang IS NOT NULL").select(order.alias("order"), "lang", F.substring(F.col("text"), start.cast("int"), F.lit(WINDOW)).alias("cut"))
    names, sample = _sample(rows)
    if sample.empty:
        return [], None
    windows = np.stack([windows_of(t.encode()[:WINDOW])[0] for t in sample["cut"]])
    net = ByteCNN(len(names))
    net.train(windows, sample["lang"].map(names.index).to_numpy())
    return names, net


def _predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    names, net = model.value
    for batch in pieces(batches):
        lang, score = [], []
        keep, owner, bytes_in = [], [], []
        total = np.zeros((batch.num_rows, max(len(names), 1)))

        def flush() -> None:
            if keep:
                p = net.predict(np.concatenate(keep)) * np.concatenate(bytes_in)[:, None]
                np.add.at(total, np.concatenate(owner), p)
                keep.clear(), owner.clear(), bytes_in.clear()

        for i, text in enumerate(batch.column("text").to_pylist()):
            if not names or not text or not any(map(str.isalpha, text)):
                continue
            raw = text.encode()
            cut = windows_of(raw)
            size = np.full(len(cut), WINDOW)
            size[-1] = len(raw) - STEP * (len(cut) - 1)
            for at in range(0, len(cut), AT_ONCE):
                part = cut[at : at + AT_ONCE]
                keep.append(part), owner.append(np.full(len(part), i)), bytes_in.append(size[at : at + AT_ONCE])
                if sum(map(len, keep)) >= AT_ONCE:
                    flush()
        flush()
        for row in total:
            whole = row.sum()
            lang.append(names[int(row.argmax())] if whole else "und")
            score.append(float(row.max() / whole) if whole else 0.0)
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["key", "lang_pred", "score"])


def identify(docs: DataFrame, model: tuple[list[str], ByteCNN | None], key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) for every row of docs(key, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(lambda it: _predict(it, shared), keyed(rows, "lang_pred string, score double"))
    return found.select(F.col("key").alias(key), "lang_pred", "score")
