"""Language identification by a byte convolutional network.

Bytes (ASCII letters in lower case) are embedded; filters of several widths run over a window of ``LENGTH`` bytes; each
keeps its largest value in the window (max pooling, ReLU); a linear layer and softmax give the languages. Trained in numpy
by Adam on windows of a bounded sample of documents with a ``lang``. A text is cut whole into consecutive windows, the last
padded with zeros; the language of the largest summed log probability is the text's.

For application, embedding and filters are folded into tables: the part of a filter that sees two bytes is a row of a
65,536-row table, so a window costs a few gathers a byte instead of a matrix product.

Results for odd input: null or empty text has a null language, a null confidence and no windows; a null lang trains
nothing; without labelled text every language is null; ties go to the language first in order; repeated rows get the same
answer; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import _lower, buffers, slices

LENGTH = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: Documents of the training sample, by the hash of their ids, and windows of each, evenly spaced.
TRAIN_DOCS, TRAIN_WINDOWS = 4_000, 4
EPOCHS, BATCH, RATE = 6, 128, 0.01
BLOCK = 512


class ByteNet:
    def __init__(self, langs: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.p = {"e": rng.normal(0, 0.5, (256, EMBEDDING))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w * EMBEDDING, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p["v"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs)))
        self.p["c"] = np.zeros(len(langs))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _forward(self, x: np.ndarray):
        e, n = self.p["e"][x], len(x)
        best, features = {}, []
        for w in WIDTHS:
            patches = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(-1, w * EMBEDDING)
            out = (patches @ self.p[f"w{w}"]).reshape(n, -1, FILTERS)
            best[w] = out.argmax(1)
            features.append(np.take_along_axis(out, best[w][:, None], 1)[:, 0] + self.p[f"b{w}"])
        f = np.concatenate(features, 1)
        z = np.maximum(f, 0) @ self.p["v"] + self.p["c"]
        z -= z.max(1, keepdims=True)
        return best, f, z - np.log(np.exp(z).sum(1, keepdims=True))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        best, f, logp = self._forward(x)
        g = np.exp(logp)
        g[np.arange(len(y)), y] -= 1
        g /= len(y)
        out = {"v": np.maximum(f, 0).T @ g, "c": g.sum(0), "e": np.zeros_like(self.p["e"])}
        gf = (g @ self.p["v"].T) * (f > 0)
        for n, w in enumerate(WIDTHS):
            part = gf[:, n * FILTERS : (n + 1) * FILTERS]
            bytes_ = x[np.arange(len(x))[:, None, None], best[w][:, :, None] + np.arange(w)]
            patch = self.p["e"][bytes_].reshape(len(x), FILTERS, w * EMBEDDING)
            out[f"w{w}"] = np.einsum("nfd,nf->df", patch, part)
            out[f"b{w}"] = part.sum(0)
            back = part[:, :, None] * self.p[f"w{w}"].T[None]
            np.add.at(out["e"], bytes_.ravel(), back.reshape(-1, EMBEDDING))
        return out

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 6) -> ByteNet:
        """Adam over batches in which the languages take equal parts."""
        rng = np.random.default_rng(seed)
        share = 1 / np.bincount(y, minlength=len(self.langs))[y]
        m, v, t = {k: 0 * a for k, a in self.p.items()}, {k: 0 * a for k, a in self.p.items()}, 0
        steps = max(1, epochs * len(x) // BATCH)
        for _ in range(steps):
            t += 1
            pick = rng.choice(len(x), min(BATCH, len(x)), p=share / share.sum())
            rate = RATE * (1 - t / (steps + 1))
            for k, g in self.gradients(x[pick], y[pick]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def folded(self) -> Folded:
        return Folded(self)


class Folded:
    """The trained network as tables over bytes and pairs of bytes."""

    def __init__(self, net: ByteNet):
        self.langs, self.v, self.c = net.langs, net.p["v"], net.p["c"]
        one = {w: [net.p["e"] @ net.p[f"w{w}"][i * EMBEDDING : (i + 1) * EMBEDDING] for i in range(w)] for w in WIDTHS}
        pair = lambda a, b: np.ascontiguousarray((a[:, None] + b[None]).reshape(65536, FILTERS))
        self.tables = {w: [pair(one[w][i], one[w][i + 1]) if i + 1 < w else np.ascontiguousarray(one[w][i]) for i in range(0, w, 2)] for w in WIDTHS}
        self.bias = np.concatenate([net.p[f"b{w}"] for w in WIDTHS])

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """(windows, languages) of (windows, LENGTH) bytes."""
        return np.concatenate([self._block(x[k : k + BLOCK]) for k in range(0, len(x), BLOCK)]) if len(x) else np.zeros((0, len(self.langs)), np.float32)

    def _block(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        t = np.ascontiguousarray(x.T).astype(np.intp)
        pairs = t[:-1] * 256 + t[1:]
        f = np.empty((n, FILTERS * len(WIDTHS)), np.float32)
        a, b = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.float32)
        for k, w in enumerate(WIDTHS):
            best = np.full((n, FILTERS), -np.inf, np.float32)
            for i in range(x.shape[1] - w + 1):
                np.take(self.tables[w][0], pairs[i], axis=0, out=a, mode="clip")
                for j, table in enumerate(self.tables[w][1:], 1):
                    np.take(table, pairs[i + 2 * j] if len(table) > 256 else t[i + 2 * j], axis=0, out=b, mode="clip")
                    a += b
                np.maximum(best, a, out=best)
            f[:, k * FILTERS : (k + 1) * FILTERS] = best
        z = np.maximum(f + self.bias, 0) @ self.v + self.c
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def windows(column, length: int = LENGTH):
    """(first text, windows as (n, length) bytes, the text of each) for slices of a string column."""
    data, offsets = buffers(column)
    for i, j in slices(offsets, 1 << 18):
        size = np.diff(offsets[i : j + 1])
        count = -(-size // length)
        out = np.zeros(int(count.sum()) * length, np.uint8)
        first = (np.cumsum(count) - count) * length
        own = _lower[data[offsets[i] : offsets[j]]]
        out[np.arange(len(own)) + np.repeat(first - (offsets[i:j] - offsets[i]), size)] = own
        yield i, out.reshape(-1, length), np.repeat(np.arange(j - i), count)


def _training(batches):
    for b in batches:
        langs = b.column(1).to_pylist()
        out, names = [], []
        for first, x, doc in windows(b.column(0)):
            start = np.searchsorted(doc, np.arange(doc[-1] + 2)) if len(doc) else [0]
            for d in range(len(start) - 1):
                n = start[d + 1] - start[d]
                for k in np.unique(np.arange(TRAIN_WINDOWS) * n // TRAIN_WINDOWS) if n else ():
                    out.append(x[start[d] + k].tobytes())
                    names.append(langs[first + d])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(names, pa.string())], ["x", "lang"])


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Folded | None:
    """Trains on a bounded sample; None if no document has both a lang and a text."""
    ids = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(31)), "doc_id").limit(train_docs)
    chosen = docs.select("doc_id", "text", "lang").join(F.broadcast(ids), "doc_id", "left_semi").filter("lang is not null and text is not null")
    rows = sorted((bytes(r[0]), r[1]) for r in chosen.select("text", "lang").mapInArrow(_training, "x binary, lang string").collect())
    if not rows:
        return None
    langs = sorted({r[1] for r in rows})
    x = np.frombuffer(b"".join(r[0] for r in rows), np.uint8).reshape(len(rows), LENGTH)
    return ByteNet(langs).train(x, np.array([langs.index(r[1]) for r in rows])).folded()


def _labeller(model):
    def run(batches):
        net = model.value
        for b in batches:
            n = b.num_rows
            sums, count = np.zeros((n, len(net.langs) if net else 1)), np.zeros(n, np.int64)
            for first, x, doc in windows(b.column(1)):
                if net and len(x):
                    logp = net.log_probabilities(x)
                    for k in range(logp.shape[1]):
                        part = np.bincount(doc, logp[:, k])
                        sums[first : first + len(part), k] += part
                part = np.bincount(doc) if len(doc) else []
                count[first : first + len(part)] += part
            some = (count > 0) & (net is not None)
            mean = np.exp(sums / np.maximum(1, count)[:, None])
            sure = np.round(mean.max(1) / mean.sum(1), 6)
            best = sums.argmax(1)
            names = [net.langs[k] if ok else None for k, ok in zip(best, some)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(sure, mask=~some), pa.array(count)], ["doc_id", "lang_found", "confidence", "n_windows"])

    return run


def identify(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, lang_found, confidence and n_windows of every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, train_docs))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_labeller(model), "doc_id long, lang_found string, confidence double, n_windows long")
