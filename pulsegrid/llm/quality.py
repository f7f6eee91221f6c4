"""Quality scores: a small byte-level convolutional network, trained and run in numpy.

Bytes are embedded; learned filters of ``width`` bytes slide over overlapping chunks that together
cover the whole text; a chunk keeps each filter's largest and mean response; a document keeps the
largest of these over its chunks and their mean, and a logistic layer makes one probability of them.
Training runs in one task over a bounded sample of labelled documents (``rows``), with all chunks of each; responses
are computed a slice of chunks at a time, so memory does not follow a document's length.

Defined results: null and empty texts are one chunk of padding, and a byte 0 in a text counts as padding, as UTF-8 prose has none;
repeated rows score alike; without labelled rows every score is 0.5; a null id is never learned from and its ``held_out`` is
null; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame

from pulsegrid.llm import labelled

THRESHOLD = 0.7
#: At most this many labelled rows are fitted on.
TRAIN_ROWS = 3000
PAD = 0


@dataclass(frozen=True)
class Options:
    embedding: int = 6
    width: int = 8
    stride: int = 2
    filters: int = 24
    chunk: int = 256
    overlap: int = 32
    epochs: int = 5
    batch: int = 32
    rate: float = 0.01


def chunks(text: bytes, o: Options) -> np.ndarray:
    """Overlapping chunks that cover the text, padded at the end, at least one."""
    step = o.chunk - o.overlap
    n = max(1, -(-(len(text) - o.overlap) // step))
    padded = np.full(n * step + o.overlap, PAD, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return sliding_window_view(padded, o.chunk)[::step]


def shapes(o: Options) -> list[tuple[int, ...]]:
    return [(256, o.embedding), (o.width * o.embedding, o.filters), (o.filters,), (4 * o.filters,), (1,)]


def unpack(model: bytes, o: Options) -> list[np.ndarray]:
    flat, out, k = np.frombuffer(model, np.float32), [], 0
    for s in shapes(o):
        n = int(np.prod(s))
        out.append(flat[k : k + n].reshape(s))
        k += n
    return out


def respond(c: np.ndarray, p: list[np.ndarray], o: Options) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, responses, which windows hold text) of chunks ``c``."""
    embedded = p[0][c]
    x = sliding_window_view(embedded, o.width, axis=1)[:, :: o.stride].transpose(0, 1, 3, 2)
    x = np.ascontiguousarray(x).reshape(len(c), -1, o.width * o.embedding)
    r = np.maximum(x @ p[1] + p[2], 0)
    real = (c[:, : (r.shape[1] - 1) * o.stride + 1 : o.stride] != PAD).astype(np.float32)
    real[:, 0] = 1
    return x, r, real


def pool(r: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Per chunk, each filter's largest and mean response over windows that begin in text."""
    r = r * real[:, :, None]
    return np.concatenate([r.max(1), r.sum(1) / real.sum(1)[:, None]], 1)


def gradients(parts: list[np.ndarray], labels: np.ndarray, p: list[np.ndarray], o: Options, slice_: int = 256) -> tuple[float, list[np.ndarray]]:
    """Mean logistic loss of documents, given as chunks, and its gradients."""
    f = o.filters
    n = np.array([len(c) for c in parts])
    start, owner = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    c = np.concatenate(parts)
    cuts = range(0, len(c), slice_)
    kept = [respond(c[k : k + slice_], p, o) for k in cuts] if len(cuts) == 1 else None
    h = np.concatenate([pool(*(kept[0] if kept else respond(c[k : k + slice_], p, o))[1:]) for k in cuts])
    high, mean = np.maximum.reduceat(h, start), np.add.reduceat(h, start) / n[:, None]
    z = np.concatenate([high, mean], 1)
    y = 1 / (1 + np.exp(-np.clip(z @ p[3] + p[4], -30, 30)))
    loss = float(-np.mean(np.where(labels > 0, np.log(y), np.log(1 - y))))
    g = ((y - labels) / len(parts)).astype(p[3].dtype)
    dz = g[:, None] * p[3]
    # Of chunks that share a document's largest response the first one takes its gradient.
    best = (h == high[owner]) & (h > 0)
    first = np.zeros_like(best)
    rank = np.cumsum(best, 0)
    first[:] = best & (rank - (rank[start] - best[start])[owner] == 1)
    dh = (dz[:, 2 * f :] / n[:, None])[owner] + dz[:, : 2 * f][owner] * first
    grads = [np.zeros_like(x) for x in p]
    for k in cuts:
        part = c[k : k + slice_]
        x, r, real = kept[0] if kept else respond(part, p, o)
        r = r * real[:, :, None]
        d = dh[k : k + slice_]
        top = r.argmax(1)
        dr = (d[:, None, f:] / real.sum(1)[:, None, None]) * np.ones_like(r)
        np.put_along_axis(dr, top[:, None], np.take_along_axis(dr, top[:, None], 1) + d[:, None, :f], 1)
        dr *= (r > 0) * real[:, :, None]
        dx = (dr @ p[1].T).reshape(len(part), -1, o.width, o.embedding)
        de = np.zeros((*part.shape, o.embedding), p[0].dtype)
        for j in range(o.width):
            de[:, j : j + dx.shape[1] * o.stride : o.stride][:, : dx.shape[1]] += dx[:, :, j]
        flat = part.ravel()
        grads[0] += np.stack([np.bincount(flat, de[:, :, e].ravel(), 256) for e in range(o.embedding)], 1).astype(p[0].dtype)
        grads[1] += np.tensordot(x, dr, ([0, 1], [0, 1]))
        grads[2] += dr.sum((0, 1))
    grads[0][PAD] = 0
    grads[3] += g @ z
    grads[4] += g.sum()
    return loss, grads


def fit(texts: list[bytes], labels: np.ndarray, o: Options = Options()) -> bytes:
    rng = np.random.default_rng(11)
    p = [rng.normal(0, 0.5, shapes(o)[0]), rng.normal(0, 0.15, shapes(o)[1]), np.zeros(o.filters), np.zeros(4 * o.filters), np.zeros(1)]
    p = [x.astype(np.float32) for x in p]
    p[0][PAD] = 0
    if not len(texts):
        return b"".join(x.tobytes() for x in p)
    p[4][0] = np.log((labels.mean() + 0.01) / (1.01 - labels.mean()))
    m, v, t = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    steps = o.epochs * -(-len(texts) // o.batch)
    for _ in range(o.epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(texts), o.batch):
            docs = order[k : k + o.batch]
            _, grads = gradients([chunks(texts[d], o) for d in docs], labels[docs], p, o)
            grads[3] += 1e-4 * p[3]
            t += 1
            rate = o.rate * (1 - 0.9 * t / steps)
            for i, d in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.99 * v[i] + 0.01 * d * d
                p[i] = (p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return b"".join(x.tobytes() for x in p)


class Scorer:
    def __init__(self, model: bytes, o: Options, block: int = 128):
        self.model, self.o, self.block = model, o, block

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        o, p = self.o, unpack(self.model, self.o)
        parts = [chunks(t, o) for t in texts]
        n = np.array([len(c) for c in parts])
        c, start = np.concatenate(parts), np.cumsum(n) - n
        h = np.concatenate([pool(*respond(c[k : k + self.block], p, o)[1:]) for k in range(0, len(c), self.block)])
        z = np.concatenate([np.maximum.reduceat(h, start), np.add.reduceat(h, start) / n[:, None]], 1)
        return 1 / (1 + np.exp(-np.clip(z @ p[3] + p[4], -30, 30)))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = TRAIN_ROWS, options: Options = Options()) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1) and ``predicted``."""
    model = labelled.fit_once(labelled.sample(docs, labels, "quality", rows), lambda t, y: fit(t, y, options))
    return labelled.scored(docs, Scorer(model, options), threshold)
