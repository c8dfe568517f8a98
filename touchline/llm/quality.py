"""Text quality by a byte-level convolutional network in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched
from .sampling import sample

#: Bytes of a chunk, and of its part that the next one doesn't share.
CHUNK, STRIDE = 512, 384
#: Bytes that a filter sees, filters.
WIDTH, FILTERS = 5, 16
#: Labelled rows for fitting, at most, and characters of the longest of them.
ROWS, LONGEST = 1500, 20_000


@dataclass
class ByteConvNet:
    """score = sigmoid(v . [mean over chunks of p, max over chunks of p] + c), where p is a chunk's max-pooled relu(filters).

    table[j, b] holds what byte b at place j of a filter's window adds to each filter, so a convolution is WIDTH look-ups and sums.
    """

    table: np.ndarray  # WIDTH x 257 x FILTERS; byte 256 pads
    bias: np.ndarray
    v: np.ndarray
    c: float

    @classmethod
    def new(cls, seed: int = 0) -> ByteConvNet:
        rng = np.random.default_rng(seed)
        table = rng.normal(0, 0.3, (WIDTH, 257, FILTERS)).astype(np.float32)
        table[:, 256] = 0
        return cls(table, np.zeros(FILTERS, dtype=np.float32), rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32), 0.0)

    def pooled(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(max-pooled responses by chunk, their places, the padded bytes); overlapping chunks cover the whole text, and an empty text is one chunk of padding."""
        x = np.full(max(len(data), 1) + WIDTH - 1, 256, dtype=np.int16)
        x[: len(data)] = np.frombuffer(data, dtype=np.uint8)
        n = len(x) - WIDTH + 1
        starts = np.arange(0, max(1, n - (CHUNK - STRIDE)), STRIDE)
        best, at = np.empty((len(starts), FILTERS), dtype=np.float32), np.empty((len(starts), FILTERS), dtype=np.int64)
        many = 64  # chunks held at once
        for k in range(0, len(starts), many):
            a, b = starts[k], min(n, starts[min(k + many, len(starts)) - 1] + CHUNK)
            z = self.table[0][x[a:b]]
            for j in range(1, WIDTH):
                z += self.table[j][x[a + j : b + j]]
            for i, s in enumerate(starts[k : k + many] - a, start=k):
                part = z[s : s + CHUNK]
                at[i] = part.argmax(axis=0)
                best[i] = part[at[i], np.arange(FILTERS)]
                at[i] += a + s
        return best, at, x

    def maxima(self, data: bytes) -> np.ndarray:
        """As pooled(), responses only: maxima of the parts between chunks' borders meet in the chunks' maxima."""
        x = np.full(max(len(data), 1) + WIDTH - 1, 256, dtype=np.int16)
        x[: len(data)] = np.frombuffer(data, dtype=np.uint8)
        n = len(x) - WIDTH + 1
        starts = np.arange(0, max(1, n - (CHUNK - STRIDE)), STRIDE)
        best = np.empty((len(starts), FILTERS), dtype=np.float32)
        for k in range(0, len(starts), 64):
            s = starts[k : k + 64]
            a, b = s[0], min(n, s[-1] + CHUNK)
            z = self.table[0].take(x[a:b], axis=0)
            for j in range(1, WIDTH):
                z += self.table[j].take(x[a + j : b + j], axis=0)
            grid = np.maximum.reduceat(z, np.arange(0, b - a, CHUNK - STRIDE), axis=0)
            per = CHUNK // (CHUNK - STRIDE)
            for i in range(len(s)):
                best[k + i] = grid[i * (per - 1) : i * (per - 1) + per].max(axis=0)
        return best

    def features(self, best: np.ndarray) -> np.ndarray:
        p = np.maximum(best + self.bias, 0)
        return np.concatenate([p.mean(axis=0), p.max(axis=0)])

    def score(self, text: str | None) -> float:
        u = self.features(self.maxima((text or "").encode("utf-8", "surrogatepass")))
        return float(1 / (1 + np.exp(-np.clip(self.v @ u + self.c, -30, 30))))

    def fit(self, rows: list[tuple[str, int]], epochs: int = 8, batch: int = 16, rate: float = 0.02, seed: int = 0) -> ByteConvNet:
        """Adam on the log loss, the gradient of a maximum goes to where it was reached.

        A short stretch of each text is one more text of its label, so that shortness alone tells nothing.
        """
        rng = np.random.default_rng(seed)
        rows = list(rows)
        for t, v in list(rows):
            w = t.split(" ")
            n = int(rng.integers(3, 25))
            k = int(rng.integers(0, max(1, len(w) - n)))
            rows.append((" ".join(w[k : k + n]), v))
        data = [t.encode("utf-8", "surrogatepass") for t, _ in rows]
        y = np.array([v for _, v in rows], dtype=np.float32)
        par = [self.table, self.bias, self.v, np.array([self.c], dtype=np.float32)]
        m, s, step = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par], 0
        for epoch in range(epochs):
            order = rng.permutation(len(data))
            lr = rate * (1 - epoch / epochs)
            for k in range(0, len(order), batch):
                g = [np.zeros_like(p) for p in par]
                for i in order[k : k + batch]:
                    best, at, x = self.pooled(data[i])
                    p = np.maximum(best + self.bias, 0)
                    u = np.concatenate([p.mean(axis=0), p.max(axis=0)])
                    d = (1 / (1 + np.exp(-np.clip(self.v @ u + par[3][0], -30, 30))) - y[i]) / batch
                    g[2] += d * u
                    g[3] += d
                    up = np.broadcast_to(d * self.v[:FILTERS] / len(p), p.shape).copy()
                    up[p.argmax(axis=0), np.arange(FILTERS)] += d * self.v[FILTERS:]
                    up *= p > 0
                    g[1] += up.sum(axis=0)
                    f = np.broadcast_to(np.arange(FILTERS), at.shape)
                    for j in range(WIDTH):
                        np.add.at(g[0][j], (x[at + j], f), up)
                g[0][:, 256] = 0
                step += 1
                for p, gr, mm, ss in zip(par, g, m, s):
                    mm += 0.1 * (gr - mm)
                    ss += 0.01 * (gr * gr - ss)
                    p -= lr * (mm / (1 - 0.9**step)) / (np.sqrt(ss / (1 - 0.99**step)) + 1e-8)
            self.c = float(par[3][0])
        return self


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS, longest: int = LONGEST) -> ByteConvNet:
    """Fits on labelled rows whose crc32 of the id as text isn't 2 modulo 4; the others are held out. Without labels the net stays untrained."""
    seen = F.pmod(F.crc32(F.col("_id").cast("string").cast("binary")), F.lit(4)) != 2
    got = sample(docs, labels, "quality", rows, longest, seen)
    return ByteConvNet.new().fit(got) if got else ByteConvNet.new()


def score(docs: DataFrame, net: ByteConvNet, text_col: str = "text") -> DataFrame:
    """(doc_id, score) per row, from the whole text alone; null and empty texts are scored as padding."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([net.score(t.as_py()) for t in b.column(1)], type=pa.float64())], names=["doc_id", "score"])

    return batched(docs).select(F.col("doc_id").cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, score double")


def op1_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's row per document. Null and empty texts are scored as padding, all alike; rows of null ids (not held out) and of repeated ids are scored each; extra columns are ignored.

    Without usable labels the net stays as it was drawn; an empty table gives no rows.
    """
    s = score(docs, train(docs, labels))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    return s.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
