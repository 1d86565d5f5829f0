"""A point-set autoencoder in numpy: shared layers and a maximum over points, trained on the Chamfer distance.

Training is a driver-side fit on a bounded number of clusters; embedding all clusters is a grouped pass
with the weights broadcast. There is no batch normalisation here, so weights aren't those of other libraries.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import sample_normalized

#: Most clusters that a model is trained on.
TRAIN_CLUSTERS = 5_000


def chamfer_gradient(a: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray]:
    """Symmetric mean squared distance to the nearest point, and its gradient by ``b``."""
    d = ((a[:, None, :] - b[None]) ** 2).sum(axis=2)
    to_b, to_a = d.argmin(axis=1), d.argmin(axis=0)
    grad = 2 * (b - a[to_a]) / len(b)
    np.add.at(grad, to_b, 2 * (b[to_b] - a) / len(a))
    return float(d.min(axis=1).mean() + d.min(axis=0).mean()), grad


@dataclass
class PointAutoencoder:
    """Layers of the encoder (3, 64, 128, dim) and of the decoder (dim, 256, 512, 3 * n)."""

    weights: list[np.ndarray]
    n: int
    dim: int
    losses: list[float]

    @classmethod
    def create(cls, n: int, dim: int, seed: int = 42) -> PointAutoencoder:
        rng, sizes = np.random.default_rng(seed), [(3, 64), (64, 128), (128, dim), (dim, 256), (256, 512), (512, 3 * n)]
        weights: list[np.ndarray] = []
        for a, b in sizes:
            weights += [rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)]
        return cls(weights, n, dim, [])

    def _forward(self, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Inputs of all layers, the points that gave the maxima, and the output."""
        w, ins, h = self.weights, [], x
        for k in range(3):
            ins.append(h)
            h = h @ w[2 * k] + w[2 * k + 1]
            if k < 2:
                h = np.maximum(h, 0)
        top = h.argmax(axis=0)
        h = h[top, np.arange(self.dim)]
        for k in range(3, 6):
            ins.append(h)
            h = h @ w[2 * k] + w[2 * k + 1]
            if k < 5:
                h = np.maximum(h, 0)
        return ins, top, h.reshape(self.n, 3)

    def encode(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[0][3]

    def gradients(self, x: np.ndarray) -> tuple[float, list[np.ndarray]]:
        ins, top, out = self._forward(x)
        loss, g = chamfer_gradient(x, out)
        w, grads = self.weights, [np.zeros(0)] * 12
        g = g.reshape(-1)
        for k in (5, 4, 3):
            grads[2 * k], grads[2 * k + 1] = np.outer(ins[k], g), g
            g = w[2 * k] @ g
            if k > 3:
                g = g * (ins[k] > 0)
        full = np.zeros((len(x), self.dim))
        full[top, np.arange(self.dim)] = g
        g = full
        for k in (2, 1, 0):
            grads[2 * k], grads[2 * k + 1] = ins[k].T @ g, g.sum(axis=0)
            g = g @ w[2 * k].T
            if k:
                g = g * (ins[k] > 0)
        return loss, grads

    def train(self, sets: list[np.ndarray], epochs: int = 100, batch: int = 32, rate: float = 1e-3, seed: int = 42) -> PointAutoencoder:
        """Adam over shuffled batches; ``losses`` gets the mean of each epoch."""
        rng = np.random.default_rng(seed)
        m, v, t = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights], 0
        for _ in range(epochs if sets else 0):
            order, total = rng.permutation(len(sets)), 0.0
            for a in range(0, len(order), batch):
                part = order[a : a + batch]
                sums = [np.zeros_like(w) for w in self.weights]
                for i in part:
                    loss, grads = self.gradients(sets[i])
                    total += loss
                    for s, g in zip(sums, grads, strict=True):
                        s += g / len(part)
                t += 1
                for k, g in enumerate(sums):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.weights[k] = self.weights[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
            self.losses.append(total / len(sets))
        return self

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, *self.weights, n=self.n, dim=self.dim, losses=np.array(self.losses))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> PointAutoencoder:
        x = np.load(io.BytesIO(raw))
        return cls([x[f"arr_{k}"] for k in range(12)], int(x["n"]), int(x["dim"]), x["losses"].tolist())


def train_autoencoder(points: DataFrame, *, n: int = 256, dim: int = 64, epochs: int = 100, cluster: str = "cluster_id") -> PointAutoencoder:
    """A model of the clusters (point_id, cluster, x, y, z), TRAIN_CLUSTERS of them at most, chosen by hash."""
    ids = points.select(cluster).distinct().orderBy(F.xxhash64(cluster), cluster).limit(TRAIN_CLUSTERS)
    rows = sample_normalized(points.join(F.broadcast(ids), cluster), n, cluster).toPandas().sort_values([cluster, "k"])
    sets = [g[["x", "y", "z"]].to_numpy(float) for _, g in rows.groupby(cluster)]
    return PointAutoencoder.create(n, dim).train(sets, epochs)


def embeddings(points: DataFrame, model: PointAutoencoder, cluster: str = "cluster_id") -> DataFrame:
    """cluster, emb_0..: the code of each cluster's sample."""
    shared = points.sparkSession.sparkContext.broadcast(model)
    names = [f"emb_{k}" for k in range(model.dim)]
    arrays = sample_normalized(points, model.n, cluster).groupBy(cluster).agg(F.sort_array(F.collect_list(F.struct("k", "x", "y", "z"))).alias("p"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            codes = [shared.value.encode(np.array([[q["x"], q["y"], q["z"]] for q in p])) for p in part["p"]]
            yield pd.DataFrame(np.array(codes).reshape(len(part), model.dim), columns=names).assign(**{cluster: part[cluster].to_numpy()})[[cluster, *names]]

    return arrays.mapInPandas(run, f"{cluster} {points.schema[cluster].dataType.simpleString()}, " + ", ".join(f"{c} double" for c in names))
