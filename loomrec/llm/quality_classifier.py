"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed on the executors. A bounded sample of labelled rows (`sample_rows`, chosen by a
hash of the id) fits the trees: feature values are binned by quantiles, every split is found from gradient sums per
bin, and trees are complete binary trees stored as flat arrays, so that scoring a batch is a few numpy steps per level.

Defined results: null or empty text has all-zero statistics and gets a score like any other; without usable labels, or
with one class only, every score is the smoothed share of label 1; rows with a null label are left out; several labels
of one id count as their largest; a labelled id that several rows repeat is fitted by its smallest text; equal texts get
equal scores; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.llm.mixing import few
from loomrec.llm.quality_rules import counts
from loomrec.llm.text import slices, words

N_FEATURES = 20


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a whole text, whatever its language."""
    if not text:
        return [0.0] * N_FEATURES
    n_words, chars, symbols, dup_lines, repeated, n_lines, upper, stutters = counts(text)
    w = words(text)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    by = np.bincount(raw, minlength=256)
    total, n = max(len(raw), 1), max(n_words, 1)
    share = by[by > 0] / total
    lengths = np.fromiter(map(len, w), np.int64, len(w)) if w else np.zeros(1, np.int64)
    lower = int(by[97:123].sum())
    return [
        np.log1p(n_words), chars / n, symbols / n, upper / max(chars, 1), by[48:58].sum() / total, dup_lines / max(n_lines, 1), repeated / n,
        len(set(w)) / n, stutters / n, by[ord("|")] / n, by[ord("!")] / n, (by[ord(".")] + by[ord(",")]) / n,
        by[128:].sum() / total, chars / max(n_lines, 1), float(lengths.max()), float(lengths.std()), float(-(share * np.log2(share)).sum()),
        lower / total, by[ord("\n")] / n, sum(x.isalpha() for x in w) / n,
    ]


@dataclass
class Trees:
    """base + the sum over trees of a leaf's value; feature and edge are (trees, inner nodes), value is (trees, leaves)."""

    base: float
    feature: np.ndarray
    edge: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, edge, value in zip(self.feature, self.edge, self.value):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < len(feature):
                node = 2 * node + 1 + (x[rows, feature[node]] > edge[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, smooth: float = 1.0, least: float = 1.0) -> Trees:
    """Boosting with logistic loss; `smooth` is the L2 term, `least` the smallest Hessian sum of a leaf."""
    inner, leaves = 2**depth - 1, 2**depth
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if not len(y) or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    offset = np.arange(x.shape[1]) * bins
    total, feature, edge, value = np.full(len(y), base), [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        f_of, e_of, cut_of = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, bins)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (x.shape[1] * bins) + offset + binned).ravel()
            size = wide * x.shape[1] * bins
            gs = np.bincount(cell, np.repeat(g, x.shape[1]), size).reshape(wide, x.shape[1], bins).cumsum(2)
            hs = np.bincount(cell, np.repeat(h, x.shape[1]), size).reshape(wide, x.shape[1], bins).cumsum(2)
            ga, ha = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + smooth) + (ga - gs) ** 2 / (ha - hs + smooth) - ga**2 / (ha + smooth)
            gain[(hs < least) | (ha - hs < least)] = 0
            for j, e in enumerate(edges):
                gain[:, j, len(e) :] = 0
            best = gain.reshape(wide, -1).argmax(1)
            for k in range(wide):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9:
                    f_of[first + k], e_of[first + k], cut_of[first + k] = j, edges[j][b], b
            node = 2 * node + 1 + (binned[np.arange(len(y)), f_of[node]] > cut_of[node])
        leaf = node - inner
        v = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + smooth)
        total += v[leaf]
        feature.append(f_of), edge.append(e_of), value.append(v)
    return Trees(base, np.stack(feature), np.stack(edge), np.stack(value))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, label: str = "quality") -> Trees:
    """Fit on at most sample_rows labelled documents."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    part = min(1.0, 0.95 * sample_rows / max(known.count(), 1))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.lit(int(part * (1 << 40)))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # A doc_id that several rows repeat is one labelled row: its smallest text.
    rows = docs.join(few(known, sample_rows), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.float64()), pa.array([statistics(t) for t in b.column(2).to_pylist()], pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    found = rows.mapInArrow(run, "doc_id long, y double, x array<double>").toPandas().sort_values("doc_id")
    x = np.asarray(found["x"].tolist(), float).reshape(-1, N_FEATURES)
    return fit(x, found["y"].to_numpy(float))


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, score) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = np.asarray([statistics(t) for t in b.column(1).to_pylist()]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(trees.score(x))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
