"""Language-model scores: the marginal probability of a text over all segmentations in a lattice.

The pieces and their first weights are those of an existing vocabulary (`loomrec.llm.lattice`). Two rounds of
expectation (forward and backward over all segmentations of every distinct training word) fit the weights to the
corpus, for each class of documents, drawn to those of all classes, and these to the vocabulary's scores. In a text's
lattice a word has, beside all its segmentations into pieces, one more edge for the word as a whole, weighted by how
often training texts have it:

    p(word | class) = (c_class + mu * p(word)) / (N_class + mu),  p(word) = (max(c - D, 0) + D * V * lattice(word)) / N

with D from the counts of counts. These add up to 1 over all words. Words of a text are drawn to those it already has:
the k-th token costs (earlier occurrences + nu * p) / (k - 1 + nu). Texts are mixtures of classes (their languages); a
text's own class is read in training alone. As pieces cross no word and the last formula does not depend on the order
of words, the forward recursion of a text is the sum over its distinct words, so each distinct word of the corpus goes
through the lattice once.

The `common` words that occur most go to every task, all others meet the documents by a join.

Defined results: null or blank text has the end token alone; a document without an id is neither held out nor learned
from; rows that repeat a doc_id count each; a null class is one of its own; without training documents the lattice
scores alone, on the vocabulary's weights, and base_score is 0; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrec.llm.lattice import Lattice, usable_pieces
from loomrec.llm.text import slices
from loomrec.scratch import materialise

#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Probability that the lattice gives to the end of a text.
END = 0.01
LN10 = math.log(10)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[Lattice, np.ndarray]:
    pieces, weight = usable_pieces(path)
    return Lattice(pieces), weight


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def log_rising(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log of (1 + x)(2 + x)...(n - 1 + x), for n of 1 or more."""
    return _lgamma(n + x) - _lgamma(1 + x)


def _lgamma(z: np.ndarray) -> np.ndarray:
    shift = np.log(z)
    for k in range(1, 8):
        shift = shift + np.log(z + k)
    z = z + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def _in_chunks(words: list[bytes], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of words that hold about `most` bytes."""
    a = held = 0
    for b, w in enumerate(words):
        if held and held + len(w) > most:
            yield a, b
            a, held = b, 0
        held += len(w) + 2
    if a < len(words):
        yield a, len(words)


class Model:
    """What was learned: totals, piece weights by class, and a table of all words of the corpus with their counts."""

    def __init__(self, docs: DataFrame, train: Column, path: str, by: str | None = "lang", classes: int = 16, rounds: int = 2, prior: float = 1000.0, mu: float = 30_000.0, nu: float = 3000.0, common: int = 100_000):
        self.path, self.mu, self.nu, self.common = path, mu, nu, common
        self.train = F.coalesce(train, F.lit(False))
        name = F.coalesce(F.col(by).cast("string"), F.lit("")) if by and by in docs.columns else F.lit("")
        ranked = docs.where(self.train).groupBy(name.alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(classes).collect()
        self.texts = docs.where(self.train).count()
        names = [r["name"] for r in ranked]
        ends = [r["n"] for r in ranked]
        if sum(ends) < self.texts or not names:  # what is left over is one more class
            names, ends = [*names, None], [*ends, self.texts - sum(ends)]
        self.k, self.ends = len(names), np.asarray(ends, float)
        index = F.lit(self.k - 1)
        for i, n in enumerate(names):
            index = F.when(name == n, i).otherwise(index) if n is not None else index
        self.words = materialise(self._count(docs.select("text", F.when(self.train, index).otherwise(-1).cast("int").alias("class"))), "words")
        got = self.words.agg(
            F.count(F.when(F.col("c") > 0, 1)).alias("v"), F.sum("c").alias("n"), F.count(F.when(F.col("c") == 1, 1)).alias("n1"), F.count(F.when(F.col("c") == 2, 1)).alias("n2"), *[F.sum(F.col("by")[i]).alias(f"s{i}") for i in range(self.k)]
        ).first()
        self.v, self.n = got["v"] + (self.texts > 0), (got["n"] or 0) + self.texts
        self.discount = got["n1"] / (got["n1"] + 2 * got["n2"]) if got["n1"] else 0.5
        self.sizes = np.asarray([got[f"s{i}"] or 0 for i in range(self.k)], float) + self.ends
        self.odds = np.log((self.ends + 1) / (self.ends + 1).sum())
        _, scores = vocabulary(path)
        self.weights = np.tile(scores, (self.k, 1))
        for _ in range(rounds if self.texts else 0):
            self._maximise(scores, prior)

    def _count(self, docs: DataFrame) -> DataFrame:
        """(word, c, t, by): occurrences of every word in training documents, in all, and in each class's training documents."""
        k = self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, Counter] = {}
            for b in slices(batches):
                for text, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    held.setdefault(c, Counter()).update(tokens(text))
                if sum(map(len, held.values())) > 200_000:
                    yield from _counted(held)
                    held = {}
            yield from _counted(held)

        found = docs.mapInArrow(run, "word binary, class int, n long")
        by = F.array(*[F.coalesce(F.sum(F.when(F.col("class") == i, F.col("n"))), F.lit(0)) for i in range(k)])
        c = F.coalesce(F.sum(F.when(F.col("class") >= 0, F.col("n"))), F.lit(0))
        return found.groupBy("word").agg(c.alias("c"), F.sum("n").alias("t"), by.alias("by"))

    def _maximise(self, scores: np.ndarray, prior: float) -> None:
        path, k, logs = self.path, self.k, np.log(self.weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice, _ = vocabulary(path)
            total = np.zeros((k, len(lattice.pieces)))
            for b in slices(batches, 20_000):
                words = b.column(0).to_pylist()
                for i in range(k):
                    own = [w for w, n in zip(words, b.column(1 + i).to_numpy(zero_copy_only=False)) if n]
                    for lo, hi in _in_chunks(own):
                        total[i] += lattice.expected(own[lo:hi], logs[i])
            at, piece = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[at, piece])], names=["class", "piece", "e"])

        seen = self.words.where("c > 0").select("word", *[F.col("by")[i].alias(f"n{i}") for i in range(k)])
        got = seen.mapInArrow(run, "class int, piece int, e double").groupBy("class", "piece").agg(F.sum("e").alias("e")).toPandas()
        e = np.zeros_like(self.weights)
        e[got["class"], got["piece"]] = got["e"]
        pooled = e.sum(0) + prior * scores
        pooled /= pooled.sum()
        e += prior * pooled
        self.weights = e / e.sum(1, keepdims=True)

    def log_weights(self, c: np.ndarray, by: np.ndarray, lattice: np.ndarray) -> np.ndarray:
        """log p(word | class) from counts and log lattice(word), both words x classes."""
        with np.errstate(divide="ignore"):
            if self.n:
                own = np.log(np.maximum(c - self.discount, 0) / self.n)[:, None]
                pooled = np.logaddexp(own, math.log(self.discount * self.v / self.n) + lattice)
            else:
                pooled = lattice
            return np.logaddexp(np.log(by), math.log(self.mu) + pooled) - np.log(self.sizes + self.mu)

    def weighed(self, words: DataFrame) -> DataFrame:
        """(word, c, lattice, weight): the last two are logs for each class, as arrays."""
        path, k, logs, log_weights = self.path, self.k, np.log(self.weights), self._frozen()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice, _ = vocabulary(path)
            for b in slices(batches, 20_000):
                words = b.column(0).to_pylist()
                for lo, hi in _in_chunks(words):
                    part = words[lo:hi]
                    c = b.column(1).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(float)
                    by = np.asarray([b.column(2 + i).slice(lo, hi - lo).to_numpy(zero_copy_only=False) for i in range(k)], float).T
                    within = lattice.marginals(part, logs) + math.log(1 - END)
                    weight = log_weights(c, by, within)
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array(c.astype(np.int64)), *(pa.array(list(x)) for x in (within, weight))], names=["word", "c", "lattice", "weight"])

        return words.select("word", "c", *[F.col("by")[i].alias(f"n{i}") for i in range(k)]).mapInArrow(run, "word binary, c long, lattice array<double>, weight array<double>")

    def _frozen(self) -> Callable:
        """log_weights without the tables that tasks cannot hold."""
        bare = object.__new__(Model)
        bare.n, bare.v, bare.discount, bare.mu, bare.sizes = self.n, self.v, self.discount, self.mu, self.sizes
        return bare.log_weights

    def least_common(self) -> int:
        """Words that occur at least so often go to every task; they are `common` at most."""
        octave = F.floor(F.log2("t") * 4).cast("int")
        left, least = self.common, 1 << 62
        for r in self.words.groupBy(octave.alias("o")).agg(F.count("*").alias("n"), F.min("t").alias("t")).orderBy(F.desc("o")).collect():
            left -= r["n"]
            if left < 0:
                break
            least = r["t"]
        return least


def _counted(held: dict[int, Counter]) -> Iterator[pa.RecordBatch]:
    for c, n in held.items():
        words = list(n)
        for a in range(0, len(words), 20_000):
            part = words[a : a + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([c] * len(part), pa.int32()), pa.array([n[w] for w in part], pa.int64())], names=["word", "class", "n"])


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, n_tokens, n_known, train_tokens, base_score, lattice_score (pieces alone) and score, for every row of docs."""
    k, nu, log_nu, n, v = model.k, model.nu, math.log(model.nu), model.n, model.v
    least = model.least_common()
    often = model.weighed(model.words.where(F.col("t") >= least)).collect()
    # The end of a text is one more common word.
    within = np.full((1, k), math.log(END))
    end = model.log_weights(np.asarray([float(model.texts)]), model.ends[None, :], within)
    table = ({r["word"]: i + 1 for i, r in enumerate(often)}, np.asarray([model.texts, *(r["c"] for r in often)], float), np.vstack([within, *(r["lattice"] for r in often)]), np.vstack([end, *(r["weight"] for r in often)]))
    shared = docs.sparkSession.sparkContext.broadcast(table)
    base_of = math.log10(n + v + 1)
    kinds = dict(docs.dtypes)
    keys = [f"_c{i}" for i in range(len(carry))]
    sums = [f"{x}{i}" for x in ("l", "s") for i in range(k)]
    ddl = ", ".join([*(f"{name} {kinds[c]}" for name, c in zip(keys, carry)), "row long, n_tokens long, n_known long, base double, urn double", *(f"{x} double" for x in sums), "rare array<struct<key:binary,n:long>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, c, lattice, weight = shared.value
        for b in slices(batches):
            doc, ids, ns, length, rare = [], [], [], [], []
            for i, text in enumerate(b.column(b.num_columns - 1).to_pylist()):
                found = Counter(tokens(text))
                at = [place.get(w, -1) for w in found]
                rare.append([{"key": xxhash.xxh3_128_digest(w), "n": m} for (w, m), a in zip(found.items(), at) if a < 0] if -1 in at else [])
                at.append(0)
                doc.append(np.full(len(at), i))
                ids.append(at)
                ns.extend(found.values())
                ns.append(1)
                length.append(sum(found.values()) + 1)
            ids, ns, doc = np.concatenate(ids).astype(np.int64), np.asarray(ns, float), np.concatenate(doc)
            known = ids >= 0
            ids, ns, doc = ids[known], ns[known], doc[known]
            total = lambda x: np.bincount(doc, x, b.num_rows)
            again = ns > 1
            out = [total(ns * lattice[ids, i]) for i in range(k)]
            for i in range(k):
                w = log_nu + weight[ids, i]
                more = w.copy()
                more[again] += log_rising(np.exp(w[again]), ns[again])
                out.append(total(more))
            length = np.asarray(length)
            urn = log_nu + log_rising(np.full(len(length), nu), length)
            base = total(ns * (np.log10(c[ids] + 1) - base_of))
            arrays = [pa.array(length), pa.array(total(ns * (c[ids] > 0)).astype(np.int64)), pa.array(base), pa.array(urn), *map(pa.array, out)]
            arrays.append(pa.array(rare, pa.list_(pa.struct([("key", pa.binary()), ("n", pa.int64())]))))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *arrays], names=[*keys, "row", "n_tokens", "n_known", "base", "urn", *sums, "rare"])

    rows = docs.select(*[F.col(c).alias(x) for c, x in zip(carry, keys)], F.monotonically_increasing_id().alias("row"), F.col("text").alias("text"))
    first = materialise(rows.mapInArrow(run, ddl), "lm_common")
    digest = F.pandas_udf(_digests, "binary")
    seldom = model.weighed(model.words.where(F.col("t") < least)).withColumn("key", digest("word")).drop("word")
    met = first.select("row", F.inline("rare")).join(seldom, "key")
    parts = [F.sum("n").alias("_n"), F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("_known"), F.sum(F.col("n") * (F.log10(F.col("c") + 1) - base_of)).alias("_base")]
    for i in range(k):
        w = F.col("weight")[i] + log_nu
        more = F.expr(f"aggregate(sequence(1, cast(n as int) - 1), 0D, (a, j) -> a + ln(j + exp(weight[{i}] + {log_nu!r}D)))")
        parts += [F.sum(F.col("n") * F.col("lattice")[i]).alias(f"_l{i}"), F.sum(w + F.when(F.col("n") > 1, more).otherwise(0.0)).alias(f"_s{i}")]
    rest = met.groupBy(F.col("row").alias("_row")).agg(*parts)
    both = first.drop("rare").join(rest, F.col("row") == F.col("_row"), "left")

    def whole(x: str, less: Column | float) -> Column:
        one = [F.coalesce(F.col(f"_{x}{i}"), F.lit(0.0)) + F.col(f"{x}{i}") + float(model.odds[i]) for i in range(k)]
        top = F.array_max(F.array(*one))
        return (top + F.log(sum((F.exp(o - top) for o in one), F.lit(0.0))) - less) / LN10

    return both.select(
        *[F.col(x).alias(c) for c, x in zip(carry, keys)],
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        whole("l", 0.0).alias("lattice_score"),
        whole("s", F.col("urn")).alias("score"),
    )


def _digests(words):
    return words.map(xxhash.xxh3_128_digest)
