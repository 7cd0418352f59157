"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors x and y with cosine at least t differ by a squared distance of at most 2 - 2t. After a rotation the
coordinates are split into blocks, and each block gets a part of that budget in proportion to its width: a pair within
the whole budget is within the budget of at least one block. So each block is range-joined under its own budget, the
union of what the blocks find is verified exactly in double precision, and no link is lost.

Equal vectors are one class first, with the smallest id and a number of members. Each block has a tiling of its own:
the cells of a k-d tree over the block's coordinates, each with the box around its vectors. A vector lives in one cell
of a block and visits those later cells whose box its block's coordinates come near enough to, so a pair meets in one
cell. Only the block's coordinates travel. A cell of many vectors is dealt over tasks, each for two chunks of about
`tile_rows`. What a task sends on are the vectors that have a partner within the block's budget; their whole vectors are
then fetched, once for each task where they have one. The pair is verified in the first block that finds it. Tasks return counts and a spanning set of
links, never the pairs, so a large group of near copies costs rows in proportion to its size and its chunks.

The trees' cuts come from a sample of at most `sample_rows` vectors, which decides where vectors meet and nothing else.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors
of different lengths never link; rows that repeat a vec_id count as one (the smallest vector); a null id is left out;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.llm.components import components, local_roots
from loomrec.llm.mixing import few
from loomrec.scratch import materialise

SLACK = 1e-5  # of squared distances between coordinates rounded to single precision
ROUGH = 1e-4  # of those that a product of matrices gives


def rotation(width: int, seed: int = 7) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed + width).standard_normal((width, width)))[0]


def block_edges(width: int, block: int) -> list[tuple[int, int]]:
    return [(a, min(a + block, width)) for a in range(0, width, block)]


def part_of(budget: float, width: int, a: int, z: int) -> float:
    return budget * (z - a) / width + SLACK


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def stored(vectors: DataFrame) -> str:
    """How vectors travel: as the numbers of the table, so single precision where that is what it holds."""
    return "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"


def turned(classes: DataFrame, kind: str) -> DataFrame:
    """classes (id, n, embedding) -> (id, n, width, raw, turned): the vector, and its rotated unit vector in single precision."""
    rotations: dict[int, np.ndarray] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, n, v in zip(*(b.column(c).to_pylist() for c in range(3))):
                v = np.asarray(v, np.float64)
                if len(v) not in rotations:
                    rotations[len(v)] = rotation(len(v))
                out.append((i, n, len(v), v.astype(kind).tobytes(), (_unit(v[None]) @ rotations[len(v)]).astype("<f4").tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], k) for j, k in enumerate(kinds)], names=["id", "n", "width", "raw", "turned"])

    return classes.select("id", "n", "embedding").mapInArrow(run, "id long, n long, width int, raw binary, turned binary")


class Cells:
    """A k-d tree over a block's coordinates: a coordinate for each level, and a cut for each inner node."""

    def __init__(self, y: np.ndarray, depth: int):
        self.dims = np.argsort(-y.var(0), kind="stable")[: min(depth, y.shape[1])] if len(y) else np.zeros(0, np.int64)
        self.cuts = np.zeros(2 ** len(self.dims) - 1)
        node = np.zeros(len(y), np.int64)
        for level, dim in enumerate(self.dims):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                inside = y[node == k, dim]
                self.cuts[k] = np.median(inside) if len(inside) else 0.0
            node = 2 * node + 1 + (y[:, dim] > self.cuts[node])
        leaves = 2 ** len(self.dims)
        self.low, self.high = np.full((leaves, y.shape[1]), -np.inf), np.full((leaves, y.shape[1]), np.inf)

    def home(self, y: np.ndarray) -> np.ndarray:
        """The cell that holds each row."""
        node = np.zeros(len(y), np.int64)
        for dim in self.dims:
            node = 2 * node + 1 + (y[:, dim] > self.cuts[node])
        return node - len(self.cuts)

    def visits(self, y: np.ndarray, part: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, at home): each row's own cell, and later cells whose box is within a squared distance of part."""
        part = part + 1e-9  # sums in another order
        row, node, away = np.arange(len(y)), np.zeros(len(y), np.int64), np.zeros(len(y))
        for dim in self.dims:
            gap = y[row, dim] - self.cuts[node]
            right = gap > 0
            far = away + gap.astype(np.float64) ** 2
            near = far <= part
            row, node, away = (np.concatenate(x) for x in ((row, row[near]), (2 * node + 1 + right, 2 * node[near] + 1 + ~right[near]), (away, far[near])))
        cell = node - len(self.cuts)
        # A row's own cell is the first entry of each row.
        near = np.concatenate([np.ones(len(y), bool), cell[len(y) :] > cell[row[len(y) :]]])
        row, cell = row[near], cell[near]
        keep = np.ones(len(row), bool)
        for c in range(len(y), len(row), 100_000):
            r, k = row[c : c + 100_000], cell[c : c + 100_000]
            gap = np.maximum(0.0, np.maximum(self.low[k] - y[r], y[r] - self.high[k]))
            keep[c : c + 100_000] = (gap * gap).sum(1) <= part
        home = np.arange(len(row)) < len(y)
        return row[keep], cell[keep], home[keep]


def planted(vectors: DataFrame, block: int, tile_rows: int, sample_rows: int) -> dict[tuple[int, int], Cells]:
    """Cells by (width, block's first coordinate), from a bounded sample."""
    total = vectors.count()
    share = min(1.0, 0.9 * sample_rows / max(total, 1))
    some = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))).select("width", "turned").limit(sample_rows).collect()
    found = {}
    for width in {r["width"] for r in some}:
        x = np.frombuffer(b"".join(sorted(r["turned"] for r in some if r["width"] == width)), "<f4").reshape(-1, width).astype(np.float64)
        depth = max(0, min(ceil(log2(max(1.0, len(x) / share / tile_rows))), int(log2(max(1, len(x) // 8))), 14))
        for a, z in block_edges(width, block):
            found[width, a] = Cells(x[:, a:z], depth)
    return found


def bounded(vectors: DataFrame, cells: dict[tuple[int, int], Cells], block: int) -> None:
    """Set the cells' boxes, from all vectors: as many rows as there are cells, which the sample bounds."""
    split = {k: c for k, c in cells.items() if len(c.dims)}
    if not split:
        return
    names = ["width", "a", "cell", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: (np.full(c.low.shape, np.inf), np.full(c.low.shape, -np.inf)) for k, c in split.items()}
        for b in batches:
            widths, raw = b.column(0).to_numpy(), b.column(1).to_pylist()
            for width in {w for w, _ in split}:
                at = np.flatnonzero(widths == width)
                x = np.frombuffer(b"".join(raw[i] for i in at), "<f4").reshape(-1, width)
                for a, z in block_edges(width, block):
                    cell, (low, high) = split[width, a].home(x[:, a:z]), held[width, a]
                    np.minimum.at(low, cell, x[:, a:z])
                    np.maximum.at(high, cell, x[:, a:z])
        for (width, a), (low, high) in held.items():
            some = np.flatnonzero(low[:, 0] <= high[:, 0])
            cols = [np.full(len(some), width, np.int32), np.full(len(some), a, np.int32), some.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), *(pa.array(list(m[some]), pa.list_(pa.float64())) for m in (low, high))], names=names)

    found = vectors.select("width", "turned").mapInArrow(run, "width int, a int, cell int, low array<double>, high array<double>")
    found = found.groupBy("width", "a", "cell").agg(*[f(F.get(c, F.lit(k))).alias(f"{c}{k}") for c, f in (("low", F.min), ("high", F.max)) for k in range(block)])
    for (width, a), c in split.items():
        c.low[:], c.high[:] = np.inf, -np.inf  # a cell without vectors is not visited
    for r in found.collect():
        c = cells[r["width"], r["a"]]
        n = c.low.shape[1]
        c.low[r["cell"]], c.high[r["cell"]] = ([r[f"{x}{k}"] for k in range(n)] for x in ("low", "high"))


def routes(vectors: DataFrame, cells: dict[tuple[int, int], Cells], budget: float, block: int) -> DataFrame:
    """(width, a, cell, home, id, coordinates): a row for each cell of block a that a vector lives in or visits, with its coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["width", "a", "cell", "home", "id", "coordinates"]
        for b in batches:
            ids, widths, raw = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            for width in np.unique(widths).tolist():
                at = np.flatnonzero(widths == width)
                x = np.frombuffer(b"".join(raw[i] for i in at), "<f4").reshape(-1, width)
                for a, z in block_edges(width, block):
                    y = np.ascontiguousarray(x[:, a:z])
                    row, cell, home = (cells.get((width, a)) or Cells(y[:0], 0)).visits(y, part_of(budget, width, a, z))
                    for c in range(0, len(row), 10_000):
                        r = row[c : c + 10_000]
                        cols = [np.full(len(r), width, np.int32), np.full(len(r), a, np.int32), cell[c : c + 10_000].astype(np.int32), home[c : c + 10_000], ids[at[r]]]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array([y[i].tobytes() for i in r], pa.binary())], names=names)

    return vectors.select("id", "width", "turned").mapInArrow(run, "width int, a int, cell int, home boolean, id long, coordinates binary")


CELL = ["width", "a", "cell"]
TASK = [*CELL, "i", "j"]


def dealt(routed: DataFrame, tile_rows: int) -> DataFrame:
    """routed with i, j and own: a row for each task, a task for every two chunks of a cell of which one lives there."""
    sizes = routed.groupBy(*CELL).agg(*[F.ceil(F.count_if(F.col("home") if home else ~F.col("home")) / tile_rows).cast("int").alias(c) for c, home in (("lives", True), ("guests", False))])
    rows = routed.join(few(materialise(sizes.where("lives > 0"), "cells"), 200_000), CELL)
    pick = F.xxhash64("id")
    own = F.when(F.col("home"), F.pmod(pick, F.col("lives"))).otherwise(F.col("lives") + F.pmod(pick, F.col("guests"))).cast("int")
    rows = rows.withColumn("own", own)
    last = F.when(F.col("home"), F.col("lives") + F.col("guests")).otherwise(F.col("lives")) - 1
    other = F.explode(F.sequence(F.lit(0), last)).alias("other")
    return rows.select(*CELL, "id", "own", "coordinates", other).select(*CELL, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "coordinates")


def within(p: np.ndarray, q: np.ndarray, part: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of the rows of p and q that are within part, some at a time: a product proposes, differences decide."""
    norm = (q * q).sum(1)
    for c in range(0, len(p), 256):
        d = p[c : c + 256] @ (-2 * q.T)
        d += (p[c : c + 256] ** 2).sum(1)[:, None]
        d += norm[None]
        near = d <= np.float32(part + ROUGH)
        i, j = np.nonzero(np.triu(near, 1 + c) if same else near)
        for k in range(0, len(i), 50_000):
            u, v = i[k : k + 50_000] + c, j[k : k + 50_000]
            keep = distances(p[u], q[v]) <= part
            if keep.any():
                yield u[keep], v[keep]


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances row by row. The coordinates are rounded ones, so every task gets the same numbers."""
    return ((p.astype(np.float64) - q) ** 2).sum(1)


def partners(tasks: DataFrame, budget: float, block: int) -> DataFrame:
    """(width, a, cell, i, j, own, id): the vectors that have a partner within the block's budget in a task."""
    schema = pa.schema([(c, pa.int32()) for c in (*TASK, "own")] + [("id", pa.int64())])

    def run(key: tuple, group: pa.Table) -> pa.Table:
        width, a, cell, i, j = (k.as_py() for k in key)
        z = min(a + block, width)
        own, ids = group["own"].to_numpy(), group["id"].to_numpy()
        y = np.frombuffer(b"".join(group["coordinates"].to_pylist()), "<f4").reshape(-1, z - a)
        one, two = np.flatnonzero(own == i), np.flatnonzero(own == j)
        some = np.zeros(len(ids), bool)
        for u, v in within(y[one], y[two], part_of(budget, width, a, z), i == j):
            some[one[u]] = some[two[v]] = True
        n = int(some.sum())
        cols = [np.full(n, x, np.int32) for x in (width, a, cell, i, j)] + [own[some], ids[some]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return tasks.groupBy(*TASK).applyInArrow(run, "width int, a int, cell int, i int, j int, own int, id long")


def verified(found: DataFrame, vectors: DataFrame, kind: str, cosine: float, budget: float, block: int) -> DataFrame:
    """(id, n, root): how many vectors an id links with in a task, and the smallest id that the task's links join it to."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        width, a, _, i, j = (k.as_py() for k in key)
        z = min(a + block, width)
        own, ids, many = (group[c].to_numpy() for c in ("own", "id", "n"))
        x = np.frombuffer(b"".join(group["raw"].to_pylist()), kind).astype(float).reshape(-1, width)
        t = np.frombuffer(b"".join(group["turned"].to_pylist()), "<f4").reshape(-1, width)
        one, two = np.flatnonzero(own == i), np.flatnonzero(own == j)
        x = x / np.abs(x).max(1, keepdims=True)
        norm = np.sqrt((x * x).sum(1))
        n, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for u, v in within(t[one, a:z], t[two, a:z], part_of(budget, width, a, z), i == j):
            u, v = one[u], two[v]
            for b, y in block_edges(width, block):
                if b < a and len(u):  # a pair belongs to the first block that finds it
                    new = distances(t[u, b:y], t[v, b:y]) > part_of(budget, width, b, y)
                    u, v = u[new], v[new]
            for c in range(0, len(u), 20_000):
                p, q = u[c : c + 20_000], v[c : c + 20_000]
                keep = np.einsum("ij,ij->i", x[p], x[q]) / (norm[p] * norm[q]) >= cosine
                p, q = p[keep], q[keep]
                np.add.at(n, p, many[q])
                np.add.at(n, q, many[p])
                label = local_roots(len(ids), np.concatenate([p, np.arange(len(ids))]), np.concatenate([q, label]))
        some = n > 0
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, label, ids)
        return pa.table({"id": ids[some], "n": n[some], "root": least[label[some]]})

    rows = found.join(vectors.select("id", "n", "raw", "turned"), "id")
    return rows.groupBy(*TASK).applyInArrow(run, "id long, n long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, block: int = 16, tile_rows: int = 4096, sample_rows: int = 20_000) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every vec_id."""
    kind, budget = stored(vectors), 2 - 2 * cosine
    vectors = vectors.where("vec_id is not null").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    sound = vectors.where("size(embedding) > 0").where(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))).where(F.exists("embedding", lambda v: v != 0))
    key = F.struct(F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit("again"), "embedding").alias("h2"))  # 128 bits
    sound = sound.withColumn("key", key)
    classes = materialise(sound.groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("embedding").alias("embedding")), "classes")
    held = materialise(turned(classes, kind), "vectors")
    cells = planted(held, block, tile_rows, sample_rows)
    bounded(held, cells, block)
    routed = materialise(routes(held, cells, budget, block), "routes")
    found = materialise(partners(dealt(routed, tile_rows), budget, block), "partners")
    found = materialise(verified(found, held, kind, cosine, budget, block), "links")
    counts = found.groupBy("id").agg(F.sum("n").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    done = classes.select("key", "id", "n").join(counts, "id", "left").join(roots, "id", "left")
    done = materialise(done.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "id").alias("root")), "classes_done")
    linked = sound.select("vec_id", "key").join(done, "key").select("vec_id", "n_links", "root")
    out = vectors.select("vec_id").join(linked, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
