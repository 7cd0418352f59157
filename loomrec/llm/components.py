"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.scratch import materialise


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of long ids -> (id, root) for every id that has an edge to another; root is the smallest id.

    Every round is written to the shared folder. A node with many neighbours is grouped by a partial minimum and joined
    back, never collected. Null ends and loops are ignored."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b")
    e = materialise(e.distinct(), "edges")
    while not _are_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        e = materialise(small.distinct(), "stars")
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _are_stars(e: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: as v < u, each v is then the smallest of its component."""
    centres = e.select(F.col("v").alias("u")).distinct()
    return e.join(centres, "u", "left_semi").isEmpty() and e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels of nodes 0..n-1 under the links a[i]-b[i]."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new
