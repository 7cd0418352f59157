"""Audit of how the sources of a language differ, by ranking cells of counts.

A term's value for a group depends only on its count in the group and its count in what the group is compared with. So
terms are grouped into cells of equal counts, the divergence is evaluated once a cell, and cells are ranked by
cumulative multiplicity. Cells of equal value are merged, and only those that reach the wanted ranks are expanded into
terms, in UTF-8 order. Sums over all terms of two sources are sums over cells, too: terms that both have are counted by
cell, those that only one has follow from its own counts, and the rest have none in either.

Occurrences are counted within tasks first, so frequent terms and hot sources are summed before they are shuffled.
Counts of a term in the sources of its language meet in one row; the pair part has a row for each pair of sources, so
its result itself grows with the square of a language's sources.

All arithmetic is exact: shares are whole billionths, by decimal division.

Defined results: null text, language and source are ''; repeated rows and ids count each; a group without terms has
ranks for its pairs and none for terms; a language without kept terms has pair values of 0; equal values are ranked by
item in UTF-8 order; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomrec.llm.text import slices
from loomrec.scratch import materialise

#: Letters A-Z become a-z, other ASCII a space, bytes of other characters stay: what is left between spaces are terms.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
BILLION = 1_000_000_000


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TERMS).split() if text else []


def counted(docs: DataFrame, flush: int = 200_000) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term in every group; a group's row without a term says that it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for b in slices(batches):
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns)):
                n, d = held.setdefault((lang or "", source or ""), (Counter(), Counter()))
                found = terms(text)
                n.update(found)
                d.update(set(found))
            size = sum(len(n) for n, _ in held.values())
            if size > flush:
                yield from _rows(held)
                held = {}
        yield from _rows(held)

    rows = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _rows(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, d) in held.items():
        items = [None, *n]
        for a in range(0, len(items), 20_000):
            part = items[a : a + 20_000]
            k = len(part)
            cols = [pa.array([lang] * k), pa.array([source] * k), pa.array([t if t is None else t.decode("utf-8", "replace") for t in part], pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array([0 if t is None else x[t] for t in part], pa.int64()) for x in (n, d))], names=["lang", "source", "term", "n", "docs"])


def share(count: Column, total: Column, kept: Column) -> Column:
    """Whole billionths, from 1, of count among total with two more for each kept term."""
    wide = "decimal(38,0)"
    above = (count.cast("decimal(20,0)") + F.lit(2).cast("decimal(1,0)")) * F.lit(BILLION).cast("decimal(10,0)")
    below = total.cast("decimal(20,0)") + kept.cast("decimal(20,0)") * F.lit(2).cast("decimal(1,0)")
    return F.call_function("div", above.cast(wide), below.cast(wide)) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


class Audit:
    """The counts that all parts of the audit are made of."""

    def __init__(self, docs: DataFrame, least: int = 10):
        by_group = materialise(counted(docs), "term_counts")
        # One row a term: its count in each source of the language.
        held = F.collect_list(F.struct("source", "n"))
        kept = by_group.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), held.alias("held")).where(F.col("docs") >= least)
        self.kept = materialise(kept.drop("docs"), "kept_terms")
        langs = self.kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
        totals = self.kept.select("lang", F.inline("held")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = by_group.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        none = F.lit(0).cast("long")
        #: (lang, source, total, v, lang_total) of every occurring group.
        self.groups = materialise(groups.select("lang", "source", *[F.coalesce(c, none).alias(c) for c in ("total", "v", "lang_total")]), "groups")

    def top_terms(self, ranks: int = 10) -> DataFrame:
        """Ranks of each group's terms that are more frequent than in its language."""
        held = self.kept.select("lang", "term", "lang_n", F.inline("held"))
        cells = materialise(held.groupBy("lang", "source", "n", "lang_n").agg(F.count("*").alias("terms")), "cells")
        p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
        cells = cells.join(self.groups, ["lang", "source"]).withColumns({"p": p, "q": q}).where("p > q")
        cells = cells.withColumn("value", divergence(F.col("p"), F.col("q")))
        group = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
        # Every value has a term at least, so values beyond the wanted ranks are out before they are accumulated.
        values = cells.groupBy("lang", "source", "value").agg(F.sum("terms").alias("terms")).withColumn("place", F.row_number().over(group)).where(F.col("place") <= ranks)
        before = F.coalesce(F.sum("terms").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        values = values.withColumn("before", before).where(F.col("before") < ranks).select("lang", "source", "value", "before")
        wanted = materialise(cells.join(values, ["lang", "source", "value"]).select("lang", "source", "n", "lang_n", "value", "before"), "wanted")
        found = held.join(wanted, ["lang", "source", "n", "lang_n"])
        tied = Window.partitionBy("lang", "source", "value").orderBy("term")
        found = found.withColumn("at", F.row_number().over(tied)).where(F.col("at") <= ranks)
        return found.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", (F.col("before") + F.col("at")).cast("int").alias("rank")).where(F.col("rank") <= ranks)

    def pairs(self) -> DataFrame:
        """Ranks of the other sources of each group's language by their divergence."""
        one = self.groups.select("lang", F.col("source").alias("a"), F.col("total").alias("total_a"), "v")
        two = self.groups.select("lang", F.col("source").alias("b"), F.col("total").alias("total_b"))
        both = materialise(one.join(two, "lang").where("a < b"), "source_pairs")
        # Terms that both have, by cell.
        held = F.sort_array("held")
        first = self.kept.select("lang", held.alias("held")).select("lang", "held", F.posexplode("held").alias("i", "x"))
        met = first.select("lang", F.col("x.source").alias("a"), F.col("x.n").alias("n_a"), F.explode(F.slice("held", F.col("i") + 2, F.size("held"))).alias("y"))
        met = materialise(met.groupBy("lang", "a", "n_a", F.col("y.source").alias("b"), F.col("y.n").alias("n_b")).agg(F.count("*").alias("terms")), "both_cells")
        # Terms that only one has: its own counts less those above.
        own = materialise(self.kept.select("lang", F.inline("held")).groupBy("lang", "source", "n").agg(F.count("*").alias("terms")), "own_cells")
        zero = F.lit(0).cast("long")
        cells = [met.select("lang", "a", "b", "n_a", "n_b", "terms")]
        for this, other, n in (("a", "b", "n_a"), ("b", "a", "n_b")):
            alone = both.select("lang", this, other).join(own.select("lang", F.col("source").alias(this), F.col("n").alias(n), "terms"), ["lang", this])
            less = met.select("lang", "a", "b", n, (-F.col("terms")).alias("terms"))
            cells.append(alone.select("lang", "a", "b", n, "terms").unionByName(less).withColumn("n_b" if n == "n_a" else "n_a", zero).select("lang", "a", "b", "n_a", "n_b", "terms"))
        every = cells[0].unionByName(cells[1]).unionByName(cells[2]).groupBy("lang", "a", "b", "n_a", "n_b").agg(F.sum("terms").alias("terms")).where("terms <> 0")
        p, q = share(F.col("n_a"), F.col("total_a"), F.col("v")), share(F.col("n_b"), F.col("total_b"), F.col("v"))
        valued = every.join(both, ["lang", "a", "b"]).withColumns({"p": p, "q": q})
        sums = valued.groupBy("lang", "a", "b").agg(F.sum(F.col("terms") * divergence(F.col("p"), F.col("q"))).alias("some"), F.sum("terms").alias("terms"))
        out = both.join(sums, ["lang", "a", "b"], "left").withColumns({"p": F.when(F.col("v") > 0, share(zero, F.col("total_a"), F.col("v"))), "q": F.when(F.col("v") > 0, share(zero, F.col("total_b"), F.col("v")))})
        rest = (F.col("v") - F.coalesce("terms", zero)) * divergence(F.col("p"), F.col("q"))
        out = out.withColumn("value", F.when(F.col("v") > 0, F.coalesce("some", zero) + rest).otherwise(zero))
        ways = F.inline(F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in (("a", "b"), ("b", "a"))]))
        ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return out.select("lang", "value", ways).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))


def audit(docs: DataFrame, least: int = 10, ranks: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): both parts for every (lang, source) of docs."""
    found = Audit(docs, least)
    return found.pairs().unionByName(found.top_terms(ranks))
