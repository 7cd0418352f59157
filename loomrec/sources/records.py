"""Records of delimited text files whose quoted fields may hold line ends, read by as many tasks as there are splits.

A split begins in the middle of a file and cannot tell whether it is within a quoted field. So every split first
works out what becomes of both cases: a function from "within quotes at its first line" to "within quotes behind its
last". These functions are composed in the order of a file's splits, a prefix scan over one small row a split. Then
every split knows how it begins, finds its records, and hands over the lines of a record that began before it or ends
behind it; such pieces, two a split at most, are put together by file.

A field is quoted if it begins with the quote; a doubled quote within it is one, and a quote within an unquoted field
is a character like others.

Defined results: line ends may be \\n or \\r\\n and are \\n within fields; blank lines between records are no records; a
field that is never closed reaches to the end of its file; an empty folder or file has no records.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One row of 17 bytes a split goes to every task: 128 TB in splits of 128 MB.
MOST_SPLITS = 1_000_000
WHOLE, HEAD, TAIL = 0, 1, 2


def within_after(line: str, within: bool, sep: str = "\t", quote: str = '"') -> bool:
    """Whether the place behind a line is within a quoted field, if the line begins so or not."""
    if quote not in line:
        return within
    at = 0
    while True:
        if within:
            end = line.find(quote, at)
            while end >= 0 and line[end + 1 : end + 2] == quote:
                end = line.find(quote, end + 2)
            if end < 0:
                return True
            at, within = line.find(sep, end + 1) + 1, False
            if not at:
                return False
        elif line.startswith(quote, at):
            at, within = at + 1, True
        else:
            at = line.find(sep, at) + 1
            if not at:
                return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file (a hash), block (its split's first byte) and value: lines in the order of the file within a split."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[str], list]]:
    """Runs of lines of one split: file, block, lines without \\r, and further columns."""
    for b in batches:
        file, block = b.column(0).to_pylist(), b.column(1).to_pylist()
        a = 0
        while a < len(file):
            z = a + 1
            while z < len(file) and file[z] == file[a] and block[z] == block[a]:
                z += 1
            lines = [x[:-1] if x.endswith("\r") else x for x in b.column(2).slice(a, z - a).to_pylist()]
            yield file[a], block[a], lines, [c[a].as_py() for c in b.columns[3:]]
            a = z


def splits(lines: DataFrame, sep: str = "\t") -> DataFrame:
    """file, block, within, after: whether each split begins, and ends, within a quoted field."""

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[tuple[int, int], list[bool]] = {}
        for file, block, found, _ in _by_split(batches):
            ends = done.setdefault((file, block), [False, True])
            for line in found:
                if '"' in line:
                    ends[:] = [within_after(line, x, sep) for x in ends]
        keys = list(done)
        cols = [[k[0] for k in keys], [k[1] for k in keys], [done[k][0] for k in keys], [done[k][1] for k in keys]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_(), pa.bool_()))], names=["file", "block", "out", "inside"])

    each = lines.mapInArrow(functions, "file long, block long, out boolean, inside boolean")
    held = each.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("block", "out", "inside"))).alias("held"))  # a row a split

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                within = False
                for x in r["held"]:
                    after = x["inside"] if within else x["out"]
                    rows.append({"file": r["file"], "block": x["block"], "within": within, "after": after})
                    within = after
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.int64()), ("block", pa.int64()), ("within", pa.bool_()), ("after", pa.bool_())]))

    return held.mapInArrow(scanned, "file long, block long, within boolean, after boolean")


def records(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """value, first: every record of the files, and whether it is the first of its file."""
    lines = _lines(spark, path)
    known = splits(lines, sep).collect()  # MOST_SPLITS at most are used
    if len(known) > MOST_SPLITS:
        raise ValueError(f"{len(known)} splits; raise spark.sql.files.maxPartitionBytes")
    begin = spark.sparkContext.broadcast({(r["file"], r["block"]): r["within"] for r in known if r["within"]})
    across = any(r["within"] or r["after"] for r in known)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, open_lines, within, kind, first = None, [], False, WHOLE, False
        out: list[tuple] = []

        def close(last: int) -> None:
            """The open lines are a record, or a piece of one where the split begins or ends within it."""
            what = HEAD if kind == HEAD else last
            value = "\n".join(open_lines)
            if value or what != WHOLE:
                out.append((what, *here, value, first))

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["piece", "file", "block", "value", "first"])
            out.clear()
            return done

        for file, block, found, _ in _by_split(batches):
            if (file, block) != here:
                if open_lines:
                    close(TAIL)
                here, open_lines = (file, block), []
                within = begin.value.get(here, False)
                kind, first = (HEAD if within else WHOLE), block == 0
            for line in found:
                open_lines.append(line)
                within = within_after(line, within, sep)
                if not within:
                    close(WHOLE)
                    first = first and kind == WHOLE and not open_lines[0] and len(open_lines) == 1  # blank lines are no records
                    open_lines, kind = [], WHOLE
            yield batch()
        if open_lines:
            close(TAIL)
        yield batch()

    pieces = lines.mapInArrow(cut, "piece int, file long, block long, value string, first boolean")
    whole = pieces.where(F.col("piece") == WHOLE).select("value", "first")
    if not across:
        return whole
    order = Window.partitionBy("file").orderBy("block", "piece")
    parts = pieces.where(F.col("piece") != WHOLE).withColumn("nth", F.sum(F.when(F.col("piece") == TAIL, 1).otherwise(0)).over(order))
    held = F.sort_array(F.collect_list(F.struct("block", "piece", "value", "first")))
    joined = parts.groupBy("file", "nth").agg(held.alias("held"))  # the lines of one record
    return whole.unionByName(joined.select(F.array_join(F.transform("held", lambda x: x["value"]), "\n").alias("value"), F.get("held", F.lit(0))["first"].alias("first")))
