"""Records of delimited files by split, against a reader of whole files."""

from __future__ import annotations

import csv
import io
import random

import pytest

from loomrec.sources import tables
from loomrec.sources.records import records, within_after


def _file(seed: int, rows: int) -> tuple[str, list[list[str]]]:
    r = random.Random(seed)
    words = ["plain", "two words", 'a "quoted" word', "line\nend", "tab\there", '"', "\n\n", "", 'five" disk', "é" * 9, "x" * 200]
    table = [["user_id", "item_id", "review_text"]] + [[str(k), str(r.randrange(9)), r.choice(words)] for k in range(rows)]
    lines = []
    for row in table:
        cells = []
        for c in row:
            bare = not any(x in c for x in "\n\t") and not c.startswith('"') and r.random() < 0.7  # quotes inside a bare field are characters
            cells.append(c if bare else '"' + c.replace('"', '""') + '"')
        lines.append("\t".join(cells))
    return r.choice(["\n", "\r\n"]).join(lines) + r.choice(["", "\n"]), table


def test_within_after():
    assert not within_after('a\t5" disk\tb', False) and within_after('a\t"b', False) and within_after('a\t"b""', False)
    assert not within_after('a""b"\tc"', True) and within_after('a"\t"c', True) and not within_after('"a"b"\t', False)


@pytest.mark.parametrize("seed", range(6))
def test_a_file_of_many_splits(spark, tmp_path, seed):
    text, table = _file(seed, 300)
    (tmp_path / "x.text").write_text(text, newline="")
    (tmp_path / "empty.text").write_text("")
    size = len(text.encode()) // 7
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = records(spark, f"{tmp_path}/*.text")
        assert spark.read.option("lineSep", "\n").text(f"{tmp_path}/x.text").rdd.getNumPartitions() >= 7
        got = sorted(next(csv.reader(io.StringIO(r["value"], newline=""), delimiter="\t")) for r in found.where("not first").collect())
        assert got == sorted(table[1:]) and found.where("first").count() == 1
        back = tables.read_tsv(spark, f"{tmp_path}/x.text", tables.REVIEWS)
        assert sorted((str(r[0]), str(r[1]), r[2] or "") for r in back.collect()) == sorted(map(tuple, table[1:]))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_records_longer_than_splits(spark, tmp_path):
    """Fields that run over several splits, a field that is never closed, and a file of blank lines."""
    long = "\n".join("z" * 50 for _ in range(40))
    (tmp_path / "a.text").write_text(f'user_id\titem_id\treview_text\n1\t2\t"{long}"\n\n2\t3\tshort\n3\t4\t"{long}\n')
    (tmp_path / "b.text").write_text("\n\n\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
        got = [r["value"].split("\t") for r in records(spark, f"{tmp_path}/*.text").where("not first").collect()]
        assert sorted(got) == sorted([["1", "2", f'"{long}"'], ["2", "3", "short"], ["3", "4", f'"{long}']])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
