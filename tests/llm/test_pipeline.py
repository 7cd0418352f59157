"""Each stage of the pipeline against plain Python on what the stage before it kept."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from loomrec.llm import queries
from loomrec.scratch import materialise
from tests.llm import brute
from tests.llm.test_operators import EXTRA, awkward, check_places, prose

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
        seen[name] = docs.collect()
        if name != "best-fit packing":
            assert docs.columns == COLUMNS
    whole, ruled, lined, joined, mixed, packed = seen.values()

    kept = {r["doc_id"] for r in queries.op2_quality_rules(spark, sf_dir).where("kept").collect()}
    assert sorted(ruled) == sorted(r for r in whole if r["doc_id"] in kept)
    for r in whole:
        n, _, _, _, repeated = brute.rule_counts(r["text"])
        assert not (r["doc_id"] in kept and (n < 10 or 100 * repeated > 20 * n))

    want = {d: sha for d, _, _, sha in brute.line_dedup([(r["doc_id"], r["text"]) for r in ruled])}
    assert {r["doc_id"]: brute.sha(r["text"]) for r in lined} == want
    assert all(r["n_chars"] == len(r["text"]) for r in lined) and len(lined) == len(ruled)

    groups = brute.jaccard([(r["doc_id"], r["text"]) for r in lined])
    assert sorted(joined) == sorted(r for r in lined if groups[r["doc_id"]][1] == r["doc_id"])

    sizes, taken = defaultdict(int), defaultdict(int)
    copies = Counter(r["doc_id"] for r in mixed)
    for r in joined:
        n = len(brute.WORD.findall(r["text"]))
        sizes[r["source"]] += n
        taken[r["source"]] += n * copies[r["doc_id"]]
        assert copies[r["doc_id"]] <= 3
    for s, want in brute.targets(dict(sizes)).items():
        assert abs(taken[s] - want) <= max(len(brute.WORD.findall(r["text"])) for r in joined if r["source"] == s)
    by_id = {r["doc_id"]: r for r in joined}
    assert all(r == by_id[r["doc_id"]] for r in mixed)

    from tokenizers import Tokenizer

    tok, pieces = Tokenizer.from_file(queries.tokenizer_path()), []
    for r in mixed:
        ids = [*tok.encode(r["text"], add_special_tokens=False).ids, 0]
        pieces += [(r["doc_id"], k, a, len(ids[a : a + 2048]), zlib.crc32(np.asarray(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted(tuple(r)[:5] for r in packed) == sorted(pieces)
    assert check_places(packed) <= 1.05 * sum(p[3] for p in pieces) / 2048 + 2
    assert sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(pieces)


def test_near_duplicates_by_row(spark):
    """Ids that are repeated with different texts, and rows without an id."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (2, a + " more"), (2, b), (2, b), (None, c), (None, c), (None, b), (3, None), (3, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=repr)
    assert got == sorted([(1, a), (2, b), (None, c), (3, None), (3, None), (None, "")], key=repr)


def test_awkward_rows_through_all_stages(spark):
    """Nulls in every column, blanks, repeated rows and ids, a long text and columns of clashing names."""
    rows = awkward() + [(50 + k, prose(50 + k, 60), "en", "ab"[k % 2]) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.when(F.col("doc_id") % 2 == 0, F.length("text")).cast("long"))
    docs = docs.withColumns({c: F.lit("clash") for c in [*EXTRA, "copies", "sid", "rank", "kept_text", "n_dropped", "_row", "order", "base_failed"]}).repartition(3)
    seen = [docs.select(*COLUMNS).collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, ""), "stage")
        seen.append(docs.collect())
        assert name == "best-fit packing" or docs.columns == COLUMNS
    whole, ruled, lined, joined, mixed, packed = seen
    assert Counter(ruled) <= Counter(whole) and all(r["text"] and r["text"].split() for r in ruled)
    with_id = [(r["doc_id"], r["text"]) for r in ruled if r["doc_id"] is not None]
    assert Counter((r["doc_id"], brute.sha(r["text"])) for r in lined if r["doc_id"] is not None) == Counter((d, sha) for d, _, _, sha in brute.line_dedup(with_id))
    assert Counter(r["text"] for r in lined if r["doc_id"] is None) == Counter(r["text"] for r in ruled if r["doc_id"] is None)
    assert Counter(joined) <= Counter(lined) and set(mixed) <= set(joined) and max(Counter(mixed).values()) <= 3 * max(Counter(joined).values())
    groups = brute.jaccard(list(enumerate(r["text"] for r in lined)))
    assert len(joined) == len({root for _, root in groups.values()})
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in mixed)
    check_places(packed)


def test_empty_through_all_stages(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, size string")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, ""), "stage")
        assert docs.count() == 0
