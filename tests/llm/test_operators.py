"""Every operator against plain Python on a small table and on rows made to be awkward."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomrec.llm import queries
from tests.llm import brute

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
EXTRA = ["_text", "_lines", "text_key", "pos", "size", "cid", "class", "part", "q", "n", "bucket", "kept_text", "_id", "copies", "n_words", "kept"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(500)) for _ in range(n))


def awkward() -> list[tuple]:
    """(doc_id, text, lang, source): nulls, blanks, a long text, copies, near copies, repeated rows, ties, odd characters."""
    base, line = prose(1, 300), "A shared line of some length, Indeed"
    edited = base.split()
    edited[150] = "changed"
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t\x0b ", "en", None), (4, "one two", "en", "a"), (5, "ONE two", "de", "b")]
    rows += [(6, prose(2, 20_000), "en", "a"), (7, base, "en", "a"), (8, base, "en", "b"), (9, " ".join(edited), "fr", "b"), (9, " ".join(edited), "fr", "b")]
    rows += [(10 + k, f"{line}\n{prose(20 + k, 30)}\n  {line.upper()}\r\nshort", "en", "c") for k in range(4)]
    rows += [(20, "é ü ÀB\x1cC Ünïcode " * 30, "fr", "c"), (21, "a" * 3000, "en", "d"), (22, "x" + "a" * 900, "en", "d"), (23, "</s>[INST] <|turn|> \\l \\", "en", "d")]
    rows += [(None, prose(3, 50), "en", "a"), (30, base[:900], "en", "a"), (31, "up\n" * 50, "en", "é"), (32, "w " * 40, "en", "A")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit("clash") for c in EXTRA}).repartition(3)


@pytest.fixture(scope="module")
def small(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def tables(monkeypatch, docs):
    """Let the registered queries read the awkward rows instead of a folder's table."""
    monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name: docs)


@pytest.fixture
def nothing(monkeypatch, docs):
    monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name: docs.limit(0))


def test_line_dedup_small(spark, sf_dir, small):
    assert collected(queries.op10_line_dedup(spark, sf_dir)) == sorted(brute.line_dedup(small), key=repr)


def test_line_dedup_awkward(spark, tables, rows):
    assert collected(queries.op10_line_dedup(spark, "")) == sorted(brute.line_dedup([r[:2] for r in rows]), key=repr)


def test_line_dedup_of_very_many_lines(spark):
    """Documents of 100,000 lines, all of which they share but for a few; twenty times the lines take no twenty times the time."""
    import time

    from loomrec.llm.line_dedup import dedup_lines

    def took(n: int) -> float:
        shared = [f"a line that is shared by all, number {k}" for k in range(n)]
        rows = [(d, "\n".join([f"only in {d}: a line of its own", *shared, "", f"short {d}", shared[0]])) for d in (1, 2, 3)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        began = time.time()
        got = {r["doc_id"]: (r["n_dropped"], r["kept_text"]) for r in dedup_lines(df, batches=1).collect()}
        assert got[3] == (0, rows[2][1])
        assert all(got[d] == (n + 1, f"only in {d}: a line of its own\n\nshort {d}") for d in (1, 2))
        return time.time() - began

    took(100)
    assert took(100_000) < 5 * took(5000)


def test_line_dedup_plan_has_no_python(spark, docs):
    from loomrec.llm.line_dedup import dedup_lines

    plan = dedup_lines(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_line_runs_hold_each_key_once(spark):
    from loomrec.llm.line_dedup import LineRuns

    store = LineRuns(spark, fanout=2, buckets=2)
    for k in range(7):
        store.add(spark.range(10 * k, 10 * k + 15).select(F.col("id").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(-k).cast("long").alias("holder"), F.lit(1).cast("long").alias("n")))
    held = [r["h1"] for run in store.runs() for r in run.collect()]
    assert sorted(held) == list(range(75)) and len(store.runs()) < 7
    assert store.frequent(2).count() == 30


def test_quality_counts(spark, tables, rows):
    got = collected(queries.op2_quality_rules(spark, "").drop("kept"))
    want = [(d, *brute.rule_counts(t)) for d, t, *_ in rows]
    want = [(d, *c, c[0] < 10 or 100 * c[4] > 20 * c[0]) for d, *c in want]
    assert got == sorted(want, key=repr)


def test_quality_rules_keep_good_and_drop_bad(spark, sf_dir):
    judged = queries.op2_quality_rules(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    got = {(r["quality"], r["kept"]): r["n"] for r in judged.groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    assert got.get((1, False), 0) <= 0.1 * got[(1, True)]
    assert not judged.where("base_failed and kept").count()


def test_sketches_merge(spark):
    from loomrec.llm.quality_rules import merged, quartiles, sketch, spaced

    parts = spark.range(2000).select((F.col("id") % 2).cast("string").alias("lang"), F.lit("s").alias("source"), F.lit(100).alias("n_words"), (F.col("id") % 100).alias("n_symbols"), F.lit(0).alias("n_dup_lines"), F.lit(0).alias("n_upper"), F.lit(0).alias("n_repeat_words"), F.lit(0).alias("n_stutters"), F.lit(500).alias("word_chars"))
    own = sketch(parts, 1.02).where("measure = 'symbols'")
    every = merged(own).select(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "measure", "bucket", "n")
    few = spaced(every, 20, "lang", "source")
    assert [few.agg(F.sum("n")).first()[0], every.agg(F.sum("n")).first()[0]] == [20, 2000]
    for s in (every, few):
        q = quartiles(s, 1.02).first()
        assert abs(q["q75"] - 0.75) < 0.04 and abs(q["q25"] - 0.25) < 0.04
    assert {r["docs"] for r in quartiles(own, 1.02).collect()} == {1000}


def _verdicts(docs, gamma=1.02, reach=3.0, prior=20):
    """docs: (doc_id, text, lang, source) -> {doc_id: kept}, document by document."""
    import math

    from loomrec.llm.quality_rules import counts

    rows = [(d, lang, source, counts(t)) for d, t, lang, source in docs]
    names = ("symbols", "dup_lines", "upper", "stutters", "word_length")

    def parts(c):  # (count, out of) of each measure
        n, chars, symbols, dup, _, _, upper, stutters = c
        return dict(zip(names, ((symbols, n), (dup, n), (upper, chars), (stutters, n), (chars, n))))

    def bucketed(s, n):
        return 0.0 if s / n < 1e-6 else gamma ** (math.ceil(math.log(s / n) / math.log(gamma)) - 0.5)

    def spaced(v):
        return [sorted(v)[math.ceil((2 * i + 1) * len(v) / (2 * prior)) - 1] for i in range(prior)]

    some = [r for r in rows if r[3][0]]
    out = {}
    for d, lang, source, c in rows:
        if c[0] < 10 or 100 * c[4] > 20 * c[0]:
            out[d] = False
            continue
        own, wide = [[x[3] for x in some if x[1] == lang and (k or x[2] == source)] for k in (0, 1)]
        fine = True
        for m in names:
            mine, language, every = ([bucketed(*parts(x)[m]) for x in group] for group in (own, wide, [x[3] for x in some]))
            v = sorted(mine + spaced(language + spaced(every)))
            q = [v[math.ceil(at * len(v)) - 1] for at in (0.25, 0.75)]
            s, n = parts(c)[m]
            if m == "word_length":
                f = max((q[1] / q[0]) ** (3 * reach), 1 + reach * 0.5 / math.sqrt(n))
                fine &= q[0] / f <= s / n <= q[1] * f
            else:
                high = q[1] + reach * (3 if m in ("upper", "stutters") else 1) * (q[1] - q[0])
                usual = max(q[1], sum(v) / len(v))
                fine &= s <= max(n * high, (math.sqrt(n * usual + 0.375) + reach / 2) ** 2 - 0.375)
        out[d] = fine
    return out


@pytest.mark.parametrize("table", ["sf0.001", "awkward"])
def test_verdicts(spark, sf_dir, rows, docs, table, monkeypatch):
    df = docs if table == "awkward" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    monkeypatch.setattr(queries, "table", lambda *_: df)
    got = {r["doc_id"]: r["kept"] for r in queries.op2_quality_rules(spark, "").collect()}
    assert got == _verdicts([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()])


def test_the_same_ratio_in_two_sources(spark):
    """Signs are usual in one source and unheard of in the other; a source of three documents follows its language."""
    from loomrec.llm.quality_rules import judge

    def signs(k: int, n: int) -> str:
        return " ".join(w + "#" * (i < n) * (1 + (n > 100) * 4) for i, w in enumerate(prose(k, 100).split()))

    docs = [(k, signs(k, 10 + k % 40), "en", "code") for k in range(120)] + [(200 + k, signs(k, 0), "en", "prose") for k in range(120)]
    docs += [(400, signs(400, 45), "en", "code"), (401, signs(401, 45), "en", "prose"), (402, signs(402, 400), "en", "code")] + [(410 + k, signs(k, 20), "fr", "few") for k in range(3)]
    got = {r["doc_id"]: r["kept"] for r in judge(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    assert sorted(d for d, kept in got.items() if not kept) == [401, 402]


@pytest.mark.parametrize("group", ["clean", "mixed"])
def test_long_documents_with_a_few_signs_stay(spark, group):
    """A few signs or repeated lines do not reject a long text, also where hardly any text has one; texts full of them go."""
    from loomrec.llm.quality_rules import judge

    def with_signs(k: int, n: int, signs: int, lines: int = 0) -> str:
        w = prose(k, n).split()
        for i in range(signs):
            w[(i + 1) * n // (signs + 1)] = "AT&T"
        body = [" ".join(w[a : a + 400]) for a in range(0, n, 400)]
        for i in range(lines):
            body.insert((i + 1) * len(body) // (lines + 1), "---")
        return "\n".join(body)

    docs = [(k, with_signs(k, 100 + 7 * k, k % 29 == 0, 2 * (k % 31 == 0)), "en", "a") for k in range(150)]
    junk = [(200 + k, " ".join(f"{w}|#" for w in prose(k, 80).split()), "en", "a") for k in range(12 * (group == "mixed"))]
    long = [(300, with_signs(1, 100_000, 5), "en", "a"), (301, with_signs(2, 20_000, 5), "en", "a"), (302, with_signs(3, 20_000, 0, 6), "en", "a"), (303, with_signs(4, 100_000, 9, 9), "en", "a")]
    full = [(400, with_signs(5, 20_000, 9000), "en", "a"), (401, with_signs(6, 2000, 900), "en", "a")]
    df = spark.createDataFrame(docs + junk + long + full, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in judge(df).collect()}
    assert [d for d, *_ in docs + long if not got[d]] == []
    assert [d for d, *_ in junk + full if got[d]] == []


def test_fences_come_from_the_group(spark):
    from loomrec.llm.quality_rules import judge

    def text(group: int, k: int) -> str:  # words of the second group are twice as long
        return " ".join(w * (1 + group) for w in prose(1000 * group + k, 60).split())

    def capitals(text: str, every: int) -> str:
        return "".join(c.upper() if i % every == 0 else c for i, c in enumerate(text))

    r = random.Random(5)
    docs = [(100 * g + k, capitals(text(g, k), 40 + k % 9), "en", str(g)) for g in (0, 1) for k in range(80)]
    broken = " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300))
    docs += [(1000 + g, broken, "en", str(g)) for g in (0, 1)] + [(1010 + g, text(1 - g, 900), "en", str(g)) for g in (0, 1)]
    docs += [(1020 + g, capitals(text(g, 901), 6), "en", str(g)) for g in (0, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in judge(df).collect()}
    assert {d: v for d, v in got.items() if v != (False, True)} == {d: (False, False) for d in (1000, 1001, 1010, 1011, 1020, 1021)}


def test_packing(spark, tables, rows):
    from tokenizers import Tokenizer

    out = queries.op3_best_fit_packing(spark, "").collect()
    tok, want = Tokenizer.from_file(queries.tokenizer_path()), []
    for d, t, *_ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(d, p, a, len(ids[a : a + 2048]), zlib.crc32(np.asarray(ids[a : a + 2048], "<u4").tobytes())) for p, a in enumerate(range(0, len(ids), 2048))]
    assert sorted((tuple(r)[:5] for r in out), key=repr) == sorted(want, key=repr)
    check_places(out)


def check_places(out):
    places = defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    return len(places)


@pytest.mark.parametrize("seed", range(6))
def test_layout_is_close_to_the_bound(seed):
    from loomrec.llm.packing import layout

    r = np.random.default_rng(seed)
    lengths = np.clip((r.lognormal(5 + seed % 3, 1.0, 3000)).astype(int) + 1, 1, 2048)
    counts = np.bincount(lengths, minlength=2049)
    places, n = layout(counts, 2048)
    used = defaultdict(list)
    for length, runs in places.items():
        ends = [x[0] for x in sorted(runs)][1:] + [int(counts[length])]
        for (first, seq, offset), end in zip(sorted(runs), ends):
            for k in range(end - first):
                used[seq + k].append((offset, length))
    assert sum(map(len, used.values())) == len(lengths) and len(used) == n
    for held in used.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert n <= 1.02 * (-(-int(lengths.sum()) // 2048)) + 2


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01", "awkward"])
def test_mixing(spark, docs, table, monkeypatch):
    df = docs if table == "awkward" else spark.read.parquet(f"/root/testdata/{table}/documents.parquet")
    monkeypatch.setattr(queries, "table", lambda *_: df)
    from loomrec.llm.mixing import mix

    out = mix(df).collect()
    sizes, taken, largest, target = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for r in out:
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 3
    want = brute.targets(dict(sizes))
    assert len(out) == df.count()
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - want[s]) <= largest[s]  # whole documents only: ten of them in a source of the smallest table
        if table == "sf0.01":
            assert abs(taken[s] - want[s]) <= 0.02 * want[s]
    assert collected(queries.op4_source_mixing(spark, "")) == collected(queries.op4_source_mixing(spark, ""))


def test_mixing_carries_columns_along(spark, docs):
    from loomrec.llm.mixing import mix, word_count

    out = mix(docs, carry=("text", "lang"))
    assert collected(out.select("doc_id", "text", "lang")) == collected(docs.select("doc_id", "text", "lang"))
    assert collected(out.drop("text", "lang")) == collected(mix(docs))
    assert out.where(word_count(F.col("text")) != F.col("size")).count() == 0
    assert collected(mix(docs.limit(0), carry=("text", "lang"))) == []


def test_inclusion_follows_the_odds(spark):
    from loomrec.llm.mixing import mix

    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("only").alias("source"), F.when(F.col("id") % 2 == 0, F.repeat(F.lit("w "), 64)).otherwise(F.repeat(F.lit("w "), 8)).alias("text"))
    two = docs.withColumn("source", F.when(F.col("doc_id") < 2000, "a").otherwise("b"))
    got = mix(two, weights=(1.0, 3.0)).where("source = 'a'").groupBy("size").agg(F.avg("copies").alias("p")).collect()
    p = {r["size"]: r["p"] for r in got}
    assert abs(p[64] / p[8] - 7 / 4) < 0.25  # odds are the sizes' binary digits


def test_suffix_dedup_small(spark, sf_dir, small):
    out = queries.op5_suffix_dedup(spark, sf_dir)
    assert collected(out.drop("kept_text")) == sorted(brute.repeats(small), key=repr)
    whole = {r["doc_id"]: r for r in out.collect()}
    for d, text in small:
        left, r = whole[d]["kept_text"], whole[d]
        assert (left == text) == (r["n_removed"] == 0)
        assert "\ufffd" in left or len(left.encode()) == r["n_bytes"] - r["n_removed"]


def test_suffix_dedup_awkward(spark, tables, rows):
    assert collected(queries.op5_suffix_dedup(spark, "").drop("kept_text")) == sorted(brute.repeats([r[:2] for r in rows]), key=repr)


def test_suffix_dedup_when_ids_meet(spark):
    """Many texts share the first hash; each is still judged by itself."""
    from loomrec.llm.suffix_dedup import remove_repeats

    rows = [(k, prose(k % 20, 90) + prose(100 + k % 7, 80)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = remove_repeats(df, ident=lambda t: F.length(t).cast("long") % 3).drop("kept")
    assert collected(got) == sorted(brute.repeats(rows), key=repr)


@pytest.mark.parametrize("hot", [1, 4096])
def test_suffix_dedup_overlaps(spark, hot):
    """Short strings over few letters: overlapping, periodic and self-repeating, with and without the way for hot groups."""
    from loomrec.llm.suffix_dedup import remove_repeats

    r = random.Random(5)
    parts = ["".join(r.choice("ab c") for _ in range(r.randrange(30, 90))) for _ in range(12)]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randrange(1, 9)))) for i in range(60)]
    rows += [(100, "ab" * 300), (101, "z" * 200), (102, "ab" * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = remove_repeats(df, 48, core=16, spacing=6, hot=hot).drop("kept")
    assert collected(got) == sorted(brute.repeats(rows, 48), key=repr)


def test_ngram_join_small(spark, sf_dir, small):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op1_ngram_join(spark, sf_dir).collect()}
    assert got == brute.jaccard(small)


def test_ngram_join_awkward(spark, tables, rows):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in queries.op1_ngram_join(spark, "").collect() if r["doc_id"] is not None}
    assert got == {(d, *v) for d, v in brute.jaccard([r[:2] for r in rows if r[0] is not None]).items()}


def test_ngram_join_in_blocks(spark):
    """A large group of near copies, a chain at the threshold and strays, in blocks of eight."""
    from loomrec.llm.ngram_join import similar_documents

    r = random.Random(3)
    base = prose(7, 120).split()
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    slide = prose(8, 400).split()
    rows += [(200 + i, " ".join(slide[5 * i : 5 * i + 60])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for options in ({"group": 6}, {"common": 1, "ident": lambda raw: len(raw) % 5}):
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in similar_documents(df, block=8, **options).collect()}
        assert got == brute.jaccard(rows)


def test_embeddings(spark):
    from loomrec.llm.embedding_dedup import near_duplicates

    r = np.random.default_rng(0)
    base = r.standard_normal((40, 16))
    rows = [(i, (base[i % 40] + 0.14 * r.standard_normal(16)).tolist()) for i in range(300)]
    rows += [(400 + i, rows[0][1]) for i in range(30)] + [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, []), (504, [1.0, None] + [0.0] * 14), (505, [1.0, 0.0]), (506, [2.0, 0.0]), (507, [1e300, 1e300] + [0.0] * 14), (508, [float("inf")] * 16)]
    df = spark.createDataFrame(rows + rows[:3], "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("tile", F.lit(2))
    ids = [i for i, v in rows]
    links = []
    for k, (i, v) in enumerate(rows):
        for j, u in rows[:k]:
            if v and u and len(v) == len(u) and None not in v + u:
                a, b = np.asarray(v) / max(np.abs(v).max(), 1e-300), np.asarray(u) / max(np.abs(u).max(), 1e-300)
                if np.isfinite(v).all() and np.isfinite(u).all() and a.any() and b.any() and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9:
                    links.append((j, i))
    degree = defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    comp = brute.components(ids, links)
    got = near_duplicates(df, tile_rows=64).collect()
    assert sorted((x["vec_id"], x["n_links"], x["component_id"], x["kept"]) for x in got) == sorted((i, degree[i], comp[i], comp[i] == i) for i in ids)
    assert len(links) > 300
    assert near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("block,tile_rows", [(4, 32), (8, 64), (16, 4096)])
def test_embeddings_in_blocks(spark, block, tile_rows):
    """Clusters, a large group of near copies over several chunks, a chain, equal vectors: counts and components are whole."""
    from loomrec.llm.embedding_dedup import near_duplicates

    r = np.random.default_rng(11)
    base = r.standard_normal((30, 16))
    x = [base[i % 30] + 0.25 * r.standard_normal(16) for i in range(240)]
    x += [base[0] + 0.02 * r.standard_normal(16) for _ in range(150)] + [base[1]] * 90
    a, b = np.eye(16)[:2]
    x += [np.cos(t) * a + np.sin(t) * b for t in np.arange(0, 3, 0.3)]
    x = np.asarray(x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    comp = brute.components(range(len(u)), [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(near)))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in near_duplicates(df, block=block, tile_rows=tile_rows).collect())
    assert got == [(i, int(near[i].sum()), comp[i]) for i in range(len(u))]


def test_cells_prune(spark):
    """Every pair within a block's budget meets in a cell; of clustered vectors few cells are visited."""
    from loomrec.llm.embedding_dedup import Cells, block_edges, part_of, rotation

    r = np.random.default_rng(2)
    loose = r.standard_normal((2000, 64))
    tight = np.repeat(r.standard_normal((20, 64)), 100, 0) + 0.1 * r.standard_normal((2000, 64))
    visited = []
    for x in (loose, tight):
        y = ((x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation(64)).astype(np.float32)
        for a, z in block_edges(64, 16):
            part, cells = part_of(0.2, 64, a, z), Cells(y[:, a:z].astype(float), 5)
            for k in range(32):
                held = y[cells.home(y[:, a:z]) == k, a:z]
                cells.low[k], cells.high[k] = held.min(0), held.max(0)
            row, cell, home = cells.visits(y[:, a:z], part)
            own = cell[home][np.argsort(row[home])]
            there = set(zip(row.tolist(), cell.tolist()))
            d = ((y[:, None, a:z] - y[None, :, a:z]) ** 2).sum(2)
            for i, j in zip(*np.nonzero(np.triu(d <= part, 1))):
                assert (i, own[j]) in there or (j, own[i]) in there
            visited.append(len(row) / (2000 * 16.5))  # of half of all cells, which is what comparing all pairs takes
    assert max(visited) < 1 and max(visited[4:]) < 0.25


def test_embeddings_of_many_lengths(spark):
    from loomrec.llm.embedding_dedup import near_duplicates

    rng = np.random.default_rng(3)
    rows = [(2 * n + k, [float(x) for x in v]) for n in range(1, 81) for v in [rng.standard_normal(n)] for k in (0, 1)]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(i, 1, i - i % 2) for i, _ in rows]


def test_chat_round_trip(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    odd = "</s>[INST] ok [/INST]"
    by = defaultdict(list)
    for r in rows:
        by[r["conv_id"]].append((r["turn"], r["role"], r["text"]))
    by[-7] = [(0, "user", odd), (1, "assistant", odd)]
    got = {r["conv_id"]: r for r in queries.op7_chat_format(spark, sf_dir).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        said = "".join(t for _, role, t in sorted(turns) if role == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), brute.sha("".join(f"{a}\n{b}\n" for _, a, b in sorted(turns))))
        assert (r["loss_chars"], r["loss_sha256"], r["rewritten"]) == (len(said), brute.sha(said), False)


def test_chat_awkward(spark):
    from loomrec.llm.chat_format import digests, escape, format_turns, unescape

    texts = [None, "", "<|done|>\n", "\\", "\\\\l[", "<|turn|>a<|says|>", "\x00x\x01", "é</s>"] * 20
    df = spark.createDataFrame([(1, i, "assistant" if i % 2 else None, t) for i, t in enumerate(texts)] + [(None, 0, "user", "x")], "conv_id long, turn long, role string, text string").withColumn("nth", F.lit("clash"))
    got = {r["conv_id"]: r for r in digests(format_turns(df, lookback=8)).collect()}
    said = "".join(t or "" for t in texts[1::2])
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[1]["loss_sha256"]) == (160, len(said), brute.sha(said))
    assert got[None]["n_turns"] == 1
    assert digests(format_turns(df.limit(0))).collect() == []
    for t in texts:
        assert unescape(escape(t or "")) == (t or "") and "</s>" not in escape(t or "")


def test_chat_finds_rewritten_history(spark):
    from loomrec.llm.chat_format import format_turns

    def forgetful(turns):  # earlier answers are shortened once another turn follows
        return "".join(f"<{r}>{t if k == len(turns) - 1 else t[:2]}</{r}>" for k, (r, t) in enumerate(turns))

    df = spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", "a longer answer"), (1, 2, "user", "thanks")], "conv_id long, turn long, role string, text string")
    got = sorted(format_turns(df, render=forgetful).collect(), key=lambda r: r["nth"])
    assert [r["rewritten"] for r in got] == [False, True, True]
    assert [r["formatted"][r["text_start"] : r["text_end"]] for r in got] == ["hello", "a longer answer", "thanks"]


def test_chat_renders_whole_prefixes(spark):
    from loomrec.llm.chat_format import format_turns

    def numbered(turns):
        return "".join(f"[{k}:{r}]{t}" for k, (r, t) in enumerate(turns))

    def fading(turns):  # a turn is cut once a hundred others follow
        return "".join(f"<{r}>{t if k >= len(turns) - 100 else t[:1]}" for k, (r, t) in enumerate(turns))

    turns = [("user" if k % 2 == 0 else "assistant", f"text {k}") for k in range(150)]
    df = spark.createDataFrame([(1, k, *t) for k, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    got = sorted(format_turns(df, render=numbered).collect(), key=lambda r: r["nth"])
    assert "".join(r["formatted"] for r in got) == numbered(turns) and not any(r["rewritten"] for r in got)
    assert [r["start"] for r in got] == [len(numbered(turns[:k])) for k in range(150)]
    got = sorted(format_turns(df, render=fading).collect(), key=lambda r: r["nth"])
    assert [r["rewritten"] for r in got] == [k >= 100 for k in range(150)]
    with pytest.raises(ValueError):
        format_turns(df, render=numbered, lookback=64)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a<b) "</p>"</script></head><body><header><h1>Site</h1></header>
<div id="main-menu"><a href=x>Home</a></div><main><h1>A &amp; B</h1><p>First&nbsp;para <b>bo</b>ld,
 next.<p>Short.<ul><li>item one<li>item <i>two</i></ul><div class="advert">Buy now</div><form><p>Mail?</p></form>
<section id="comments"><h2>Comments</h2><p>I like this a lot, really a very nice article it is.</p></section></main><aside>x</aside>
<div class="cookie-notice">We use cookies to do many things here, is that fine?</div><footer>f</footer></body></html>"""


def test_html(spark):
    from loomrec.llm.html_extract import extract

    odd = [None, "", "<", "<p", "</p></p>", "<a 'b <p>x", "<div>" * 3000 + "deep", "<!-- open", "<script>x", "&#0;&bogus;", "plain words " * 20, "<p>" * 2000]
    df = spark.createDataFrame([(0, "u", PAGE), *((k + 1, None, h) for k, h in enumerate(odd))], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in extract(df).collect()}
    assert got[0]["text"] == "A & B\nFirst para bold, next.\nShort.\nitem one\nitem two"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and len(got) == 1 + len(odd)
    assert got[11]["text"] == ("plain words " * 20).strip()
    assert extract(df.limit(0)).collect() == []
    long = spark.createDataFrame([(k, "u", f"<article>{'<p>' + LONG + '.</p>'}" * 3000) for k in (5, 5)], "page_id long, url string, html string")
    assert [(r["page_id"], r["text"]) for r in extract(long).collect()] == [(5, "\n".join([f"{LONG}."] * 3000))] * 2


STORY = "".join(f"<p>{prose(k, 40)}.</p>" for k in range(4))
TOLD = "\n".join(f"{prose(k, 40)}." for k in range(4))
SIDE = f"<p>{prose(9, 50)}.</p>"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        *((f"<div class='{c}'><article>{STORY}</article></div>", TOLD) for c in ("layout has-sidebar", "no-sidebar", "social-impact", "legal-news")),
        (f"<div class='no-sidebar'><div>{STORY}</div><div class='sidebar'>{SIDE}</div></div><footer>f</footer>", TOLD),
        (f"<form id=aspnet><div id=menu>Home</div><main>{STORY}</main><div class=sidebar>{SIDE}</div></form>", TOLD),
        (f"<form id=aspnet><nav>Home</nav><div>{STORY}</div></form>", TOLD),
        (f"<main>{STORY}</main><section class=related><article>{SIDE}</article></section>", TOLD),
        (f"<main>{STORY}<form>{SIDE * 9}</form><section id=comments>{SIDE * 9}</section></main>", TOLD),
        (f"<div>{STORY}</div><section id=comments>{SIDE * 6}</section>", TOLD),
        (f"<main>{STORY.replace('</p>', ' <button>Share</button><span hidden>secret</span> <span class=ad>Buy now</span></p>')}</main>", TOLD),
    ],
)
def test_html_wrappers(html, want):
    from loomrec.llm.html_extract import main_text

    assert main_text(f"<html><body>{html}</body></html>") == want


LONG = prose(70, 30)


@pytest.mark.parametrize("fitted", [False, True])
@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<article><h1>Legal news</h1><div class='legal'><p>The court ruled on Monday that it holds.</p></div></article>", "Legal news\nThe court ruled on Monday that it holds."),
        (f"<h1>Study</h1><div class='related-work'><p>{LONG}.</p><p>{LONG}!</p></div>", f"Study\n{LONG}.\n{LONG}!"),
        (f"<article><p>{LONG}.</p><section class='comments'><p>{LONG}, said a reader.</p></section></article>", f"{LONG}."),
        (f"<div class=cookie-notice><p>We use cookies, {LONG}.</p></div><div><p>{LONG}.</p><p>{LONG}.</p></div>", f"{LONG}.\n{LONG}."),
        ("<article><h1>Council</h1><p>It met.</p><div class='notice-of-meeting'><p>The council gave notice of its next meeting on Monday.</p></div></article>", "Council\nIt met.\nThe council gave notice of its next meeting on Monday."),
        (f"<article><p>{LONG}.</p><blockquote class='reply'>We will not go, the minister said.</blockquote><p>{LONG}.</p></article>", f"{LONG}.\nWe will not go, the minister said.\n{LONG}."),
        (f"<article><h1>Soup</h1><div id='menu'><p>Our menu for the week begins with a soup.</p></div><p>{LONG}.</p></article>", f"Soup\nOur menu for the week begins with a soup.\n{LONG}."),
        (f"<article><h1>Views</h1><div class='comment'><p>{LONG}, we think.</p><p>{LONG}.</p></div></article>", f"Views\n{LONG}, we think.\n{LONG}."),
        (f"<article><p>{LONG}.</p><ul class='menu'><li><a href=a>Home</a><li><a href=b>News</a></ul></article>", f"{LONG}."),
        (f"<article><p>{LONG}.</p><ol><li class=comment><p>{LONG}, said a reader.</p><li class=comment><p>No, it is {LONG}.</p></ol></article>", f"{LONG}."),
    ],
)
def test_html_words_in_attributes(html, want, fitted):
    from loomrec.llm.html_extract import DEFAULT, main_text

    assert main_text(f"<html><body>{html}</body></html>", _fitted() if fitted else DEFAULT) == want


def _page(r: random.Random) -> tuple[str, str]:
    """A page that marks its article, and the article's text."""
    said = lambda n: prose(r.randrange(10**6), n)
    told = [said(6), *(f"{said(r.randrange(4, 60))}." for _ in range(r.randrange(2, 8)))]
    box, end = r.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<div role=main><div>", "</div></div>")])
    menu = "".join(f"<li><a href=/{k}>{said(1)}</a>" for k in range(r.randrange(1, 7)))
    side = [f"<div class=ad>{said(9)}.</div>", f"<nav><ul>{menu}</ul></nav>", f"<div class='comments'><p>{said(30)}.</p></div>", f"<aside><p>{said(20)}.</p></aside>", f"<ul class=links>{menu}</ul>"]
    r.shuffle(side)
    at = r.randrange(len(side))
    body = f"<h1>{told[0]}</h1>" + "".join(f"<p>{t}</p>" for t in told[1:])
    return f"<html><body>{''.join(side[:at])}{box}{body}{end}{''.join(side[at:])}<footer>{said(5)}</footer></body></html>", "\n".join(told)


def _fitted():
    from loomrec.llm.html_extract import examples, fitted

    found = [examples(_page(random.Random(k))[0], 100) for k in range(60)]
    return fitted(np.concatenate([x for x, _, _ in found]), np.concatenate([y for _, y, _ in found]).astype(float), sum(e for *_, e in found))


def test_html_generated_pages(spark):
    """Pages with marks are read back whole by the model that they fit, and nearly all of them without their marks."""
    from loomrec.llm.html_extract import DEFAULT, extract, fit, main_text

    pages = [_page(random.Random(k)) for k in range(60)]
    df = spark.createDataFrame([(k, "u", h) for k, (h, _) in enumerate(pages)], "page_id long, url string, html string")
    model = fit(df.repartition(5))
    assert np.allclose(model.weights, _fitted().weights) and np.allclose(model.capacities, _fitted().capacities)
    assert [r["text"] for r in extract(df).orderBy("page_id").collect()] == [t for _, t in pages]
    bare = [(h.replace("<article>", "<div>").replace("</article>", "</div>").replace("<main>", "<div>").replace("</main>", "</div>").replace(" role=main", ""), t) for h, t in pages]
    assert sum(main_text(h, model) == t for h, t in bare) >= 57
    assert np.allclose(fit(df.limit(0)).weights, DEFAULT.weights) and np.allclose(fit(df.limit(0)).capacities, DEFAULT.capacities)


def test_html_neighbours_decide():
    """A short block among paragraphs, and one paragraph-like line among links, take their neighbours' label."""
    from loomrec.llm.html_extract import labelled, minimum_cut

    changed = 0
    for html, want in [
        (f"<div><p>{LONG}.</p><div>Figure 2</div><p>{LONG}.</p></div><footer>f</footer>", [True, True, True, False]),
        (f"<article><p>{LONG}.</p></article><div>" + "".join(f"<div><a href={k}>{prose(k, 3)}</a></div>" for k in range(4)) + "</div>", [True] + [False] * 4),
    ]:
        texts, odds, labels = labelled(html)
        assert labels == want
        changed += sum((o > 0) != x for o, x in zip(odds, labels))
    assert changed > 0
    assert minimum_cut([-0.4, 3.0, 3.0], [(0, 1, 0.9), (1, 2, 0.9)]) == [True, True, True]


@pytest.mark.parametrize("seed", range(20))
def test_html_pages_by_brute_force(seed):
    """The text of small generated pages, marked or not, is that of the best of all labellings."""
    from loomrec.llm.html_extract import blocks, log_odds, main_text, neighbours

    r = random.Random(seed)
    piece = lambda: r.choice([f"<p>{prose(r.randrange(99), r.randrange(1, 12))}</p>", f"<div class={r.choice(['menu', 'comment', 'notice', 'ad', 'x'])}><p>{prose(r.randrange(99), 9)}.</p></div>", f"<li><a href=a>{prose(r.randrange(99), 2)}</a>", f"<h2>{prose(r.randrange(99), 3)}</h2>"])
    inner = "".join(piece() for _ in range(r.randrange(1, 6)))
    html = f"<body>{''.join(piece() for _ in range(3))}{r.choice([f'<article>{inner}</article>', f'<div>{inner}</div>'])}{piece()}<footer>f</footer></body>"
    model = _fitted()
    texts, rows, around = blocks(html)
    odds, edges = log_odds(rows, around, model.weights), [(i, j, model.capacities[k]) for i, j, k in neighbours(around)]

    def cost(label):
        return sum(abs(o) for o, x in zip(odds, label) if (o > 0) != x) + sum(c for i, j, c in edges if label[i] != label[j])

    labels = [[bool(k >> i & 1) for i in range(len(texts))] for k in range(1 << len(texts))]
    best = min(map(cost, labels))
    assert main_text(html, model) in {"\n".join(t for t, x in zip(texts, label) if x) for label in labels if cost(label) < best + 1e-9}


def test_html_model_is_the_best():
    """No small step away from the fitted weights makes the labels and the prior more likely."""
    from loomrec.llm.html_extract import DEFAULT, PRECISIONS, fitted

    r = np.random.default_rng(3)
    n = len(PRECISIONS)
    x = np.column_stack([np.ones(150), r.random((150, n - 1))])
    y = (x @ r.standard_normal(n) + r.standard_normal(150) > 0).astype(float)
    given = r.choice([0.0, -2.0], 150)
    w = np.asarray(fitted(np.column_stack([x, given]), y, np.zeros((4, 2))).weights)

    def loss(w):
        return np.log1p(np.exp(np.where(y > 0, -1, 1) * (x @ w + given))).sum() + 0.5 * (PRECISIONS * (w - DEFAULT.weights) ** 2).sum()

    assert all(loss(w) <= loss(w + d) + 1e-9 for k in range(n) for d in (0.01 * np.eye(n)[k], -0.01 * np.eye(n)[k]))


@pytest.mark.parametrize("seed", range(30))
def test_minimum_cut(seed):
    from loomrec.llm.html_extract import minimum_cut

    r = random.Random(seed)
    n = r.randrange(1, 10)
    odds = [r.uniform(-2, 2) for _ in range(n)]
    edges = [(a, b, r.uniform(0, 2)) for a in range(n) for b in range(a) if r.random() < 0.5]

    def cost(label):
        return sum(abs(o) for o, x in zip(odds, label) if (o > 0) != bool(x)) + sum(c for a, b, c in edges if bool(label[a]) != bool(label[b]))

    best = min(cost([k >> i & 1 for i in range(n)]) for k in range(1 << n))
    assert abs(cost(minimum_cut(odds, edges)) - best) < 1e-9


def test_classifier_held_out(spark, sf_dir):
    out = queries.op9_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in out) / len(out)
    good, bad = ([r["score"] for r in out if r["quality"] == q] for q in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert right > 0.93 and auc > 0.95


def test_classifier_awkward(spark, docs, rows):
    from loomrec.llm.quality_classifier import fit, score, train

    for labels in ([], [(7, 1)], [(7, 1), (8, 0), (2, 0), (6, 1), (None, 1), (5, None)]):
        trees = train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        out = score(docs, trees).collect()
        assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    r = np.random.default_rng(1)
    x = r.standard_normal((600, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    assert ((fit(x, y).score(x) > 0.5) == y).mean() > 0.9


def test_trees_score_as_walked():
    from loomrec.llm.quality_classifier import fit

    r = np.random.default_rng(4)
    x = r.standard_normal((300, 4))
    trees = fit(x, (x[:, 0] + x[:, 2] ** 2 > 0.5).astype(float), rounds=20, depth=3)
    for row, got in zip(x, trees.score(x)):
        total = trees.base
        for feature, edge, value in zip(trees.feature.tolist(), trees.edge.tolist(), trees.value.tolist()):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > edge[node] else 1)
            total += value[node - len(feature)]
        assert abs(got - 1 / (1 + np.exp(-total))) < 1e-12
    assert trees.score(x[:0]).shape == (0,)


def test_classifier_of_no_documents(spark, docs):
    from loomrec.llm.quality_classifier import score, train

    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, quality int")
    assert score(docs.limit(0), train(docs.limit(0), labels)).collect() == []


def test_empty_tables(spark, nothing):
    for name in ("op1_ngram_join", "op2_quality_rules", "op3_best_fit_packing", "op4_source_mixing", "op5_suffix_dedup", "op10_line_dedup"):
        assert queries.QUERIES[name](spark, "").collect() == [], name


def test_embeddings_in_single_precision(spark, sf_dir):
    from loomrec.llm.embedding_dedup import near_duplicates

    base = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 60").select("vec_id", "embedding")
    shifted = base.select((F.col("vec_id") + 1000).alias("vec_id"), F.transform("embedding", lambda v, i: (v + F.sin(i) * 0.04).cast("float")).alias("embedding"))
    df = base.unionByName(shifted)
    assert dict(df.dtypes)["embedding"] == "array<float>"
    rows = df.collect()
    x = np.asarray([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    got = {r["vec_id"]: r["n_links"] for r in near_duplicates(df).collect()}
    assert got == {r["vec_id"]: int(n) for r, n in zip(rows, near.sum(1))} and near.sum() > 60


@pytest.mark.parametrize("n,m", [(30, 12), (60, 45), (40, 400)])
def test_components(spark, n, m):
    from loomrec.llm.components import components

    r = random.Random(m)
    links = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(100 + i, 101 + i) for i in range(20)]
    got = {x["id"]: x["root"] for x in components(spark.createDataFrame(links + [(None, 3)], "a long, b long")).collect()}
    want = brute.components(range(200), links)
    assert got == {i: want[i] for a, b in links if a != b for i in (a, b)}
