"""LM scores, token alignment and the audit of sources against plain Python, on small tables and awkward rows."""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomrec.llm import oracles, queries
from tests.llm.test_operators import awkward, prose

PIECES, BYTES = "piece_bpe_32k.model", "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def rows():
    more = [(40, "New York ▁ ﬁ ▁x", "en", "a"), (41, "  two  spaces \n\n line\n\tTab <|endoftext|> <s> </s> ", "en", "a"), (42, "語" * 400 + " 漢字かな", "ja", None), (43, "é" * 5000, "", "")]
    return awkward() + more + [(50 + k, prose(k, 40), "en", "ab"[k % 2]) for k in range(12)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("clash") for c in ("row", "n_a", "pairs", "score", "term", "n", "class", "rare", "key", "word", "part", "_c0", "first")}).repartition(3)


@pytest.fixture
def tables(monkeypatch, docs):
    monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name: docs)


def same(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


# -- scores --------------------------------------------------------------------------------------------------------


def _marginal(word, logs, longest):
    """The log of the sum over all segmentations, position by position."""
    s = b" " + word
    total = [0.0] + [-math.inf] * len(s)
    for j in range(1, len(s) + 1):
        for i in range(max(0, j - longest), j):
            if s[i:j] in logs:
                total[j] = np.logaddexp(total[j], total[i] + logs[s[i:j]])
    return total[-1]


def _paths(s, logs, longest):
    """Every segmentation of s, as tuples of pieces."""
    if not s:
        yield ()
    for j in range(1, min(len(s), longest) + 1):
        if s[:j] in logs:
            for rest in _paths(s[j:], logs, longest):
                yield (s[:j], *rest)


def test_lattice_by_enumeration():
    from loomrec.llm.lattice import Lattice

    r = random.Random(1)
    pieces = sorted({b" ", b"a", b"b", b"c", b" a", b"ab", b"abc", b"bc", b" ab", b"ca", b"aaa"})
    w = np.asarray([r.random() for _ in pieces])
    logs = np.log(w / w.sum())
    by = dict(zip(pieces, logs))
    words = ["".join(r.choice("abc") for _ in range(r.randrange(0, 8))).encode() for _ in range(40)]
    lattice, expected = Lattice(pieces), np.zeros(len(pieces))
    for word, got in zip(words, lattice.marginals(words, logs)):
        paths = [(p, math.exp(sum(by[x] for x in p))) for p in _paths(b" " + word, by, 3)]
        whole = sum(x for _, x in paths)
        assert math.isclose(math.exp(got), whole, rel_tol=1e-12)
        for p, x in paths:
            for piece in p:
                expected[pieces.index(piece)] += x / whole
    assert np.allclose(lattice.expected(words, logs), expected)
    both = lattice.marginals(words, np.stack([logs, logs - 1]))
    assert np.allclose(both[:, 0], lattice.marginals(words, logs)) and (both[:, 1] < both[:, 0]).all()
    assert lattice.marginals([], logs).shape == (0,) and lattice.expected([], logs).sum() == 0


def test_lattice_adds_up():
    """Marginals of all words of up to nine letters nearly add up to 1 where pieces that begin a word are likely."""
    from itertools import product

    from loomrec.llm.lattice import Lattice

    pieces = [b" ", b" a", b"a", b"ab", b"b"]
    lattice = Lattice(pieces)
    words = ["".join(x).encode() for n in range(10) for x in product("ab", repeat=n)]
    total = np.exp(lattice.marginals(words, np.log([0.3, 0.4, 0.1, 0.1, 0.1]))).sum()
    assert 0.985 < total < 1.0


def _scores(rows, mu=30_000.0, nu=3000.0, prior=1000.0, rounds=2):
    """doc index -> (n_tokens, n_known, N, base, lattice, score), word by word and segmentation by segmentation."""
    from loomrec.llm.lattice import usable_pieces

    pieces, first = usable_pieces(queries.tokenizer_path(PIECES))
    longest = max(map(len, pieces))
    split = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for _, t, *_ in rows]
    split = [[w.encode() for w in re.findall("[^\x20\x09-\x0d]+", t)] for t in split]
    held = [None if d is None else zlib.crc32(str(d).encode()) % 7 == 2 for d, *_ in rows]
    name = [lang or "" for _, _, lang, _ in rows]
    train = [k for k, h in enumerate(held) if h is False]
    langs = [x for x, _ in sorted(Counter(name[k] for k in train).items(), key=lambda x: (-x[1], x[0]))] or [None]
    by = {x: Counter(w for k in train if name[k] == x for w in split[k]) for x in langs}
    ends = {x: sum(name[k] == x for k in train) for x in langs}
    c = sum(by.values(), Counter())
    n, v = sum(c.values()) + len(train), len(c) + bool(train)
    ones, twos = (sum(x == k for x in c.values()) for k in (1, 2))
    discount = ones / (ones + 2 * twos) if ones else 0.5
    weight = {x: first for x in langs}
    index = {p: i for i, p in enumerate(pieces)}
    for _ in range(rounds if train else 0):
        e = {}
        for x in langs:
            logs = {p: math.log(w) for p, w in zip(pieces, weight[x])}
            e[x] = np.zeros(len(pieces))
            for word in by[x]:
                s = b" " + word
                fw, bw = [0.0] + [-math.inf] * len(s), [-math.inf] * len(s) + [0.0]
                edges = [(i, j) for j in range(1, len(s) + 1) for i in range(max(0, j - longest), j) if s[i:j] in logs]
                for i, j in edges:
                    fw[j] = np.logaddexp(fw[j], fw[i] + logs[s[i:j]])
                for i, j in sorted(edges, key=lambda x: -x[0]):
                    bw[i] = np.logaddexp(bw[i], bw[j] + logs[s[i:j]])
                for i, j in edges:
                    e[x][index[s[i:j]]] += math.exp(fw[i] + logs[s[i:j]] + bw[j] - fw[-1])
        pooled = sum(e.values()) + prior * first
        weight = {x: (e[x] + prior * pooled / pooled.sum()) / (e[x].sum() + prior) for x in langs}
    logs = {x: {p: math.log(w) for p, w in zip(pieces, weight[x])} for x in langs}
    inside = {w: {x: _marginal(w, logs[x], longest) + math.log(0.99) for x in langs} for w in {w for s in split for w in s}}
    inside[b"\n"] = dict.fromkeys(langs, math.log(0.01))
    c[b"\n"] = len(train)
    for x in langs:
        by[x][b"\n"] = ends[x]
    sizes = {x: sum(by[x].values()) for x in langs}

    def log_p(w, x):
        pooled = inside[w][x]
        if n:
            own = math.log(max(c[w] - discount, 0) / n) if c[w] > discount else -math.inf
            pooled = np.logaddexp(own, math.log(discount * v / n) + pooled)
        own = math.log(by[x][w]) if by[x][w] else -math.inf
        return np.logaddexp(own, math.log(mu) + pooled) - math.log(sizes[x] + mu)

    out = []
    for s in split:
        s, totals = [*s, b"\n"], []
        for kind in ("lattice", "score"):
            each = []
            for x in langs:
                z, had = math.log((ends[x] + 1) / (sum(ends.values()) + len(langs))), Counter()
                for k, w in enumerate(s):
                    if kind == "lattice":
                        z += inside[w][x]
                    else:
                        p = log_p(w, x) + math.log(nu)
                        z += (math.log(had[w] + math.exp(p)) if had[w] else p) - math.log(k + nu)
                        had[w] += 1
                each.append(z)
            totals.append(float(np.logaddexp.reduce(each)) / math.log(10))
        out.append((len(s), sum(c[w] > 0 for w in s), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in s), *totals))
    return out


@pytest.mark.parametrize("least", [None, 3, 1 << 62])
def test_scores_awkward(spark, tables, rows, monkeypatch, least):
    """Whatever words go to every task, and whatever are joined."""
    from loomrec.llm.lm_scoring import Model

    if least is not None:
        monkeypatch.setattr(Model, "least_common", lambda self: least)
    got = queries.op11_lm_scoring(spark, "").collect()
    want = _scores(rows)
    assert len(got) == len(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["lattice_score"], r["score"]) for r in got), key=key)
    for g, w in zip(got, sorted(((r[0], *x) for r, x in zip(rows, want)), key=key)):
        assert g[:4] == w[:4] and np.allclose(g[4:], w[4:], rtol=1e-9), (g, w)


def test_scores_held_out(spark, sf_dir):
    """Held-out documents of known words are likelier than under the base, and spelled-out words than by the pieces alone."""
    out = queries.op11_lm_scoring(spark, sf_dir).where("held_out").collect()
    known = [r for r in out if r["n_known"] == r["n_tokens"]]
    assert all(r["score"] > r["base_score"] for r in known) and sum(r["score"] for r in out) > sum(r["lattice_score"] for r in out) + len(out)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)


def test_scores_without_training(spark, docs, monkeypatch):
    only = docs.where("doc_id = 43 or doc_id is null")  # nothing to learn from but row 43, if at all
    from loomrec.llm.lm_scoring import Model, score

    got = score(only, Model(only, F.lit(False), queries.tokenizer_path(PIECES))).collect()
    assert {(r["n_known"], r["train_tokens"], r["base_score"]) for r in got} == {(0, 0, 0.0)} and all(math.isfinite(r["score"]) for r in got)
    monkeypatch.setattr(queries, "table", lambda *_: docs.limit(0))
    assert queries.op11_lm_scoring(spark, "").collect() == []


# -- alignment -----------------------------------------------------------------------------------------------------


def _aligned(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    from loomrec.llm.token_alignment import _byte_level

    first, second = Tokenizer.from_file(queries.tokenizer_path(BYTES)), sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path(PIECES))
    first.encode_special_tokens = True
    spell_a = _byte_level(first).__getitem__

    def spell_b(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()

    count, each = Counter(), []
    for d, t, *_ in rows:
        sides = []
        for ids, spell in ((first.encode(" " + t, add_special_tokens=False).ids, spell_a), (second.encode(t), spell_b)) if t else ():
            ends = np.cumsum([len(spell(i)) for i in ids]).tolist()
            sides.append((ids, [0, *ends], b"".join(map(spell, ids))))
        if not t or any(x[2] != (" " + t).encode() for x in sides):
            each.append((d, 0, 0, 0, [], ""))
            continue
        common = sorted(set(sides[0][1][1:]) & set(sides[1][1][1:]))
        groups = [[[], []] for _ in common]
        for k, (ids, ends, _) in enumerate(sides):
            for i, s, e in zip(ids, ends, ends[1:]):
                groups[bisect.bisect_left(common, e)][k].append((i, s, e))
        links = [(x[0], y[0]) for a, b in groups for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        count.update(links)
        told = ";".join("|".join(",".join(str(x[0]) for x in side) for side in g) for g in groups)
        each.append((d, *(len(x[0]) for x in sides), len(common), links, hashlib.sha256(told.encode()).hexdigest()))
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(d, a, b, g, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), sha) for d, a, b, g, links, sha in each]


def test_alignment_small(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    same(queries.op12_token_alignment(spark, sf_dir).collect(), _aligned(docs))


@pytest.mark.parametrize(("part", "span", "fan"), [(1 << 16, 1 << 16, 16), (300, 64, 2), (5000, 7, 16), (1 << 16, 997, 3)])
def test_alignment_awkward(spark, docs, rows, part, span, fan):
    """Parts and byte ranges of any size give the same groups; a text without a cut is one part of many ranges."""
    from loomrec.llm.token_alignment import align

    short = [r for r in rows if len(r[1] or "") < 20_000] if part < 1 << 16 else rows
    df = docs.where("length(text) < 20000 or text is null") if part < 1 << 16 else docs
    same(align(df, queries.tokenizer_path(BYTES), queries.tokenizer_path(PIECES), part_bytes=part, range_bytes=span, fan_in=fan).collect(), _aligned(short))
    assert align(df.limit(0), queries.tokenizer_path(BYTES), queries.tokenizer_path(PIECES)).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_fragments_are_a_monoid(seed):
    """Cut tokens anywhere, compose the fragments in any order of brackets: always the fragment of the whole."""
    from loomrec.llm.token_alignment import Fragment, compose, fragment, whole

    r = random.Random(seed)
    n = 40
    a, b = ([(r.randrange(9), e) for e in sorted({*r.sample(range(1, n), r.randrange(3, 25)), n})] for _ in range(2))
    cuts = [0, *sorted(r.sample(range(1, n), 6)), n]
    parts = [fragment(*([t for t in x if lo < t[1] <= hi] for x in (a, b))) for lo, hi in zip(cuts, cuts[1:])]
    parts.insert(r.randrange(len(parts)), Fragment())

    def tree(some):
        if len(some) == 1:
            return some[0]
        k = r.randrange(1, len(some))
        return compose(tree(some[:k]), tree(some[k:]))

    want = fragment(a, b)
    for _ in range(5):
        assert tree(parts) == want
    done = whole(want)
    common = sorted({e for _, e in a} & {e for _, e in b})
    assert done.ok and (done.n_a, done.n_b, done.n_groups) == (len(a), len(b), len(common))
    starts = [dict(zip((e for _, e in x), [0, *(e for _, e in x)])) for x in (a, b)]
    assert done.n_links == sum(max(starts[0][e], starts[1][f]) < min(e, f) for _, e in a for _, f in b)


# -- sources -------------------------------------------------------------------------------------------------------


def _sql(df):
    con = duckdb.connect()
    con.register("documents", df.toPandas()[["doc_id", "text", "lang", "source"]])
    return con.sql(oracles.ORACLES["op13_source_divergence"]).fetchall()


def _audited(rows, least=10, ranks=10):
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", fold(t))) for _, t, lang, source in rows]
    out = []
    for lang in {x for x, *_ in docs}:
        mine = [(s, w) for x, s, w in docs if x == lang]
        seen = Counter(t for _, w in mine for t in set(w))
        kept = sorted((t for t, n in seen.items() if n >= least), key=str.encode)
        count = {s: Counter(t for z, w in mine if z == s for t in w if seen[t] >= least) for s in {s for s, _ in mine}}
        every = sum(count.values(), Counter())
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        q, p = share(every), {s: share(c) for s, c in count.items()}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in count:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in count if o != s))
            top = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if count[s][t] and p[s][t] > q[t])[:ranks]
            out += [(lang, s, part, i.decode(), -v, k) for part, some in (("pair", pairs), ("term", top)) for k, (v, i) in enumerate(some, 1)]
    return out


def test_audit_small(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    want = _audited([tuple(r) for r in df.collect()])
    same(queries.op13_source_divergence(spark, sf_dir).collect(), want)
    same(_sql(df), want)


@pytest.mark.parametrize("least", [1, 3, 10, 1000])
def test_audit_awkward(spark, docs, rows, least):
    """Ties beyond the last rank, groups without terms, no kept terms at all, null languages and sources."""
    from loomrec.llm.source_divergence import audit

    same(audit(docs, least).collect(), _audited(rows, least))
    assert audit(docs.limit(0)).collect() == []


def test_audit_flushes(spark, docs, rows):
    """Counts that leave a task in parts add up."""
    from loomrec.llm.source_divergence import counted

    many, few = (sorted(map(tuple, counted(docs, flush).collect()), key=repr) for flush in (1, 1 << 30))
    assert many == few


def test_shares_are_exact(spark):
    """Counts whose product with a billion has no place in 64 bits."""
    from loomrec.llm.source_divergence import share

    for c, n, v in [(0, 0, 1), (10**13, 10**14 + 3, 10**9), (9_223_372_036, 9_223_372_037, 7), (5, 10, 3)]:
        got = spark.createDataFrame([(c, n, v)], "c long, n long, v long").select(share(F.col("c"), F.col("n"), F.col("v"))).first()[0]
        assert got == 1 + 1_000_000_000 * (c + 2) // (n + 2 * v)
