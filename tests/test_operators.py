"""Operators on small literal tables with known results."""

from __future__ import annotations

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from loomrec.functions.columns import cosine
from loomrec.operators import context, facets, graph, leakage, memory, metrics, pruning, records, rerank, rewards, sampling
from loomrec.operators import sequences as seq
from loomrec.sources import tables
from loomrec.streaming import incremental

def _answer(*entries, **fields) -> str:
    return json.dumps({"facets": list(entries)} | fields)


TRAINS = {"facet": "night trains", "confidence": 0.75, "supporting_neighbors": ["User-12", "Item-340"]}
GOOD = _answer(TRAINS)
#: Kinds of damage: completion, facet texts read from it, whether it counts as well-formed.
DAMAGE = {
    # Nothing to read.
    "nothing": (None, [], False),
    "blank": (" \n", [], False),
    "refusal": ("There is too little here to say what this reader wants; ask again later.", [], False),
    "numbers": ("[1, 2, 3]", [], False),
    # Wrapped.
    "talk on both sides": (f"Reading the log gives\n{GOOD}\nwhich is all I can see.", ["night trains"], True),
    "fenced": (f"~\n```JSON\n{GOOD}\n```\n~", ["night trains"], True),
    "bare fence": (f"```{GOOD}```", ["night trains"], True),
    # Other shapes.
    "top-level list": (json.dumps([TRAINS, {"facet": "slow travel"}]), ["night trains", "slow travel"], True),
    "keyed by number": (json.dumps({"facets": {"a": TRAINS, "b": {"facet": "maps"}}}), ["night trains", "maps"], True),
    "plain texts": (_answer("ferries", "harbours"), ["ferries", "harbours"], True),
    "other names": (json.dumps({"preferences": [{"description": "alpine huts", "score": 0.3, "evidence": ["i_5"]}]}), ["alpine huts"], True),
    "half usable": (_answer(TRAINS, {"confidence": 1}, 7, {"facet": " "}), ["night trains"], True),
    # Other values.
    "share": (_answer({"facet": "tides", "confidence": "40 %"}), ["tides"], True),
    "digits as text": (_answer({"facet": "tides", "confidence": "about .25"}), ["tides"], True),
    "far too sure": (_answer({"facet": "tides", "confidence": 42}), ["tides"], True),
    "below zero": (_answer({"facet": "tides", "confidence": -3}), ["tides"], True),
    "not sure": (_answer({"facet": "tides"}), ["tides"], True),
    "neighbours in one text": (_answer({"facet": "tides", "supporting_neighbors": "user 8; Item-0031, nobody"}), ["tides"], True),
    # Broken JSON.
    "commas too many": ('{"facets": [{"facet": "lighthouses", "confidence": 0.2,}, ], }', ["lighthouses"], True),
    "apostrophes": ("{'facets': [{'facet': 'lighthouses', 'confidence': 0.2}]}", ["lighthouses"], True),
    "typeset quotes": ("{\u201cfacets\u201d: [{\u201cfacet\u201d: \u201clighthouses\u201d}]}", ["lighthouses"], True),
    "ends too soon": (GOOD[:-2] + ', {"facet": "canals", "conf', ["night trains"], False),
}


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in DAMAGE.items()] + [("good", GOOD)], "req_id string, completion string")
    return {r["req_id"]: r for r in facets.parse_facets(df).collect()}


@pytest.mark.parametrize("kind", DAMAGE)
def test_damaged_completions(parsed, kind):
    _, want, valid = DAMAGE[kind]
    assert [f["facet"] for f in parsed[kind]["facets"]] == want and parsed[kind]["valid"] == valid


def test_facet_values(parsed):
    assert parsed["good"]["facets"][0].asDict() == TRAINS
    sure = {k: parsed[k]["facets"][0]["confidence"] for k in ("share", "digits as text", "far too sure", "below zero", "not sure", "other names")}
    assert sure == {"share": 0.4, "digits as text": 0.25, "far too sure": 1.0, "below zero": 0.0, "not sure": 0.5, "other names": 0.3}
    assert parsed["neighbours in one text"]["cited"] == ["User-8", "Item-31"] and parsed["other names"]["cited"] == ["Item-5"]
    assert parsed["ends too soon"]["truncated"] and parsed["half usable"]["dropped"] == 3


def test_repeated_facets_count_each(spark):
    rows = [(1, "a b", 0.5), (1, "a b", 0.5), (1, "c", 1.0), (2, "a b", 0.5), (2, "c", 1.0)]
    got = {(r["user_id"], r["dim"]): r["value"] for r in facets.facet_vectors(spark.createDataFrame(rows, "user_id long, facet string, confidence double")).collect()}
    dim = {w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64 for w in "abc"}
    assert len(set(dim.values())) == 3
    for u, times in ((1, 2), (2, 1)):
        v = {"a": times * 0.5 / math.sqrt(2), "b": times * 0.5 / math.sqrt(2), "c": 1.0}
        norm = math.sqrt(sum(x * x for x in v.values()))
        assert all(abs(got[u, dim[w]] - x / norm) < 1e-9 for w, x in v.items())


def test_facet_limits_and_whitelist(spark):
    many = json.dumps({"facets": [{"facet": "x" * 5000, "confidence": 0.5, "supporting_neighbors": ["Item-1", "Item-9999"]}] * 12})
    df = spark.createDataFrame([("a", many, ["Item-1"]), ("b", f"```{many}```", ["Item-1"])], "req_id string, completion string, allowed array<string>")
    for r in facets.parse_facets(df, allowed="allowed").collect():
        assert len(r["facets"]) == 7 and len(r["facets"][0]["facet"]) == 400
        assert r["facets"][0]["supporting_neighbors"] == ["Item-1"] and r["cited"] == ["Item-1", "Item-9999"]


def test_node_forms(spark):
    forms = {"Item-123": "Item-123", "item-123": "Item-123", "USER-7": "User-7", "u_4412": "User-4412", "i_88301": "Item-88301", "[Item-42]": "Item-42", "Item 42": "Item-42", "Item-007": "Item-7", "123": None, "": None, "Book-3": None}
    got = spark.createDataFrame([(k,) for k in forms], "k string").select("k", facets.node(F.col("k")).alias("n")).collect()
    assert {r["k"]: r["n"] for r in got} == forms
    assert {k: facets._node(k) for k in forms} == forms


def test_metrics(spark):
    rows = spark.createDataFrame([(g, list(range(10, 101, 10))) for g in (10, 20, 30, 40, 50, 60, 100, 999)], "gold int, ranking array<int>")
    at = metrics.rank_of(F.col("ranking"), F.col("gold"))
    got = {r["gold"]: r for r in rows.select("gold", at.alias("r"), metrics.ndcg(at, 5).alias("n5"), metrics.ndcg(at, 10).alias("n10"), metrics.hit(at, 1).alias("h1"), metrics.hit(at, 3).alias("h3")).collect()}
    want = {10: 1.0, 20: 1 / math.log2(3), 30: 0.5, 40: 1 / math.log2(5), 50: 1 / math.log2(6), 60: 0, 100: 0, 999: 0}
    assert all(abs(got[g]["n5"] - v) < 1e-12 for g, v in want.items()) and abs(got[60]["n10"] - 1 / math.log2(7)) < 1e-12
    assert got[100]["r"] == 9 and got[999]["r"] is None and (got[10]["h1"], got[20]["h1"], got[30]["h3"], got[40]["h3"]) == (1, 0, 1, 0)
    with pytest.raises(ValueError):
        metrics.hit(at, 0)


def test_missing_users(spark):
    gold = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "user_id long, gold long")
    ranked = spark.createDataFrame([(1, 5, 0), (2, 9, 0)], "user_id long, item_id long, pos int")
    got = lambda how: {r["user_id"]: r["pos"] for r in metrics.target_positions(gold, ranked, 10, how).collect()}
    assert got("miss") == {1: 0, 2: 10, 3: 10} and got("skip") == {1: 0, 2: 10}


@pytest.fixture(scope="module")
def bag(spark):
    """Random bags with repeats: (user, ordered items)."""
    r = random.Random(4)
    lists = {u: [r.randrange(12) for _ in range(r.randrange(1, 14))] for u in range(25)}
    rows = [(u, i, p, len(v)) for u, v in lists.items() for p, i in enumerate(v)]
    return lists, seq.leave_one_out(spark.createDataFrame(rows, "user_id long, item_id long, pos int, n long"))


def test_neighbors_over_an_item_of_all(spark):
    """An item that every user has, others that most have, and few besides: with hot items, with blocks, with neither."""
    r = random.Random(8)
    rows = []
    for u in range(70):
        bag = [0] + [i for i in (1, 2) if r.random() < 0.7] + [0] * (r.random() < 0.2) + [r.randrange(3, 40) for _ in range(r.randrange(4))]
        r.shuffle(bag)
        rows += [(u, i, p) for p, i in enumerate(bag)]
    edges = spark.createDataFrame(rows, "user_id long, item_id long, pos int")
    has = {}
    for u, i, p in rows:
        has.setdefault(u, {}).setdefault(i, []).append(p)
    want = []
    for u, mine in has.items():
        seen = []
        for o, other in has.items():
            both = [i for i in mine if i in other]
            if o != u and both:
                seen.append((-sum(len(mine[i]) * len(other[i]) for i in both), min(min(mine[i]) for i in both), o))
        want += [(u, o, -n, k) for k, (n, _, o) in enumerate(sorted(seen)[:6], 1)]
    for hot, n, block, light in ((10, 3, 4096, 512), (10, 1, 4096, 1), (10, 2, 7, 2), (1000, 8, 16, 3), (1000, 8, 4096, 512)):
        got = graph.user_neighbors(edges, 6, hot_degree=hot, hot_items=n, block=block, light_degree=light).collect()
        assert sorted(map(tuple, got)) == sorted(want), (hot, n, block, light)
    assert graph.user_neighbors(edges.limit(0)).count() == 0


def test_neighbor_search_ends(spark, monkeypatch):
    """Users who share rare items meet few others over an item that all have: far fewer pairs than d^2, and the same neighbours."""
    r = random.Random(4)
    rows = []
    for u in range(400):
        team = u // 8  # eight users who share five rare items, some of them twice
        items = [1000 + 10 * team + k for k in range(5)] + [1000 + 10 * team + r.randrange(5)] + [r.randrange(3)] + [7] * (u % 40 == 0)
        rows += [(u, i, p) for p, i in enumerate(items)]
    edges = spark.createDataFrame(rows, "user_id long, item_id long, pos int")
    made, plain = [], graph._pairs

    def counted(mine, other, degrees, block):
        made.append(mine.select("item_id").join(other.select("item_id"), "item_id").count())
        return plain(mine, other, degrees, block)

    monkeypatch.setattr(graph, "_pairs", counted)
    every = sorted(map(tuple, graph.user_neighbors(edges, 5).collect()))
    whole = sum(made)
    made.clear()
    assert sorted(map(tuple, graph.user_neighbors(edges, 5, light_degree=16).collect())) == every
    assert sum(made) < 0.3 * whole and len(made) > 1
    made.clear()
    assert sorted(map(tuple, graph.user_neighbors(edges, 5, light_degree=16, hot_degree=130, hot_items=1).collect())) == every


def test_split_and_neighbors(bag):
    lists, split = bag
    train = {u: v[:-2] for u, v in lists.items() if len(v) >= 3}
    edges = seq.train_edges(split)
    got = {}
    for r in graph.user_neighbors(edges, 10).collect():
        got.setdefault(r["user_id"], {})[r["ord"]] = (r["neighbor_id"], r["overlap"])
    for u, v in train.items():
        overlap = {}
        for i in v:
            for o, w in train.items():
                for j in w:
                    if o != u and i == j:
                        overlap[o] = overlap.get(o, 0) + 1
        first = {o: min(p for p, i in enumerate(v) if i in train[o]) for o in overlap}
        want = sorted(overlap.items(), key=lambda x: (-x[1], first[x[0]], x[0]))[:10]
        assert [got.get(u, {})[k + 1] for k in range(len(want))] == want
    late = {(r["user_id"], r["item_id"]): r["recency"] for r in edges.collect()}
    assert all(late[u, i] == max(p + 1 for p, x in enumerate(v) if x == i) / len(v) for u, v in train.items() for i in v)


def test_mix_keeps_minima_and_size(bag):
    for rows in (pruning.top_neighbors(seq.train_edges(bag[1]), k=8, min_items=3, min_users=2), pruning.top_neighbors(seq.train_edges(bag[1]), "rules", "yelp", k=8, min_items=3, min_users=2)):
        by = {}
        for r in rows.collect():
            by.setdefault(r["user_id"], []).append(r)
        for u, held in by.items():
            assert len(held) <= 8 and sorted(r["ord"] for r in held) == list(range(1, len(held) + 1))
            if len(held) == 8:
                assert sum(r["nb_type"] == "item" for r in held) >= min(3, len(set(bag[0][u][:-2]))) and sum(r["nb_type"] == "user" for r in held) >= 2


def test_rule_names():
    assert [pruning.rule_name(x) for x in ("Books", "amazon-yelp-2018", "unknown", "movie")] == ["books", "yelp", "books", "movietv"]


def test_candidates(spark):
    users = spark.createDataFrame([(u, 42) for u in range(200)] + [(900, 1)], "user_id long, target long")
    mine = spark.createDataFrame([(900, i) for i in range(2000) if i % 250], "user_id long, item_id long")
    one, two = (sampling.candidates(users, mine, 2000, 10, 42, s).collect() for s in (0, 1))
    again = sampling.candidates(users.repartition(7), mine, 2000, 10, 42, 0).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, again))
    lists = {}
    for r in one:
        lists.setdefault(r["user_id"], {})[r["pos"]] = r["item_id"]
    other = {}
    for r in two:
        other.setdefault(r["user_id"], set()).add(r["item_id"])
    assert 900 not in lists and len(lists) == 200  # a pool of eight is too small
    for u, v in lists.items():
        assert len(set(v.values())) == 10 and list(v.values()).count(42) == 1 and len(set(v.values()) & other[u] - {42}) <= 2
    assert len({next(p for p, i in v.items() if i == 42) for v in lists.values()}) > 5 and lists[7] != lists[8]
    short = sampling.negatives(users.where("user_id = 900"), mine, 2000, 12, 42, on_short="repeat").collect()
    assert len(short) == 12 and {r["item_id"] for r in short} == {i for i in range(2000) if i % 250 == 0}


def test_user_splits(spark):
    users = spark.range(50).withColumnRenamed("id", "user_id")
    parts = sampling.user_splits(users, users.where("user_id < 5"), 20, 5, 42)
    assert {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()} == {"train": 20, "val": 5, "test": 5}
    assert sampling.overlapping_users(parts).count() == 0
    with pytest.raises(ValueError):
        sampling.user_splits(users, users.limit(0), 100, 50, 42)
    assert sampling.checked_splits(parts).count() == 30
    for bad in (parts.where("part <> 'val'"), parts.unionByName(parts.limit(1))):
        with pytest.raises(ValueError):
            sampling.checked_splits(bad)
    ring = {r["user_id"]: r["partner_id"] for r in sampling.shuffled_partner(users).collect()}
    assert ring == {u: (u + 1) % 50 for u in range(50)}


def test_weighted_draws_follow_popularity(spark):
    edges = spark.createDataFrame([(u, 0, u) for u in range(90)] + [(u, 1, u) for u in range(10)], "user_id long, item_id long, pos int")
    users = spark.range(1000, 1400).withColumnRenamed("id", "user_id")
    first = sampling.weighted_negatives(users, edges, edges.limit(0), 1, 42).groupBy("item_id").count().collect()
    assert abs({r["item_id"]: r["count"] for r in first}[0] - 360) < 30


def test_weighted_draws_are_whole(spark):
    # Item 0 holds nearly all edges; user 1 has it and all but two drawn items, user 2 all but one item, user 3 every item.
    edges = spark.createDataFrame([(9, 0, k) for k in range(5000)] + [(9, i, 5000 + i) for i in range(1, 8)], "user_id long, item_id long, pos int")
    mine = spark.createDataFrame([(1, i) for i in range(6)] + [(2, i) for i in range(11)] + [(3, i) for i in range(12)], "user_id long, item_id long")
    users = spark.createDataFrame([(1,), (2,), (3,), (4,)], "user_id long")
    got = sorted(map(tuple, sampling.weighted_negatives(users, edges, mine, 5, 42, n_items=12).collect()), key=lambda r: (r[0], r[2]))
    assert [r[0] for r in got] == [u for u in (1, 2, 3, 4) for _ in range(5)] and [r[2] for r in got] == [1, 2, 3, 4, 5] * 4
    drawn = {u: [r[1] for r in got if r[0] == u] for u in (1, 2, 3, 4)}
    assert set(drawn[1][:2]) == {6, 7} and len(set(drawn[1])) == 5 and set(drawn[1]) <= set(range(6, 12))
    assert drawn[2] == [11] * 5 and drawn[3] == [0] * 5
    assert drawn[4][0] == 0 and len(set(drawn[4])) == 5 and set(drawn[4]) <= set(range(8))
    flat = sampling.weighted_negatives(users, edges.limit(0), mine, 5, 42, n_items=12).where("user_id = 4").collect()
    assert len({r["item_id"] for r in flat}) == 5


def test_weighted_draws_beside_a_dominant_item(spark, monkeypatch):
    """An item of 99.9 % of the edges: nobody walks through all items, and the others are drawn by their weights."""
    edges = [(0, 0, k) for k in range(400_000)] + [(1, i, i) for i in range(1, 200)] + [(1, 7, k) for k in range(200)]
    edges = spark.createDataFrame([(u, i) for u, i, _ in edges[:1]] + [(u, i) for u, i, _ in edges[400_000:]], "user_id long, item_id long").unionByName(spark.range(399_999).select(F.lit(0).cast("long").alias("user_id"), F.lit(0).cast("long").alias("item_id")))
    users = spark.range(1000, 1300).withColumnRenamed("id", "user_id")
    mine = users.where("user_id % 2 = 0").select("user_id", F.lit(0).cast("long").alias("item_id"))
    listed, plain = [], sampling.all_others
    monkeypatch.setattr(sampling, "all_others", lambda *x: listed.append(x) or plain(*x))
    got = sampling.weighted_negatives(users, edges, mine, 5, 42, n_items=2000).collect()
    assert listed == [] and len(got) == 1500 and len({(r["user_id"], r["item_id"]) for r in got}) == 1500
    first = {r["user_id"]: r["item_id"] for r in got if r["nth"] == 1}
    assert all(i == 0 for u, i in first.items() if u % 2) and all(i for u, i in first.items() if u % 2 == 0)
    # Item 7 weighs as much as the other 198 together: about half of the first draws where item 0 is out.
    assert abs(sum(i == 7 for u, i in first.items() if u % 2 == 0) - 75) < 25
    again = sampling.weighted_negatives(users.repartition(3), edges, mine, 5, 42, n_items=2000).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_overlap_by_sets(spark):
    r = random.Random(8)
    edges = {(r.choice([r.randrange(40), 10**12 + r.randrange(40)]), r.randrange(12)) for _ in range(200)}
    near, asked = [[(u, i) for u in range(6) for i in r.sample(range(14), 4)] for _ in range(2)]
    frame = lambda rows: spark.createDataFrame(list(rows), "user_id long, item_id long")
    by = {i: {u for u, j in edges if j == i} for i in range(14)}
    want = sorted((u, i, max(len(by[i] & by[c]) for v, c in asked if v == u) / len(by[i]) if by[i] else 0.0) for u, i in near)
    for block in (4, 8192):
        assert sorted(map(tuple, graph.candidate_overlap(frame(edges), frame(near), frame(asked), block).collect())) == want


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_passages_within_texts(spark, monkeypatch, most):
    """The same hits whether passages go to every task or are joined."""
    monkeypatch.setattr(leakage, "MOST_PASSAGES", most)
    texts = [(1, "It says: Alpha beta, gamma delta. Epsilon!"), (2, "prealpha beta gamma deltapost"), (3, "nothing here"), (4, None), (5, "one two"), (6, "xone two"), (7, "a " * 50)]
    passages = [(1, "alpha beta gamma delta"), (2, "Beta Gamma"), (3, "one"), (4, ""), (5, "one two three"), (6, " ".join("a" * 20))]
    got = leakage.contained_passages(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(passages, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (1, 2), (2, 1), (2, 2), (5, 3), (7, 6)]


def test_every_train_edge_has_a_negative(spark):
    edges = spark.createDataFrame([(1, i, i) for i in range(90)] + [(2, i, i) for i in range(100)] + [(3, 5, 0)], "user_id long, item_id long, pos int")
    got = sampling.bpr_triples(edges, edges, 100, 42).collect()
    assert sorted((r["user_id"], r["pos_item"], r["pos"]) for r in got) == sorted(map(tuple, edges.collect()))
    drawn = {u: {r["neg_item"] for r in got if r["user_id"] == u} for u in (1, 2, 3)}
    assert drawn[1] == set(range(90, 100)) and drawn[2] == {0} and drawn[3] != {5}
    again = sampling.bpr_triples(edges.repartition(5), edges, 100, 42).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_budgeted_pack(spark):
    r = random.Random(0)
    rows = [(u, k, r.choice([1.0, 2.0, 3.0]), "x" * r.randrange(0, 300)) for u in range(50) for k in range(20)]
    df = spark.createDataFrame(rows, "user_id long, ord int, score double, snippet string")
    got = {}
    for x in context.packed(df, 400).collect():
        got.setdefault(x["user_id"], set()).add(x["ord"])
    for u in range(50):
        total, want = 0, set()
        for _, k, _, s in sorted((x for x in rows if x[0] == u), key=lambda x: (-x[2], x[1])):
            if total + len(s) // 4 > 400:
                break
            total += len(s) // 4
            want.add(k)
        assert got.get(u, set()) == want
    assert context.budget(1800, True) == context.budget(1500, False) == 700


def test_snippets_read_back(spark):
    text = "Neighbors:\n1. [Item-144648] The Undertaking of Tess | ['a tender comedy'] (score=1.000)\n2. [User-6902] (overlap_score=0.500) - Recent: Dune, Neuromancer"
    df = spark.createDataFrame([(1, text), (2, ""), (3, context.NONE), (4, None)], "user_id long, text string")
    got = {r["user_id"]: r["snippets"] for r in context.parsed_snippets(df).collect()}
    assert set(got[1]) == {"Item-144648", "User-6902"} and got[2] == got[3] == got[4] == {}
    twice = spark.createDataFrame([(1, "1. [Item-5] old\n2. [User-1] b\n3. [Item-5] new")], "user_id long, text string")
    assert context.parsed_snippets(twice).first()["snippets"] == {"Item-5": "new", "User-1": "b"}


def test_ranker(spark):
    df = spark.createDataFrame([(1, i, p, v) for p, (i, v) in enumerate([(1, 0.0), (2, 5.0), (3, 1.0)])], "req_id long, item_id long, pos int, logit double")
    got = rerank.softmax_rank(df).orderBy("rank").collect()
    assert [r["item_id"] for r in got] == [2, 3, 1] and abs(sum(r["prob"] for r in got) - 1) < 1e-12
    p = spark.range(50).select(F.concat(F.lit("prompt "), "id").alias("p"), F.col("id").alias("i"))
    for r in p.select("p", "i", rerank.pseudo_logit(F.col("p"), F.col("i")).alias("x")).collect():
        want = (int.from_bytes(hashlib.sha256(f"{r['p']}|{r['i']}".encode()).digest()[:8], "big") / 2**64 - 0.5) * 8
        assert abs(r["x"] - want) < 1e-9


def test_choice_prompt(spark):
    rows = spark.createDataFrame([(1, k, f"Book {101 + k}", None, [], None) for k in range(10)], "req_id long, pos int, title string, memory string, facets array<string>, instruction string")
    text = context.choice_prompt(rows).first()["prompt"]
    assert [x.split(". ")[0] for x in text.split("\n")[1:11]] == list("ABCDEFGHIJ") and "Preferences" not in text
    many = spark.createDataFrame([(1, k, f"Book {k}", None, [], None) for k in range(60)], "req_id long, pos int, title string, memory string, facets array<string>, instruction string")
    told = [x.split(". ")[0] for x in context.choice_prompt(many).first()["prompt"].split("\n")[1:61]]
    assert told[25:29] == ["Z", "AA", "AB", "AC"] and told[51:53] == ["AZ", "BA"] and len(set(told)) == 60


def test_records_of_repeated_rows(spark):
    """Items and memories that come in several rows, and an item that is listed twice."""
    states = spark.createDataFrame([(1, "m", "1. [Item-5] x", ["Item-5"], 3)], "user_id long, user_memory string, neighbors_text string, neighbor_ids array<string>, n_train_items int")
    cand = spark.createDataFrame([(1, 7, 1, True), (1, 8, 0, False), (1, 7, 3, False)], "user_id long, item_id long, pos int, is_target boolean")
    about = spark.createDataFrame([(7, "B"), (7, "A"), (8, None)], "item_id long, title string")
    mem = spark.createDataFrame([("item", 7, "new", 5), ("item", 7, "old", 2), ("user", 1, "x", 1)], "entity_type string, entity_id long, memory string, seq long")
    maps = spark.createDataFrame([(1, {"Item-5": "x"})], "user_id long, snippets map<string,string>")
    got = records.records(states, context.policy_prompt(states), cand, about, mem, spark.createDataFrame([(1, "ask")], "user_id long, instruction string"), maps).collect()
    assert len(got) == 1 and got[0]["candidates"] == [8, 7] and got[0]["gold_item_id"] == 7
    assert got[0]["candidate_titles"] == {"7": "A", "8": "N/A"} and got[0]["candidate_memories"] == {"7": "new"} and got[0]["neighbor_snippets"] == {"Item-5": "x"}


def test_splits_round_trip(spark, tmp_path):
    parts = spark.createDataFrame([(u, "train" if u % 3 else "test") for u in range(50)], "user_id long, part string")
    tables.write_splits(parts.repartition(4), f"{tmp_path}/splits")
    assert sorted(map(tuple, tables.read_splits(spark, f"{tmp_path}/splits").collect())) == sorted(map(tuple, parts.collect()))


SNIPPETS = [("Item-1", "epic fantasy dragons quest"), ("Item-2", "french cooking recipes kitchen"), ("User-3", "space opera starships")]


@pytest.mark.parametrize("facet,cited,n,score,made_up", [
    ("epic fantasy dragons", ["Item-1"], 1, 1.0, []), ("french cooking recipes", ["Item-1"], 1, 0.0, []), ("epic fantasy", ["Item-9999"], 1, 0.0, ["Item-9999"]),
    ("epic fantasy dragons", ["Item-2", "Item-1"], 1, 1.0, []), ("epic fantasy dragons", ["Item-1"], 7, 1 / 7, []), ("epic fantasy dragons", [], 1, 0.0, []),
])
def test_grounding(spark, facet, cited, n, score, made_up):
    f = spark.createDataFrame([(1, 0, facet, cited)], "req_id long, nth int, facet string, cited array<string>")
    s = spark.createDataFrame([(1, *x) for x in SNIPPETS], "req_id long, node string, snippet string")
    r = rewards.word_grounding(f, s, n).first()
    assert abs(r["grounding"] - score) < 1e-12 and r["hallucinated"] == made_up


def test_cosine(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 1.0]), ([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, 0.0]


def test_composite(spark):
    ranking = list(range(101, 111))
    rows = [("good", "x" * 400, True, ranking, 103, 0.3, 1.0, 0.1), ("long", "x" * 2400, True, ranking, 103, 0.3, 1.0, None), ("prose", "no", False, ranking, 103, 0.3, None, 0.9), ("none", None, None, None, 103, None, None, None)]
    df = spark.createDataFrame(rows, "req_id string, completion string, valid boolean, ranking array<long>, gold long, p_gold double, grounding double, null_ndcg double")
    got = {r["req_id"]: r for r in rewards.composite(df).collect()}
    assert abs(got["good"]["total"] - 0.7) < 1e-12 and got["good"]["beats_null"] and abs(got["long"]["len_penalty"] - 0.2) < 1e-12
    assert got["prose"]["fmt_penalty"] == 1.0 and got["prose"]["beats_null"] is False and got["long"]["beats_null"] is None and got["none"]["total"] == -1.0
    assert abs(rewards.composite(df, soft_weight=0.3).where("req_id = 'good'").first()["soft"] - 0.09) < 1e-12
    with pytest.raises(ValueError, match="gold_item_id"):
        rewards.check_columns(df)


@pytest.mark.parametrize("values,rate", [([1, 1, 1, 1], 1.0), ([1, 2, 3, 4], 0.0), ([1, 1, 3, 4], 0.5), ([1], 0.0)])
def test_tie_rate(spark, values, rate):
    assert rewards.tie_rate(spark.createDataFrame([(float(v),) for v in values], "v double"), "v").first()["tie_rate"] == rate


@pytest.mark.parametrize("x,y,rho", [([1, 2, 3, 4], [10, 20, 30, 40], 1), ([1, 2, 3, 4], [40, 30, 20, 10], -1), ([1, 2, 3, 4], [1, 10, 1000, 100000], 1), ([1, 2, 2, 3], [1, 2, 3, 4], 0.9486832980505138), ([1, 1, 1], [1, 2, 3], None), ([1], [1], None)])
def test_spearman(spark, x, y, rho):
    got = rewards.spearman(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double"), "x", "y").first()["rho"]
    assert math.isnan(got) if rho is None else abs(got - rho) < 1e-12


@pytest.mark.parametrize("means,passes", [((0.60, 0.45, 0.38, 0.37), True), ((0.7204, 0.6090, 0.6079, 0.6092), True), ((0.40, 0.41, 0.40, 0.40), False), ((0.605, 0.600, 0.599, 0.600), False), ((0.6, 0.4, 0.3), False)])
def test_gate(spark, means, passes):
    df = spark.createDataFrame(list(zip(("sample1", "shuffled", "lorem", "empty"), means)), "arm string, ndcg_at_5 double")
    assert rewards.arm_gate(df).first()["passes"] == passes


def test_leaks(spark):
    title = "The Undertaking of Tess and Others"
    rows = [(1, "see Item-21254", 2125, [2125, 7], title), (2, "see Item-2125 here", 2125, [2125, 7], title), (3, "Item-7", 2125, [2125, 7], title), (4, "He read: the undertaking, of TESS and others!", 2125, [2125, 7], title), (5, "dune", 2125, [2125], "Dune")]
    df = spark.createDataFrame(rows, "user_id long, prompt string, gold_item_id long, candidates array<long>, gold_title string")
    assert {r["user_id"]: r["reason"] for r in leakage.leak_reason(df).collect()} == {1: None, 2: "gold id", 3: "candidate id", 4: "gold title", 5: None}
    kept, dropped = leakage.screened(df)
    assert (kept.count(), dropped.count()) == (2, 3)


def test_memory(spark):
    rows = [("user", 1, " first ", 1), ("user", 1, "second", 3), ("user", 1, "  ", 4), ("user", 1, "late", 2), ("item", 0, "zero", 1)]
    df = spark.createDataFrame(rows, "entity_type string, entity_id long, memory string, seq long")
    assert {(r["entity_type"], r["entity_id"]): (r["memory"], r["n_updates"]) for r in memory.compacted(df).collect()} == {("user", 1): ("second", 3), ("item", 0): ("zero", 1)}
    items = spark.createDataFrame([(1, "T", "about"), (2, "T", "nan"), (3, None, None), (4, "T", "x")], "item_id long, title string, description string")
    got = {r["item_id"]: r["memory"] for r in memory.initial_item_memories(items, items.where("item_id = 4")).collect()}
    assert got == {1: "T. about", 2: "T", 3: "Item-3"}
    answers = spark.createDataFrame([(1, 5, 0, "me", "it", [("Item-3", "n"), ("Item-99", "unknown"), ("User-2", " ")])], "user_id long, seq long, item_id long, user_memory string, item_memory string, neighbor_updates array<struct<neighbor_id:string,memory_update:string>>")
    asked = spark.createDataFrame([(1, 5, 0), (2, 5, 0)], "user_id long, seq long, item_id long")
    given = answers.select("user_id", "user_memory", "item_memory", "neighbor_updates")
    told = {r["user_id"]: (r["failed"], r["user_memory"], len(r["neighbor_updates"])) for r in memory.write_responses(asked, given).collect()}
    assert told == {1: (False, "me", 3), 2: (True, "", 0)}
    assert memory.user_lookup(asked.where("user_id = 1"), given).count() == 1
    with pytest.raises(KeyError, match="2"):
        memory.user_lookup(asked, given)
    known = spark.createDataFrame([(1, "item", 3), (1, "user", 2)], "user_id long, nb_type string, nb_id long")
    assert sorted((r["entity_type"], r["entity_id"]) for r in memory.patches(answers, known).collect()) == [("item", 0), ("item", 3), ("user", 1)]


PATCH = "entity_type string, entity_id long, memory string, seq long"


def _versions(path):
    return {int(b.name[7:]): sorted(int(v.parent.name[8:]) for v in path.glob(f"version=*/{b.name}")) for b in path.glob("version=*/bucket=*")}


def test_patch_stream(spark, tmp_path):
    """Batches rewrite the buckets that they touch, repeated patches count once, and the rest stays as it was."""
    run = lambda: incremental.upsert_patches(spark.readStream.schema(PATCH).parquet(f"{tmp_path}/in"), f"{tmp_path}/kept", f"{tmp_path}/state", buckets=16).awaitTermination()
    log = [("user", k, f"m{k}", 1) for k in range(40)] + [("user", 1, " ", 9), ("item", 1, "i", 3)]
    spark.createDataFrame(log, PATCH).write.parquet(f"{tmp_path}/in")
    run()
    more = [("user", 1, "b", 2), ("user", 1, "old", 0), ("user", 1, "m1", 1), ("user", 1, "b", 2)]
    spark.createDataFrame(more, PATCH).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    log += more
    want = {tuple(r) for r in memory.compacted(spark.createDataFrame(log, PATCH).distinct()).collect()}
    got = incremental.memories(spark, f"{tmp_path}/kept").select("entity_type", "entity_id", "memory", "seq", "n_updates").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    versions = _versions(tmp_path / "kept")
    assert len(versions) > 8 and sum(len(v) == 2 for v in versions.values()) == 1 and sum(v == [0] for v in versions.values()) == len(versions) - 1


def test_bucketed_state_replays(spark, tmp_path):
    """A batch that runs again, also after part of it was written, leaves the same rows; old versions can go."""
    state = incremental.BucketedState(spark, f"{tmp_path}/s", incremental.ENTITY, buckets=4)
    rows = lambda *x: memory.compacted(spark.createDataFrame(list(x), PATCH))
    read = lambda: sorted((r["entity_id"], r["memory"], r["n_updates"]) for r in state.read().collect())
    state.merge(0, rows(*[("user", k, "a", 1) for k in range(9)]), incremental.merged_memories)
    for _ in range(3):
        assert len(state.merge(1, rows(("user", 3, "b", 2)), incremental.merged_memories)) == 1
        assert read() == sorted([(k, "a", 1) for k in range(9) if k != 3] + [(3, "b", 2)])
    (tmp_path / "s/manifest/batch=1/_SUCCESS").unlink()  # the batch did not get to its end: the one before it is read
    assert read() == [(k, "a", 1) for k in range(9)]
    state.merge(1, rows(("user", 3, "b", 2)), incremental.merged_memories)
    assert state.merge(2, rows(("user", 3, "  ", 5)), incremental.merged_memories) == []
    state.merge(3, rows(("user", 3, "c", 1), ("user", 5, "d", 7)), incremental.merged_memories)
    before = read()
    state.vacuum(keep=1)
    assert read() == before == sorted([(k, "a", 1) for k in range(9) if k not in (3, 5)] + [(3, "b", 3), (5, "d", 2)])
    assert all(len(v) == 1 for v in _versions(tmp_path / "s").values())


def test_degree_stream(spark, tmp_path):
    """What a batch writes are the nodes that it changed; runs are merged by level and replays change nothing."""
    schema, edges = "user_id long, item_id long", []
    run = lambda: incremental.upsert_degrees(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/d", f"{tmp_path}/state", fanout=2).awaitTermination()
    for k in range(5):
        new = [(u, u % 7) for u in range(200)] if k == 0 else [(k, 3)]
        edges += new
        spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run()
        want = sorted(tuple(r) for r in graph.degrees(spark.createDataFrame(edges, schema)).collect())
        assert sorted(tuple(r) for r in incremental.current_degrees(spark, f"{tmp_path}/d").select("kind", "id", "degree").collect()) == want
    written = {int(p.name[4:]): spark.read.parquet(str(p)).count() for p in (tmp_path / "d").glob("level=0/run=*")}
    assert written == {0: 207, 1: 2, 2: 2, 3: 2, 4: 2}
    held = incremental._newest(spark, f"{tmp_path}/d")
    assert len(held) < 5 and max(r["level"] for r in held) == 1
    runs = incremental.ChangeRuns(spark, f"{tmp_path}/d", incremental.NODE, fanout=2)
    runs.append(4, spark.createDataFrame([("user", 4, 2), ("item", 3, 33)], "kind string, id long, degree long"))
    assert sorted(tuple(r) for r in runs.read().select("kind", "id", "degree").collect()) == want


def test_files(spark, tmp_path):
    (tmp_path / "x.inter").write_text("user_id\titem_id\trating\ttimestamp\n1\t2\t5.0\t1\n1\t3\t5.0\t2\n")
    (tmp_path / "x.text").write_text('user_id\titem_id\treview_text\n1\t2\t"two\nlines ""quoted"""\n1\t3\t\n')
    (tmp_path / "list.json").write_text(json.dumps({"user_ids": [1, 5], "seed": 42}))
    (tmp_path / "splits.json").write_text(json.dumps({"meta": {}, "splits": {"train": [1, 2], "val": [3], "test": [4]}}))
    got = tables.load_all(spark, f"{tmp_path}/x")
    assert got["interactions"].count() == 2 and got["items"].count() == 0 and got["instructions"].count() == 0
    assert sorted(r["review_text"] for r in got["reviews"].collect()) == ["", 'two\nlines "quoted"']
    assert [r["user_id"] for r in tables.read_user_list(spark, f"{tmp_path}/list.json", got["interactions"]).collect()] == [1]
    assert tables.read_splits(spark, f"{tmp_path}/splits.json").count() == 4
    users = spark.createDataFrame([(1, "likes fantasy", "1. [Item-5] Dune", ["Item-5"], 12)], "user_id long, user_memory string, neighbors_text string, neighbor_ids array<string>, n_train_items int")
    mem = spark.createDataFrame([(5, "A desert epic.")], "item_id long, memory string")
    tables.save_snapshot(users, mem, f"{tmp_path}/snap")
    a, b = tables.load_snapshot(spark, f"{tmp_path}/snap")
    assert a.collect() == users.collect() and b.collect() == mem.collect()
    tables.save_snapshot(users, mem, f"{tmp_path}/snap2", version=999)
    with pytest.raises(ValueError):
        tables.load_snapshot(spark, f"{tmp_path}/snap2")
    row = tables.result_row(spark.createDataFrame([("ndcg", 1, 0.5), ("hit", 1, 0.25)], "metric string, k int, value double"), "vanilla", (1,), ("hit", "ndcg"))
    assert row.columns == ["mode", "hit@1", "ndcg@1"] and tuple(row.first()) == ("no memory", 0.25, 0.5)
    tables.write_conversion(got["interactions"], got["reviews"], got["items"], got["instructions"], spark.createDataFrame([(2, 0.5)], "n_rows long, density double"), f"{tmp_path}/out/c")
    again = tables.load_all(spark, f"{tmp_path}/out/c")
    assert again["interactions"].collect() == got["interactions"].collect() and sorted(map(tuple, again["reviews"].collect())) == sorted(map(tuple, got["reviews"].collect()))
    assert [r[0] for r in spark.read.text(f"{tmp_path}/out/c.statistics").collect()] == ["n_rows: 2", "density: 0.5"]
    tables.write_report(row, spark.createDataFrame([(7, "gold id", 1)], "user_id long, reason string, x int"), f"{tmp_path}/out/report")
    assert spark.read.json(f"{tmp_path}/out/report/dropped").collect()[0].asDict() == {"user_id": 7, "reason": "gold id"}
    both = spark.createDataFrame([("user", 1, "u"), ("item", 5, "Dune"), ("item", 6, "['Emma']"), ("item", 7, "Emma, again")], "entity_type string, entity_id long, memory string")
    titled = spark.createDataFrame([(5, "Dune"), (6, "Emma"), (7, "Emma")], "item_id long, title string")
    tables.export_memories(both, titled, f"{tmp_path}/out/export")
    assert [r["item_id"] for r in spark.read.json(f"{tmp_path}/out/export/items").collect()] == [7] and spark.read.json(f"{tmp_path}/out/export/users").count() == 1
    names = spark.createDataFrame([("x.inter", 3, hashlib.sha256((tmp_path / "x.inter").read_bytes()).hexdigest(), True), ("gone", 1, "", True), ("extra", 1, "", False)], "name string, lines long, sha256 string, required boolean")
    assert {r["name"]: r["ok"] for r in leakage.file_audit(spark, f"{tmp_path}/*.*", names).collect()} == {"x.inter": True, "gone": False, "extra": True}


def test_conversion(spark):
    t = spark.createDataFrame([("b", [7, 8], ["r7", None, "extra"]), ("a", [9], ["r9"])], "key string, asin array<long>, reviews array<string>")
    assert sorted(map(tuple, seq.exploded_interactions(t, "key", "asin").collect())) == [(0, 9, 5.0, 1), (1, 7, 5.0, 1), (1, 8, 5.0, 2)]
    ids = seq.running_ids(t, "key")
    assert sorted(map(tuple, seq.exploded_reviews(ids, "asin", "reviews").collect())) == [(0, 9, "r9"), (1, 7, "r7")]
    with pytest.raises(ValueError):
        seq.metadata_from_mapping(t)


def test_records(spark):
    rows = spark.createDataFrame([(1, 0.5, None), (2, 0.9, None), (3, None, None)], "user_id long, baseline_h1 double, r_null double")
    assert [r["user_id"] for r in records.dataset(rows, n=5).collect()] == [1, 3]
    with pytest.raises(ValueError):
        records.dataset(rows.where("user_id = 2"))
    out, n = records.back_filled(rows, spark.createDataFrame([(1, 0.25), (9, 1.0)], "user_id long, r_null double"), "r_null")
    assert n == 1 and {r["user_id"]: r["r_null"] for r in out.collect()} == {1: 0.25, 2: None, 3: None}
    samples = spark.createDataFrame([(u, k, [f"f{u}{k}"] if u else None) for u in range(3) for k in (1, 2)], "user_id long, nth int, facets array<string>")
    arms = {(r["user_id"], r["arm"]): r["facets"] for r in records.arms(samples, sampling.shuffled_partner(samples.select("user_id").distinct())).collect()}
    assert len(arms) == 15 and arms[0, "shuffled"] == ["f11"] and arms[2, "shuffled"] == [] and arms[0, "sample1"] == [] and len(arms[1, "lorem"]) == 3


def test_facet_parse_keeps_every_document(spark, monkeypatch):
    from loomrec import queries

    rows = [(k, t) for k, t in enumerate([None, "", "...", "é ü", "plain", None, "!", "-"])]
    monkeypatch.setattr(queries, "table", lambda spark, d, name: spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["req_id"] for r in queries.facet_parse(spark, "").collect()) == list(range(8))


def test_first_users_alike_by_limit_and_by_ranges(spark, monkeypatch):
    users = spark.range(500).withColumnRenamed("id", "user_id")
    small = [r["user_id"] for r in sampling.user_sample(users, 60, 3).collect()]
    parts = sorted(map(tuple, sampling.user_splits(users, users.limit(5), 50, 20, 3).collect()))
    monkeypatch.setattr(sampling, "SMALL", 0)
    assert [r["user_id"] for r in sampling.user_sample(users, 60, 3).collect()] == small and len(small) == 60
    assert sorted(map(tuple, sampling.user_splits(users, users.limit(5), 50, 20, 3).collect())) == parts and len(parts) == 75


def test_spearman_over_everything(spark):
    r = random.Random(2)
    pairs = [(float(r.randrange(9)), float(r.randrange(40))) for _ in range(300)]
    got = rewards.spearman(spark.createDataFrame(pairs, "x double, y double"), "x", "y").head()
    rank = lambda v: [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]
    x, y = (rank([p[k] for p in pairs]) for k in (0, 1))
    mx, my = sum(x) / 300, sum(y) / 300
    want = sum((a - mx) * (b - my) for a, b in zip(x, y)) / (sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y)) ** 0.5
    assert got["n"] == 300 and abs(got["rho"] - want) < 1e-9


def test_texts_are_encoded_in_batches(spark, tmp_path):
    """The encoder is made once in a worker, whatever the batches; blank parts leave no separators."""
    facets_ = spark.createDataFrame([(1, 2, "second"), (1, 1, "first"), (1, 3, ""), (2, 1, None)], "user_id long, nth int, facet string")
    assert {r["user_id"]: r["text"] for r in rerank.profile_texts(facets_).collect()} == {1: "first. second"}
    about = spark.createDataFrame([(1, "T", ["a", "b", "c", "d", "e", "f"], "m" * 200), (2, "", None, None), (3, None, [], "memory")], "item_id long, title string, tags array<string>, memory string")
    assert {r["item_id"]: r["text"] for r in rerank.item_texts(about).collect()} == {1: "T. a, b, c, d, e. " + "m" * 150, 2: "Unknown item", 3: "memory"}
    made = str(tmp_path / "made")

    def factory():
        with open(made, "a") as f:
            f.write("x")
        return rerank.hashed_words(8)

    texts = spark.createDataFrame([(k, None if k % 7 == 0 else f"word{k} word") for k in range(100)], "id long, text string").coalesce(1)
    got = {r["id"]: r["vector"] for r in rerank.encoded(texts, "id", factory, batch=9).collect()}
    assert len(open(made).read()) == 1 and all((v is None) == (k % 7 == 0) for k, v in got.items())
    assert all(sum(v) == 2 for v in got.values() if v)
    cand = spark.createDataFrame([(1, 1, 0), (1, 3, 1), (9, 2, 0), (9, 1, 1)], "user_id long, item_id long, pos int")
    ranks = rerank.text_rerank(cand, facets_, about).collect()
    assert sorted((r["user_id"], r["rank"]) for r in ranks) == [(1, 1), (1, 2), (9, 1), (9, 2)]


def test_throughput(spark):
    meter = rewards.Throughput("t1")
    meter.watch(spark.range(1000, numPartitions=4)).collect()
    row = meter.report(spark).first()
    assert row["n"] == 1000 and row["seconds"] >= 0 and (row["rows_per_second"] is None) == (row["seconds"] == 0)
    empty = rewards.Throughput("t2")
    empty.watch(spark.range(0)).collect()
    assert tuple(empty.report(spark).first()) == (0, 0.0, None)


def test_sketches_of_parts_merge(spark):
    rows = spark.range(30_000).select((F.col("id") % 7000).alias("user_id"), (F.col("id") % 911).alias("item_id"), (F.col("id") % 5).alias("part"))
    whole, parts = (seq.sketched_stats(s).first() for s in (seq.count_sketches(rows), seq.count_sketches(rows, "part")))
    assert whole["n_rows"] == parts["n_rows"] == 30_000
    for got in (whole, parts):
        assert abs(got["n_users"] / 7000 - 1) < 0.03 and abs(got["n_items"] / 911 - 1) < 0.03


def test_runs_replace_themselves(spark, tmp_path):
    rows = lambda v: spark.createDataFrame([("hit", 1, v), ("hit", 5, v + 0.1)], "metric string, k int, value double")
    for run, mode, v in (("a", "full", 0.1), ("b", "vanilla", 0.2), ("a", "full", 0.3)):
        tables.write_run(rows(v), mode, run, str(tmp_path), ks=(1, 5), names=("hit",))
    runs, summary = tables.read_runs(spark, str(tmp_path))
    assert sorted((r["run"], r["k"], round(r["value"], 3)) for r in runs.collect()) == [("a", 1, 0.3), ("a", 5, 0.4), ("b", 1, 0.2), ("b", 5, 0.3)]
    assert {r["mode"]: round(r["hit@1"], 3) for r in summary.collect()} == {"full": 0.3, "no memory": 0.2}


@pytest.mark.parametrize("opens", [True, False])
def test_file_digests(spark, tmp_path, monkeypatch, opens):
    """By streams and by the file source: the same digests, lines and sizes."""
    if not opens:
        monkeypatch.setattr(leakage, "_opens", lambda folder: False)
    data = {"a.txt": b"one\ntwo\n", "b.bin": bytes(range(256)) * 5000, "c.txt": b"no end", "empty": b""}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    got = {r["name"]: (r["sha256"], r["n_lines"], r["n_bytes"]) for r in leakage.file_digests(spark, f"{tmp_path}/*", chunk=1000).collect()}
    assert got == {n: (hashlib.sha256(c).hexdigest(), c.count(b"\n") + (not c.endswith(b"\n") and bool(c)), len(c)) for n, c in data.items()}


def test_scratch_is_cleared(spark):
    from loomrec import scratch

    kept = scratch.materialise(spark.range(3), "kept")
    spark.range(5).write.option("path", scratch.table_path(spark, "loomrec_test_table")).saveAsTable("loomrec_test_table")
    assert kept.count() == 3 and spark.catalog.tableExists("loomrec_test_table")
    scratch.clear(spark)
    assert not spark.catalog.tableExists("loomrec_test_table")
    assert scratch.materialise(spark.range(2), "again").count() == 2
