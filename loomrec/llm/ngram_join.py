"""N-gram Jaccard join with signature trees.

Texts become sets of hashed word shingles; equal sets are one class (its id is a 64-bit hash of the set, or a second one
where several sets share the first). Two sets of
Jaccard similarity at least 0.75 share a shingle among the first n - ceil(3n/4) + 1 of each under any common order, so
only such prefixes are grouped. The order puts shingles that are common in the corpus last, which keeps groups small;
as any order is exact, its list of common shingles may be bounded.

Signature trees hold the OR and the AND of their sets' token bitmaps and their range of sizes in every node, and a dual
traversal drops pairs of nodes whose largest possible overlap is too small. First groups are traversed by bitmaps
alone, which are small enough to travel with them: each group's smallest class with the others, then, in groups that
this does not join, all classes. Those that may still be similar form clusters. Then each cluster's sets are fetched
once, and trees over them find the pairs that are verified exactly. A cluster comes in blocks of at most about `block`
sets. Blocks are searched by themselves, then one set of each block with those of the other blocks; where a cluster is
still in several parts, the sets outside its largest part meet every block. A pair whose sets are linked already through
others is not verified again, so copies never cost their square.

Defined results: null, empty or blank text has no shingles and links with nothing; a text of fewer words than a shingle
is one shingle; rows that repeat a doc_id are searched each for itself and share the id; a row whose id is null is
linked only through an equal text with an id, else its component is null; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.llm.components import components, local_roots
from loomrec.llm.mixing import few
from loomrec.llm.text import slices
from loomrec.scratch import materialise

MULTIPLIERS = np.random.default_rng(20240229).integers(1, 2**63, 32, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BUCKET_SHINGLES = 4_000_000  # of sets, about a quarter of which meet in one task as prefixes
MOST_SHARED = 10_000  # ids of several sets; chance makes a few
_hashes: dict[bytes, int] = {}


def word_hashes(w: list[bytes]) -> np.ndarray:
    if len(_hashes) > 120_000:
        _hashes.clear()
    for x in set(w).difference(_hashes):
        _hashes[x] = xxhash.xxh3_64_intdigest(x)
    return np.fromiter(map(_hashes.__getitem__, w), np.uint64, len(w))


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles of the whole text, A-Z lower-cased."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return np.empty(0, np.uint64)
    h = word_hashes(w)
    wide = min(n, len(w))
    out = np.full(len(w) - wide + 1, MULTIPLIERS[-1 - wide])
    for k in range(wide):
        out += h[k : len(w) - wide + 1 + k] * MULTIPLIERS[k]
    out ^= out >> np.uint64(31)
    out *= MULTIPLIERS[-1]
    out ^= out >> np.uint64(29)
    return np.unique(out)


def set_hash(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)


def second_hash(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw, seed=1) - (1 << 63)


class Names:
    """Ids of sets: a 64-bit hash, or a second one where the first is shared by several sets."""

    def __init__(self, first: Callable[[bytes], int] = set_hash, shared: frozenset[int] = frozenset()):
        self.first, self.shared = first, shared

    def __call__(self, tokens: np.ndarray) -> int:
        raw = tokens.tobytes()
        name = self.first(raw)
        return second_hash(raw) if name in self.shared else name


SEEN = "doc_id long, n_shingles long, class long, second long, bits binary, tokens binary, times binary"


def scanned(docs: DataFrame, n: int, names: Names) -> DataFrame:
    """One pass over the texts: a row (doc_id, n_shingles, class, second, bits) for every document, and rows (tokens,
    times) of packed shingles that recur among the different sets that a task has seen for a while."""
    schema = pa.schema([(c, k) for c, k in zip(("doc_id", "n_shingles", "class", "second", "bits", "tokens", "times"), [pa.int64()] * 4 + [pa.binary()] * 3)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = set(), [], 0

        def counted():
            tokens, times = np.unique(np.concatenate(held), return_counts=True)
            some = times > 1
            packed = [tokens[some].tobytes(), times[some].astype(np.int64).tobytes()]
            return pa.RecordBatch.from_arrays([*(pa.nulls(1, schema.field(k).type) for k in range(5)), *(pa.array([x], pa.binary()) for x in packed)], schema=schema)

        for b in slices(batches, 256):
            sets = [shingles(t, n) for t in b.column(1).to_pylist()]
            keys = [names(s) if len(s) else None for s in sets]
            cols = [
                b.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(keys, pa.int64()),
                pa.array([second_hash(s.tobytes()) if len(s) else None for s in sets], pa.int64()),
                pa.array([bitmap(s, width(len(s))) if len(s) else None for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.nulls(len(sets), pa.binary()) for _ in range(2))], schema=schema)
            for key, tokens in zip(keys, sets):
                if key is not None and key not in seen:
                    seen.add(key)
                    held.append(tokens)
                    size += len(tokens)
            if size > 1_000_000:
                yield counted()
                seen, held, size = set(), [], 0
        if held:
            yield counted()

    return docs.select("doc_id", "text").mapInArrow(run, SEEN)


def common_shingles(passed: DataFrame, most: int) -> np.ndarray:
    """At most `most` shingles that recur within tasks, least common first: what every task counts is summed up over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(t, np.int64)), pa.array(np.frombuffer(k, np.int64))], names=["token", "times"])

    found = passed.where("tokens is not null").select("tokens", "times").mapInArrow(run, "token long, times long").groupBy("token").agg(F.sum("times").alias("times"))
    top = found.orderBy(F.desc("times"), "token").limit(most).toArrow()
    return top["token"].to_numpy()[::-1].astype(np.int64).view(np.uint64)


def prefix(tokens: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles of which one is shared with any set that is similar enough; common is sorted, rank its order."""
    want = len(tokens) - -(-3 * len(tokens) // 4) + 1
    if not len(common):
        return tokens[:want]
    at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
    is_common = common[at] == tokens
    rare = tokens[~is_common][:want]
    if len(rare) == want:
        return rare
    rest = tokens[is_common]
    return np.concatenate([rare, rest[np.argsort(rank[at[is_common]])][: want - len(rare)]])


def prefixes(docs: DataFrame, common: np.ndarray, buckets: int, n: int, names: Names) -> DataFrame:
    """Rows (bucket, tokens, classes) of packed prefixes."""
    order = np.argsort(common)
    shared = docs.sparkSession.sparkContext.broadcast((common[order], order))  # bounded by common_shingles' `most`
    columns = ["bucket", "tokens", "classes"]
    kinds = [pa.int32(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank = shared.value
        seen, parts, owners, size = set(), [], [], 0

        def packed():
            t, c = np.concatenate(parts), np.concatenate(owners)
            bucket = t % np.uint64(buckets)
            by = np.argsort(bucket, kind="stable")
            t, c, bucket = t[by], c[by], bucket[by]
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1), len(t)]
            rows = [(int(bucket[a]), t[a:z].tobytes(), c[a:z].tobytes()) for a, z in zip(cuts, cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=columns)

        for b in slices(batches, 256):
            for text in b.column(0).to_pylist():
                tokens = shingles(text, n)
                key = names(tokens) if len(tokens) else None
                if key is not None and key not in seen:
                    seen.add(key)
                    parts.append(prefix(tokens, common, rank))
                    owners.append(np.full(len(parts[-1]), key, np.int64))
                    size += len(parts[-1])
            if size > 500_000:
                yield packed()
                seen, parts, owners, size = set(), [], [], 0
        if parts:
            yield packed()

    return docs.select("text").mapInArrow(run, "bucket int, tokens binary, classes binary")


def shared_prefixes(packed: DataFrame, buckets: int) -> DataFrame:
    """(group, class): the classes of each prefix shingle that several share; groups of the same classes count as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, c = [], []
        for b in batches:
            t += [np.frombuffer(x, np.uint64) for x in b.column(0).to_pylist()]
            c += [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
        if t:
            t, c = np.concatenate(t), np.concatenate(c)
            by = np.lexsort((c, t))
            t, c = t[by], c[by]
            keep = np.concatenate([[True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])])
            t, c = t[keep], c[keep]
            new = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            many = np.diff(np.append(new, len(t)))
            # A group's name is a hash of its members.
            mixed = c.view(np.uint64) * MULTIPLIERS[0]
            mixed = (mixed ^ (mixed >> np.uint64(32))) * MULTIPLIERS[1]
            names = np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), new).view(np.int64)
            _, first = np.unique(names, return_index=True)
            first = first[many[first] > 1]
            at = np.repeat(new[first], many[first]) + np.arange(many[first].sum()) - np.repeat(np.cumsum(many[first]) - many[first], many[first])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[first], many[first])), pa.array(c[at])], names=["group", "class"])

    return packed.repartitionById(buckets, F.col("bucket")).select("tokens", "classes").mapInArrow(run, "group long, class long").distinct()


def width(n: int) -> int:
    """Bits for a set of n tokens: at least two a token, a power of two, so that a wider bitmap folds into a narrower one."""
    return max(512, 1 << (2 * n - 1).bit_length())


def bitmap(tokens: np.ndarray, bits: int) -> bytes:
    marks = np.zeros(bits, np.uint8)
    marks[tokens % np.uint64(bits)] = 1
    return np.packbits(marks).tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def _lost(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Tokens of p's sets, at least, that q's sets do not have."""
    return np.bitwise_count(p & ~q).sum(-1, dtype=np.int64)


def possible(sizes: np.ndarray, bitmaps: list[bytes], leaf: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the pairs that sizes and bitmaps allow to be similar: a tree of one level over leaves by size."""
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    wide = [len(bitmaps[i]) for i in order]
    cuts, a = [], 0
    for z in range(1, len(sizes) + 1):
        if z == len(sizes) or z - a == leaf or wide[z] != wide[a]:
            cuts.append((a, z))
            a = z
    nodes = []
    for a, z in cuts:
        bits = np.frombuffer(b"".join(bitmaps[i] for i in order[a:z]), np.uint64).reshape(z - a, -1)
        nodes.append((int(sizes[a]), int(sizes[z - 1]), bits, np.bitwise_and.reduce(bits), np.bitwise_or.reduce(bits)))
    label = np.arange(len(sizes))
    found: list[np.ndarray] = []
    for i, (a, z) in enumerate(cuts):
        low1, high1, p, all1, any1 = nodes[i]
        for j in range(i, len(cuts)):
            low2, high2, q, all2, any2 = nodes[j]
            if 4 * high1 < 3 * low2:
                break  # leaves only get larger
            words, need = p.shape[1], 3 * (low1 + low2)
            if j > i and 7 * (high1 - int(_lost(all1, folded(any2, words)))) < need:
                continue
            b, y = cuts[j]
            q = folded(q, words)
            step = max(1, (1 << 20) // (words * (y - b)))
            for c in range(0, z - a, step):
                part, n, m = p[c : c + step, None], sizes[a + c : min(z, a + c + step), None], sizes[None, b:y]
                most = n - _lost(part, q[None])
                if q is nodes[j][2]:  # a folded bitmap says less about how much its own set loses
                    most = np.minimum(most, m - _lost(q[None], part))
                ok = 7 * most >= 3 * (n + m)
                if i == j:
                    ok = np.triu(ok, 1 + c)
                u, v = np.nonzero(ok)
                if len(u):
                    found.append(np.stack([u + a + c, v + b]))
        if len(found) > 64:
            found = [_spanning(label, np.concatenate(found, 1))]
    pairs = _spanning(label, np.concatenate(found, 1)) if found else np.zeros((2, 0), np.int64)
    return order[pairs[0]], order[pairs[1]]


def _spanning(label: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Links of each node to the smallest of its component: as connected as the pairs, and fewer."""
    roots = local_roots(len(label), pairs[0], pairs[1])
    some = np.flatnonzero(roots != label)
    return np.stack([roots[some], some])


def first_pairs(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): each group's smallest class with its others, where their bitmaps allow Jaccard 0.75.

    Groups of one family of near copies differ little, so these pairs are few, and each is looked at once."""
    head = groups.groupBy("group").agg(F.min("class").alias("a"))
    pairs = groups.join(head, "group").where("class <> a").select("a", F.col("class").alias("b")).distinct()
    one, two = (classes.select(F.col("class").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}")) for k in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            keep = [len(possible(np.asarray([n, m], np.int64), [x, y])[0]) > 0 for n, m, x, y in zip(*(b.column(i).to_pylist() for i in range(2, 6)))]
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def unsettled(groups: DataFrame, parts: DataFrame) -> DataFrame:
    """The groups whose classes are not all in one part (class, root) yet."""
    known = groups.join(parts, "class", "left").withColumn("root", F.coalesce("root", "class"))
    open_ = known.groupBy("group").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("group")
    return groups.join(open_, "group")


def may_be_similar(groups: DataFrame, classes: DataFrame, most: int = 20_000) -> DataFrame:
    """(a, b): classes of a group, as connected as the pairs whose bitmaps allow Jaccard 0.75.

    A group of more than `most` classes is dealt over tasks that each hold two parts of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def linked():
            if len(held) < 2:
                return []
            u, v = possible(np.asarray([h[1] for h in held], np.int64), [h[2] for h in held])
            return [(held[i][0], held[j][0]) for i, j in zip(u.tolist(), v.tolist())]

        def sent(pairs):
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            out = []
            for g, i, j, *row in zip(*(b.column(i).to_pylist() for i in range(6))):
                if (g, i, j) != group:
                    out += linked()
                    group, held = (g, i, j), []
                held.append(row)
            yield sent(list(set(out)))
        yield sent(linked())

    large = materialise(groups.groupBy("group").agg(F.count("*").alias("k")).where(F.col("k") > most).select("group", F.ceil(2 * F.col("k") / most).cast("int").alias("parts")), "large_groups")
    dealt = groups.join(few(large, 200_000), "group", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.hash("class"), F.col("parts")))
    # With two parts or more, a part's classes meet among themselves wherever it meets another part.
    other = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != F.col("own")))
    dealt = dealt.withColumn("other", F.explode(other)).select("group", "class", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = dealt.join(classes, "class").select("group", "i", "j", "class", "n_shingles", "bits")
    return rows.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(run, "a long, b long")


class Node:
    """A signature tree's node over sets [first, last): OR and AND of their bitmaps, and their range of sizes."""

    __slots__ = ("first", "last", "any", "all", "low", "high", "kids")
    FANOUT = 8

    def __init__(self, first: int, last: int, bitmaps: list[int], sizes: list[int]):
        self.first, self.last, self.kids = first, last, []
        if last - first <= self.FANOUT:
            some = [(b, b, n, n) for b, n in zip(bitmaps[first:last], sizes[first:last])]
        else:
            step = self.FANOUT
            while step * self.FANOUT < last - first:
                step *= self.FANOUT
            self.kids = [Node(a, min(a + step, last), bitmaps, sizes) for a in range(first, last, step)]
            some = [(k.any, k.all, k.low, k.high) for k in self.kids]
        self.any, self.all, self.low, self.high = some[0]
        for o, a, low, high in some[1:]:
            self.any |= o
            self.all &= a
            self.low, self.high = min(self.low, low), max(self.high, high)


def may_link(low1: int, high1: int, all1: int, any1: int, low2: int, high2: int, all2: int, any2: int) -> bool:
    """Whether the largest possible overlap is 3/7 of the smallest sum of sizes, that is, Jaccard 0.75."""
    need = 3 * (low1 + low2)
    if 7 * min(high1, high2) < need or 4 * high1 < 3 * low2 or 4 * high2 < 3 * low1:
        return False
    return 7 * (high1 - (all1 & ~any2).bit_count()) >= need and 7 * (high2 - (all2 & ~any1).bit_count()) >= need


class Forest:
    """Signature tree search over sets with parts (union-find labels) known so far; `found` gets the links that join parts."""

    def __init__(self, sets: list[np.ndarray], parts: list[int]):
        self.sets, self.sizes = sets, [len(s) for s in sets]
        bits = width(max(self.sizes, default=1))
        self.bitmaps = [int.from_bytes(bitmap(s, bits)) for s in sets]
        heads: dict[int, int] = {}
        self.up = [heads.setdefault(p, i) for i, p in enumerate(parts)]
        self.found: list[tuple[int, int]] = []

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def tree(self, first: int, last: int) -> Node:
        return Node(first, last, self.bitmaps, self.sizes)

    def join(self, one: Node, two: Node) -> None:
        todo = [(one, two)]
        while todo:
            p, q = todo.pop()
            if p is not q and not may_link(p.low, p.high, p.all, p.any, q.low, q.high, q.all, q.any):
                continue
            if p.kids or q.kids:
                if p is q:
                    todo += [(p.kids[i], p.kids[j]) for i in range(len(p.kids)) for j in range(i, len(p.kids))]
                elif p.kids:
                    todo += [(k, q) for k in p.kids]
                else:
                    todo += [(p, k) for k in q.kids]
                continue
            for i in range(p.first, p.last):
                for j in range(i + 1 if p is q else q.first, q.last):
                    self.verify(i, j)

    def verify(self, i: int, j: int) -> None:
        a, b = self.top(i), self.top(j)
        n, m, x, y = self.sizes[i], self.sizes[j], self.bitmaps[i], self.bitmaps[j]
        if a == b or not may_link(n, n, x, x, m, m, y, y):
            return
        both = len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True))
        if 100 * both >= 75 * (n + m - both):
            self.up[max(a, b)] = min(a, b)
            self.found.append((i, j))


def _sets(group: pa.Table) -> tuple[list[int], list[np.ndarray], list[int], list[bool]]:
    """Classes, sets, parts and whether each is a visitor, residents first, by size; each class once per side."""
    rows = {(r["visitor"], r["class"]): r for r in group.to_pylist()}
    rows = sorted(rows.values(), key=lambda r: (r["visitor"], len(r["tokens"]), r["class"]))
    return [r["class"] for r in rows], [np.frombuffer(r["tokens"], np.uint64) for r in rows], [r["part"] for r in rows], [r["visitor"] for r in rows]


def search(members: DataFrame, *keys: str) -> DataFrame:
    """Verified links (a, b) between residents, or between visitors and residents of a group that has visitors."""

    def run(group: pa.Table) -> pa.Table:
        classes, sets, parts, visitor = _sets(group)
        forest, guests = Forest(sets, parts), sum(visitor)
        edge = len(sets) - guests
        if not guests:
            whole = forest.tree(0, edge)
            forest.join(whole, whole)
        elif edge:
            forest.join(forest.tree(0, edge), forest.tree(edge, len(sets)))
        pairs = [(classes[i], classes[j]) for i, j in forest.found]
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return members.groupBy(*keys).applyInArrow(run, "a long, b long")


def similar_documents(docs: DataFrame, n: int = 5, block: int = 128, common: int = 1_000_000, group: int = 20_000, ident: Callable[[bytes], int] = set_hash) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs: documents linked at Jaccard 0.75 or more."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    passed = materialise(scanned(docs, n, Names(ident)), "scanned")
    every = passed.where("tokens is null")
    shared = every.where("class is not null").groupBy("class").agg(F.min("second").alias("low"), F.max("second").alias("high")).where("low <> high")
    shared = frozenset(r["class"] for r in shared.select("class").limit(MOST_SHARED + 1).collect())
    if len(shared) > MOST_SHARED:
        raise ValueError(f"more than {MOST_SHARED} ids are shared by several sets")
    names = Names(ident, shared)
    if shared:
        every = every.withColumn("class", F.when(F.col("class").isin([*shared]), F.col("second")).otherwise(F.col("class")))
    total = every.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    buckets = max(parts, -(-total // BUCKET_SHINGLES))  # a task's share does not grow with the corpus
    groups = materialise(shared_prefixes(prefixes(docs, common_shingles(passed, common), buckets, n, names), buckets), "groups")
    classes = every.where("class is not null").select("class", "n_shingles", "bits")
    classes = classes.join(few(groups.select("class").distinct(), 200_000), "class", "left_semi").dropDuplicates(["class"])
    classes = materialise(classes, "classes")
    every = every.select("doc_id", "n_shingles", "class")
    first = materialise(first_pairs(groups, classes), "first_pairs")
    parts = materialise(components(first).withColumnRenamed("id", "class"), "first_parts")
    clusters = components(first.unionByName(may_be_similar(unsettled(groups, parts), classes, group)))
    clusters = materialise(clusters.select(F.col("id").alias("class"), F.col("root").alias("cluster")), "clusters")

    # The sets themselves, for one document of each class in a cluster; large clusters are dealt over blocks by hash.
    large = clusters.groupBy("cluster").agg(F.count("*").alias("k")).where(F.col("k") > block)
    large = materialise(large.select("cluster", F.ceil(F.col("k") / block).cast("int").alias("blocks")), "large")
    first = every.where("class is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    first = materialise(first, "first")
    wanted = materialise(first.join(clusters, "class").join(few(large), "cluster", "left").select("doc_id", "class", "cluster", F.coalesce("blocks", F.lit(1)).alias("blocks")), "wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            texts, classes = b.column(3).to_pylist(), b.column(0).to_pylist()
            tokens = [shingles(t, n) for t in texts]
            same = [len(t) > 0 and names(t) == c for t, c in zip(tokens, classes)]  # not so if an id has several texts
            keep = pa.array(same)
            cols = [b.column(i).filter(keep) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([t.tobytes() for t, s in zip(tokens, same) if s], pa.binary())], names=["class", "cluster", "blocks", "tokens"])

    texts = docs.select("doc_id", "text").join(few(wanted, 200_000), "doc_id").select("class", "cluster", "blocks", "text")
    held = texts.mapInArrow(sets, "class long, cluster long, blocks int, tokens binary")
    held = held.withColumn("block", F.pmod(F.hash("class"), F.col("blocks")))
    held = materialise(held.withColumn("part", F.col("class")).withColumn("visitor", F.lit(False)), "sets")
    links = materialise(search(held, "cluster", "block"), "links")

    many = held.where("blocks > 1")
    if not many.isEmpty():
        heads = many.groupBy("cluster", "block").agg(F.min("class").alias("class"))
        heads = many.join(heads.select("class"), "class")
        # One set of each block: at most a `block`-th of the cluster, in groups of as many blocks again.
        heads = heads.withColumn("group", F.floor(F.col("block") / block))
        links = materialise(links.unionByName(search(heads, "cluster", "group")), "links")
        parts = components(links).select(F.col("id").alias("class"), F.col("root"))
        many = materialise(many.join(parts, "class", "left").withColumn("part", F.coalesce("root", "class")).drop("root"), "parts")
        sizes = many.groupBy("cluster", "part").agg(F.count("*").alias("k"))
        main = materialise(sizes.groupBy("cluster").agg(F.max(F.struct("k", "part"))["part"].alias("main"), F.count("*").alias("n_parts"), F.sum("k").alias("k")), "main")
        left = many.join(few(main.where("n_parts > 1").select("cluster", "main")), "cluster")
        guests = left.where("part <> main")
        chunks = guests.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("chunks"))
        left = left.join(few(chunks), "cluster")
        chunk = F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int")
        visitors = left.where("part <> main").withColumn("visitor", F.lit(True)).withColumn("chunk", chunk).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        residents = left.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        links = links.unionByName(search(residents.unionByName(visitors), "cluster", "block", "chunk"))

    # Components by class, so that a component of many documents is no key of a join; only equal texts share one.
    roots = materialise(components(links).select(F.col("id").alias("class"), "root"), "roots")
    linked = first.join(roots, "class")
    linked = linked.join(linked.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("class", "component_id")
    of = materialise(first.join(linked, "class", "left").select("class", F.coalesce("component_id", "doc_id").alias("component_id")), "components")
    some = every.where("class is not null").join(of, "class", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return some.unionByName(every.where("class is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
