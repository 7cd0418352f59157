"""Alignment of two tokenizers' tokens by bytes, with an associative fragment monoid.

Both tokenizers split the bytes of one string. Offsets where tokens of both end cut the tokens into groups. A fragment
is what is known of a byte range: the tokens before its first common end (open prefix), what its closed groups add up
to, and the tokens behind its last common end (open suffix). Two neighbours compose by closing the group that the left
one's suffix and the right one's prefix make; without a common end on one side that side's tokens just grow. The
operation is associative, so fragments of a very long text are composed by a tree, level by level, whichever tasks
they come from.

Texts are cut for the tokenizers where both provably start anew: before a line end, or a single space, that follows a
character that is no white space, as no token of either holds one behind such a character. Parts of about `part_bytes`
are dealt over tasks; a part gives one fragment for every byte range of `range_bytes` that it has tokens ending in. A
stretch between two cuts (mostly a word) is tokenized once a task, together with other new ones, and looked up after that.

The corpus-wide counts of pairs are summed from a table of pairs by text and joined back; they are broadcast only after
being counted.

Defined results: null and empty texts, and texts whose tokens of either side do not spell them (characters that a
vocabulary normalises), have no tokens, and their links count nowhere; repeated rows count each; a null doc_id keeps
its row; an empty table gives an empty result; extra columns are ignored unless `carry` names them. A text's digest
needs its groups in order, so they meet in one row, as the text does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.llm.mixing import few
from loomrec.llm.text import slices
from loomrec.scratch import materialise

#: A token: (id, offset of its end).
Token = tuple[int, int]
PAIRS = pa.list_(pa.struct([("pair", pa.int64()), ("n", pa.int64())]))
#: Where both tokenizers start anew: a single space between characters that are no white space, a line end behind one.
CUT = re.compile(r"(?<=\S)(?: (?=\S)|(?=\n))")


def linked(a: list[Token], b: list[Token]) -> list[tuple[int, int]]:
    """The pairs of ids of one group's tokens whose byte ranges overlap, in order."""
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        out.append((a[i][0], b[j][0]))
        end_a, end_b = a[i][1], b[j][1]
        i, j = i + (end_a <= end_b), j + (end_b <= end_a)
    return out


@dataclass
class Fragment:
    """A byte range: whether a common end is in it, the open tokens on both sides, and the closed groups' sums."""

    prefix: tuple[list[Token], list[Token]] = field(default_factory=lambda: ([], []))
    suffix: tuple[list[Token], list[Token]] = field(default_factory=lambda: ([], []))
    ends: bool = False
    ok: bool = True
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    groups: list[bytes] = field(default_factory=list)
    pairs: dict[int, int] = field(default_factory=dict)

    def close(self, a: list[Token], b: list[Token]) -> None:
        """Take in one whole group."""
        links = linked(a, b)
        self.n_a, self.n_b, self.n_groups, self.n_links = self.n_a + len(a), self.n_b + len(b), self.n_groups + 1, self.n_links + len(links)
        self.groups.append(spelled(a, b))
        for x, y in links:
            self.pairs[x << 32 | y] = self.pairs.get(x << 32 | y, 0) + 1


def spelled(a: list[Token], b: list[Token]) -> bytes:
    return (",".join(str(x) for x, _ in a) + "|" + ",".join(str(x) for x, _ in b)).encode()


def fragment(a: list[Token], b: list[Token]) -> Fragment:
    """The fragment of the tokens that end in a byte range, whatever they begin with."""
    out = Fragment()
    common = sorted({e for _, e in a} & {e for _, e in b})
    out.ends = bool(common)
    i = j = 0
    for k, end in enumerate(common):
        p, q = i, j
        while i < len(a) and a[i][1] <= end:
            i += 1
        while j < len(b) and b[j][1] <= end:
            j += 1
        if k:
            out.close(a[p:i], b[q:j])
        else:
            out.prefix = (a[p:i], b[q:j])
    rest = (a[i:], b[j:])
    if common:
        out.suffix = rest
    else:
        out.prefix = rest
    return out


def compose(left: Fragment, right: Fragment) -> Fragment:
    """left followed by right; Fragment() is neutral."""
    out = Fragment(ok=left.ok and right.ok, ends=left.ends or right.ends, prefix=left.prefix, suffix=right.suffix)
    out.n_a, out.n_b, out.n_groups, out.n_links = left.n_a + right.n_a, left.n_b + right.n_b, left.n_groups + right.n_groups, left.n_links + right.n_links
    out.groups, out.pairs = list(left.groups), dict(left.pairs)
    for key, n in right.pairs.items():
        out.pairs[key] = out.pairs.get(key, 0) + n
    if not left.ends:
        out.prefix = (left.prefix[0] + right.prefix[0], left.prefix[1] + right.prefix[1])
    else:
        middle = (left.suffix[0] + right.prefix[0], left.suffix[1] + right.prefix[1])
        if not right.ends:
            out.suffix = middle
        elif any(middle):
            out.close(*middle)
    out.groups += right.groups
    return out


def whole(f: Fragment) -> Fragment:
    """The fragment of a whole text: its prefix is its first group, and nothing may be left open."""
    out = compose(Fragment(ends=True), f)
    out.ok = out.ok and not any(out.suffix)
    return out


class Pair:
    """Two tokenizers as one function of stretches, which remembers what it has seen.

    A stretch goes by a name: what is behind its space, or, if it begins otherwise, the stretch itself."""

    def __init__(self, path_a: str, path_b: str, most: int = 90_000):
        import sentencepiece
        from tokenizers import Tokenizer

        self.first, self.second = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.first.encode_special_tokens = True
        by_id = _byte_level(self.first)
        self.bytes_a = [by_id.get(i, b"") for i in range(1 + max(by_id))]
        self.bytes_b = [_piece_bytes(self.second, i) for i in range(self.second.get_piece_size())]
        self.safe = not any(re.search(r"\S[ \n]", x.decode("utf-8", "replace")) for x in [*self.bytes_a, *self.bytes_b])
        self.lengths = [np.fromiter(map(len, x), np.int64) for x in (self.bytes_a, self.bytes_b)]
        n = max(len(self.bytes_a), len(self.bytes_b))
        #: Ids followed by what stands between them: within a side, between the sides, between groups, between stretches.
        self.names = [[f"{i}{end}" for i in range(n)] for end in ",|;\n"]
        #: What was met of late, and what was met before that; of the latter only what is met again is kept.
        self.seen: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        self.most = most

    def __call__(self, names: list[str]) -> list[tuple]:
        """For each stretch: bytes, n_a, groups, its links' pairs as packed numbers; groups is None where its tokens do not spell it."""
        new = set(names).difference(self.seen)
        if len(self.seen) + len(new) > self.most:
            self.older, self.seen, new = self.seen, {}, set(names)
        again = [x for x in new if x in self.older]
        self.seen.update(zip(again, map(self.older.__getitem__, again)))
        new.difference_update(again)
        chain = [x for x in new if x and x[0] != " " and not x[-1].isspace()] if self.safe else []
        for x in new.difference(chain):
            self._one(x)
        for a in range(0, len(chain), 8192):
            self._chain(chain[a : a + 8192])
        return list(map(self.seen.__getitem__, names))

    def ids(self, stretch: str) -> tuple[list[int], list[int]]:
        """Both sides' ids; the second side puts a space before what it is given."""
        ids_b = self.second.encode(stretch.removeprefix(" "))
        return self.first.encode(stretch, add_special_tokens=False).ids, ids_b if stretch.startswith(" ") else ids_b[1:]

    def tokens(self, stretch: str) -> tuple[list[Token], list[Token], bool]:
        """Both sides' tokens and whether they spell the stretch."""
        raw, sides, ok = stretch.encode("utf-8", "surrogatepass"), [], True
        for ids, spell in zip(self.ids(stretch), (self.bytes_a, self.bytes_b)):
            parts = [spell[i] for i in ids]
            ok = ok and b"".join(parts) == raw
            sides.append(list(zip(ids, accumulate(map(len, parts)))))
        return *sides, ok

    def _one(self, name: str) -> None:
        stretch = stretch_of(name)
        a, b, ok = self.tokens(stretch)
        f = whole(fragment(a, b)) if ok else Fragment()
        pairs = np.repeat(np.fromiter(f.pairs.keys(), np.int64), np.fromiter(f.pairs.values(), np.int64))
        self.seen[name] = (len(stretch.encode("utf-8", "surrogatepass")), f.n_a, b";".join(f.groups) if ok else None, pairs.tobytes())

    def _chain(self, chain: list[str]) -> None:
        """Tokenize stretches as one text, behind a word of its own, and align them at once; where bytes differ, halves are tried."""
        some = ["x", *chain]
        stretches = list(map(stretch_of, some))
        text = "".join(stretches)
        raw = text.encode("utf-8", "surrogatepass")
        sides = self.first.encode(text, add_special_tokens=False).ids, self.second.encode(text[1:])
        if any(b"".join(map(spell.__getitem__, ids)) != raw for ids, spell in zip(sides, (self.bytes_a, self.bytes_b))):
            for half in (chain[: len(chain) // 2], chain[len(chain) // 2 :]):
                self._chain(half) if len(chain) > 1 else [self._one(x) for x in half]
            return
        size = list(map(len, stretches)) if len(raw) == len(text) else [len(x.encode("utf-8", "surrogatepass")) for x in stretches]
        upto = np.cumsum(size)
        ids_a, ids_b = (np.asarray(x) for x in sides)
        ends_a, ends_b = np.cumsum(self.lengths[0][ids_a]), np.cumsum(self.lengths[1][ids_b])
        # Between two neighbouring ends of either side lies one overlap of one token of each.
        ends = np.union1d(ends_a, ends_b)
        pairs = (ids_a[np.searchsorted(ends_a, ends)] << 32) | ids_b[np.searchsorted(ends_b, ends)]
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        last = np.searchsorted(ends_a, common, "right"), np.searchsorted(ends_b, common, "right")  # tokens up to each group's end
        # Each group's tokens of the first side, then those of the second.
        told = np.empty(len(ids_a) + len(ids_b), object)
        comma, bar, semicolon, line = self.names
        before = np.r_[0, last[1]]
        shut = np.zeros(len(ids_a), bool)
        shut[last[0] - 1] = True
        told[np.arange(len(ids_a)) + before[group_a]] = [(bar if x else comma)[i] for i, x in zip(sides[0], shut.tolist())]
        kind = np.zeros(len(ids_b), np.int64)
        kind[last[1] - 1] = 1
        kind[np.searchsorted(ends_b, upto, "right") - 1] = 2
        told[np.arange(len(ids_b)) + last[0][group_b]] = [(comma, semicolon, line)[x][i] for i, x in zip(sides[1], kind.tolist())]
        groups = "".join(told.tolist()).encode().split(b"\n")
        n_a = np.diff(np.r_[0, np.searchsorted(ends_a, upto, "right")]).tolist()
        cuts = (8 * np.r_[0, np.searchsorted(ends, upto, "right")]).tolist()
        packed = pairs.astype(np.int64).tobytes()
        for k, name in enumerate(chain, 1):
            self.seen[name] = (size[k], n_a[k], groups[k], packed[cuts[k] : cuts[k + 1]])


def stretch_of(name: str) -> str:
    return name if name[:1] in (" ", "\n") else " " + name


@lru_cache(maxsize=1)
def pair_of(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def _byte_level(tokenizer) -> dict[int, bytes]:
    """The bytes of every entry of a byte-level vocabulary: printable bytes stand for themselves, others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return {i: bytes(code[c] for c in t) if all(c in code for c in t) else t.encode() for t, i in tokenizer.get_vocab().items()}


def _piece_bytes(model, i: int) -> bytes:
    piece = model.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()


def _size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def parts_of(text: str, part_bytes: int, safe: bool) -> list[tuple[int, str]]:
    """(first byte, part) of a space and the text: parts of part_bytes or a little more, cut where tokenizers start anew."""
    s, out, a, at = " " + text, [], 0, 0
    while True:
        cut = CUT.search(s, a + part_bytes) if safe and len(s) - a > part_bytes else None
        b = cut.start() if cut else len(s)
        out.append((at, s[a:b]))
        if b == len(s):
            return out
        at += _size(s[a:b])
        a = b


def stretches_of(part: str, safe: bool) -> list[str]:
    """The names of a part's stretches, cut at every place where tokenizers start anew; a part begins with a space or a line end."""
    head, *rest = CUT.split(part) if safe else [part]
    return [head[1:] if head[:1] == " " and len(head) > 1 and not head[1].isspace() and safe else head, *rest]


def fragments(first: int, part: str, pair: Pair, range_bytes: int) -> list[tuple[int, Fragment]]:
    """(byte range, fragment) in order, of a part that begins at byte `first`. A token lies in the range that holds its end.

    Stretches that lie within one range are looked up, others are cut at the ranges' borders."""
    names = stretches_of(part, pair.safe)
    found = pair(names)
    if any(f[2] is None for f in found):
        return [(first // range_bytes, Fragment(ok=False))]
    ends = first + np.cumsum([f[0] for f in found])
    begins = ends - [f[0] for f in found]
    where = np.where((begins + 1) // range_bytes == ends // range_bytes, ends // range_bytes, -1)
    out: dict[int, Fragment] = {}
    cuts = [0, *(np.flatnonzero(np.diff(where) | (where[1:] < 0)) + 1), len(found)]
    for k, n in zip(cuts, cuts[1:]):
        if where[k] >= 0:
            r = int(where[k])
            out[r] = compose(out.get(r, Fragment()), closed(found[k:n]))
            continue
        a, b, _ = pair.tokens(stretch_of(names[k]))
        a, b = ([(i, e + int(begins[k])) for i, e in x] for x in (a, b))
        for r in sorted({e // range_bytes for _, e in a + b}):
            own = fragment(*([t for t in x if t[1] // range_bytes == r] for x in (a, b)))
            out[r] = compose(out.get(r, Fragment()), own)
    return list(out.items())


def sums_of(found: list[tuple]) -> tuple[tuple[int, int, int, int], bytes, np.ndarray, np.ndarray]:
    """Of whole stretches: n_a, n_b, n_groups, n_links; groups; the links' pairs and how often each is there."""
    _, n_a, groups, pairs = zip(*found)
    told, n_a = b";".join(groups), sum(n_a)
    links = np.frombuffer(b"".join(pairs), np.int64)
    n_groups = told.count(b"|")
    keys, n = np.unique(links, return_counts=True)
    return (n_a, told.count(b",") + 2 * n_groups - n_a, n_groups, len(links)), told, keys, n


def closed(found: list[tuple]) -> Fragment:
    """The fragment of whole stretches."""
    counts, told, keys, n = sums_of(found)
    return Fragment(([], []), ([], []), True, True, *counts, [told], dict(zip(keys.tolist(), n.tolist())))


NAMES = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"]
SUMS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<pair:long,n:long>>"
SIDES = [f"{x}_{y}" for x in ("prefix", "suffix") for y in ("a", "b")]
FRAGMENT = f"row long, range long, first long, ok boolean, ends boolean, {', '.join(f'{x} array<struct<id:long,end:long>>' for x in SIDES)}, n_a long, n_b long, n_groups long, n_links long, groups binary, pairs array<struct<pair:long,n:long>>"
TOKENS = pa.list_(pa.struct([("id", pa.int64()), ("end", pa.int64())]))


NOTHING = ((0, 0, 0, 0), None, np.empty(0, np.int64), np.empty(0, np.int64))


def _pairs(each: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    flat = [pa.array(np.concatenate([np.empty(0, np.int64), *(x[k] for x in each)])) for k in (0, 1)]
    return pa.ListArray.from_arrays(np.cumsum([0, *(len(x) for x, _ in each)]).astype(np.int32), pa.StructArray.from_arrays(flat, names=["pair", "n"]))


def _summed(each: list[tuple]) -> list[pa.Array]:
    """Columns SUMS of what sums_of() gives of whole texts; NOTHING has no digest."""
    out = [pa.array([e[0][k] for e in each], pa.int64()) for k in range(4)]
    out.append(pa.array(["" if e[1] is None else hashlib.sha256(e[1]).hexdigest() for e in each], pa.string()))
    return [*out, _pairs([e[2:] for e in each])]


def _arrays(pairs: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))


def _ended(f: Fragment) -> tuple:
    """A whole text's fragment as sums_of() gives it; one that failed has NOTHING."""
    return ((f.n_a, f.n_b, f.n_groups, f.n_links), b";".join(f.groups), *_arrays(f.pairs)) if f.ok else NOTHING


def _written(rows: list[tuple[int, int, int, Fragment]]) -> pa.RecordBatch:
    """Columns FRAGMENT."""
    row, where, first, f = zip(*rows) if rows else ((), (), (), ())
    cols = [pa.array(x, pa.int64()) for x in (row, where, first)] + [pa.array([x.ok for x in f], pa.bool_()), pa.array([x.ends for x in f], pa.bool_())]
    for name in SIDES:
        side, k = name.split("_")
        cols.append(pa.array([[{"id": i, "end": e} for i, e in getattr(x, side)["ab".index(k)]] for x in f], TOKENS))
    cols += [pa.array([getattr(x, n) for x in f], pa.int64()) for n in NAMES[:4]]
    cols += [pa.array([b";".join(x.groups) for x in f], pa.binary()), _pairs([_arrays(x.pairs) for x in f])]
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in FRAGMENT.split(", ")])


def _read(r: dict) -> Fragment:
    side = {n: [(t["id"], t["end"]) for t in r[n]] for n in SIDES}
    f = Fragment((side["prefix_a"], side["prefix_b"]), (side["suffix_a"], side["suffix_b"]), r["ends"], r["ok"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"])
    f.groups = [r["groups"]] if r["groups"] else []
    f.pairs = {p["pair"]: p["n"] for p in r["pairs"]}
    return f


def _composed(table: DataFrame, fan_in: int) -> DataFrame:
    """One level of the tree: each text's fragments of fan_in neighbouring ranges become one."""
    node = F.floor(F.col("range") / fan_in).cast("long")
    order = F.sort_array(F.collect_list(F.struct("range", "first", F.struct(*[c for c in table.columns if c not in ("row", "range", "first")]).alias("f"))))
    grouped = table.groupBy("row", node.alias("node")).agg(order.alias("below"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 8):
            done = []
            for r in b.to_pylist():
                f = Fragment()
                for x in r["below"]:
                    f = compose(f, _read(x["f"]))
                done.append((r["row"], r["node"], r["below"][0]["first"], f))
            yield _written(done)

    return grouped.mapInArrow(run, FRAGMENT)


def align(docs: DataFrame, path_a: str, path_b: str, carry: tuple[str, ...] = ("doc_id",), part_bytes: int = 1 << 16, range_bytes: int = 1 << 16, fan_in: int = 16) -> DataFrame:
    """The carried columns, SUMS without pairs, n_best and count_sum for every row of docs. Both paths must be readable wherever tasks run."""
    kinds = dict(docs.dtypes)
    keys = [f"_c{i}" for i in range(len(carry))]
    ddl = ", ".join([*(f"{k} {kinds[c]}" for k, c in zip(keys, carry)), "row long, first long, part string", SUMS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(path_a, path_b)
        for b in slices(batches, 256):
            row, at, first, part, each = b.column(len(keys)).to_pylist(), [], [], [], []
            for i, text in enumerate(b.column(b.num_columns - 1).to_pylist()):
                parts = parts_of(text, part_bytes, pair.safe) if text else []
                if len(parts) == 1 and _size(parts[0][1]) < range_bytes:
                    ready = pair(stretches_of(parts[0][1], pair.safe))
                    each.append(sums_of(ready) if all(f[2] is not None for f in ready) else NOTHING)
                elif parts:
                    at += [i] * len(parts)
                    first += [f for f, _ in parts]
                    part += [p for _, p in parts]
                    each.append(NOTHING)
                else:
                    each.append(NOTHING)
            long = set(at)
            sums = _summed(each)
            sums[4] = pa.array([None if i in long else x for i, x in enumerate(sums[4].to_pylist())], pa.string())
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), *sums], schema=_schema(b, keys))
            if at:
                head = [pa.nulls(len(at), c.type) for c in b.columns[: len(keys)]]
                yield pa.RecordBatch.from_arrays([*head, pa.array([row[i] for i in at], pa.int64()), pa.array(first, pa.int64()), pa.array(part, pa.string()), *_summed([NOTHING] * len(at))], schema=_schema(b, keys))

    def _schema(b: pa.RecordBatch, keys: list[str]) -> pa.Schema:
        types = [("row", pa.int64()), ("first", pa.int64()), ("part", pa.string()), *((n, pa.int64()) for n in NAMES[:4]), ("groups_sha256", pa.string()), ("pairs", PAIRS)]
        return pa.schema([*((k, c.type) for k, c in zip(keys, b.columns)), *types])

    rows = docs.select(*[F.col(c).alias(k) for c, k in zip(carry, keys)], F.monotonically_increasing_id().alias("row"), F.col("text").alias("text"))
    first = materialise(rows.mapInArrow(run, ddl), "aligned")
    heads = first.where("part is null").drop("part", "first")
    parts = first.where("part is not null").select("row", "first", "part")
    if not parts.isEmpty():
        sums = materialise(_long(parts, path_a, path_b, range_bytes, fan_in), "aligned_long")
        done = heads.where("groups_sha256 is null").select("row", *keys).join(sums, "row")
        heads = heads.where("groups_sha256 is not null").unionByName(done)
    return _counted(heads, keys, carry)


def _long(parts: DataFrame, path_a: str, path_b: str, range_bytes: int, fan_in: int) -> DataFrame:
    """(row, SUMS) of texts in several parts or ranges."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(path_a, path_b)
        for b in slices(batches, 4):
            yield _written([(r["row"], where, r["first"], f) for r in b.to_pylist() for where, f in fragments(r["first"], r["part"], pair, range_bytes)])

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 8):
            got = b.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([r["row"] for r in got], pa.int64()), *_summed([_ended(whole(_read(r))) for r in got])], names=["row", *NAMES])

    table = materialise(parts.repartition("row", "first").mapInArrow(cut, FRAGMENT), "fragments")
    top = table.agg(F.max("range")).first()[0]
    while True:
        table, top = _composed(table, fan_in), top // fan_in
        if not top:
            return table.mapInArrow(end, f"row long, {SUMS}")


def _counted(heads: DataFrame, keys: list[str], carry: tuple[str, ...]) -> DataFrame:
    """n_best and count_sum beside each text's sums."""
    links = heads.select("row", F.inline("pairs"))
    counts = materialise(links.groupBy("pair").agg(F.sum("n").alias("count")), "pair_counts")
    side = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    best = counts.groupBy(side.alias("b")).agg(F.max("count").alias("most"))
    known = materialise(counts.join(best, side == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "pairs")
    sums = links.join(few(known, 500_000), "pair").groupBy(F.col("row").alias("_row")).agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    out = heads.drop("pairs").join(sums, F.col("row") == F.col("_row"), "left")
    zero = F.lit(0).cast("long")
    return out.select(*[F.col(k).alias(c) for c, k in zip(carry, keys)], "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
