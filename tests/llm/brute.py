"""Plain Python versions of the operators' contracts, row by row and pair by pair, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def line_dedup(docs, min_chars=20, min_docs=3):
    """docs: (doc_id, text) pairs -> {(doc_id, n_lines, n_dropped, sha)} as a sorted list."""
    holders = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if d is not None:
                holders[line.strip(BLANK).translate(LOWER)].add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        stay = []
        for line in lines:
            k = line.strip(BLANK).translate(LOWER)
            if d is None or len(k) < min_chars or len(holders[k]) < min_docs or max(holders[k]) == d:
                stay.append(line)
        out.append((d, len(lines), len(lines) - len(stay), sha("\n".join(stay))))
    return out


def rule_counts(t):
    w = WORD.findall(t or "")
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered)


def targets(sizes, weights=(5, 2, 1), limit=3):
    """sizes: {source: words} -> {source: target} by resharing round after round."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    free, left, target = sum(sizes.values()), set(order), {}
    while left:
        total = sum(weight[s] for s in left)
        over = {s for s in left if free * weight[s] / total > limit * sizes[s]}
        if not over:
            return target | {s: free * weight[s] / total for s in left}
        for s in over:
            target[s] = limit * sizes[s]
        free -= sum(target[s] for s in over)
        left -= over
    return target


def repeats(docs, n=400):
    """docs: (doc_id, text) -> rows of op5: bytes covered by an n-byte string that starts anywhere else too."""
    raw = [(d, (t or "").encode()) for d, t in docs]
    starts = Counter(r[i : i + n] for _, r in raw for i in range(len(r) - n + 1))
    out = []
    for d, r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - n + 1):
            if starts[r[i : i + n]] > 1:
                gone[i : i + n] = b"\x01" * n
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((d, len(r), sum(gone), spans, sha(bytes(b for b, g in zip(r, gone) if not g))))
    return out


def shingles(t):
    w = WORD.findall((t or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def components(ids, links):
    at = {i: i for i in ids}

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        at[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def jaccard(docs):
    """docs: (doc_id, text) -> {doc_id: (n_shingles, component)}"""
    sets = {d: shingles(t) for d, t in docs}
    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    links = set()
    for d, s in sets.items():
        for o, k in Counter(o for g in s for o in holders[g] if o < d).items():
            if 100 * k >= 75 * (len(s) + len(sets[o]) - k):
                links.add((o, d))
    comp = components(sets, links)
    return {d: (len(s), comp[d]) for d, s in sets.items()}
