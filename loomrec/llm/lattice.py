"""All segmentations of a word into pieces of a fixed vocabulary: log-space forward and backward recursion.

A word is its bytes behind one space, as pieces that begin a word do. Every single byte is a piece, so every word has
a segmentation. With piece probabilities that add up to 1, the marginals of all words add up to 1: a word goes on
until the next piece that begins with the space.

Many words are taken at once: pieces are found by walking one trie from every byte, and the recursion goes over
positions within the words.
"""

from __future__ import annotations

import numpy as np

BEGIN = b" "


def usable_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """The pieces of a SentencePiece model that lower-cased words can hold, as bytes, and probabilities from its scores.

    Scores of a merge vocabulary are minus a rank, so a piece weighs 1 / (2 - score), as ranked words usually do. Byte
    pieces and bytes that have no piece weigh as the last rank does."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    last = 2.0 + model.get_piece_size()
    found = {bytes([b]): 1 / last for b in range(256) if not 65 <= b <= 90}
    for k in range(model.get_piece_size()):
        if model.is_control(k) or model.is_unknown(k) or model.is_byte(k):
            continue
        piece = model.id_to_piece(k).replace("▁", " ").encode()
        if BEGIN not in piece[1:] and not any(65 <= b <= 90 for b in piece):
            found[piece] = 1 / (2 - model.get_score(k))
    pieces = sorted(found)
    weight = np.asarray([found[p] for p in pieces])
    return pieces, weight / weight.sum()


class Lattice:
    """The pieces as a trie, and the recursions over batches of words."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        nodes = {b"": 0}
        for p in pieces:
            for i in range(1, len(p) + 1):
                nodes.setdefault(p[:i], len(nodes))
        steps = sorted((nodes[x[:-1]] * 256 + x[-1], n) for x, n in nodes.items() if x)
        self.keys = np.asarray([k for k, _ in steps], np.int64)
        self.to = np.asarray([n for _, n in steps], np.int64)
        self.ends = np.full(len(nodes), -1, np.int64)
        self.ends[[nodes[p] for p in pieces]] = np.arange(len(pieces))

    def edges(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(from node, to node, piece, first node of each word, place of each node in its word); a word of n bytes has n + 2 nodes."""
        size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        first = np.cumsum(size) - size
        raw = np.frombuffer(b"".join(BEGIN + w + b"\0" for w in words), np.uint8).astype(np.int64)
        place = np.arange(len(raw)) - np.repeat(first, size)
        left = np.repeat(size, size) - 1 - place  # bytes from here to the word's end
        at, state, depth = np.flatnonzero(left), None, 0
        state = np.zeros(len(at), np.int64)
        out = []
        while len(at):
            key = state * 256 + raw[at + depth]
            k = np.searchsorted(self.keys, key)
            k[k == len(self.keys)] = 0
            good = self.keys[k] == key
            at, state, depth = at[good], self.to[k[good]], depth + 1
            piece = self.ends[state]
            whole = piece >= 0
            out.append((at[whole], at[whole] + depth, piece[whole]))
            on = left[at] > depth
            at, state = at[on], state[on]
        u, v, piece = (np.concatenate([o[i] for o in out]) if out else np.empty(0, np.int64) for i in range(3))
        return u, v, piece, first, place

    @staticmethod
    def _recursion(n: int, start: np.ndarray, frm: np.ndarray, to: np.ndarray, weight: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Log sums over all paths from start to every node; step is the order in which target nodes are reached."""
        total = np.full(n, -np.inf)
        total[start] = 0.0
        order = np.lexsort((to, step))
        frm, to, weight, step = frm[order], to[order], weight[order], step[order]
        new = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.empty(0, np.int64)
        cut = np.searchsorted(step[new], np.arange(step[-1] + 2)) if len(to) else [0]
        bound = np.r_[new, len(to)]
        for a, b in zip(cut[:-1], cut[1:]):
            if a < b:
                lo, hi = bound[a], bound[b]
                total[to[new[a:b]]] = np.logaddexp.reduceat(total[frm[lo:hi]] + weight[lo:hi], new[a:b] - lo)
        return total

    def marginals(self, words: list[bytes], logs: np.ndarray) -> np.ndarray:
        """The natural log probability of each word, over all segmentations, under logs of piece probabilities.

        A matrix of logs, one row for each class, gives a matrix with a column for each class."""
        if not words:
            return np.empty((0, *logs.shape[:-1]))
        u, v, piece, first, place = self.edges(words)
        last = np.r_[first[1:], len(place)] - 1
        found = [self._recursion(len(place), first, u, v, x[piece], place[v])[last] for x in np.atleast_2d(logs)]
        return np.stack(found, 1).reshape(len(words), *logs.shape[:-1])

    def expected(self, words: list[bytes], logs: np.ndarray) -> np.ndarray:
        """How often each piece is expected in these words, each word once."""
        if not words:
            return np.zeros(len(self.pieces))
        u, v, piece, first, place = self.edges(words)
        last = np.r_[first[1:], len(place)] - 1
        weight = logs[piece]
        forward = self._recursion(len(place), first, u, v, weight, place[v])
        size = np.diff(np.r_[first, len(place)])
        from_end = np.repeat(size, size) - 1 - place
        backward = self._recursion(len(place), last, v, u, weight, from_end[u])
        share = np.exp(forward[u] + weight + backward[v] - np.repeat(forward[last], size)[u])
        return np.bincount(piece, share, len(self.pieces))
