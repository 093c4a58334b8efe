"""Sums over all segmentations of words into vocabulary pieces, for many words at once in numpy.

A word is the mark of a word's start and its characters. Its segmentations are the paths of
a graph whose nodes are places between characters and whose edges are the pieces that stand
there; a character without a piece of its own is an edge of the class OTHER. The forward
pass sums the probabilities of all paths, forward and backward together give the expected
number of times each piece is used.

Words longer than PART characters are taken in parts. Probabilities are scaled by SCALE for
each character, so that the smallest product of PART characters stays a normal number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from panelloom.llm.vocabularies import pieces_model

MARK = "▁"
PART = 48
SCALE = 1024.0
#: Characters handled at once.
BLOCK = 1 << 18
POINT_BITS = 21


def is_word_piece(piece: str) -> bool:
    """Lower-case letters, after the mark or not, or the mark alone."""
    body = piece[1:] if piece.startswith(MARK) else piece
    return piece == piece.lower() and (body.isalpha() or piece == MARK)


class Trie:
    """The pieces as a trie whose transitions lie in one open-addressed table."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        ids: dict[tuple[int, int], int] = {}
        ends = {}
        for number, piece in enumerate(pieces):
            node = 0
            for char in piece:
                node = ids.setdefault((node, ord(char)), len(ids) + 1)
            ends[node] = number
        self.piece_at = np.full(len(ids) + 1, -1, dtype=np.int64)
        self.piece_at[list(ends)] = list(ends.values())
        self.bits = max(4, (4 * len(ids)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.nodes = np.full(1 << self.bits, -1, dtype=np.int64)
        keys = np.array([node << POINT_BITS | point for node, point in ids], dtype=np.int64)
        for key, slot, node in zip(keys.tolist(), self.slots(keys).tolist(), ids.values()):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.nodes[slot] = key, node

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, nodes: np.ndarray, points: np.ndarray) -> np.ndarray:
        """The next node of each, -1 where the trie ends."""
        keys = nodes << POINT_BITS | points
        slots, out = self.slots(keys), np.full(len(keys), -1, dtype=np.int64)
        there = self.keys[slots]
        hit = there == keys
        out[hit] = self.nodes[slots[hit]]
        open_ = np.flatnonzero(~hit & (there >= 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slots[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.nodes[slots[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out


@lru_cache(maxsize=2)
def trie_of(file: str) -> Trie:
    model = pieces_model(file)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i))
    return Trie(sorted({p for p in pieces if is_word_piece(p)}))


@dataclass(frozen=True)
class Lattice:
    """Edges of the graphs of parts of words; nodes of part i begin at first[i] and end at last[i].

    Edges are grouped by the place of their end in the part and by length: no two of a group
    share an end or a start. `bounds` holds the groups' limits, ends ascending.
    """

    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    length: np.ndarray
    bounds: np.ndarray
    first: np.ndarray
    last: np.ndarray
    sizes: np.ndarray
    nodes: int

    def scaled(self, probability: np.ndarray) -> np.ndarray:
        """probability: of each edge, in the last axis."""
        return probability * SCALE**self.length

    def forward(self, edge: np.ndarray) -> np.ndarray:
        """edge: (..., edges), scaled. Sums of all paths from a part's begin to each node."""
        alpha = np.zeros((*edge.shape[:-1], self.nodes))
        alpha[..., self.first] = 1
        for a, b in zip(self.bounds[:-1], self.bounds[1:]):
            alpha[..., self.end[a:b]] += alpha[..., self.start[a:b]] * edge[..., a:b]
        return alpha

    def backward(self, edge: np.ndarray) -> np.ndarray:
        """Sums of all paths from each node to its part's end."""
        beta = np.zeros((*edge.shape[:-1], self.nodes))
        beta[..., self.last] = 1
        for a, b in zip(self.bounds[-2::-1], self.bounds[:0:-1]):
            beta[..., self.start[a:b]] += beta[..., self.end[a:b]] * edge[..., a:b]
        return beta

    def log_totals(self, alpha: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(alpha[..., self.last], 1e-300)) - self.sizes * np.log(SCALE)


def lattice(points: np.ndarray, begins: np.ndarray, trie: Trie) -> Lattice:
    """points: characters of consecutive parts, which begin at `begins` (one more at the end)."""
    sizes = np.diff(begins)
    part = np.repeat(np.arange(len(sizes)), sizes)
    stop = begins[1:][part]
    at, node = np.arange(len(points)), np.zeros(len(points), dtype=np.int64)
    starts, pieces, lengths, k = [], [], [], 0
    alone = np.zeros(len(points), dtype=bool)
    while len(at):
        node = trie.step(node, points[at + k])
        k += 1
        on = node >= 0
        at, node = at[on], node[on]
        piece = trie.piece_at[node]
        is_piece = piece >= 0
        if k == 1:
            alone[at[is_piece]] = True
        starts.append(at[is_piece])
        pieces.append(piece[is_piece])
        lengths.append(np.full(int(is_piece.sum()), k))
        inside = at + k < stop[at]
        at, node = at[inside], node[inside]
    other = np.flatnonzero(~alone)
    starts.append(other)
    pieces.append(np.full(len(other), len(trie.pieces)))
    lengths.append(np.ones(len(other), dtype=np.int64))
    start, piece, length = np.concatenate(starts), np.concatenate(pieces), np.concatenate(lengths).astype(np.int64)
    group = (start + length - begins[part[start]]) * (PART + 1) + length
    order = np.argsort(group, kind="stable")
    start, piece, length, group = start[order], piece[order], length[order], group[order]
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
    shift = part[start]
    return Lattice(
        start + shift, start + length + shift, piece, length, bounds,
        begins[:-1] + np.arange(len(sizes)), begins[1:] + np.arange(len(sizes)), sizes, len(points) + len(sizes),
    )


def parts_of(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """In blocks: the characters of the words' parts, where parts begin, and the word of each part."""
    at = 0
    while at < len(words):
        sizes, to = [], at
        while to < len(words) and (to == at or sum(sizes[-1:]) < BLOCK):
            sizes.append((sizes[-1] if sizes else 0) + len(words[to]) + 1)
            to += 1
        joined = MARK + MARK.join(words[at:to])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        begins = np.array([0, *sizes])
        lengths = np.diff(begins)
        count = -(-lengths // PART)
        word = np.repeat(np.arange(to - at), count)
        step = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
        yield points, np.append(begins[:-1][word] + step * PART, len(points)), word + at
        at = to


def log_probabilities(words: list[str], probability: np.ndarray, trie: Trie) -> np.ndarray:
    """words x models: log of the sum over all segmentations; probability: models x (pieces + OTHER)."""
    out = np.zeros((len(words), len(probability)))
    for points, begins, word in parts_of(words):
        graph = lattice(points, begins, trie)
        totals = graph.log_totals(graph.forward(graph.scaled(probability[:, graph.piece])))
        np.add.at(out, word, totals.T)
    return out


def expected_counts(
    words: list[str], counts: np.ndarray, model: np.ndarray, probability: np.ndarray, trie: Trie
) -> np.ndarray:
    """models x (pieces + OTHER): how often pieces are used in `counts` copies of each word under its model."""
    used = np.zeros(probability.size)
    width = probability.shape[1]
    for points, begins, word in parts_of(words):
        graph = lattice(points, begins, trie)
        part_of_edge = np.searchsorted(graph.first, graph.start, "right") - 1
        own = model[word[part_of_edge]]
        edge = graph.scaled(probability[own, graph.piece])
        alpha, beta = graph.forward(edge), graph.backward(edge)
        whole = np.maximum(alpha[graph.last], 1e-300)
        share = alpha[graph.start] * edge * beta[graph.end] / whole[part_of_edge]
        used += np.bincount(own * width + graph.piece, share * counts[word[part_of_edge]], probability.size)
    return used.reshape(probability.shape)
