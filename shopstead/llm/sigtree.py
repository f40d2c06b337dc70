"""Signature trees: dual traversal of two trees of sets finds pairs whose Jaccard similarity reaches a ratio."""

from __future__ import annotations

import numpy as np

from .common import Forest

#: Bits of a set's signature, sets in a leaf.
BITS, LEAF = 1024, 16


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(sets), BITS), bool)
    for i, s in enumerate(sets):
        out[i, (s & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(out, axis=1).view(np.uint64)


class Node:
    """Sets lo..hi of a block: the OR and AND of their signatures and the range of their sizes."""

    __slots__ = ("lo", "hi", "any", "all", "least", "most", "kids")

    def __init__(self, sig: np.ndarray, sizes: np.ndarray, lo: int, hi: int):
        self.lo, self.hi = lo, hi
        if hi - lo <= LEAF:
            self.kids = ()
            self.any, self.all = np.bitwise_or.reduce(sig[lo:hi]), np.bitwise_and.reduce(sig[lo:hi])
            self.least, self.most = int(sizes[lo:hi].min()), int(sizes[lo:hi].max())
        else:
            mid = (lo + hi) // 2
            self.kids = a, b = Node(sig, sizes, lo, mid), Node(sig, sizes, mid, hi)
            self.any, self.all = a.any | b.any, a.all & b.all
            self.least, self.most = min(a.least, b.least), max(a.most, b.most)


class Block:
    """Sets ordered by size class, then by their least element, which brings near copies together."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        first = np.fromiter((s[0] for s in sets), np.uint64, len(sets))
        order = np.lexsort((first, (np.log(sizes) / np.log(1 / 0.85)).astype(np.int64)))
        self.ids = [ids[i] for i in order]
        self.sets = [sets[i] for i in order]
        self.sizes = sizes[order]
        self.sig = signatures(self.sets)
        self.bits = np.bitwise_count(self.sig).sum(axis=1, dtype=np.int64)
        self.root = Node(self.sig, self.sizes, 0, len(ids))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sorted sets have in common."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")  # merges the two runs
    return int(np.count_nonzero(both[1:] == both[:-1]))


def apart(a: Node, b: Node, num: int, den: int) -> bool:
    """Whether no set of a and set of b can reach the ratio, by sizes and by elements that the other side lacks."""
    if den * a.most < num * b.least or den * b.most < num * a.least:
        return True
    da, db = int(np.bitwise_count(a.all & ~b.any).sum()), int(np.bitwise_count(b.all & ~a.any).sum())
    return den * da + num * db > (den - num) * a.most or den * db + num * da > (den - num) * b.most


def links(x: Block, y: Block, num: int, den: int):
    """(id, id) pairs with den * |intersection| >= num * |union| that connect all such pairs between x and y (x may be
    y): a pair is passed over only when links found before connect it already."""
    same = x is y
    n = len(x.ids)
    forest = Forest(n if same else n + len(y.ids))
    shift = 0 if same else n
    stack = [(x.root, y.root)]
    while stack:
        a, b = stack.pop()
        if apart(a, b, num, den):
            continue
        if a.kids or b.kids:
            if same and a is b:
                stack += [(a.kids[0], a.kids[1]), (a.kids[1], a.kids[1]), (a.kids[0], a.kids[0])]
            elif a.kids and (not b.kids or a.hi - a.lo >= b.hi - b.lo):
                stack += [(k, b) for k in a.kids]
            else:
                stack += [(a, k) for k in b.kids]
            continue
        common = x.sig[a.lo : a.hi].T[:, :, None] & y.sig[b.lo : b.hi].T[:, None, :]
        common = np.bitwise_count(common).sum(axis=0, dtype=np.int64)
        di, dj = x.bits[a.lo : a.hi, None] - common, y.bits[b.lo : b.hi] - common
        near = (den * di + num * dj <= (den - num) * x.sizes[a.lo : a.hi, None]) & (den * dj + num * di <= (den - num) * y.sizes[b.lo : b.hi])
        if same and a is b:
            near = np.triu(near, 1)
        for i, j in zip(*(at.tolist() for at in np.nonzero(near))):
            i, j = a.lo + i, b.lo + j
            if forest.find(i) == forest.find(shift + j):
                continue
            common = overlap(x.sets[i], y.sets[j])
            if den * common >= num * (int(x.sizes[i]) + int(y.sizes[j]) - common):
                forest.union(i, shift + j)
                yield x.ids[i], y.ids[j]
