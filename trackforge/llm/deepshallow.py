"""Deep-shallow sorting of byte strings, with the common prefix of neighbours.

Multikey quicksort, eight bytes a symbol, orders the strings to a shallow depth. Groups that still
share a prefix then go to blind tries: a trie that keeps only branching depths and bytes, is
descended blindly to some leaf, and compares with that one string, whatever the size of the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes to which quicksort goes.
SHALLOW = 32


def _common_bytes(x: np.ndarray) -> np.ndarray:
    """Leading zero bytes of big-endian words."""
    out = np.zeros(len(x), np.int64)
    for k in range(1, 9):
        out += (x >> np.uint64(64 - 8 * k)) == 0
    return out


class BlindTrie:
    """Strings of one length, as integers. An inner node is [depth, {byte: child}], a leaf the string."""

    def __init__(self, width: int):
        self.width, self.root = width, None

    def _byte(self, s: int, depth: int) -> int:
        return s >> 8 * (self.width - 1 - depth) & 255

    def insert(self, s: int) -> None:
        if self.root is None:
            self.root = s
            return
        node = self.root
        while type(node) is list:  # blindly: only the bytes at branching depths are looked at
            child = node[1].get(self._byte(s, node[0]))
            node = next(iter(node[1].values())) if child is None else child
        if s == node:
            return
        depth = self.width - ((s ^ node).bit_length() + 7) // 8  # the only comparison
        above, node = None, self.root
        while type(node) is list and node[0] < depth:
            above, node = node, node[1][self._byte(s, node[0])]
        own = self._byte(s, depth)
        if type(node) is list and node[0] == depth:
            node[1][own] = s
            return
        leaf = node
        while type(leaf) is list:
            leaf = next(iter(leaf[1].values()))
        new = [depth, {self._byte(leaf, depth): node, own: s}]
        if above is None:
            self.root = new
        else:
            above[1][self._byte(s, above[0])] = new

    def walk(self) -> Iterator[tuple[int, int]]:
        """Strings in order, each with the prefix it shares with the one before (the first: 0)."""
        stack, lcp = [(self.root, 0)], 0
        while stack:
            node, lcp = stack.pop()
            if type(node) is not list:
                yield node, lcp
                continue
            children = [node[1][b] for b in sorted(node[1])]
            stack += [(c, node[0]) for c in reversed(children[1:])] + [(children[0], lcp)]


def deep_shallow(rows: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): numbers of the rows (bytes, of a width divisible by 8) sorted by group and string, and
    the bytes that each shares with the row before; -1 in front of a group."""
    n, width = rows.shape
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    own = group[order]
    common = np.where(np.diff(own, prepend=own[:1] - 1) != 0, -1, width)
    open_, depth = common == width, 0  # not told apart from the row before yet
    while depth < min(shallow, width) // 8 and open_.any():
        number = np.cumsum(~open_)
        active = np.flatnonzero(open_ | np.append(open_[1:], False))
        key = words[order[active], depth]
        by = np.lexsort((key, number[active]))
        order[active], key = order[active][by], key[by]
        inside = open_[active]
        differ = np.append(np.uint64(0), key[1:] ^ key[:-1])
        split = inside & (differ != 0)
        common[active[split]] = 8 * depth + _common_bytes(differ[split])
        open_[active[split]] = False
        depth += 1
    if 8 * depth < width and open_.any():
        first = np.flatnonzero(~open_ & np.append(open_[1:], False))
        end = np.searchsorted(np.flatnonzero(~open_), first, side="right")
        ends = np.append(np.flatnonzero(~open_), n)[end]
        deep = np.ascontiguousarray(rows[:, 8 * depth :])
        for a, b in zip(first.tolist(), ends.tolist(), strict=True):
            same: dict[int, list[int]] = {}
            for i in order[a:b].tolist():
                same.setdefault(int.from_bytes(deep[i].tobytes(), "big"), []).append(i)
            if len(same) == 1:
                continue
            trie = BlindTrie(width - 8 * depth)
            for s in same:
                trie.insert(s)
            at = a
            for s, lcp in trie.walk():
                own_rows = same[s]
                order[at : at + len(own_rows)] = own_rows
                if at > a:
                    common[at] = 8 * depth + lcp
                common[at + 1 : at + len(own_rows)] = width
                at += len(own_rows)
    return order, common
