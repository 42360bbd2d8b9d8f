"""Deep-shallow sorting of many short strings at a time, and blind tries."""

from __future__ import annotations

import numpy as np

#: Words of eight bytes that the multikey quicksort looks at before blind tries take over.
SHALLOW_WORDS = 4


class BlindTrie:
    """Strings of one length in order; a node keeps only the place where its strings branch."""

    def __init__(self):
        self.root = None

    def insert(self, s: bytes, item: int) -> None:
        if self.root is None:
            self.root = [s, [item]]  # a leaf: string, items
            return
        node = self.root
        while isinstance(node[1], dict):  # down without looking at what is skipped
            children = node[1]
            node = children.get(s[node[0]]) or next(iter(children.values()))
        leaf = node[0]
        if leaf == s:
            node[1].append(item)
            return
        at = next(i for i, (x, y) in enumerate(zip(s, leaf, strict=True)) if x != y)
        parent, node = None, self.root
        while isinstance(node[1], dict) and node[0] < at:
            parent, node = node, node[1][s[node[0]]]
        if isinstance(node[1], dict) and node[0] == at:
            node[1][s[at]] = [s, [item]]
            return
        branch = [at, {s[at]: [s, [item]], leaf[at]: node}]
        if parent is None:
            self.root = branch
        else:
            parent[1][s[parent[0]]] = branch

    def items(self) -> list[int]:
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node[1], dict):
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                out += node[1]
        return out


def deep_shallow(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of bytes, and the common prefix of each with its predecessor (first: 0).

    Multikey quicksort, a word of eight bytes for a character and all groups of a depth at once,
    goes to SHALLOW_WORDS; what then still has a longer common prefix goes into a blind trie, a
    group at a time. Groups of equal rows need no trie.
    """
    n, width = rows.shape
    order = np.arange(n)
    slots, group = np.arange(n), np.zeros(n, np.int64)
    words = -(-width // 8)
    padded = np.zeros((n, 8 * words), np.uint8)
    padded[:, :width] = rows
    key = padded.view(">u8").astype(np.uint64)
    for depth in range(min(SHALLOW_WORDS, words)):
        if not len(slots):
            break
        own = order[slots]
        w = key[own, depth]
        to = np.lexsort((w, group))
        own, w, group = own[to], w[to], group[to]
        order[slots] = own
        new = np.ones(len(slots), bool)
        new[1:] = (group[1:] != group[:-1]) | (w[1:] != w[:-1])
        group = np.cumsum(new)
        size = np.bincount(group)
        on = size[group] > 1
        slots, group = slots[on], group[on]
    if len(slots) and words > SHALLOW_WORDS:
        rest = key[order[slots], SHALLOW_WORDS:]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        differs = np.zeros(len(slots), bool)
        differs[1:] = (rest[1:] != rest[:-1]).any(axis=1) & (group[1:] == group[:-1])
        deep = np.logical_or.reduceat(differs, first)
        last = np.append(first[1:], len(slots))
        for a, b in zip(first[deep].tolist(), last[deep].tolist(), strict=True):
            own = order[slots[a:b]]
            trie = BlindTrie()
            for i in own.tolist():
                trie.insert(padded[i, 8 * SHALLOW_WORDS :].tobytes(), i)
            order[slots[a:b]] = trie.items()
    lcp = np.zeros(n, np.int64)
    if n > 1:
        for a in range(1, n, 65_536):
            own = order[a - 1 : a + 65_536]
            unequal = rows[own[1:]] != rows[own[:-1]]
            lcp[a : a + len(own) - 1] = np.where(unequal.any(axis=1), unequal.argmax(axis=1), width)
    return order, lcp
