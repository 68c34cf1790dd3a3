"""Deep-shallow suffix sorting (after Manzini and Ferragina) of chosen suffixes, compared over their first bytes.

Multikey quicksort takes eight bytes as one character and refines groups of equal prefixes down to a shallow depth;
what still shares that prefix is ordered by blind tries, which branch only where strings differ.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 32


class BlindTrie:
    """Strings of one length, ordered; inner nodes hold a depth and one child for each byte there, no edge labels."""

    def __init__(self) -> None:
        self.root: list | None = None

    def insert(self, text: bytes, item: int) -> None:
        if self.root is None:
            self.root = [-1, text, [item]]
            return
        node = self.root
        while node[0] >= 0:  # blind descent: a missing byte may take any way
            children = node[1]
            node = children.get(text[node[0]]) or next(iter(children.values()))
        other = node[1]
        differ = int.from_bytes(text, "big") ^ int.from_bytes(other, "big")
        if not differ:
            node[2].append(item)
            return
        depth = len(text) - (differ.bit_length() + 7) // 8
        parent, node = None, self.root
        while 0 <= node[0] < depth:
            parent, node = node, node[1][text[node[0]]]
        leaf = [-1, text, [item]]
        if node[0] == depth:
            node[1][text[depth]] = leaf
            return
        inner = [depth, {other[depth]: node, text[depth]: leaf}]
        if parent is None:
            self.root = inner
        else:
            parent[1][text[parent[0]]] = inner

    def leaves(self) -> list[list[int]]:
        """Items of each distinct string, in the order of the strings."""
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] < 0:
                out.append(node[2])
            else:
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
        return out


def suffix_order(buffer: np.ndarray, starts: np.ndarray, limit: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts``, and for each in that order its class: equal over ``limit`` bytes.

    ``buffer`` must hold limit + 8 bytes from every start on.
    """
    n = len(starts)
    order, group = np.arange(n), np.zeros(n, np.int64)
    if not n:
        return order, group
    view = np.ndarray((len(buffer) - 7,), ">u8", np.ascontiguousarray(buffer), strides=(1,))

    def word(at: np.ndarray, depth: int) -> np.ndarray:
        x = view[at + depth].astype(np.uint64)
        return x >> np.uint64(8 * (depth + 8 - limit)) if depth + 8 > limit else x

    active, depth = np.ones(n, bool), 0
    while depth < min(shallow, limit):
        at = np.flatnonzero(active)
        if not len(at):
            break
        key = word(starts[order[at]], depth)
        within = np.lexsort((key, group[at]))
        key, order[at] = key[within], order[at][within]
        new = np.ones(len(at), bool)
        new[1:] = (group[at][1:] != group[at][:-1]) | (key[1:] != key[:-1])
        group[at] = at[np.flatnonzero(new)][np.cumsum(new) - 1]  # a group's number is its first place
        size = np.bincount(group, minlength=n)
        active = size[group] > 1
        depth += 8
    if depth < limit and active.any():
        at = np.flatnonzero(active)
        head = starts[order[group[at]]]
        same = np.ones(len(at), bool)
        for d in range(depth, limit, 8):
            same &= word(starts[order[at]], d) == word(head, d)
        mixed = np.unique(group[at][~same])
        if len(mixed):
            size = np.bincount(group, minlength=n)
            raw = buffer.tobytes()
            for g in mixed.tolist():
                members = order[g : g + size[g]].copy()
                trie = BlindTrie()
                for i in members.tolist():
                    s = int(starts[i])
                    trie.insert(raw[s + depth : s + limit], i)
                place = g
                for leaf in trie.leaves():
                    order[place : place + len(leaf)] = leaf
                    group[place : place + len(leaf)] = place
                    place += len(leaf)
    return order, group
