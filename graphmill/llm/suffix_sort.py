"""Deep-shallow sorting of sampled suffixes and the windows that they show to be repeated.

Multikey quicksort works on 8-byte characters for all tied groups at once, down to a
shallow depth. Groups that still tie there have long common prefixes; a blind trie per
group orders them: it branches on single bytes only, so that inserting a string takes one descent
and one comparison with one stored string.
"""

from __future__ import annotations

import numpy as np

from graphmill.llm.textkit import BYTE_CODE, Poly, mix64, ragged

SHALLOW = 32
#: Distance of the sampled suffixes of a segment; windows that start up to STEP - 1 bytes before one are checked with it.
STEP = 32


def _words(buffer: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Eight bytes from each position as a big-endian number; bytes from ``end`` on are 0."""
    out = np.zeros(len(at), np.uint64)
    for j in range(8):
        inside = at + j < end
        out |= np.where(inside, buffer[np.minimum(at + j, len(buffer) - 1)], 0).astype(np.uint64) << np.uint64(56 - 8 * j)
    return out


def _equal_bytes(x: np.ndarray) -> np.ndarray:
    """Leading zero bytes of each number (of an exclusive or: the equal bytes)."""
    out = np.zeros(len(x), np.int64)
    for j in range(1, 9):
        out += (x >> np.uint64(64 - 8 * j)) == 0 if j < 8 else x == 0
    return out


class BlindTrie:
    """Patricia trie over byte strings; nodes are [depth, {byte or -1: child}], leaves are lists of string numbers."""

    def __init__(self, strings: list[bytes], size: int):
        self.strings, self.bits = strings, 8 * size
        self.numbers = [int.from_bytes(s.ljust(size, b"\0"), "big") for s in strings]
        self.root: list = [0]
        for i in range(1, len(strings)):
            self.insert(i)

    def common(self, i: int, j: int) -> int:
        same = (self.bits - (self.numbers[i] ^ self.numbers[j]).bit_length()) // 8
        return min(same, len(self.strings[i]), len(self.strings[j]))

    def insert(self, i: int) -> None:
        x = self.strings[i]
        node = self.root
        while isinstance(node, tuple):  # blind descent to some leaf
            depth, children = node
            node = children.get(x[depth] if depth < len(x) else -1) or next(iter(children.values()))
        leaf = node[0]
        same = self.common(i, leaf)
        y = self.strings[leaf]
        if same == len(x) == len(y):
            node.append(i)
            return
        mine, other = x[same] if same < len(x) else -1, y[same] if same < len(y) else -1
        parent, key, node = None, None, self.root
        while isinstance(node, tuple) and node[0] < same:
            parent, key = node, x[node[0]]
            node = node[1][key]
        if isinstance(node, tuple) and node[0] == same:
            node[1][mine] = [i]
            return
        branch = (same, {other: node, mine: [i]})
        if parent is None:
            self.root = branch
        else:
            parent[1][key] = branch

    def ordered(self) -> tuple[list[int], list[int]]:
        """String numbers in order, and the common prefix of each with the one before (0 for the first)."""
        order: list[int] = []
        shared: list[int] = []
        todo: list[tuple[object, int]] = [(self.root, 0)]
        while todo:
            node, before = todo.pop()
            if isinstance(node, tuple):
                depth, children = node
                keys = sorted(children)
                todo += [(children[k], depth if n else before) for n, k in reversed(list(enumerate(keys)))]
            else:
                order += node
                shared += [before, *[len(self.strings[node[0]])] * (len(node) - 1)]
        return order, shared


def sort_suffixes(buffer: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): suffixes buffer[start:end] sorted within their groups; lcp with the one before, -1 at the first of a group."""
    slots = np.argsort(group, kind="stable")
    lcp = np.zeros(len(slots), np.int64)
    new = np.ones(len(slots), bool)
    new[1:] = group[slots][1:] != group[slots][:-1]
    lcp[new] = -1
    first = np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))
    for deep in range(0, SHALLOW, 8):
        sizes = np.bincount(first, minlength=len(slots))
        active = np.flatnonzero(sizes[first] > 1)
        if not len(active):
            return slots, lcp
        word = _words(buffer, start[slots[active]] + deep, end[slots[active]])
        order = np.lexsort((word, first[active]))
        slots[active], word = slots[active[order]], word[order]
        split = np.zeros(len(active), bool)
        split[1:] = (first[active][1:] == first[active][:-1]) & (word[1:] != word[:-1])
        lcp[active[split]] = deep + _equal_bytes(word[split] ^ word[np.flatnonzero(split) - 1])
        new = first == np.arange(len(slots))
        new[active[split]] = True
        first = np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))
    sizes = np.bincount(first, minlength=len(slots))
    raw = buffer.tobytes()
    for at in np.flatnonzero(sizes > 1).tolist():
        members = slots[at : at + sizes[at]]
        trie = BlindTrie([raw[a:b] for a, b in zip(start[members].tolist(), end[members].tolist(), strict=True)], depth)
        order, shared = trie.ordered()
        slots[at : at + sizes[at]] = members[order]
        lcp[at + 1 : at + sizes[at]] = shared[1:]
    length = end[slots] - start[slots]
    lcp[1:] = np.minimum(lcp[1:], np.minimum(length[1:], length[:-1]))
    return slots, lcp


def suffix_places(rel: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, step) of the sampled suffixes: they start ``step`` times STEP bytes before the anchor, which lies ``rel`` bytes into the segment."""
    low = (rel - windows + 1) // STEP
    seg, inside = ragged(rel // STEP - low + 1)
    return seg, low[seg] + inside


def repeated_windows(buffer: np.ndarray, base: np.ndarray, anchor: np.ndarray, windows: np.ndarray, group: np.ndarray, copies: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window) of the ``size``-byte windows of segments that another segment of the group, or a copy of the segment, has too.

    Segment i lies at base[i] and has windows[i] window starts from there on; anchor[i] is
    the position of its anchor. Windows are equal only where they lie alike to the anchor.
    """
    seg, step = suffix_places(anchor - base, windows)
    start = anchor[seg] - STEP * step
    stop = base[seg] + windows[seg] - 1 + size
    end = np.minimum(start + size, stop)
    _, both = np.unique(np.stack([group[seg], step], axis=1), axis=0, return_inverse=True)
    slots, lcp = sort_suffixes(buffer, start, end, both.reshape(-1), size)
    near = lcp >= size - STEP + 1
    near[:-1] |= near[1:].copy()
    near |= copies[seg[slots]] > 1
    poly = Poly(BYTE_CODE[buffer])
    found_seg, found_window = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for left in range(STEP):
        run = np.cumsum(lcp < size - left)
        window = start[slots] - left - base[seg[slots]]
        use = np.flatnonzero(near & (window >= 0) & (window < windows[seg[slots]]))
        if not len(use):
            continue
        s = slots[use]
        key = mix64(run[use].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ poly.span(start[s] - left, start[s])
        _, inverse = np.unique(key, return_inverse=True)
        hit = np.bincount(inverse, copies[seg[s]])[inverse] >= 2
        found_seg.append(seg[s][hit])
        found_window.append(window[use][hit])
    return np.concatenate(found_seg), np.concatenate(found_window)
