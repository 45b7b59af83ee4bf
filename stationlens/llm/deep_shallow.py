"""Deep-shallow sorting of byte strings.

Shallow part: multikey quicksort (Bentley and Sedgewick 1997) on symbols of eight bytes. A
range of strings equal so far is parted by the next symbol of a pivot into smaller, equal
and greater; the equal ones go on with the symbol after it, down to a shallow depth. Short
ranges are sorted at once. Deep part: what is still
equal shares a long prefix, and comparing it byte by byte would go over that prefix again
and again. Those groups are ordered by a blind trie instead: a string is led down by the
branching bytes alone, compared once with the string it ends at, and hung in at the depth
where the two differ.
"""

from __future__ import annotations

import numpy as np

SYMBOL = 8


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """Orders distinct strings; nodes are [depth, children by byte, any string below]."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | int | None = None
        for number in range(len(strings)):
            self._insert(number)

    def _insert(self, number: int) -> None:
        text = self.strings[number]
        if self.root is None:
            self.root = number
            return
        node, path = self.root, []
        while not isinstance(node, int):
            path.append(node)
            depth = node[0]
            node = node[1].get(text[depth] if depth < len(text) else -1, node[2])  # blind where no byte fits
        other = self.strings[node]
        depth = common_prefix(text, other)
        mine = text[depth] if depth < len(text) else -1
        theirs = other[depth] if depth < len(other) else -1
        above, below = None, self.root
        for step in path:
            if step[0] > depth:
                break
            if step[0] == depth:
                step[1][mine] = number
                return
            above = step
            below = step[1][text[step[0]]]
        fresh = [depth, {theirs: below, mine: number}, number]
        if above is None:
            self.root = fresh
        else:
            above[1][text[above[0]]] = fresh

    def ordered(self) -> tuple[list[int], list[int]]:
        """Numbers in ascending order, and the common prefix of each with the one before (0 for the first)."""
        order, prefixes = [], []
        stack = [(self.root, 0)]
        while stack:
            node, depth = stack.pop()
            if isinstance(node, int):
                order.append(node)
                prefixes.append(depth)
                continue
            children = [node[1][b] for b in sorted(node[1])]
            stack += [(child, node[0]) for child in children[:0:-1]]
            stack.append((children[0], depth))
        return order, prefixes


#: Ranges up to this length are sorted without further parting.
SHORT = 256


def multikey_quicksort(keys: np.ndarray) -> np.ndarray:
    """The order of the rows of ``keys`` by their columns; equal rows keep their order."""
    order = np.arange(len(keys))
    depth = keys.shape[1]
    todo = [(0, len(keys), 0)]
    while todo:
        low, high, at = todo.pop()
        if at == depth or high - low < 2:
            continue
        part = order[low:high]
        if len(part) <= SHORT:
            order[low:high] = part[np.lexsort(keys[part, at:].T[::-1])]
            continue
        symbol = keys[part, at]
        # The median of nine symbols spread over the range.
        pivot = np.sort(symbol[np.linspace(0, len(symbol) - 1, 9).astype(np.int64)])[4]
        less, equal = symbol < pivot, symbol == pivot
        order[low:high] = np.concatenate([part[less], part[equal], part[~(less | equal)]])
        middle = low + int(less.sum())
        end = middle + int(equal.sum())
        todo += [(low, middle, at), (middle, end, at + 1), (end, high, at)]
    return order


def deep_shallow(rows: np.ndarray, lengths: np.ndarray, groups: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of distinct strings within their groups, and common prefixes with the string before.

    ``rows`` holds the strings zero-padded to a common width, ``lengths`` their lengths,
    ``groups`` a number each. The result is sorted by group, then string; the first of a
    group has common prefix -1.
    """
    n, width = rows.shape
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.zeros((n, -(-width // SYMBOL) * SYMBOL), np.uint8)
    padded[:, :width] = rows
    symbols = padded.view(">u8").astype(np.uint64)
    shallow_symbols = max(1, min(shallow // SYMBOL, symbols.shape[1]))
    order = multikey_quicksort(np.column_stack([groups.astype(np.uint64), symbols[:, :shallow_symbols]]))
    prefix = np.full(n, -1, np.int64)
    same = groups[order][1:] == groups[order][:-1]
    tied = same.copy()
    for s in range(shallow_symbols):
        a, b = symbols[order[1:], s], symbols[order[:-1], s]
        differ = same & (prefix[1:] < 0) & (a != b)
        where = np.flatnonzero(differ)
        byte = (padded[order[where + 1], s * SYMBOL : (s + 1) * SYMBOL] != padded[order[where], s * SYMBOL : (s + 1) * SYMBOL]).argmax(1)
        prefix[where + 1] = s * SYMBOL + byte
        tied &= a == b
    # Runs of strings equal down to the shallow depth.
    edge = np.flatnonzero(np.diff(np.concatenate([[0], tied.view(np.int8), [0]])))
    raw = rows.tobytes()
    sizes = lengths.tolist()
    for first, last in zip(edge[::2].tolist(), edge[1::2].tolist()):
        members = order[first : last + 1]
        strings = [raw[i * width : i * width + sizes[i]] for i in members.tolist()]
        found, common = BlindTrie(strings).ordered()
        order[first : last + 1] = members[found]
        prefix[first + 1 : last + 1] = common[1:]
    # Padding is not part of a string.
    inside = np.flatnonzero(prefix > 0)
    prefix[inside] = np.minimum(prefix[inside], np.minimum(lengths[order[inside]], lengths[order[inside - 1]]))
    return order, prefix
