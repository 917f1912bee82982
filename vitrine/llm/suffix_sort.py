"""Deep-shallow sorting of strings: multikey quicksort to a shallow depth, then blind tries.

Multikey quicksort splits a group of strings by one byte at a time.  Below a shallow depth the strings that are still
together share long prefixes, and walking them byte by byte would cost their length again and again; a blind trie then
orders each such group.  It keeps only branching depths and bytes, so a string goes down on branching bytes alone and is
compared once, with the leaf that it ends at.
"""

from __future__ import annotations

#: Bytes beyond the common prefix that the quicksort looks at, and the smallest group that it is used for.
SHALLOW, SMALL = 12, 3


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    high = min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    low = 0  # a and b agree below low and differ somewhere below high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _byte(s: bytes, depth: int) -> int:
    """The byte at a depth, or -1 past the end: a prefix sorts before what it is a prefix of."""
    return s[depth] if depth < len(s) else -1


class BlindTrie:
    """Sorts strings that share a prefix of ``depth`` bytes.

    An inner node is [depth, {byte: child}], a leaf is the list of the numbers of equal strings, marked by None.
    """

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.top: list | None = None

    def insert(self, item: int) -> None:
        s = self.strings[item]
        if self.top is None:
            self.top = [None, [item]]
            return
        node = self.top
        while node[0] is not None:  # blindly: any child will do where the byte is new
            node = node[1].get(_byte(s, node[0])) or next(iter(node[1].values()))
        other = self.strings[node[1][0]]
        depth = common_prefix(s, other)
        if depth == len(s) == len(other):
            node[1].append(item)
            return
        above, node = None, self.top
        while node[0] is not None and node[0] < depth:
            above, node = node, node[1][_byte(s, node[0])]
        if node[0] == depth:
            node[1][_byte(s, depth)] = [None, [item]]
            return
        split = [depth, {_byte(s, depth): [None, [item]], _byte(other, depth): node}]
        if above is None:
            self.top = split
        else:
            above[1][_byte(s, above[0])] = split

    def ordered(self) -> list[int]:
        out, stack = [], [self.top]
        while stack:
            depth, below = stack.pop()
            if depth is None:
                out += below
            else:
                stack += [below[b] for b in sorted(below, reverse=True)]
        return out


def _quicksort(strings: list[bytes], items: list[int], depth: int, limit: int, out: list[int]) -> None:
    """Append the items in order; they agree below ``depth``."""
    while True:
        if len(items) < SMALL:
            out += sorted(items, key=strings.__getitem__)
            return
        if depth >= limit:
            trie = BlindTrie(strings)
            for item in items:
                trie.insert(item)
            out += trie.ordered()
            return
        keys = [_byte(strings[i], depth) for i in items]
        pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
        less = [i for i, k in zip(items, keys) if k < pivot]
        more = [i for i, k in zip(items, keys) if k > pivot]
        same = [i for i, k in zip(items, keys) if k == pivot]
        if less:
            _quicksort(strings, less, depth, limit, out)
        if pivot < 0:  # ended strings are all equal
            out += same
        elif same and not more:
            items, depth = same, depth + 1
            continue
        else:
            _quicksort(strings, same, depth + 1, limit, out)
        if not more:
            return
        items = more


def sort_strings(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Numbers of the strings in order, and the common prefix of each with the one before (0 for the first)."""
    order: list[int] = []
    if strings:
        shared = common_prefix(min(strings), max(strings))
        _quicksort(strings, list(range(len(strings))), shared, shared + SHALLOW, order)
    prefixes = [0] + [common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:])]
    return order, prefixes[: len(order)]
