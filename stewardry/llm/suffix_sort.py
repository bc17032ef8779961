"""Deep-shallow sorting of suffixes.

Multikey quicksort splits the suffixes by one character after the other down to a shallow
depth. Groups that still agree there are put in order by a blind trie, which looks at branching
characters only and compares each string with one other (Manzini and Ferragina, "Engineering a
lightweight suffix array construction algorithm", 2004).
"""

from __future__ import annotations

SHALLOW = 24


def common_prefix(x: bytes, y: bytes, start: int = 0) -> int:
    """Length of the longest common prefix; the first ``start`` bytes are known to agree."""
    end = min(len(x), len(y))
    if x[start:end] == y[start:end]:
        return end
    low, high = start, end
    while high - low > 1:
        mid = (low + high) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            high = mid
    return low


class BlindTrie:
    """Strings of a group; inner nodes are ``[depth, {character: child}]``, leaves lists of numbers."""

    def __init__(self, strings: list[bytes], depth: int):
        self.strings, self.known, self.root = strings, depth, None

    def _at(self, number: int, depth: int) -> int:
        s = self.strings[number]
        return s[depth] if depth < len(s) else -1

    @staticmethod
    def _leaf(node: list) -> list:
        while isinstance(node[-1], dict):
            node = next(iter(node[1].values()))
        return node

    def insert(self, number: int) -> None:
        if self.root is None:
            self.root = [number]
            return
        node = self.root
        while isinstance(node[-1], dict) and (child := node[1].get(self._at(number, node[0]))) is not None:
            node = child
        near = self._leaf(node)
        other = self.strings[near[0]]
        same = common_prefix(self.strings[number], other, self.known)
        if same == len(other) == len(self.strings[number]):
            near.append(number)
            return
        above, node, slot = None, self.root, None
        while isinstance(node[-1], dict) and node[0] < same:
            above, slot = node, self._at(number, node[0])
            node = node[1][slot]
        if isinstance(node[-1], dict) and node[0] == same:
            node[1][self._at(number, same)] = [number]
            return
        split = [same, {self._at(near[0], same): node, self._at(number, same): [number]}]
        if above is None:
            self.root = split
        else:
            above[1][slot] = split

    def in_order(self) -> tuple[list[int], list[int]]:
        """Numbers in order, and of each the common prefix with the one before it."""
        order: list[int] = []
        shared: list[int] = []
        stack: list[tuple[list, int]] = [(self.root, self.known)]
        while stack:
            node, before = stack.pop()
            if isinstance(node[-1], dict):
                keys = sorted(node[1], reverse=True)
                stack += [(node[1][k], node[0]) for k in keys[:-1]] + [(node[1][keys[-1]], before)]
            else:
                order += node
                shared += [before] + [len(self.strings[n]) for n in node[1:]]
        return order, shared


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """The order of the strings, and of each the common prefix with the one before it (0 first)."""
    order: list[int] = []
    shared: list[int] = []
    # Groups still to be put out, the next one last: members, depth they agree to, and what the
    # first of them shares with the one before.
    stack: list[tuple[list[int], int, int]] = [(list(range(len(strings))), 0, 0)]
    while stack:
        group, depth, before = stack.pop()
        if len(group) == 1:
            order.append(group[0])
            shared.append(before)
            continue
        if not group:
            continue
        if depth >= shallow or min(len(strings[n]) for n in group) <= depth:
            trie = BlindTrie(strings, depth)
            for n in group:
                trie.insert(n)
            some, prefixes = trie.in_order()
            order += some
            shared += [before] + prefixes[1:]
            continue
        pivot = strings[group[len(group) // 2]][depth]
        parts: tuple[list[int], list[int], list[int]] = ([], [], [])
        for n in group:
            c = strings[n][depth]
            parts[0 if c < pivot else 1 if c == pivot else 2].append(n)
        bounds, first = [], before
        for part, deeper in zip(parts, (depth, depth + 1, depth)):
            if part:
                bounds.append((part, deeper, first))
                first = depth
        stack += reversed(bounds)
    return order, shared


def repeated_offsets(contexts: list[tuple[bytes, int, int]], wanted: list[bool], length: int) -> list[list[tuple[int, int]]]:
    """Which strings of ``length`` bytes around a common anchor occur in another context.

    A context is ``(bytes, most, least)``: the anchor stands ``most`` bytes after its start, and
    its strings begin ``least`` to ``most`` bytes before the anchor. Per wanted context ranges
    of such distances come back.
    """
    rights = [c[most:] for c, most, _ in contexts]
    lefts = [c[:most][::-1] for c, most, _ in contexts]
    order, shared = deep_shallow(rights)
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    for rank, i in enumerate(order):
        if not wanted[i]:
            continue
        _, most, least = contexts[i]
        for step in (-1, 1):
            common, at = length, rank
            while 0 <= at + step < len(order):
                common = min(common, shared[at if step < 0 else at + 1])
                at += step
                if common < length - most:
                    break
                far = min(common_prefix(lefts[i], lefts[order[at]]), most)
                near = max(length - common, least)
                if near <= far:
                    out[i].append((near, far))
    return out
