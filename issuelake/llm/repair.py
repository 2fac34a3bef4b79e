"""Re-Pair grammars: the most frequent pair of neighbours becomes a rule until no pair occurs twice."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Hashable, Sequence

END = -1


class Grammar:
    """Rules (left, right) for the symbols from `first` on, the sequence that is left, and what each rule covers."""

    def __init__(self, first: int, rules: list[tuple[int, int]], sequence: list[int], length: int):
        self.first, self.rules, self.sequence, self.length = first, rules, sequence, length

    def sizes(self) -> list[int]:
        """Terminals that each rule stands for."""
        out: list[int] = []
        for a, b in self.rules:
            out.append(self._size(a, out) + self._size(b, out))
        return out

    def _size(self, symbol: int, done: list[int]) -> int:
        return 1 if symbol < self.first else done[symbol - self.first]

    def uses(self) -> list[int]:
        """How often each rule is used when the whole sequence is derived."""
        n = len(self.rules)
        out = [0] * n
        for s in self.sequence:
            if s >= self.first:
                out[s - self.first] += 1
        for i in range(n - 1, -1, -1):
            for s in self.rules[i]:
                if s >= self.first:
                    out[s - self.first] += out[i]
        return out

    def compression(self) -> float:
        """Size of the grammar against the sequence: 1 if nothing repeats, near 0 if one thing does."""
        return (len(self.sequence) + 2 * len(self.rules)) / self.length if self.length else 1.0


def infer(items: Sequence[Hashable], least: int = 2, breaks: frozenset = frozenset()) -> Grammar:
    """The Re-Pair grammar of a sequence. No rule spans an item of `breaks`.

    The sequence is a doubly linked list; each pair keeps its count and a list
    of its positions, where stale ones are skipped, and a heap with stale entries
    finds the most frequent pair, ties by the smaller symbols; of overlapping
    occurrences the left one is replaced. Work is in proportion to n log n.
    """
    ids: dict[Hashable, int] = {}
    seq = [END if x in breaks else ids.setdefault(x, len(ids)) for x in items] if breaks else [ids.setdefault(x, len(ids)) for x in items]
    n, first = len(seq), len(ids)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    # no symbol reaches `base`: every rule shortens the sequence
    base = first + n + 1
    keys = [a * base + b if a >= 0 and b >= 0 else END for a, b in zip(seq, seq[1:])]
    # neighbours that are no longer put together stay rarer than that: pairs below `least` need no places
    count = {key: c for key, c in Counter(keys).items() if c >= least and key >= 0}
    where: dict[int, list[int]] = {key: [] for key in count}
    for i, key in enumerate(keys):
        if key in count:
            where[key].append(i)
    heap = [(-c, key) for key, c in count.items()]
    heapq.heapify(heap)
    rules: list[tuple[int, int]] = []
    while heap:
        c, pair = heapq.heappop(heap)
        now = count.get(pair, 0)
        if now < least:
            continue
        if now != -c:
            heapq.heappush(heap, (-now, pair))
            continue
        a, b = divmod(pair, base)
        apart, free = [], -1
        for i in sorted(where.pop(pair)):
            if i >= free and seq[i] == a and (j := after[i]) < n and seq[j] == b and (not apart or apart[-1] != i):
                apart.append(i)
                free = after[j]
        del count[pair]
        if len(apart) < least:
            continue
        fresh = first + len(rules)
        rules.append((a, b))
        made: dict[int, list[int]] = {}
        gone: dict[int, int] = {}
        for i in apart:
            j = after[i]
            h, k = before[i], after[j]
            if h >= 0 and (s := seq[h]) >= 0:
                old = s * base + a
                if old in count:
                    count[old] -= 1
                elif old in made:
                    gone[old] = gone.get(old, 0) + 1
                key = s * base + fresh
                if key in made:
                    made[key].append(h)
                else:
                    made[key] = [h]
            seq[i], seq[j] = fresh, -2
            after[i] = k
            if k < n:
                before[k] = i
                if (s := seq[k]) >= 0:
                    old = b * base + s
                    if old in count:
                        count[old] -= 1
                    elif old in made:
                        gone[old] = gone.get(old, 0) + 1
                    key = fresh * base + s
                    if key in made:
                        made[key].append(i)
                    else:
                        made[key] = [i]
        for key, places in made.items():
            now = len(places) - gone.get(key, 0)
            if now >= least:
                where[key], count[key] = places, now
                heapq.heappush(heap, (-now, key))
    left, i = [], 0
    while i < n:
        if seq[i] != END:
            left.append(seq[i])
        i = after[i]
    return Grammar(first, rules, left, n)
