"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict


def shingle_set(text: str | None, width: int = 3) -> frozenset:
    """A-Z lowered, words without ASCII white space, distinct shingles; all words if there are fewer."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1)))


def near_components(rows: list[tuple[int, str | None]], width: int = 3, percent: int = 90) -> dict[int, tuple[int, int]]:
    """id -> (shingles, smallest id reachable)."""
    sets = {i: shingle_set(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    by_shingle = defaultdict(list)
    for i in ids:
        met = defaultdict(int)
        for s in sets[i]:
            for j in by_shingle[s]:
                met[j] += 1
            by_shingle[s].append(i)
        for j, both in met.items():
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def kept_copies(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, bool, str]]:
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


def bins(lengths: list[int], capacity: int) -> int:
    """Sequences that best-fit-decreasing opens, piece by piece."""
    gaps: list[int] = []
    opened = 0
    for length in sorted(lengths, reverse=True):
        fitting = [g for g in gaps if g >= length]
        gap = min(fitting) if fitting else capacity
        if fitting:
            gaps.remove(gap)
        else:
            opened += 1
        gaps.append(gap - length)
    return opened
