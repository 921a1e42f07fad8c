"""Brute-force counterparts of the operators."""

from collections import defaultdict


def union_find(n, edges):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingle_sets(texts, words=5):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    return out


def near_pairs(texts, least=0.8):
    """All pairs at a Jaccard similarity of `least` of their five-word shingles; two empty sets are equal."""
    sets, holders, shared = shingle_sets(texts), defaultdict(list), defaultdict(int)
    for k, s in enumerate(sets):
        for x in s:
            for j in holders[x]:
                shared[j, k] += 1
            holders[x].append(k)
    out = [(i, j) for (i, j), c in shared.items() if c / (len(sets[i]) + len(sets[j]) - c) >= least]
    empty = [k for k, s in enumerate(sets) if not s]
    return out + [(i, j) for n, i in enumerate(empty) for j in empty[n + 1 :]]
