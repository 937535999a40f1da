"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations

import re


def near_components(rows, width=5, least=75):
    """rows of (id, text): {id: (set size, component)} by comparing all pairs of full shingle sets."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if len(words) >= width:
            sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)})
        else:
            sets.append({tuple(words)} if words else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by_shingle = {}
    for k, s in enumerate(sets):
        for x in s:
            by_shingle.setdefault(x, []).append(k)
    pairs = {(a, b) for ks in by_shingle.values() for i, a in enumerate(ks) for b in ks[i + 1 :]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= least * (len(sets[a]) + len(sets[b]) - both):
            parent[find(a)] = find(b)
    lowest = {}
    for k, (doc, _) in enumerate(rows):
        root = find(k)
        lowest[root] = min(lowest.get(root, doc), doc)
    return {doc: (len(sets[k]), lowest[find(k)]) for k, (doc, _) in enumerate(rows)}


def linked_vectors(rows, least=0.93):
    """rows of (id, vector, label): list of (id, links, component) by comparing all pairs."""
    import math

    n = len(rows)

    def unit(v):
        if v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        size = math.sqrt(sum(x * x for x in v))
        return [x / size for x in v]

    units, parent, links = [unit(r[1]) if r[2] is not None else None for r in rows], list(range(n)), [0] * n

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if units[a] and units[b] and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]):
                if sum(x * y for x, y in zip(units[a], units[b], strict=True)) >= least:
                    links[a] += 1
                    links[b] += 1
                    parent[find(a)] = find(b)
    low = {}
    for k in range(n):
        low[find(k)] = min(low.get(find(k), rows[k][0]), rows[k][0])
    return [(rows[k][0], links[k], low[find(k)]) for k in range(n)]
