"""Plain versions of the operators' contracts, for small inputs."""

import re
from collections import defaultdict


class Sets:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


def shingles(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(ids, linked):
    """Least id (null last) that each row reaches by the pairs ``linked`` of row numbers."""
    sets = Sets(len(ids))
    for a, b in linked:
        sets.join(a, b)
    least = {}
    for k, i in enumerate(ids):
        root = sets.find(k)
        if i is not None and (least.get(root) is None or i < least[root]):
            least[root] = i
    return [least.get(sets.find(k)) for k in range(len(ids))]


def near_duplicates(rows, similarity=85):
    """(doc_id, text) -> (doc_id, n_shingles, component_id, kept), by an inverted index."""
    sets, index, linked = [shingles(t) for _, t in rows], defaultdict(list), []
    for k, s in enumerate(sets):
        common = defaultdict(int)
        for g in s:
            for j in index[g]:
                common[j] += 1
            index[g].append(k)
        linked += [(j, k) for j, c in common.items() if 100 * c >= similarity * (len(s) + len(sets[j]) - c)]
    comp = components([i for i, _ in rows], linked)
    return [(i, len(s), c, i == c) for (i, _), s, c in zip(rows, sets, comp, strict=True)]
