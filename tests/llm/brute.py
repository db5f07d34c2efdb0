"""Plain versions of the operators' contracts, for small tables only."""

import collections
import hashlib


def words(t):
    return (t or "").encode().split()


def lower(t):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())


def shingles(t, n):
    w = lower(t).split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def substring(rows, k=35):
    """rows (doc_id, text) -> (doc_id, n_words, n_removed, sha) of each."""
    seen = collections.Counter(tuple(w[i : i + k]) for w in (words(t) for _, t in rows) for i in range(len(w) - k + 1))
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone[i : i + k] = [True] * k
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def suffix(rows, k=50):
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - k + 1 if d is not None else 0):
            least[b[i : i + k]] = min(least.get(b[i : i + k], d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - k + 1 if d is not None else 0):
            if least[b[i : i + k]] < d:
                gone[i : i + k] = b"\1" * k
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def components(rows, n=4, share=85):
    """rows (doc_id, text) -> (doc_id, n_shingles, component_id)."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    at = collections.defaultdict(list)
    for i, s in enumerate(sets):
        both = collections.Counter(j for x in s for j in at[x])
        for j, m in both.items():
            if 100 * m >= share * (len(s) + len(sets[j]) - m):
                root[find(i)] = find(j)
        for x in s:
            at[x].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, len(sets[i]), least.get(find(i), d) if sets[i] else d) for i, (d, _) in enumerate(rows)]
