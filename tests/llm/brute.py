"""Plain versions of the operators, for small tables."""

import hashlib
from collections import Counter, defaultdict


def words(text, lower=False):
    raw = (text or "").encode()
    if lower:
        raw = bytes(c + 32 if 65 <= c < 91 else c for c in raw)
    return raw.split()


def shingles(text, n=5):
    w = words(text, True)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def jaccard_components(rows, percent=75):
    """doc_id -> (set size, smallest id reachable), over all pairs that share anything."""
    sets, of, root = {d: shingles(t) for d, t in rows}, defaultdict(list), {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sets.items():
        for x in s:
            of[x].append(d)
    overlap = Counter((a, b) for ds in of.values() for i, b in enumerate(ds) for a in ds[:i])
    for (a, b), o in overlap.items():
        if 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def without_repeats(rows, window=20):
    """doc_id -> (words, removed, hash of what is kept), rows in order of doc_id."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def water_fill(sizes, weights, share=1.5, epochs=2):
    """Targets by sharing the excess again and again."""
    total, target = share * sum(sizes), [0.0] * len(sizes)
    free, left = set(range(len(sizes))), total
    while free:
        w = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / w >= epochs * sizes[i]}
        if not over:
            for i in free:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = float(epochs * sizes[i])
            left -= target[i]
        free -= over
    return target


def mix(rows, sources, weights, keys, epochs=2):
    """(doc, size, taken) of every row, by place: rows of (id, text), the source and the key of each."""
    size = [len(words(t)) for _, t in rows]
    names = sorted({x for x in sources if x is not None}) + [None] * (None in sources)
    held = {x: sum(n for n, s in zip(size, sources) if s == x) for x in names}
    target = dict(zip(names, water_fill([held[x] for x in names], [weights[i % len(weights)] for i in range(len(names))], epochs=epochs)))
    taken = [0] * len(rows)
    for x in names:
        mine = [i for i, s in enumerate(sources) if s == x]
        whole, left = divmod(target[x], held[x]) if held[x] else (0, 0)
        left = int(left + 1e-9)
        for i in sorted(mine, key=lambda i: keys[i]):
            part = min(size[i], left)
            taken[i], left = int(whole) * size[i] + part, left - part
    return [(d, n, t) for (d, _), n, t in zip(rows, size, taken)]


def packed(items, capacity, per_source):
    """(bin, offset) of each (size, source, cluster), cluster -1: none: the larger first, each in the
    fullest bin that it fits and that takes it, the first opened of equals."""
    bins, out = [], [None] * len(items)
    for i in sorted(range(len(items)), key=lambda i: (-items[i][0], i)):
        size, source, cluster = items[i]
        fits = [b for b in bins if b["left"] >= size and b["sources"].count(source) < per_source and (cluster < 0 or cluster not in b["clusters"])]
        if fits:
            best = min(fits, key=lambda b: (b["left"], b["number"]))
        else:
            best = {"number": len(bins), "left": capacity, "sources": [], "clusters": set()}
            bins.append(best)
        out[i] = best["number"], capacity - best["left"]
        best["left"] -= size
        best["sources"].append(source)
        best["clusters"].add(cluster)
    return out
