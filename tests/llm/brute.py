"""Plain versions of the operators, for small inputs."""

import base64
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {i: i + 32 for i in range(65, 91)}


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(LOW) if lower else text)


def repeats(rows, length=20):
    """doc_id -> kept words; rows are (doc_id, text)."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            k = tuple(w[s : s + length])
            if k in seen:
                gone[s : s + length] = [True] * length
            else:
                seen.add(k)
        out[d] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


def shingles(text, n=5):
    w = words(text, lower=True)
    if len(w) >= n:
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def components(rows):
    """doc_id -> (set size, smallest linked doc_id)."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return {d: (len(sets[d]), find(d)) for d in sets}


def contained(docs, items):
    out = set()
    for i, t in items:
        q = shingles(t) if len(words(t)) >= 5 else frozenset()
        for d, text in docs:
            k = len(q & (shingles(text) if len(words(text)) >= 5 else frozenset()))
            if q and 100 * k >= 75 * len(q):
                out.add((i, d, len(q), k))
    return out


def measures(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = set()
    for i, x in enumerate(tri):
        if tri.count(x) > 1:
            hit |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def sha1_base32(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()
