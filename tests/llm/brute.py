"""Plain versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def decontaminate(docs, items):
    """{row: (n_words, n_hit, n_items, sha, contaminated)}"""
    windows = defaultdict(set)
    for i, x in items:
        w = ITEM_WORD.findall((x or "").translate(ASCII))
        if not w:
            continue
        m = min(10, len(w))
        for k in range(len(w) - m + 1):
            windows[tuple(w[k : k + m])] |= set() if i is None else {str(i)}
    sizes = {len(k) for k in windows}
    out = {}
    for n, (_, x) in enumerate(docs):
        w, hit, ids = ITEM_WORD.findall((x or "").translate(ASCII)), set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if (z := windows.get(tuple(w[k : k + m]))) is not None:
                    hit |= set(range(k, k + m))
                    ids |= z
        out[n] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out


def suffix_dedup(docs):
    """{doc_id: (n_bytes, n_removed, n_spans, sha)} and kept bytes, for distinct ids."""
    seen, out, kept = set(), {}, {}
    for i, x in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        b = (x or "").encode()
        cov = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                cov[k] += 1
                cov[k + 100] -= 1
            else:
                seen.add(w)
        gone = np.cumsum(cov)[: len(b)] > 0
        raw = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i] = (len(b), len(b) - len(raw), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(raw).hexdigest())
        kept[i] = raw
    return out, kept


def simhash(text):
    from xxhash import xxh64_intdigest

    w = WORD.findall((text or "").translate(ASCII))
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def components(fps, radius=4):
    """Smallest reachable id for each (id, fingerprint)."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    a = np.array([f for _, f in fps], np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= radius) + i + 1:
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(fps):
        k = find(i)
        least[k] = min(least.get(k, d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(fps)}


def quality(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    c, rep = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2)), set()
    for j in range(len(w) - 2):
        if c[tuple(w[j : j + 3])] > 1:
            rep |= {j, j + 1, j + 2}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w))


def longest_repeat(w):
    n = 0
    while True:
        c = Counter(tuple(w[j : j + n + 1]) for j in range(len(w) - n))
        if not c or max(c.values()) < 2:
            return n
        n += 1


def repeat_chars(w, least=8):
    """Characters of the words that lie in a string of ``least`` words or more that occurs twice in ``w``."""
    c = Counter(tuple(w[j : j + least]) for j in range(len(w) - least + 1))
    inside = {k for j in range(len(w) - least + 1) if c[tuple(w[j : j + least])] > 1 for k in range(j, j + least)}
    return sum(len(w[k]) for k in inside)
