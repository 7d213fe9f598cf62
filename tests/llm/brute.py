"""Plain Python versions of the operators' contracts, for comparison."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def luhn(d: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def pii_base(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def line_dedup(docs, min_chars=40, min_docs=5):
    def key(x):
        return x.strip(WS).translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}))

    held = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= min_chars:
                held[key(x)].add(i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or gone.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def substring_dedup(docs, size=13):
    first: dict[tuple, int] = {}
    for i, t in docs:
        w = WORD.findall(t or "")
        for k in range(len(w) - size + 1):
            if i is not None:
                key = tuple(w[k:k + size])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in docs:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k:k + size])] < i:
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def quality_base(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for x in text.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    rep = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i:i + 3])] > 1:
            rep.update((i, i + 1, i + 2))
    failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep), failed)


def longest_repeats(w):
    out = []
    for a in range(len(w)):
        best = 0
        for b in range(len(w)):
            if a != b:
                k = 0
                while max(a, b) + k < len(w) and w[a + k] == w[b + k]:
                    k += 1
                best = max(best, k)
        out.append(best)
    return out


def shingles(text, n=5):
    w = WORD.findall(text or "")
    if not w:
        return Counter()
    return Counter([tuple(w)]) if len(w) < n else Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))


def near_classes(docs, threshold=0.8, n=5):
    """Class by the exact similarity with exact document frequencies, over all pairs."""
    import math
    docs = [(i, shingles(t, n)) for i, t in docs if i is not None]
    df = Counter(s for _, sh in docs for s in sh)
    total = sum(1 for _, sh in docs if sh)
    w = {s: 1 + 0.2 * math.log((1 + total) / (1 + c)) / math.log(2 + total) for s, c in df.items()}
    vec = [(i, {s: c * w[s] for s, c in sh.items()}) for i, sh in docs]
    parent = {i: i for i, _ in vec}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = []
    for a in range(len(vec)):
        for b in range(a):
            (i, x), (j, y) = vec[a], vec[b]
            if not x or not y:
                continue
            common = sum(min(v, y[s]) for s, v in x.items() if s in y)
            sim = common / (sum(x.values()) + sum(y.values()) - common)
            if sim > 0.7:
                links.append((i, j, sim))
            if sim >= threshold and root(i) != root(j):
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return {i: root(i) for i, _ in vec}, links


def crc(ids):
    import struct
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
