"""The operators' results by the plainest means, on rows of (doc_id, text)."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import xxhash

LAST = float("inf")


def lowered(text):
    return "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def runs(mask) -> int:
    return sum(1 for i, x in enumerate(mask) if x and (i == 0 or not mask[i - 1]))


def substring(rows, window=13):
    first = {}
    for i, text in rows:
        w = words(text)
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            first[key] = min(first.get(key, LAST), LAST if i is None else i)
    out = []
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < (LAST if i is None else i):
                gone[j : j + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), sha(kept.encode()), runs(gone)))
    return out


def suffix(rows, length=200):
    count = Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        count.update(b[j : j + length] for j in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = [False] * len(b)
        for j in range(len(b) - length + 1):
            if count[b[j : j + length]] > 1:
                gone[j : j + length] = [True] * length
        out.append((i, len(b), sum(gone), runs(gone), sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def matching_sets(sets, threshold=0.8):
    links = defaultdict(set)
    sets = list(sets)
    for n, a in enumerate(sets):
        for b in sets[:n]:
            both = len(a & b)
            if both >= threshold * (len(a) + len(b) - both) - 1e-9:
                links[a].add(b)
                links[b].add(a)
    return links


def lines(rows, threshold=0.8):
    """(doc_id, text left, n_lines, n_removed, n_links)."""
    rows = [(i, t) for i, t in rows]
    at = [((LAST if i is None else i), n, frozenset(words(x))) for i, t in rows for n, x in enumerate((t or "").split("\n"))]
    first = {}
    for doc, n, s in at:
        if s:
            first[s] = min(first.get(s, (LAST, LAST)), (doc, n))
    links = matching_sets(first, threshold)
    out = []
    for i, t in rows:
        doc, kept, total, gone, linked = (LAST if i is None else i), [], 0, 0, 0
        for n, x in enumerate((t or "").split("\n")):
            s = frozenset(words(x))
            total += bool(s)
            if s:
                linked += len(links[s])
            if s and min([first[s], *(first[o] for o in links[s])]) < (doc, n):
                gone += 1
            else:
                kept.append(x)
        out.append((i, "\n".join(kept) if gone else t, total, gone, linked))
    return out


def fingerprint(text, size=3):
    w = words(lowered(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def simhash(rows, radius=3):
    """(doc_id, fingerprint, component)."""
    prints = [(i, fingerprint(t)) for i, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for n, (_, a) in enumerate(prints):
        for m, (_, b) in enumerate(prints[:n]):
            if bin(a ^ b).count("1") <= radius:
                group[find(n)] = find(m)
    least = defaultdict(lambda: LAST)
    for n, (i, _) in enumerate(prints):
        least[find(n)] = min(least[find(n)], LAST if i is None else i)
    return [(i, f"{p:016x}", None if least[find(n)] == LAST else least[find(n)]) for n, (i, p) in enumerate(prints)]


def shingles(text, size=5):
    w = [x.encode() for x in re.findall("[0-9a-z\u0080-\U0010ffff]+", lowered(text))]
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def contained(text, items, least=0.8):
    own, w = shingles(text), re.findall(r"[0-9a-z\x80-\U0010ffff]+", lowered(text))
    out = []
    for i, t in items:
        s, v = shingles(t), re.findall(r"[0-9a-z\x80-\U0010ffff]+", lowered(t))
        if 0 < len(v) < 5:
            if any(w[j : j + len(v)] == v for j in range(len(w))):
                out.append(i)
        elif s and len(s & own) >= least * len(s):
            out.append(i)
    return sorted(out)


def base_phrases(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    phrases = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
    found = [(i, label) for label, p in phrases.items() for i in range(len(w)) if w[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def quality_counts(text):
    text = text or ""
    w = words(text)
    full = [x for x in text.split("\n") if words(x)]
    triples = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {k for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(x) for x in "#*$%&|<>"), len(full) - len(set(full)), len(again), failed


def binomial_tail(n, k, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def water_filled(sizes, shares=(5, 2, 1), total=1.5, most=2):
    """Targets for sizes in the order of their sources."""
    weights = [shares[i % len(shares)] for i in range(len(sizes))]
    full = set()
    while True:
        rest = total * sum(sizes) - sum(most * sizes[i] for i in full)
        weight = sum(w for i, w in enumerate(weights) if i not in full)
        over = {i for i in range(len(sizes)) if i not in full and rest * weights[i] / weight > most * sizes[i]}
        if not over:
            return [most * s if i in full else rest * weights[i] / weight for i, s in enumerate(sizes)]
        full |= over
