"""Plain versions of the operators' contracts, by loops over all rows."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")
TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def fingerprint(text):
    words = WORD.findall(lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows):
    prints = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= 3 and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group):
        least[g] = min(least.get(g, i), i)
    return [(i, f"{p:016x}", least[g]) for (i, _), p, g in zip(rows, prints, group)]


def repeated_bytes(rows, window=200):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for (i, _), d in zip(rows, data):
        gone = [False] * len(d)
        for k in range(len(d) - window + 1):
            if seen[d[k : k + window]] > 1:
                gone[k : k + window] = [True] * window
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(d), sum(gone), spans, sha(bytes(b for b, g in zip(d, gone) if not g))))
    return out


def later_phrases(rows, window=20):
    """For rows in order of id."""
    seen, out = set(), []
    for i, t in rows:
        words, gone = WORD.findall(t or ""), set()
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            if w in seen:
                gone.update(range(k, k + window))
            seen.add(w)
        out.append((i, len(words), len(gone), sha(" ".join(w for k, w in enumerate(words) if k not in gone))))
    return out


def leaks(rows, benchmark, window=8):
    of = defaultdict(set)
    for i, t in benchmark:
        words = TERM.findall(lower(t))
        for k in range(max(1, len(words) - window + 1) if words else 0):
            of[tuple(words[k : k + window])].add(str(i))
    out = []
    for i, t in rows:
        words, hit, items = TERM.findall(lower(t)), set(), set()
        for n in {len(w) for w in of}:
            for k in range(len(words) - n + 1):
                if found := of.get(tuple(words[k : k + n])):
                    hit.update(range(k, k + n))
                    items |= found
        out.append((i, len(words), len(hit), len(items), sha(",".join(sorted(items))), len(items) > 1))
    return out
