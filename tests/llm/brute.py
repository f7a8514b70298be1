"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def suffix_dedup(docs, width=400):
    raw = [(d, (t or "").encode()) for d, t in docs]
    counts = collections.Counter(b[i:i + width] for _, b in raw for i in range(len(b) - width + 1))
    out = []
    for d, b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - width + 1):
            if counts[b[i:i + width]] > 1:
                gone[i:i + width] = [True] * width
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def substring_dedup(docs, width=50):
    words = [(d, WORD.findall(t or "")) for d, t in docs]
    first = {}
    for d, w in words:
        for i in range(len(w) - width + 1):
            if d is not None:
                key = tuple(w[i:i + width])
                first[key] = min(d, first.get(key, d))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if d is not None and first[tuple(w[i:i + width])] < d:
                gone[i:i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def near_dedup(docs):
    """For distinct keys."""
    sets = {}
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [(d, len(sets[d]), find(d), find(d) == d) for d in sets]


def quality(docs):
    out = []
    for d, t in docs:
        t = t or ""
        w = WORD.findall(t)
        counts = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        twice = [False] * len(w)
        for i in range(len(w) - 2):
            if counts[tuple(w[i:i + 3])] > 1:
                twice[i:i + 3] = [True] * 3
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        n = len(w)
        failed = n < 50 or 100 * sum(twice) > 50 * n
        symbols = sum(c in "#*$%&|<>" for c in t)
        out.append((d, n, sum(map(len, w)), symbols, dup, sum(twice), failed))
    return out


def boilerplate(docs, limit=20, percent=5, least_left=20, least_words=50):
    """``doc_id -> (kept, words left)`` of (doc_id, text, host) rows with distinct keys."""

    def split(text):
        found = [tuple(w.translate(LOWER) for w in WORD.findall(line)) for line in (text or "").split("\n")]
        return [line for line in found if line]

    texts = collections.defaultdict(set)
    for _, t, host in docs:
        texts[host or ""].add(t)
    held = collections.Counter((h, line) for h, some in texts.items() for t in some for line in set(split(t)))
    failed = {r[0]: r[-1] for r in quality([(d, t) for d, t, _ in docs])}
    out = {}
    for d, t, host in docs:
        h = host or ""
        words = [len(line) for line in split(t)]
        cut = [n for n, line in zip(words, split(t))
               if held[h, line] > limit and 100 * held[h, line] > percent * len(texts[h])]
        n, left = sum(words), sum(words) - sum(cut)
        depleted = 100 * left < least_left * n or cut and left < least_words
        out[d] = (not failed[d] and not depleted, left)
    return out


ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)


def secrets(docs):
    out = []
    for d, t in docs:
        t = t or ""
        kinds = [
            [m for m in ASSIGN.finditer(t) if len(m[2]) >= 8],
            [m for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16],
            [m for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32],
        ]
        names = ("assign", "access", "hex")
        spans = sorted((m.start(), i, m.end()) for i, ms in enumerate(kinds) for m in ms)
        joined = ",".join(f"{names[i]}:{a}:{b}" for a, i, b in spans)
        out.append((d, *map(len, kinds), hashlib.sha256(joined.encode()).hexdigest()))
    return out


def unigram(docs):
    tokens = [(d, WORD.findall((t or "").translate(LOWER)) + ["\0"]) for d, t in docs]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in tokens]
    counts = collections.Counter(x for (_, w), h in zip(tokens, held) if not h for x in w)
    n, total = sum(counts.values()), math.log10(sum(counts.values()) + 0.1 * (len(counts) + 1))
    return [
        (d, h, len(w), sum(counts[x] > 0 for x in w), n,
         round(sum(math.log10(counts[x] + 0.1) - total for x in w), 6))
        for (d, w), h in zip(tokens, held)
    ]
