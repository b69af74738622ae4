"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import zstandard

LOWER = {c: c + 32 for c in range(65, 91)}
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return (text or "").translate(LOWER)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def quality(text):
    text = text or ""
    words = SPACE_WORD.findall(text)
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


#: The bands as the contract of the operator states them, for this check alone.
LIMITS = [(131072, 0.12, 0.66), (16384, 0.18, 0.68), (4096, 0.22, 0.70), (1024, 0.26, 0.76), (512, 0.29, 0.82), (256, 0.32, 0.88), (128, 0.35, 0.97), (0, 0.0, 9.9)]


def compression_kept(text):
    """Whether a text and half of its 4 KiB pieces by bytes are in band, each compressed on its own."""
    def fits(raw):
        low, high = next((a, b) for n, a, b in LIMITS if len(raw) >= n)
        return low <= len(zstandard.compress(raw, 3)) / len(raw) <= high

    raw = (text or "").encode()
    if not raw:
        return True
    pieces = [raw[k : k + 4096] for k in range(0, len(raw), 4096)]
    return fits(raw) and 2 * sum(len(x) for x in pieces if not fits(x)) <= len(raw)


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def line_counts(texts):
    """Documents of each key."""
    return Counter(k for t in texts for k in {line_key(x) for x in (t or "").split("\n")} if k)


def lines(texts, least=10):
    keys, docs = [[line_key(x) for x in (t or "").split("\n")] for t in texts], line_counts(texts)
    out = []
    for text, own in zip(texts, keys, strict=True):
        kept = [x for x, k in zip((text or "").split("\n"), own, strict=True) if docs[k] < least or not k]
        out.append((len(own), len(own) - len(kept), sha("\n".join(kept))))
    return out


def shingles(text, n=4):
    w = SPACE_WORD.findall(lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(docs, percent=85):
    """{id: (set size, smallest linked id)} of (id, text)."""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    both = Counter((a, b) for h in holders.values() for k, a in enumerate(h) for b in h[:k])
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def contamination(text, items, size=13):
    """(words, hit words, item ids, contaminated) against (id, text) items."""
    words = ALNUM_WORD.findall(lower(text))
    hit, found = set(), set()
    for item, body in items:
        own = ALNUM_WORD.findall(lower(body))
        k = min(size, len(own))
        windows = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if k else set()
        for i in range(len(words) - k + 1):
            if k and tuple(words[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                found.add(str(item))
    return len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words)
