"""Plain versions to compare with."""

import hashlib
import math
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def repeats(docs, window):
    """docs: (id, text). What is kept of each row by its id and place."""
    first = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, (1 << 70, 0)), (i, k))
    out = {}
    for i, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (i, k):
                gone[k : k + window] = [True] * window
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def classes(sets, similarity=0.8):
    """Links of each, and the smallest index of its class."""
    n = len(sets)
    parent, links = list(range(n)), [0] * n

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-12:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return links, [find(x) for x in range(n)]


def word_shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def kept_lines(docs, k=7):
    """docs: (id, text) with different ids. The text that stays of each."""
    first = {}
    for i, t in sorted(docs):
        for n, line in enumerate((t or "").split("\n")):
            if s := line.strip(" \t\n\v\f\r"):
                first.setdefault(s, (i, n))
    lines = sorted(first, key=first.get)
    _, root = classes([{s[a : a + k] for a in range(max(1, len(s) - k + 1))} for s in lines])
    best = defaultdict(lambda: (1 << 70, 0))
    for s, r in zip(lines, root):
        best[r] = min(best[r], first[s])
    keep = set(best.values())
    return {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if not x.strip(" \t\n\v\f\r") or (i, n) in keep) for i, t in docs}


def ppm_bits(train, text, order=3):
    """Code lengths of a text under each language: plain recursion over context trees, escapes by method C, with exclusion.
    train: (language, bytes). Contexts seen twice at least in all languages together are known; texts begin after spaces."""
    symbols = {c for _, t in train for c in t} | {0x20}
    total, counts = defaultdict(int), defaultdict(lambda: defaultdict(lambda: defaultdict(int)))
    for lang, t in train:
        s = [0x20] * order + [c if c in symbols else -1 for c in t]
        for k in range(order, len(s)):
            for n in range(order + 1):
                context = tuple(s[k - n : k])
                total[context] += 1
                counts[lang][context][s[k]] += 1

    def p(lang, context, c):
        """Of the symbol after the longest known end of a context."""
        while context and total[context] < 2:
            context = context[1:]
        if context is None:
            return 0
        after = counts[lang][context] if context in counts[lang] else {}
        n, q = sum(after.values()), len(after)
        shorter = (lambda x: p(lang, context[1:], x)) if context else (lambda x: 1 / 256 if x >= 0 else (256 - len(symbols)) / 256)
        if not n:
            return shorter(c)
        if c in after:
            return after[c] / (n + q)
        return q / (n + q) * shorter(c) / max(1e-9, 1 - sum(shorter(x) for x in after))

    out = []
    s = [0x20] * order + [c if c in symbols else -1 for c in text]
    for lang in sorted({k for k, _ in train}):
        bits = 0.0
        for k in range(order, len(s)):
            bits -= math.log2(p(lang, tuple(s[k - order : k]), s[k]))
            bits += math.log2(256 - len(symbols)) if s[k] < 0 else 0
        out.append(bits)
    return out


def lexicon_matches(stems, exceptions, text):
    """Start, end and weight of entries in a folded text, tried one by one at each place."""
    free = []
    for e in exceptions:
        at = text.find(e)
        while at >= 0:
            if (not at or not text[at - 1].isalnum()) and (at + len(e) == len(text) or not text[at + len(e)].isalnum()):
                free.append((at, at + len(e)))
            at = text.find(e, at + 1)
    out = []
    for i in range(len(text)):
        if i and text[i - 1].isalnum():
            continue
        fits = [k for k in stems if text.startswith(k, i)]
        if fits and not any(a <= i < b for a, b in free):
            k = max(fits, key=len)
            out.append((i, i + len(k), stems[k]))
    return out
