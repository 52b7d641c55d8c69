"""Plain-Python versions of the corpus operators, for small fixtures."""

import collections
import hashlib
import re

WORD1 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words1(text):
    return WORD1.findall((text or "").translate(LOWER))


def contamination(docs, items, window=10):
    wins = collections.defaultdict(set)
    for i, t in items:
        w = words1(t)
        k = min(len(w), window)
        for p in range(len(w) - k + 1 if k else 0):
            wins[tuple(w[p : p + k])].add(str(i))
    out = {}
    for i, t in docs:
        w = words1(t)
        hit, names = set(), set()
        for p in range(len(w)):
            for k in {len(x) for x in wins}:
                got = wins.get(tuple(w[p : p + k])) if p + k <= len(w) else None
                if got:
                    hit |= set(range(p, p + k))
                    names |= got
        out[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out


def exact(docs):
    groups = collections.defaultdict(list)
    for i, t in docs:
        groups[SPACE.sub(" ", t or "")].append(i)
    return {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


def shingles(text, n):
    w = (text or "").translate(LOWER)
    w = [x for x in SPACE.split(w) if x]
    return frozenset(tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))) if w else frozenset()


def classes(docs, n, percent):
    sets = {i: shingles(t, n) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def deleted_lines(docs, min_words=50):
    """By definition: doc id -> line numbers of every run of lines of ``min_words`` words or more that stands earlier, in
    the corpus (by id) or the document. Runs that begin earlier count as earlier, as for the operator."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    seen, gone = set(), collections.defaultdict(set)
    for i, t in sorted(docs):
        lines = [x for x in ((s, len(word.findall(s)), n) for n, s in enumerate((t or "").split("\n"))) if x[1]]
        for a in range(len(lines)):
            here, total = [], 0
            for b in range(a + 1, len(lines) + 1):
                total += lines[b - 1][1]
                if total >= min_words:
                    run = tuple(hashlib.md5(x[0].encode()).digest() for x in lines[a:b])
                    if run in seen:
                        gone[i] |= set(range(lines[a][2], lines[b - 1][2] + 1))
                    here.append(run)
                    if total >= 4 * min_words:  # a longer run is made up of such
                        break
            seen.update(here)
    return gone
