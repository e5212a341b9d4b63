"""Plain definitions that the operators are held against."""

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def substring(rows, w=13):
    words = {i: WORDS.findall(t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - w + 1):
            first.setdefault(tuple(words[i][k : k + w]), i)
    out = {}
    for i, t in words.items():
        gone = set()
        for k in range(len(t) - w + 1):
            if first[tuple(t[k : k + w])] < i:
                gone.update(range(k, k + w))
        out[i] = (len(t), len(gone), " ".join(x for k, x in enumerate(t) if k not in gone))
    return out


def linked(rows, sim):
    """(id, links, component, is its smallest id) sorted; ``sim(a, b)`` says whether two rows link."""
    n = len(rows)
    degree, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a in range(n):
        for b in range(a):
            if sim(a, b):
                degree[a] += 1
                degree[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k in range(n):
        least[find(k)] = min(rows[k][0], least.get(find(k), rows[k][0]))
    return sorted((rows[k][0], degree[k], least[find(k)], rows[k][0] == least[find(k)]) for k in range(n))


def grams(text, n=5):
    w = WORDS.findall(text or "")
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def jaccard(rows, n=5, threshold=0.8):
    sets = [grams(t, n) for _, t in rows]

    def sim(a, b):
        x, y = sets[a], sets[b]
        if not x or not y or min(len(x), len(y)) < threshold * max(len(x), len(y)):
            return False
        both = len(x & y)
        return both / (len(x) + len(y) - both) >= threshold

    return linked(rows, sim)
