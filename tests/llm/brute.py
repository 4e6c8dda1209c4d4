"""Plain Python answers that the operators are held against."""

import re
from collections import defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k):
    w = WORD.findall(lower(text))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_components(docs, k, num, den):
    """[(doc_id, text)] -> {doc_id: (n, component)}; every pair that shares a shingle is compared."""
    sets = {d: shingles(t, k) for d, t in docs}
    index = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            index[g].append(d)
    links, seen = [], set()
    for group in index.values():
        for i, a in enumerate(group):
            for b in group[i + 1:]:
                if (a, b) not in seen and min(len(sets[a]), len(sets[b])) * den >= max(len(sets[a]), len(sets[b])) * num:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                        links.append((a, b))
    up = roots(sets, links)
    return {d: (len(s), up[d]) for d, s in sets.items()}


def remove_repeats(docs, span):
    """[(doc_id, text)] -> {doc_id: (words, removed, kept words)}"""
    import hashlib
    words = {d: WORD.findall(t or "") for d, t in docs}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - span + 1):
            first.setdefault(tuple(words[d][i:i + span]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - span + 1):
            if first[tuple(w[i:i + span])] < d:
                gone.update(range(i, i + span))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out
