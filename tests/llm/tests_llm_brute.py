"""Plain versions of operators that more than one test needs."""

import re

TAGS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def similar_groups(texts, percent=80, size=5):
    """Smallest id of the group of each id over all pairs of that similarity; texts without words are equal."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and (a == b or 100 * len(a & b) >= percent * len(a | b)):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in texts}


def sanitised(text):
    from test_privacy import PATTERNS, holds

    spans = sorted((m.start(), -m.end(), k) for k, p in PATTERNS.items() for m in re.finditer(p, text) if holds(k, m[0]))
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], TAGS[k]]
        at = max(at, -b)
    return "".join(out) + text[at:]
