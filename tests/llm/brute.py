"""Plain versions that the operators are held against."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def shingles(text, k):
    w = WORD.findall(ascii_lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(texts, k, num, den):
    """texts: id to text. id to (set size, smallest linked id)."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def uncovered(texts, width):
    """id to (words, removed, kept words) after covering every window that starts earlier too."""
    seen, out = set(), {}
    for i in sorted(texts):
        w = WORD.findall(texts[i] or "")
        hit = [False] * len(w)
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            if key in seen:
                hit[s : s + width] = [True] * width
            seen.add(key)
        out[i] = (len(w), sum(hit), [x for x, h in zip(w, hit, strict=True) if not h])
    return out
