"""Brute-force versions of pipeline stages."""

from collections import Counter

WINDOW = 35


def brute_near_copies(texts, size, percent):
    """The texts that stay: of linked ones the smallest id."""
    sets = {}
    for i, text in texts.items():
        words = text.encode().lower().split()
        sets[i] = {tuple(words[j:j + size]) for j in range(max(1, len(words) - size + 1))} if words else set()
    up = {i: i for i in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in texts:
        for b in texts:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: t for i, t in texts.items() if find(i) == i}


def brute_repeats(texts):
    """The texts without the words of repeated windows; texts that lose none as they are."""
    words = {i: t.split() for i, t in texts.items()}
    seen = Counter(tuple(w[j:j + WINDOW]) for w in words.values() for j in range(len(w) - WINDOW + 1))
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - WINDOW + 1):
            if seen[tuple(w[j:j + WINDOW])] > 1:
                gone[j:j + WINDOW] = [True] * WINDOW
        out[i] = " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else texts[i]
    return out
