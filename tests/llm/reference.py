"""Plain Python versions of the corpus operators, for small tables."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


class Groups:
    """Union of ids, named by the smallest."""

    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingle_set(words, size):
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(zip(*[words[i:] for i in range(size)]))


def linked(sets, similarity):
    """Components of all pairs of sets whose Jaccard similarity reaches the percentage."""
    groups, by_set = Groups(sets), defaultdict(list)
    for i, s in sorted(sets.items()):
        if s:
            by_set[s].append(i)
    holders = defaultdict(list)
    for s, ids in by_set.items():
        for i in ids:
            groups.join(ids[0], i)
        for x in s:
            holders[x].append(s)
    seen = set()
    for group in holders.values():
        for i, a in enumerate(group):
            for b in group[:i]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(a & b)
                    if 100 * both >= similarity * (len(a) + len(b) - both):
                        groups.join(by_set[a][0], by_set[b][0])
    return groups


def statistics(text):
    words = WORD.findall(text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for k in range(len(words) - 2):
        if grams[tuple(words[k:k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(covered))


def repeats(texts, threshold):
    """Per key of ``texts`` (bytes): what is left and the number of removed runs."""
    seen = Counter(b[p:p + threshold] for b in texts.values() for p in range(len(b) - threshold + 1))
    out = {}
    for key, b in texts.items():
        gone = [False] * len(b)
        for p in range(len(b) - threshold + 1):
            if seen[b[p:p + threshold]] > 1:
                gone[p:p + threshold] = [True] * threshold
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[key] = (bytes(x for x, g in zip(b, gone) if not g), runs)
    return out


def distance_within(pattern, text):
    """Least edit distance of ``pattern`` to a substring of ``text`` that ends at each place."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return row[1:]


def paragraphs(text, min_words=8):
    """Number and words of each paragraph that is long enough."""
    number, current = 0, []
    for line in (text or "").split("\n"):
        words = WORD.findall(line)
        for k, w in enumerate(words):
            current.append(lower(w))
            if w[-1] in ".!?" or k == len(words) - 1:
                if len(current) >= min_words:
                    yield number, current
                number, current = number + 1, []
