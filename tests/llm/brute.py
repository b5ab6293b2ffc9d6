"""Plain single-process twins of the operators, for small fixtures."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def shingle_set(text, k):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def near_copies(rows, k, percent):
    """rows: (id, text); gives id, size, component, kept of every row."""
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for at in holders.values() for n, a in enumerate(at) for b in at[n + 1 :]} if len(rows) < 2000 else set()
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            parent[root(b)] = root(a)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if d is not None and (least.get(r) is None or d < least[r]):
            least[r] = d
    return sorted(
        [(d, len(sets[i]), least.get(root(i)), d is not None and d == least.get(root(i))) for i, (d, _) in enumerate(rows)], key=repr
    )


def like_lines(rows, chars, least, percent=80):
    """rows: (id, text); id, line, first id, first line and kept of each line of ``least`` characters or more, all pairs compared."""
    found = []
    for d, t in rows:
        for n, x in enumerate((t or "").split("\n")):
            x = lower(x).strip(" \t\n\x0b\x0c\r")
            if len(x) >= max(1, least):
                found.append((d, n, frozenset(x[i : i + chars] for i in range(max(1, len(x) - chars + 1)))))
    parent = list(range(len(found)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(found)):
        for b in range(a):
            x, y = found[a][2], found[b][2]
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                parent[root(a)] = root(b)
    order = lambda i: (found[i][0] is None, found[i][0] or 0, found[i][1])
    best = {}
    for i in range(len(found)):
        if root(i) not in best or order(i) < order(best[root(i)]):
            best[root(i)] = i
    return sorted([(d, n, *found[best[root(i)]][:2], best[root(i)] == i) for i, (d, n, _) in enumerate(found)], key=repr)
