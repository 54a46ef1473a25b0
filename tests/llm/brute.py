"""Plain versions of pipeline stages for small tables."""

import re
import string

APART = str.maketrans({c: " " for c in string.digits + string.punctuation + "\t\n\v\f\r"})
PIECE = re.compile(r"[ \t\v\f\r]*+(?:[^ \t-\r]{1,64}+[ \t\v\f\r]*+){0,100}\n?")


def _edits(a, b):
    """Edit distance, a column of the table as one number (bit-parallel)."""
    if not a:
        return len(b)
    at = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    mask, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, d = mask, 0, len(a)
    for c in b:
        same = at.get(c, 0)
        xv, xh = same | down, (((same & up) + up) ^ up) | same
        more, less = down | ~(xh | up) & mask, up & xh
        d += bool(more & top) - bool(less & top)
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(xv | more)) & mask, more & xv & mask
    return d


def groups(keys, linked):
    """Smallest member of each key's group, comparing all pairs."""
    keys = sorted(keys)
    root = {k: k for k in keys}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = top(a), top(b)
            if x != y and linked(a, b):
                root[max(x, y)] = min(x, y)
    return {k: top(k) for k in keys}


def lines_left(docs):
    """(text, removed pieces) by id, for texts by id, linking lines by edit similarity alone."""
    cuts = {i: [p for p in PIECE.findall(t or "") if p] for i, t in docs.items()}
    places = {}
    for i in sorted(docs):
        for pos, p in enumerate(cuts[i]):
            words = [w for w in p.lower().translate(APART).split(" ") if w]
            if p.strip():
                places.setdefault(" ".join(words) or (p.strip(),), []).append((i, pos))

    def linked(a, b):
        most = max(len(a), len(b)) * 20 // 100
        return abs(len(a) - len(b)) <= most and _edits(a, b) <= most

    group = groups([n for n in places if isinstance(n, str)], linked)
    first = {}
    for n, found in places.items():
        first[group.get(n, n)] = min(first.get(group.get(n, n), found[0]), found[0])
    gone = {at for n, found in places.items() for at in found if at != first[group.get(n, n)]}
    return {
        i: (t if t is None else "".join(p for pos, p in enumerate(cuts[i]) if (i, pos) not in gone), sum(1 for at in gone if at[0] == i))
        for i, t in docs.items()
    }


def shingles(text):
    words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()


def jaccard_groups(docs):
    sets = {i: shingles(t) for i, t in docs.items()}
    return groups(docs, lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
