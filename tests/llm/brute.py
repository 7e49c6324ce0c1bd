"""Plain versions of what the operators compute, for small inputs."""

import hashlib
import re
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def in_order(rows):
    """Distinct (id, text) pairs: NULL ids first. Ids here have at most one text, or order does not matter."""
    return sorted({(i, t or "") for i, t in rows}, key=lambda x: (x[0] is not None, x[0] or 0))


def repeats(rows, window=100):
    seen, out = {}, {}
    for i, text in in_order(rows):
        data = text.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - window + 1):
            w = data[p : p + window]
            if w in seen:
                gone[p : p + window] = b"\1" * window
            else:
                seen[w] = i
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[i, text] = (len(data), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, n):
    w = words(text)
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def groups(rows, n, num, den):
    """Per row of ``rows``: size of its set and smallest id of its group (NULL counts as smallest)."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and den * both >= num * (len(sets[a]) + len(sets[b]) - both) and both:
                parent[find(a)] = find(b)
    least = defaultdict(lambda: (True, 10**9))
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least[find(k)], (i is not None, i or 0))
    names = [least[find(k)] for k in range(len(rows))]
    return [(i, len(s), v if known else None) for (i, _), s, (known, v) in zip(rows, sets, names, strict=True)]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def best_stretch(item, text):
    """Fewest edits of ``item`` against any stretch of ``text``."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def kept_lines(rows, edits, least):
    seen, out = [], {}
    known = set()
    for i, text in in_order(rows):
        lines, gone = [], 0
        for line in text.split("\n") if text else []:
            form = line.encode().strip(b" \t\n\x0b\x0c\r")
            if len(form) < least:
                lines.append(line)
                continue
            if form in known:
                gone += 1
                continue
            near = any(abs(len(o) - len(form)) <= edits and edit_distance(o, form) <= edits for o in seen)
            known.add(form)
            seen.append(form)
            if near:
                gone += 1
            else:
                lines.append(line)
        out[i, text] = ("\n".join(lines), gone)
    return out


