"""Plain statements of the contracts, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

BLANKS = "\x20\x09-\x0d"
ORDER = {"assign": 0, "access": 1, "hex": 2}


def words(text):
    return re.findall(f"[^{BLANKS}]+", text or "")


def shingles(text, size=5):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = words(lowered)
    if len(found) < size:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + size]) for i in range(len(found) - size + 1)}


def first_strings(rows, size):
    """doc_id -> kept bytes and number of removed runs, for rows with different ids."""
    owner, out = {}, {}
    for doc_id, text in sorted(rows):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - size + 1):
            if owner.setdefault(raw[i : i + size], doc_id) < doc_id:
                gone[i : i + size] = [True] * size
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc_id] = bytes(b for b, g in zip(raw, gone) if not g), sum(gone), runs
    return out


def lone_words(rows, size):
    """Kept words of each row, in order."""
    texts = [words(t) for _, t in rows]
    seen = Counter(tuple(w[i : i + size]) for w in texts for i in range(len(w) - size + 1))
    out = []
    for w in texts:
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


def linked(rows, percent=80, size=5):
    """doc_id -> set size, smallest linked id, for rows with different ids."""
    sets = {d: shingles(t, size) for d, t in rows}
    near = defaultdict(set)
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a != b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                near[a].add(b)
    out = {}
    for d in sorted(sets):
        if d not in out:
            todo, seen = [d], {d}
            while todo:
                for x in near[todo.pop()] - seen:
                    seen.add(x)
                    todo.append(x)
            out.update({x: (len(sets[x]), d) for x in seen})
    return out


def base_spans(text):
    """Spans of the fixed kinds as kind:start:end by start."""
    either = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    names = "|".join([either("password"), either("passwd"), either("secret"), either("token"), either("api") + "_?" + either("key")])
    text, found = text or "", []
    for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), "assign", m.end()))
    found += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(found, key=lambda s: (s[0], ORDER[s[1]])))
