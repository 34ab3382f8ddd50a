"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def shingles(text, n=5):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(len(w) - n, 0) + 1))


def components(rows):
    """doc_id -> smallest id reachable, for rows with different ids."""
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                label[y] = x
    return {i: top(i) for i in ids}


def repeated(rows, length=100):
    """doc_id -> flags of removed bytes, for rows with different ids."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            part = raw[s : s + length]
            if part in seen:
                gone[s : s + length] = b"\x01" * length
            else:
                seen.add(part)
        out[i] = gone
    return out


def tile(item, text, least=3):
    """Greedy string tiling of two lists of words: tiled words."""
    done_a, done_b, total = [False] * len(item), [False] * len(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and not done_a[i + n] and not done_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return total
        done_a[i : i + n] = [True] * n
        done_b[j : j + n] = [True] * n
        total += n


def plain_words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").translate(LOWER))


def rules(text, limits, line_limit):
    """Counts and verdict of the quality rules."""
    w = words(text)
    chars = sum(map(len, w))

    def cover(n):
        at = {}
        for i in range(len(w) - n + 1):
            at.setdefault(tuple(w[i : i + n]), []).append(i)
        hit = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(n)}
        return len(hit), sum(len(w[i]) for i in hit)

    lines, dup, dup_chars = set(), 0, 0
    for line in (text or "").split("\n"):
        if words(line):
            if line in lines:
                dup += 1
                dup_chars += sum(map(len, words(line)))
            lines.add(line)
    again = cover(8)[0]
    failed = len(w) < 20 or 100 * again > 30 * len(w)
    kept = not failed and all(cover(n)[1] <= limit * chars for n, limit in limits.items()) and dup_chars <= line_limit * chars
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), chars, symbols, dup, again, failed, kept
