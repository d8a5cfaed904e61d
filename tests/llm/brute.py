"""Slow and plain versions that the operators are tested against."""

import re


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def spaced_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))


def shingle_set(text, k):
    w = spaced_words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_duplicates(rows, k, percent):
    """(doc_id, text) rows -> sorted (doc_id, n_shingles, component_id, kept)."""
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        if d is None:
            out.append((d, len(sets[i]), None, True))
        else:
            c = min(rows[j][0] for j in range(len(rows)) if rows[j][0] is not None and (find(j) == find(i) or rows[j][0] == d and i == j))
            out.append((d, len(sets[i]), c, c == d))
    return sorted(out, key=str)
