"""Near pairs of (artist, album) keys, by an inverted index of letter pairs.

A distance of two fields is ``1 - 2 L / (p + q)`` for texts of ``p`` and ``q`` letters whose
longest common subsequence has ``L`` (the better of the texts as they stand and with their
words in order).  Two keys are near if the mean over both fields is at most ``near``, so

* the better field is within ``near``.  Its ``L`` matched letters, with a mark at either end,
  follow each other in both texts but for one break a letter that is not matched, so the texts
  share at least ``3 L + 1 - p - q`` letter pairs: those with fewer are never looked at;
* letters in common, in any order, bound ``L`` from above in both fields.

Both are necessary, so nothing is lost.  What is left is computed exactly, a row of bits a text
and many pairs at a time.
"""

from __future__ import annotations

import numpy as np

from marram.functions.text import key_distance

#: Letters of a batch with a code of their own; others share the last one.
CODES = 64
#: Pairs that are measured at once.
PAIRS = 200_000


def _shared(total: np.ndarray, near: float) -> np.ndarray:
    """Letter pairs that texts of ``total`` letters together share at least if they are within ``near``."""
    least = np.ceil((1 - near) * total / 2 - 1e-9).astype(np.int64)
    return 3 * least + 1 - total


class Texts:
    """Distinct texts of a field: letters as codes, bags, bit rows, letter pairs."""

    def __init__(self, texts: list[str], codes: dict[str, int]):
        self.texts = texts
        self.size = np.array([len(t) for t in texts], np.int64)
        n = len(texts)
        self.bags = np.zeros((n, CODES), np.int16)
        #: Texts whose letters all have codes of their own, and fit a row of bits.
        self.plain = np.array([len(t) <= 64 and all(codes[c] < CODES - 1 for c in t) for t in texts], bool)
        self.forms = []
        for form in (texts, [" ".join(sorted(t.split())) for t in texts]):
            letters = np.full((n, 64), -1, np.int8)
            rows = np.zeros((n, CODES), np.uint64)
            for i, t in enumerate(form):
                if self.plain[i]:
                    for k, c in enumerate(t):
                        letters[i, k] = codes[c]
                        rows[i, codes[c]] |= np.uint64(1 << k)
            self.forms.append((form, letters, rows))
        for i, t in enumerate(texts):
            for c in t:
                self.bags[i, codes[c]] += 1


def codes_of(*fields: list[str]) -> dict[str, int]:
    """A code a letter, the most frequent first."""
    count: dict[str, int] = {}
    for texts in fields:
        for t in texts:
            for c in t:
                count[c] = count.get(c, 0) + 1
    return {c: min(k, CODES - 1) for k, c in enumerate(sorted(count, key=lambda c: (-count[c], c)))}


def _pairs_of(text: str) -> list[tuple[str, int]]:
    """Letter pairs of a text with a mark at either end, their occurrences numbered."""
    seen: dict[str, int] = {}
    out = []
    marked = f"\x00{text}\x01"
    for i in range(len(marked) - 1):
        g = marked[i : i + 2]
        seen[g] = seen.get(g, 0) + 1
        out.append((g, seen[g]))
    return out


def share_enough(a: Texts, b: Texts, near: float) -> np.ndarray:
    """(a, b) True where texts share as many letter pairs as being within ``near`` takes, in either form."""
    out = np.zeros((len(a.texts), len(b.texts)), bool)
    need = _shared(a.size[:, None] + b.size[None, :], near)
    for (left, *_), (right, *_) in zip(a.forms, b.forms, strict=True):
        postings: dict[tuple[str, int], list[int]] = {}
        for j, t in enumerate(right):
            for g in _pairs_of(t):
                postings.setdefault(g, []).append(j)
        index = {g: np.array(js, np.int32) for g, js in postings.items()}
        for i, t in enumerate(left):
            found = [index[g] for g in _pairs_of(t) if g in index]
            if found:
                out[i] |= np.bincount(np.concatenate(found), minlength=len(right)) >= need[i]
    return out


def _common(a: Texts, b: Texts, x: np.ndarray, y: np.ndarray, form: int) -> np.ndarray:
    """Longest common subsequence of plain texts, many pairs at a time."""
    rows, letters = a.forms[form][2], b.forms[form][1]
    state = np.full(len(x), np.uint64(2**64 - 1))
    for k in range(int(b.size[y].max(initial=0))):
        code = letters[y, k]
        hit = np.where(code >= 0, state & rows[x, code], np.uint64(0))
        state = (state + hit) | (state - hit)
    mask = np.where(a.size[x] >= 64, np.uint64(2**64 - 1), (np.uint64(1) << (a.size[x].astype(np.uint64) & np.uint64(63))) - np.uint64(1))
    return np.bitwise_count(~state & mask).astype(np.int64)


def distances(a: Texts, b: Texts, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact distances of the pairs (x, y)."""
    total = a.size[x] + b.size[y]
    plain = a.plain[x] & b.plain[y]
    out = np.zeros(len(x))
    if plain.any():
        u, v = x[plain], y[plain]
        best = np.maximum(_common(a, b, u, v, 0), _common(a, b, u, v, 1))
        # Two empty texts are equal; one empty text is as far as can be, which the formula says too.
        out[plain] = np.where(total[plain] == 0, 0.0, 1 - 2 * best / np.maximum(total[plain], 1))
    for i in np.flatnonzero(~plain):
        out[i] = key_distance(a.texts[x[i]], b.texts[y[i]])
    return out


def _bound(a: Texts, b: Texts, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least possible distances of the pairs, by letters in common."""
    total = a.size[x] + b.size[y]
    return np.where(total == 0, 0.0, 1 - 2 * np.minimum(a.bags[x], b.bags[y]).sum(1) / np.maximum(total, 1))


def near_pairs(left: list[tuple[str, str]], right: list[tuple[str, str]], near: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(i, j, distance) of all near keys of two lists, and the number of pairs that were measured.

    With ``same`` the lists are one, and pairs have j < i.
    """
    codes = codes_of(*([k[f] for k in keys] for keys in (left, right) for f in (0, 1)))
    fields = []
    for f in (0, 1):
        sides = []
        for keys in (left, right):
            known: dict[str, int] = {}
            at = np.array([known.setdefault(k[f], len(known)) for k in keys], np.int64)
            sides.append((Texts(list(known), codes), at))
        fields.append(sides)
    hits = [share_enough(sides[0][0], sides[1][0], near) for sides in fields]
    found, held, measured = [], [], 0

    def settle():
        nonlocal measured
        x, y = (np.concatenate(p) for p in zip(*held, strict=True))
        held.clear()
        for lo in range(0, len(x), PAIRS):
            u, v = x[lo : lo + PAIRS], y[lo : lo + PAIRS]
            least = sum(_bound(s[0][0], s[1][0], s[0][1][u], s[1][1][v]) for s in fields) / 2
            u, v = u[least <= near + 1e-9], v[least <= near + 1e-9]
            measured += len(u)
            d = sum(distances(s[0][0], s[1][0], s[0][1][u], s[1][1][v]) for s in fields) / 2
            found.append((u[d <= near], v[d <= near], d[d <= near]))

    size = 0
    for i in range(len(left)):
        rows = [h[s[0][1][i]][s[1][1]] for h, s in zip(hits, fields, strict=True)]
        js = np.flatnonzero((rows[0] | rows[1])[: i if same else None])
        if len(js):
            held.append((np.full(len(js), i), js))
            size += len(js)
        if size >= PAIRS:
            settle()
            size = 0
    if held:
        settle()
    i, j, d = (np.concatenate(p) for p in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return i, j, d, measured
