"""Substring dedup by seed and extend, on words.

Seeds are the winnowed anchors of :mod:`veldt.llm.winnow`: texts are joined on the least
12-word gram of each 35-word window. From a seed that two different stretches share, the
match is extended to the left and to the right word by word; maximal matches of at least
``span`` words are kept, and each window inside them is removed from both texts. Seeds in
more than ``CROWD`` different stretches are lengthened first, so no task grows with a
passage's copies.

Odd input: null and blank texts have no words; a text shorter than a window loses
nothing; equal texts of at least a window lose all words; repeated rows count as copies
of each other; an empty table gives an empty result; null ids are kept; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
from pyspark.sql import DataFrame

from veldt.llm.winnow import Words, covered, remove_repeats

#: Different stretches of one seed that one task extends; beyond, they are dealt by longer seeds.
CROWD = 1024


def extend(a: list[bytes], i: int, b: list[bytes], j: int) -> tuple[int, int]:
    """Words that agree before (i, j) and from (i, j) on."""
    left = 0
    while left < i and left < j and a[i - 1 - left] == b[j - 1 - left]:
        left += 1
    right, most = 0, min(len(a) - i, len(b) - j)
    while right < most and a[i + right] == b[j + right]:
        right += 1
    return left, right


def _together(texts: list[list[bytes]], seeds: list[list[int]], span: int, gram: int) -> list[set[int]]:
    """All seeds extended at once: a step to either side splits the classes that agree so far by their next word."""
    ids: dict[bytes, int] = {}
    flat = np.array([ids.setdefault(w, len(ids)) for t in texts for w in t], dtype=np.int64)
    size = np.array([len(t) for t in texts])
    text = np.repeat(np.arange(len(texts)), [len(s) for s in seeds])
    place = np.array([p for s in seeds for p in s], dtype=np.int64)
    base, size, n, width = (np.cumsum(size) - size)[text], size[text], len(text), span - gram + 1

    def steps(depth: int, way: int) -> list[np.ndarray]:
        """Class of each seed after 0, 1, .. depth words; a text that ends is alone from there on."""
        out = [np.zeros(n, dtype=np.int64)]
        for k in range(depth):
            at = place + (k if way > 0 else -1 - k)
            inside = (at >= 0) & (at < size)
            word = np.where(inside, flat[np.where(inside, base + at, 0)], len(ids) + np.arange(n))
            out.append(np.unique(out[-1] * (len(ids) + n) + word, return_inverse=True)[1])
        return out

    right, left = steps(span, 1), steps(width - 1, -1)
    found: list[set[int]] = [set() for _ in texts]
    for k in range(width):
        _, joint, count = np.unique(right[span - k] * n + left[k], return_inverse=True, return_counts=True)
        for r in np.flatnonzero(count[joint] > 1).tolist():
            found[text[r]].add(int(place[r]) - k)
    return found


def solve(contents: list[bytes], counts: list[int], seeds: list[list[int]], unit: Words, few: int = 24) -> list[set[int]]:
    """Window positions of each stretch that also start in another (or elsewhere in itself).

    Every stretch holds the seed at ``seeds``; windows whose least gram is another one meet
    in that one's group, so other seeds are not looked at. A few seeds are extended pair by
    pair, more of them at once.
    """
    texts = [c.split() for c in contents]
    if sum(map(len, seeds)) > few:
        return _together(texts, seeds, unit.span, unit.gram)
    found: list[set[int]] = [set() for _ in texts]
    for s, a in enumerate(texts):
        for t in range(s, len(texts)):
            if counts[s] > 1 and counts[t] > 1:
                continue
            b = texts[t]
            for i in seeds[s]:
                for j in seeds[t]:
                    if s == t and j <= i:
                        continue
                    left, right = extend(a, i, b, j)
                    if left + right >= unit.span:
                        n = left + right - unit.span + 1
                        found[s].update(range(i - left, i - left + n))
                        found[t].update(range(j - left, j - left + n))
    return found


class Finish:
    names = ("n_words", "n_removed", "kept_sha256")
    schema = "n_words long, n_removed long, kept_sha256 string"

    def __init__(self, span: int):
        self.span = span

    def __call__(self, raw: bytes, spots: tuple | None) -> tuple[int, int, str]:
        words = raw.split()
        if spots is None:
            return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()
        cover, n = covered(spots, len(words), self.span)
        kept = b" ".join([w for w, c in zip(words, cover.tolist(), strict=True) if not c])
        return len(words), n, hashlib.sha256(kept).hexdigest()


def dedup(df: DataFrame, span: int = 35, gram: int = 12, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per row."""
    unit = Words(span, gram)
    return remove_repeats(df, unit, partial(solve, unit=unit), Finish(span), CROWD, 4, doc_id, text)
