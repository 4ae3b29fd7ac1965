"""Suffix-array dedup of bytes: linear grouping construction over the undecided stretches.

:mod:`veldt.llm.winnow` brings together, by anchor, the stretches of text in which a
200-byte repeat can begin or end. Here the stretches of one anchor are concatenated and
their suffix array is built by grouping (Baier 2016): suffixes are grouped by Lyndon
prefix; groups are processed in descending order, each suffix of a group finding by
previous-smaller pointers the suffix whose Lyndon prefix it prolongs; then, in one
ascending sweep, every suffix puts those that it ends into the next free place of their
group. No ranks are renamed and nothing recurses. Equal strings of ``span`` bytes are
neighbours in the array, which a sweep over it marks.

Odd input: a null text is empty; texts shorter than ``span`` bytes lose nothing; equal
texts of at least ``span`` bytes lose everything; matches may overlap themselves;
repeated rows count as copies; null ids are kept; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from functools import partial

import numpy as np
from pyspark.sql import DataFrame

from veldt.llm.winnow import Bytes, covered, remove_repeats

#: Different stretches of one seed that one task sorts; beyond, they are dealt by longer seeds.
CROWD = 1024


def suffix_array(s: list[int] | bytes) -> list[int]:
    """Start positions of the suffixes of ``s`` in ascending order, in linear time but for sorting group members."""
    n = len(s)
    if n < 2:
        return list(range(n))
    by: dict[int, list[int]] = {}
    for i, c in enumerate(s):
        by.setdefault(c, []).append(i)
    sa: list[int] = []
    group, place, size = [0] * n, [0] * n, [0] * n  # first slot of the suffix's group, own slot; size by first slot
    for c in sorted(by):
        first, members = len(sa), by[c]
        size[first] = len(members)
        for i in members:
            group[i], place[i] = first, len(sa)
            sa.append(i)
    before = [-1] * n  # nearest earlier suffix of a lower group
    end = n
    while end:
        first = group[sa[end - 1]]
        if end - first == 1:  # one suffix: at most one pointer to follow
            i = sa[first]
            p = i - 1
            while p >= 0 and group[p] > first:
                p = before[p]
            before[i] = p
            if p >= 0:
                g = group[p]
                m = size[g]
                if m > 1:
                    slot = g + m - 1
                    other, at = sa[slot], place[p]
                    sa[at], place[other] = other, at
                    sa[slot], place[p] = p, slot
                    size[g], size[slot], group[p] = m - 1, 1, slot
            end = first
            continue
        times: dict[int, int] = {}
        for i in sorted(sa[first:end]):
            p = i - 1
            while p >= 0 and group[p] >= first:
                p = before[p]
            before[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        moved: dict[int, dict[int, list[int]]] = {}
        for p, k in times.items():
            moved.setdefault(group[p], {}).setdefault(k, []).append(p)
        for g, by_times in moved.items():
            stop = g + size[g]
            for k in sorted(by_times, reverse=True):  # prolonged more often: higher
                members = by_times[k]
                start = stop - len(members)
                if start == g:
                    size[g] = len(members)
                    break
                for slot, p in enumerate(members, start):
                    other, at = sa[slot], place[p]
                    sa[at], place[other] = other, at
                    sa[slot], place[p] = p, slot
                for p in members:
                    group[p] = start
                size[start] = len(members)
                size[g] -= len(members)
                stop = start
        end = first
    free = list(range(n))  # next slot of each group, by its first slot
    out, placed = [-1] * n, bytearray(n)
    # the empty suffix ends first
    p = n - 1
    while p >= 0 and not placed[p]:
        g = group[p]
        out[free[g]] = p
        free[g] += 1
        placed[p] = 1
        p = before[p]
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            placed[p] = 1
            p = before[p]
    return out


def _reach(texts: list[bytes]) -> list[int]:
    """Longest common prefix of each with any other: with a neighbour in sorted order."""
    order = sorted(range(len(texts)), key=texts.__getitem__)
    best = [0] * len(texts)
    for a, b in zip(order, order[1:], strict=False):
        n = len(os.path.commonprefix((texts[a], texts[b])))
        best[a], best[b] = max(best[a], n), max(best[b], n)
    return best


def solve(contents: list[bytes], counts: list[int], seeds: list[list[int]], unit: Bytes) -> list[set[int]]:
    """Window positions of each stretch that start twice or more in the block of stretches."""
    span = unit.span
    found: list[set[int]] = [set() for _ in contents]
    if all(len(x) == 1 for x in seeds):
        # from the one seed no match reaches further than the longest agreement on either side
        at = [x[0] for x in seeds]
        right = _reach([c[a:] for c, a in zip(contents, at, strict=True)])
        left = _reach([c[:a][::-1] for c, a in zip(contents, at, strict=True)])
        use = [(i, a - x, a + y) for i, (a, x, y) in enumerate(zip(at, left, right, strict=True)) if x + y >= span]
    else:
        use = [(i, 0, len(c)) for i, c in enumerate(contents)]
    if all(counts[i] > 1 for i, _, _ in use):
        return found
    block, starts, of, base = bytearray(), [], [], []
    joined: list[int] = []
    for i, a, b in use:
        piece = contents[i][a:b]
        of += [i] * max(0, len(piece) - span + 1)
        starts += range(len(joined), len(joined) + len(piece) - span + 1)
        base += range(a, a + len(piece) - span + 1)
        joined += [x + 1 for x in piece]
        joined.append(0)  # between stretches, below every byte
        block += piece + b"\0"
    which = dict(zip(starts, range(len(starts)), strict=True))
    last = -1
    for p in suffix_array(joined):
        w = which.get(p)
        if w is None:
            continue
        if last >= 0 and block[p : p + span] == block[starts[last] : starts[last] + span]:
            found[of[w]].add(base[w])
            found[of[last]].add(base[last])
        last = w
    return found


class Finish:
    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def __init__(self, span: int):
        self.span = span

    def __call__(self, raw: bytes, spots: tuple | None) -> tuple[int, int, int, str]:
        if spots is None:
            return len(raw), 0, 0, hashlib.sha256(raw).hexdigest()
        cover, n = covered(spots, len(raw), self.span)
        spans = int(np.count_nonzero(np.diff(np.r_[0, cover.view(np.int8)]) == 1))
        kept = np.frombuffer(raw, dtype=np.uint8)[~cover].tobytes()
        return len(raw), n, spans, hashlib.sha256(kept).hexdigest()


def dedup(df: DataFrame, span: int = 200, gram: int = 64, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row."""
    unit = Bytes(span, gram)
    return remove_repeats(df, unit, partial(solve, unit=unit), Finish(span), CROWD, 8, doc_id, text)
