"""Token counts that follow edits.

A text is cut into pre-tokens, each encoded by itself, so its token count is a sum of
small counts. They are kept in a segment tree: leaves are runs of pre-tokens, every node
holds the characters and the tokens below it. An edit finds its leaf by characters, cuts
again from the last boundary that the edit can't have moved (the pattern looks at most
two characters past a pre-token's end) until an old boundary comes back, encodes only
those pre-tokens and updates the sums on the way up. The rest is neither read nor encoded.

Odd input: a null text counts as empty and a null list of edits as none; positions and
lengths outside the text are cut to it; edits apply one after another; repeated rows are
counted each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import partial
from pathlib import Path

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's own cut into pre-tokens (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters past a pre-token's end that may decide where it ends.
AHEAD = 2
LEAF = 64


class Encoder:
    """Tokens of a pre-token, remembered."""

    def __init__(self, path: str, pattern: str = PATTERN):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        self._encode = tiktoken.Encoding("veldt", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cut = regex.compile(pattern)
        self._known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known, out = self._known, []
        if len(known) > 400_000:
            known.clear()
        for p in pieces:
            n = known.get(p)
            if n is None:
                n = known[p] = len(self._encode(p))
            out.append(n)
        return out

    def whole(self, text: str) -> int:
        return len(self._encode(text))


class TokenTree:
    """Segment tree over the pre-tokens of one text."""

    def __init__(self, text: str, encoder: Encoder):
        self.text, self.encoder, self.encoded = text, encoder, 0
        self._build(self._cut(text))

    def _cut(self, text: str) -> list[tuple[int, int]]:
        pieces = self.encoder.cut.findall(text)
        self.encoded += len(pieces)
        return list(zip(map(len, pieces), self.encoder.counts(pieces), strict=True))

    def _build(self, items: list[tuple[int, int]]) -> None:
        leaves = [items[i : i + LEAF] for i in range(0, len(items), LEAF)] or [[]]
        size = 1
        while size < len(leaves):
            size *= 2
        self.size, self.leaves = size, leaves + [[] for _ in range(size - len(leaves))]
        self.chars, self.tokens = [0] * (2 * size), [0] * (2 * size)
        for k, leaf in enumerate(self.leaves):
            self.chars[size + k], self.tokens[size + k] = sum(n for n, _ in leaf), sum(c for _, c in leaf)
        for k in range(size - 1, 0, -1):
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _leaf_at(self, pos: int) -> tuple[int, int]:
        """Leaf whose characters reach past ``pos`` (the last one at the end), and its first character."""
        k, start = 1, 0
        while k < self.size:
            k *= 2
            if start + self.chars[k] <= pos and self.chars[k + 1]:
                start += self.chars[k]
                k += 1
        return k - self.size, start

    def _put(self, k: int, leaf: list[tuple[int, int]]) -> None:
        self.leaves[k] = leaf
        k += self.size
        self.chars[k], self.tokens[k] = sum(n for n, _ in leaf), sum(c for _, c in leaf)
        k //= 2
        while k:
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]
            k //= 2

    def edit(self, pos: int, delete: int, insert: str) -> None:
        """Replaces ``delete`` characters at ``pos`` by ``insert``."""
        pos = max(0, min(pos, len(self.text)))
        delete = max(0, min(delete, len(self.text) - pos))
        if not delete and not insert:
            return
        text = self.text = self.text[:pos] + insert + self.text[pos + delete :]
        shift = len(insert) - delete
        # left: the first pre-token that ends within AHEAD characters before the edit, or later
        first, start = self._leaf_at(max(0, pos - AHEAD))
        kept: list[tuple[int, int]] = []
        begin = start
        for n, c in self.leaves[first]:
            if begin + n > pos - AHEAD:
                break
            kept.append((n, c))
            begin += n
        # right: old boundaries from the end of the deleted characters on, leaf by leaf, until one comes back
        old, at, leaf, index = pos + delete, begin, first, len(kept)
        fresh: list[str] = []
        here = begin  # in the new text
        resume: tuple[int, int] | None = None
        find = self.encoder.cut.match
        while here < len(text):
            while at < here - shift or at < old:  # next old boundary not before this one
                while leaf < self.size and index >= len(self.leaves[leaf]):
                    leaf, index = leaf + 1, 0
                if leaf >= self.size:
                    break
                at += self.leaves[leaf][index][0]
                index += 1
            if here - shift == at and at >= old and here >= pos + len(insert):
                resume = (leaf, index)
                break
            m = find(text, here)
            if m is None:  # a character that the pattern leaves out
                here += 1
                continue
            fresh.append(m.group())
            here = m.end()
        self.encoded += len(fresh)
        middle = list(zip(map(len, fresh), self.encoder.counts(fresh), strict=True))
        if resume is None:
            resume = (self.size, 0)
        leaf, index = resume
        tail = self.leaves[leaf][index:] if leaf < self.size else []
        if leaf == first:
            self._put(first, kept + middle + tail)
        else:
            self._put(first, kept + middle)
            for k in range(first + 1, min(leaf, self.size)):
                if self.leaves[k]:
                    self._put(k, [])
            if leaf < self.size and index:
                self._put(leaf, tail)
        if len(self.leaves[first]) > 8 * LEAF:
            self._build([x for y in self.leaves for x in y])


def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(path)
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            rows: list[tuple[int, int, int, int]] = []
            for text, edits in zip(part.column("text").to_pylist(), part.column("edits").to_pylist(), strict=True):
                tree = TokenTree(text or "", encoder)
                before, pieces, tree.encoded = tree.total, tree.encoded, 0
                for e in edits or []:
                    tree.edit(e["pos"] or 0, e["n"] or 0, e["text"] or "")
                rows.append((before, pieces, tree.total, tree.encoded))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]], names=["doc_id", "n_tokens", "n_pieces", "n_tokens_edited", "n_reencoded"])


def count(df: DataFrame, edits: Column, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens, n_pieces, and after the edits (array of pos, n, text): n_tokens_edited, n_reencoded."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), edits.alias("edits"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(partial(_counted, path=tokenizer), f"doc_id {kind}, n_tokens long, n_pieces long, n_tokens_edited long, n_reencoded long")


def seeded_edits(doc_id: Column, text: Column, n: int = 3) -> Column:
    """n edits drawn from the id: by turns a replacement, a deletion and an insertion somewhere in the text."""
    size = F.length(F.coalesce(text, F.lit("")))
    one = []
    for k in range(n):
        at = F.pmod(F.xxhash64(doc_id.cast("string"), F.lit(k)), F.greatest(size, F.lit(1)).cast("long")).cast("int")
        gone, word = ((7, " tokens"), (12, ""), (0, " an edit,"))[k % 3]
        one.append(F.struct(at.alias("pos"), F.lit(gone).alias("n"), F.lit(word).alias("text")))
    return F.array(*one)
