"""Encoding with a public byte-level BPE vocabulary (problem 8): speculate and verify.

Greedy longest match proposes the tokens of each distinct word; a vectorised check tests every
adjacent pair of all proposals at once; only words with a pair the merges wouldn't leave side by
side are merged exactly. Words are those of the vocabulary's split pattern, so a text's tokens are
its words' tokens in order, and a task does the work of a word once.

Defined cases: a null text has an empty list of ids, as has an empty one, so every row has a list; strings that look like special
tokens are ordinary text; texts are encoded whole; a lone surrogate, which UTF-8 can't hold, can't
occur in a Spark string. An empty table gives an empty result; extra columns are kept out of it.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import map_arrow

#: Folder of the vocabulary files; a parameter everywhere, this is only its default.
TOKENIZERS = os.environ.get("LODESTONE_TOKENIZERS", "/opt/tokenizers")
#: The split pattern that belongs to the byte-level vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Most words a task remembers; beyond it the memory starts anew, which costs time, never a result.
REMEMBERED = 400_000


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, the rest for U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and the pair check of one byte-level BPE vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letter = byte_letters()
        known = {t: i for t, i in model["vocab"].items() if all(c in letter for c in t)}
        self.id_of = {bytes(letter[c] for c in t): i for t, i in known.items()}
        size = max(model["vocab"].values()) + 1
        self.longest = max(map(len, self.id_of))
        self.left, self.right = np.arange(size), np.arange(size)
        self.rank = np.full(size, -1)  # of single bytes: before every merge
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        keys, ranks = [], []
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            i, j, k = known.get(a), known.get(b), known.get(a + b)
            if None in (i, j, k):
                continue
            self.merge[i, j] = (r, k)
            self.left[k], self.right[k], self.rank[k] = i, j, r
            keys.append(i * size + j)
            ranks.append(r)
        order = np.argsort(keys)
        self.size, self.keys, self.ranks = size, np.array(keys)[order], np.array(ranks)[order]
        # a token is stable if its own bytes are merged to it; others are never proposed
        stable = {t: i for t, i in self.id_of.items() if len(t) == 1 or self.exact(t) == [i]}
        self.id_of = stable

    def exact(self, word: bytes) -> list[int]:
        """Merge the lowest-ranked adjacent pair until none is left."""
        ids = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        if len(ids) > 64:
            return self._exact_long(ids)
        while len(ids) > 1:
            found = min((x for x in (self.merge.get(p) for p in zip(ids, ids[1:])) if x), default=None)
            if not found:
                break
            new, out, i = found[1], [], 0
            a, b = int(self.left[new]), int(self.right[new])
            while i < len(ids):
                if i + 1 < len(ids) and ids[i] == a and ids[i + 1] == b:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _exact_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and a linked list, for very long words."""
        from heapq import heapify, heappop, heappush

        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(*self.merge[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merge]
        heap = [(r, i, k) for r, k, i in heap]
        heapify(heap)
        while heap:
            r, i, k = heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or self.merge.get((ids[i], ids[j])) != (r, k):
                continue
            ids[i], ids[j], after[i] = k, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (found := self.merge.get((ids[x], ids[y]))):
                    heappush(heap, (found[0], x, found[1]))
        return [x for x in ids if x >= 0]

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; beyond all ranks where there's none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], np.iinfo(np.int64).max)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging would leave each pair of stable tokens side by side.

        Undoes the merges of both tokens from the last on: while tokens x and y touch at the edge,
        their own merge must not come before the merge that took either of them up.
        """
        fine = np.ones(len(a), bool)
        rows = np.arange(len(a))
        x, y = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        taken_left = np.zeros(len(a), bool)  # whether the edge token that was split last is on the left
        while len(rows):
            r = self.pair_rank(x, y)
            # a merge at the limit's own rank runs from left to right: the pair comes first only if it begins first
            bad = (r < limit) | ((r == limit) & (limit < np.iinfo(np.int64).max) & ~taken_left)
            fine[rows[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go_left = rx >= ry
            ended = (rx < 0) & (ry < 0)
            go = ~bad & ~ended
            rows, x, y, rx, ry, go_left = rows[go], x[go], y[go], rx[go], ry[go], go_left[go]
            limit = np.where(go_left, rx, ry)
            taken_left = go_left
            x, y = np.where(go_left, self.right[x], x), np.where(go_left, y, self.left[y])
        return fine

    def greedy(self, word: bytes) -> list[int]:
        ids, i, n, id_of = [], 0, len(word), self.id_of
        while i < n:
            for j in range(min(n, i + self.longest), i, -1):
                if (k := id_of.get(word[i:j])) is not None:
                    ids.append(k)
                    i = j
                    break
        return ids

    def encode_words(self, words: list[bytes]) -> tuple[list[list[int]], int]:
        """Tokens of each word, and how many words had to be merged exactly."""
        out = [[k] if (k := self.id_of.get(w)) is not None else self.greedy(w) for w in words]
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter((k for x in out for k in x), np.int64, sizes.sum())
        owner = np.repeat(np.arange(len(out)), sizes)
        inside = owner[1:] == owner[:-1]
        ok = self.compatible(flat[:-1][inside], flat[1:][inside])
        failed = np.unique(owner[1:][inside][~ok])
        for i in failed:
            out[i] = self.exact(words[i])
        return out, len(failed)


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts in batches, remembering words."""

    def __init__(self, path: str):
        self.vocabulary, self.split, self.known = vocabulary(path), regex.compile(PATTERN).findall, {}

    def __call__(self, texts: list[str | None]) -> list[list[int] | None]:
        split = [None if x is None else self.split(x) for x in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        new = [*{w for x in split if x for w in x if w not in known}]
        if new:
            found, _ = self.vocabulary.encode_words([w.encode("utf-8", "surrogatepass") for w in new])
            known.update(zip(new, found))
        out = []
        for x in split:
            if x is None:
                out.append(None)
            else:
                ids: list[int] = []
                for w in map(known.__getitem__, x):
                    ids += w
                out.append(ids)
        return out


def _vocabulary_file(name: str, folder: str) -> str:
    return os.path.join(folder, f"{name}.json")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, ids array<int>): the token ids of each row's text, without special tokens. Repeated rows are kept.

    The vocabulary is a file of fixed size that each executor opens in `folder`."""
    path = _vocabulary_file(name, folder)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def make():
        encoder = Encoder(path)

        def f(batch: pa.RecordBatch) -> dict:
            ids, text = batch.columns
            got, sizes = [], [0]
            for at in range(0, len(text), 500):
                for x in encoder(text[at : at + 500].to_pylist()):
                    got.append(np.array(x or (), np.int32))
                    sizes.append(len(got[-1]))
            offsets = pa.array(np.cumsum(sizes, dtype=np.int64), pa.int32())
            return {"id": ids, "ids": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(got) if got else np.empty(0, np.int32)))}

        return f

    return map_arrow(rows, make, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def count_tokens(docs: DataFrame, columns: list[str], text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The columns given and n_tokens, the number of tokens of the row's text; a null text has 0."""
    path = _vocabulary_file(name, folder)
    rows = docs.select(*columns, F.col(text_col).alias("__text"))

    def make():
        encoder = Encoder(path)

        def f(batch: pa.RecordBatch) -> dict:
            text = batch.column(batch.num_columns - 1)
            counts = [len(x or ()) for at in range(0, len(text), 500) for x in encoder(text[at : at + 500].to_pylist())]
            return {c: batch.column(i) for i, c in enumerate(columns)} | {"n_tokens": counts}

        return f

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    return map_arrow(rows, make, f"{schema}, n_tokens long")
