"""Byte-pair encoding of whole texts with a public vocabulary, in numpy matrices.

Texts are cut into pieces by the vocabulary's pattern; the distinct pieces of a
batch are laid into matrices of rows of nearly equal length, one byte token a
cell.  In every round each row merges its leftmost pair of minimum rank; the
rank of a pair comes from an open-addressing hash table over (left, right).
Merged cells are compacted away and finished rows leave the matrix.  Pieces
longer than ``LONG`` bytes, of which a matrix would be mostly padding, are
merged with a heap in the same order.

A null and an empty text both have no ids.  Strings that look like special
tokens are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from litmusq.llm.chunking import mix64

#: Fixed value: the pattern that goes with the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes from which a piece is merged with a heap; pieces a worker remembers.
LONG, REMEMBERED = 1024, 200_000
_NONE = np.int64(1 << 40)


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed vocabulary files are."""
    try:
        import public_tokenizers

        return str(public_tokenizers.path(name))
    except ImportError:
        return f"/opt/tokenizers/{name}"


class Vocabulary:
    """Ranks of byte strings, and of pairs of tokens in a hash table."""

    def __init__(self, data: bytes) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        keys = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        self._bits = int(np.ceil(np.log2(len(keys) * 2.5)))
        self._keys = np.full(1 << self._bits, -1, np.int64)
        self._ranks = np.full(1 << self._bits, _NONE, np.int64)
        todo, at = np.arange(len(keys)), self._slot(keys)
        rank = np.array(rank, np.int64)
        self._probes = 0
        while len(todo):  # every key takes the first free slot after its own
            self._probes += 1
            free = self._keys[at] == -1
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            won = first[free[first]]
            self._keys[at[won]], self._ranks[at[won]] = keys[todo[won]], rank[todo[won]]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, at = todo[rest], (at[rest] + 1) & ((1 << self._bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys.view(np.uint64)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every pair, a huge number where it can't be merged."""
        keys = (left << 32) | right
        at = self._slot(keys)
        out = np.full(len(keys), _NONE, np.int64)
        open_, mask = np.arange(len(keys)), (1 << self._bits) - 1
        for _ in range(self._probes):
            there = self._keys[at]
            hit = there == keys[open_]
            out[open_[hit]] = self._ranks[at[hit]]
            more = ~hit & (there != -1)
            if not more.any():
                break
            open_, at = open_[more], (at[more] + 1) & mask
        return out

    def _merge_rows(self, rows: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """Merges the rows of a padded matrix; padding is -1."""
        result: list[np.ndarray | None] = [None] * len(rows)
        who = np.arange(len(rows))
        wide = rows.shape[1]
        ranks = np.full((len(rows), max(wide - 1, 0)), _NONE, np.int64)
        r, c = np.nonzero(rows[:, 1:] >= 0)
        ranks[r, c] = self.pair_ranks(rows[r, c], rows[r, c + 1])
        while len(who):
            if ranks.shape[1]:
                best = ranks.argmin(1)
                value = ranks[np.arange(len(who)), best]
            else:
                value = np.full(len(who), _NONE)
            done = value == _NONE
            for i in np.flatnonzero(done):
                result[who[i]] = rows[i, : lengths[i]]
            keep = np.flatnonzero(~done)
            if not len(keep):
                break
            who, rows, ranks, best, value, lengths = who[keep], rows[keep], ranks[keep], best[keep], value[keep], lengths[keep] - 1
            n, at = len(who), np.arange(len(who))
            rows[at, best] = value
            # the cell after the merged one is closed up, and the pair it made with it
            cell = np.arange(rows.shape[1] - 1)
            rows = np.where(cell[None, :] > best[:, None], rows[:, 1:], rows[:, :-1])
            pair = cell[:-1]
            ranks = np.where(pair[None, :] >= best[:, None], ranks[:, 1:], ranks[:, :-1])
            wide = int(lengths.max())
            rows, ranks = rows[:, :wide], ranks[:, : max(wide - 1, 0)]
            for side in (-1, 0):  # the pairs left and right of the merged cell
                p = best + side
                ok = np.flatnonzero((p >= 0) & (p + 1 < lengths))
                if len(ok):
                    ranks[ok, p[ok]] = self.pair_ranks(rows[ok, p[ok]], rows[ok, p[ok] + 1])
            past = np.flatnonzero((best >= lengths - 1) & (best < ranks.shape[1]))
            ranks[past, best[past]] = _NONE
            assert n == len(rows)
        return result  # type: ignore[return-value]

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """One long piece: a linked list and a heap, leftmost minimum rank first."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pair_ranks(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)).tolist()
        none = int(_NONE)
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r < none]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def push(i: int) -> None:
            j = after[i]
            if j < n:
                key = (ids[i], ids[j])
                r = known.get(key)
                if r is None:
                    r = known[key] = int(self.pair_ranks(np.array(key[:1], np.int64), np.array(key[1:], np.int64))[0])
                if r < none:
                    heapq.heappush(heap, (r, i, *key))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([x for x in ids if x >= 0], np.int64)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of every piece."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pieces)
        sizes = np.fromiter((len(p) for p in pieces), np.int64, len(pieces))
        for i in np.flatnonzero(sizes > LONG):
            out[i] = self._merge_long(pieces[i])
        order = np.argsort(sizes, kind="stable")
        order = order[(sizes[order] > 0) & (sizes[order] <= LONG)]
        bucket = np.where(sizes[order] <= 16, sizes[order], 16 << np.ceil(np.log2(np.maximum(sizes[order], 16) / 16)).astype(np.int64))
        for w in np.unique(bucket):
            chosen = order[bucket == w]
            for k in range(0, len(chosen), 8192):
                part = chosen[k : k + 8192]
                width = int(sizes[part].max())
                rows = np.full((len(part), width), -1, np.int64)
                inside = np.arange(width)[None, :] < sizes[part][:, None]
                rows[inside] = self.byte[np.frombuffer(b"".join(pieces[i] for i in part), np.uint8)]
                for i, ids in zip(part, self._merge_rows(rows, sizes[part].copy())):
                    out[i] = ids
        return out


_kept: dict[str, Vocabulary] = {}


def _encoder(data, name: str):
    """The encoding of batches; the vocabulary is built once a worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _kept.get(name)
        if vocabulary is None:
            vocabulary = _kept[name] = Vocabulary(data.value)
        cut = regex.compile(PATTERN).findall
        seen: dict[str, int] = {}
        stored: list[np.ndarray] = []
        for batch in batches:
            if len(seen) > REMEMBERED:
                seen, stored = {}, []
            texts = batch.column("text").to_pylist()
            codes: list[int] = []
            counts = np.zeros(len(texts), np.int64)
            fresh: list[str] = []
            for i, text in enumerate(texts):
                if text:
                    pieces = cut(text)
                    counts[i] = len(pieces)
                    for p in pieces:
                        code = seen.get(p)
                        if code is None:
                            code = seen[p] = len(seen)
                            fresh.append(p)
                        codes.append(code)
            stored.extend(vocabulary.encode_pieces([p.encode("utf-8") for p in fresh]))
            lengths = np.fromiter((len(x) for x in stored), np.int64, len(stored))
            code = np.array(codes, np.int64)
            per_piece = lengths[code] if len(code) else np.zeros(0, np.int64)
            ends = np.concatenate(([0], np.cumsum(per_piece)))
            bounds = ends[np.concatenate(([0], np.cumsum(counts)))]
            values = np.concatenate([stored[c] for c in codes]) if codes else np.zeros(0, np.int64)
            ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return run


def encode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids of each document's text without special tokens.

    ``path`` is the vocabulary file in rank format, read on the driver (its
    size, under 1 MB, bounds what is broadcast).  Every row of ``documents``
    gives one row, whatever its text.
    """
    path = path or vocabulary_path()
    data = documents.sparkSession.sparkContext.broadcast(Path(path).read_bytes())
    return documents.select("doc_id", "text").mapInArrow(_encoder(data, path), "doc_id bigint, ids array<int>")
