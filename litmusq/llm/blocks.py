"""Blocks of records under common keys: entries of fixed width, packed by part of the keys and worked on by numpy.

A row of a shuffle costs more than the few bytes that a record leaves under a
key.  So the entries of a batch travel as one run of bytes for each part of the
keys, and a part is taken apart, sorted and compared as arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmusq.functions.bitmaps import asked, bitmap

PACKED = "part int, entries binary"
#: Bytes of entries of a part, bytes of text taken at once, bits of the bitmap of the records that are read again.
PART_BYTES, PIECE, BITS = 8 << 20, 1 << 21, 1 << 26


def parts_for(entries: float, width: int) -> int:
    return max(12, int(entries * width) // PART_BYTES)


def packed(part: np.ndarray, entries: np.ndarray) -> pa.RecordBatch:
    """One row for each part, with the bytes of its entries."""
    order = np.argsort(part, kind="stable")
    part, entries = part[order], entries[order]
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    ends = np.append(starts[1:], len(part))
    return pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), pa.array([entries[i:j].tobytes() for i, j in zip(starts, ends)], pa.binary())], ["part", "entries"])


def by_part(blobs: DataFrame, entry: np.dtype, work: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], names: tuple[str, str]) -> DataFrame:
    """The distinct pairs of record ids that ``work`` finds among the entries of each part."""

    def run(table: pa.Table) -> pa.Table:
        a, b = work(np.frombuffer(b"".join(table.column("entries").to_pylist()), entry))
        both = np.unique(np.stack((a, b), 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.table([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], list(names))

    return blobs.groupBy("part").applyInArrow(run, f"{names[0]} bigint, {names[1]} bigint").distinct()


def pieces(batch: pa.RecordBatch, columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``PIECE`` bytes of text."""
    if not batch.num_rows:
        return
    sizes = sum(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    ends = np.cumsum(sizes) // PIECE
    bounds = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
    for i, j in zip(bounds, bounds[1:]):
        yield batch.slice(i, j - i)


def words_of(texts: pa.Array, tag: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, code, hash): where the words of each normalised text start, n + 1 places, their codes, and the hash of each code."""
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    hashes = np.array([int.from_bytes(blake2b(tag + w.encode(), digest_size=8).digest(), "little") for w in coded.dictionary.to_pylist()], np.uint64)
    starts = lists.offsets.to_numpy().astype(np.int64)
    return starts - starts[0], coded.indices.to_numpy().astype(np.int64), hashes


def distinct_words(starts: np.ndarray, code: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, code) of the distinct words of every text, in order of both."""
    width = max(words, 1)
    both = np.unique(np.repeat(np.arange(len(starts) - 1), np.diff(starts)) * width + code)
    return both // width, both % width


def texts_again(pairs: DataFrame, members: DataFrame, wanted: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The rows of ``pairs`` (pair_id and fields) that may hold a wanted record (rid); ``members`` are (rid, pair_id).

    Texts are not carried through the search; those of the few records it
    leaves are read again, told to the tasks by a bitmap.  More rows may come.
    """
    ids = members.join(wanted, "rid", "left_semi").groupBy("rid").agg(F.min("pair_id").alias("pair_id")).select(F.xxhash64("pair_id").alias("place"))
    raw = pairs.sparkSession.sparkContext.broadcast(bitmap(ids, "place", BITS))
    columns = ["place", *fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = asked(raw.value, batch.column("place").to_numpy().view(np.uint64))
            yield batch.filter(pa.array(hit)).select(columns)

    rows = pairs.where("pair_id IS NOT NULL").select(F.xxhash64("pair_id").alias("place"), *fields)
    return rows.mapInArrow(run, ", ".join(["place bigint", *[f"{f} string" for f in fields]])).drop("place")
