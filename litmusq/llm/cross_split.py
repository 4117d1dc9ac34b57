"""Overlaps of evaluation records with training records: exact candidates by rare words, overlap by chunks.

1. Records are normalised to words; a record is known by the 64-bit hash of its
   normalised fields, so records of equal content are one class.
2. Words of anchors are counted in ``COUNTERS`` counters.  Of n words an anchor
   keeps the rarest n - ceil(threshold * n) + 1, in the one order that the
   counters and hashes give: two sets of words of a likeness of at least
   ``threshold`` share a kept word (prefix filtering), whatever the order is.
3. A record leaves an entry of fixed width under each kept word of its anchor
   (``blocks``): the sides it is on, and number and bitmap of each field's words.
   Under a word the different anchors are compared first, every two of them,
   then the records of anchors that may be alike.  Two sets of words differ in
   at least as many words as their bitmaps in bits, so no pair is lost.
4. The texts of the records left are read again for an exact check of the word
   sets; no step loses a pair, whatever the order of words and wherever the
   edits are.
5. Records found alike are cut into chunks where a rolling hash says so.  The
   lengths of shared chunks add up to the overlap fraction that is reported.

Nulls: a null key drops the row; a null, empty or wordless field has likeness 0
to anything, so its record has no overlap.  Repeated rows of a pair_id count
once.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmusq.functions.words import likeness, normalised, word_hashes
from litmusq.llm.blocks import PACKED, by_part, distinct_words, packed, parts_for, pieces, texts_again, words_of
from litmusq.llm.chunking import chunk_batch
from litmusq.plans.lineage import materialise
from litmusq.sources.tables import latest

FIELDS = ("anchor", "positive", "negative")
EVALUATION = ("test", "heldout", "adversarial")
#: Counters of the words of anchors, anchors of a word compared without regard to size, pairs compared at once.
COUNTERS, FEW, AT_ONCE = 1 << 18, 64, 1 << 20
ENTRY = np.dtype([("key", "u4"), ("rid", "i8"), ("aid", "i8"), ("side", "u1"), *[(f"{f}_n", "i4") for f in FIELDS], ("anchor_0", "u8"), *[(f"{f}_{i}", "u8") for f in FIELDS[1:] for i in (0, 1)]])
#: Bytes of text cut at once; the arrays of the work take about a hundred times that.
PIECE = 1 << 20


def split_name(split: Column) -> Column:
    """Splits are spelled unevenly: case, blanks, hyphens and underscores are ignored."""
    return F.regexp_replace(F.lower(split), r"[^a-z]", "")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.encode() for t in batch.column("content").to_pylist()]
        ends = np.cumsum([len(t) for t in texts]) // PIECE
        bounds = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)] if texts else [0, 0]
        for i, j in zip(bounds, bounds[1:]):
            part = texts[i:j]
            owner, digest, length = chunk_batch(part)
            offsets = np.searchsorted(owner, np.arange(len(part) + 1)).astype(np.int32)
            chunks = pa.StructArray.from_arrays([pa.array(digest), pa.array(length)], ["digest", "bytes"])
            yield pa.RecordBatch.from_arrays([batch.column("rid").slice(i, j - i), pa.ListArray.from_arrays(pa.array(offsets), chunks)], ["rid", "chunks"])


def _weight(chunks: Column) -> Column:
    return F.aggregate(chunks, F.lit(0).cast("bigint"), lambda s, c: s + c["bytes"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        if batch.num_rows:
            starts, code, hashes = words_of(batch.column("anchor"))
            _, each = distinct_words(starts, code, len(hashes))
            np.add.at(counts, (hashes % np.uint64(COUNTERS)).astype(np.int64), np.bincount(each, minlength=len(hashes)))
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["i", "n"])


def word_counts(anchors: DataFrame) -> np.ndarray:
    """Records by counter of the words of ``anchor``, normalised; at most ``COUNTERS`` rows reach the driver."""
    found = anchors.mapInArrow(_count, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[found.column("i").to_numpy()] = found.column("n").to_numpy()
    return out


def _bits(starts: np.ndarray, code: np.ndarray, hashes: np.ndarray, maps: int) -> list[np.ndarray]:
    """64 bits of the words of each text in each of ``maps`` bitmaps; every text has a word."""
    place, which = hashes & np.uint64(63), (hashes >> np.uint64(6)) % np.uint64(maps)
    one = np.uint64(1) << place
    return [np.bitwise_or.reduceat(np.where(which == i, one, np.uint64(0))[code], starts[:-1]) for i in range(maps)]


def _enter(counts, threshold: float, parts: int):
    """The entries of each record under the kept words of its anchor, packed by part.

    A word that one record has is met by no other: it uses up a place only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, FIELDS):
                n = batch.num_rows
                record = np.empty(n, ENTRY)
                for c in ("rid", "aid", "side"):
                    record[c] = batch.column(c).to_numpy()
                for f in FIELDS:
                    starts, code, hashes = words_of(batch.column(f))
                    owner, each = distinct_words(starts, code, len(hashes))
                    record[f"{f}_n"] = np.bincount(owner, minlength=n)
                    for i, bits in enumerate(_bits(starts, code, hashes, 1 if f == "anchor" else 2)):
                        record[f"{f}_{i}"] = bits
                    if f == "anchor":
                        words, owners, held = hashes, owner, each
                often = counts.value[(words % np.uint64(COUNTERS)).astype(np.int64)]
                rank = np.empty(len(words), np.int64)
                rank[np.lexsort((words, often))] = np.arange(len(words))
                order = np.lexsort((rank[held], owners))
                total = record["anchor_n"].astype(np.int64)
                place = np.arange(len(owners)) - (np.cumsum(total) - total)[owners]
                kept = (place < (total - np.ceil(total * threshold - 1e-9).astype(np.int64) + 1)[owners]) & (often[held[order]] > 1)
                key, entries = words[held[order][kept]], record[owners[kept]]
                entries["key"] = key & np.uint64(0xFFFFFFFF)
                yield packed((key >> np.uint64(32)) % np.uint64(parts), entries)

    return run


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all ranges, one after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _chunks(costs: np.ndarray) -> Iterator[slice]:
    """Slices of a total of about ``AT_ONCE``, of one element where that costs more."""
    if len(costs):
        cuts = np.flatnonzero(np.diff(np.cumsum(costs) // AT_ONCE)) + 1
        yield from (slice(i, j) for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(costs)]))


def _like_anchors(n: np.ndarray, bits: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places i, j of every two anchors that may be alike, each two once, an anchor with itself too; ``n`` ascends."""
    part, out = (1 - threshold) / (1 + threshold), []
    groups = [(0, len(n), 0)] if len(n) <= FEW else [(*np.searchsorted(n, [s, s + 1]).tolist(), int(np.searchsorted(n, s * threshold - 1e-9))) for s in np.unique(n).tolist()]
    for first, end, low in groups:
        step = max(1, AT_ONCE // (end - low))
        for i in range(first, end, step):
            j = min(i + step, end)
            if len(n) <= FEW:
                most = (n[i:j, None] + n[None, low:end]) * part + 1e-9
                ok = (np.bitwise_count(bits[i:j, None] ^ bits[None, low:end]) <= most) & (n[None, low:end] >= n[i:j, None] * threshold - 1e-9)
            else:
                most = np.minimum(np.floor((n[i] + n[low:end]) * part + 1e-9), 64).astype(np.uint8)
                ok = np.bitwise_count(bits[i:j, None] ^ bits[None, low:end]) <= most
            x, y = np.nonzero(ok)
            x, y = x + i, y + low
            out.append(np.stack((x[y <= x], y[y <= x])))
    return tuple(np.concatenate(out, 1))


def _meet(threshold: float):
    """Ids of the records under one key, of different sides and classes, that may be alike in every field."""
    part = (1 - threshold) / (1 + threshold)

    def alike(e: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for f in reversed(FIELDS[1:]):
            x, y = e[f"{f}_n"][a], e[f"{f}_n"][b]
            apart = np.bitwise_count(e[f"{f}_0"][a] ^ e[f"{f}_0"][b]) + np.bitwise_count(e[f"{f}_1"][a] ^ e[f"{f}_1"][b])
            ok = (apart <= (x + y) * part + 1e-9) & (np.minimum(x, y) >= np.maximum(x, y) * threshold - 1e-9)
            a, b = a[ok], b[ok]
        other = e["rid"][a] != e["rid"][b]
        return a[other], b[other]

    def block(e: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``e`` is in order of the anchor's number of words and of anchors."""
        first = np.flatnonzero(np.concatenate(([True], e["aid"][1:] != e["aid"][:-1])))
        sides = []
        for side in (1, 2):
            at = np.flatnonzero(e["side"] & side)
            begin = np.searchsorted(at, first)
            sides.append((at, begin, np.diff(np.append(begin, len(at)))))
        (train, t0, tn), (other, o0, on) = sides
        if not len(train) or not len(other):
            return
        i, j = _like_anchors(e["anchor_n"][first], e["anchor_0"][first], threshold)
        left, right = np.concatenate((i, j[i != j])), np.concatenate((j, i[i != j]))
        both = (tn[left] > 0) & (on[right] > 0)
        left, right = left[both], right[both]
        for some in _chunks(tn[left] * on[right]):
            a, r = train[_ranges(t0[left[some]], tn[left[some]])], np.repeat(right[some], tn[left[some]])
            for few in _chunks(on[r]):
                yield alike(e, np.repeat(a[few], on[r[few]]), other[_ranges(o0[r[few]], on[r[few]])])

    def work(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = entries[np.lexsort((entries["rid"], entries["aid"], entries["anchor_n"], entries["key"]))]
        fresh = np.concatenate(([True], (e["rid"][1:] != e["rid"][:-1]) | (e["key"][1:] != e["key"][:-1])))
        side = np.bitwise_or.reduceat(e["side"], np.flatnonzero(fresh))
        e = e[fresh]
        e["side"] = side
        starts = np.flatnonzero(np.concatenate(([True], e["key"][1:] != e["key"][:-1])))
        found = [(np.zeros(0, np.int64),) * 2]
        for s, t in zip(starts.tolist(), [*starts[1:].tolist(), len(e)]):
            if t - s > 1:
                here = {c: np.ascontiguousarray(e[c][s:t]) for c in ENTRY.names}
                found += [(here["rid"][a], here["rid"][b]) for a, b in block(here)]
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])

    return work


def candidates(records: DataFrame, counts: np.ndarray, count: int, threshold: float) -> DataFrame:
    """(rid_train, rid_eval) of different classes that may be alike; holds every pair with a likeness of ``threshold`` in each field.

    ``records`` are about ``count`` rows of rid, aid, the hash of the anchor,
    side, 1 for train and 2 for evaluation, and the normalised fields, each with
    a word.  The rows of a rid may be on both sides, then it also pairs with others.
    """
    parts = parts_for(count * 4, ENTRY.itemsize)
    known = records.sparkSession.sparkContext.broadcast(counts)
    return by_part(records.mapInArrow(_enter(known, threshold, parts), PACKED), ENTRY, _meet(threshold), ("rid_train", "rid_eval"))


def chunk_overlaps(found: DataFrame, classes: DataFrame) -> DataFrame:
    """(rid_train, rid_eval, overlap): the part of the longer record that the shared chunks of each pair weigh."""
    wanted = found.select(F.explode(F.array("rid_train", "rid_eval")).alias("rid")).distinct()
    cut = classes.select("rid", "content").join(wanted, "rid", "left_semi").mapInArrow(_cut, "rid bigint, chunks array<struct<digest:bigint,bytes:bigint>>")
    side = materialise(cut.select("rid", F.array_distinct("chunks").alias("chunks")).withColumn("weight", _weight(F.col("chunks"))), "chunks")
    both = found.join(side.toDF("rid_train", "chunks_train", "weight_train"), "rid_train").join(side.toDF("rid_eval", "chunks_eval", "weight_eval"), "rid_eval")
    part = _weight(F.array_intersect("chunks_train", "chunks_eval")) / F.greatest("weight_train", "weight_eval")
    return both.select("rid_train", "rid_eval", part.alias("overlap"))


def cross_split_overlaps(pairs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(train_id, eval_id, overlap) of records alike in anchor, positive and negative.

    Both records have a likeness of at least ``threshold`` in each field.  Equal
    records have the overlap 1.
    """
    fields = [normalised(F.col(f)).alias(f) for f in FIELDS]
    content = F.when(F.least(*[F.length(f) for f in FIELDS]) > 0, F.xxhash64(*FIELDS))
    name = split_name(F.col("split"))
    side = F.when(name == "train", F.lit(1)).when(name.isin(*EVALUATION), F.lit(2)).alias("side")
    keyed = pairs.select("pair_id", "ingested_at", "ord", side, *fields).select("pair_id", "ingested_at", "ord", "side", content.alias("rid"))
    members = latest(keyed, "pair_id", ["ingested_at", "ord"], ["pair_id", "side", "rid"]).where("rid IS NOT NULL AND side IS NOT NULL")
    members = materialise(members.select("rid", "pair_id", "side"), "members")
    usable = pairs.select("pair_id", side, *fields).where("pair_id IS NOT NULL AND side IS NOT NULL")
    counts = word_counts(usable.where(F.length("anchor") > 0).select("anchor"))
    records = usable.select(content.alias("rid"), F.xxhash64("anchor").alias("aid"), "side", *FIELDS).where("rid IS NOT NULL")
    near = materialise(candidates(records, counts, pairs.count(), threshold), "candidates")
    wanted = near.select(F.explode(F.array("rid_train", "rid_eval")).alias("rid")).distinct()
    again = texts_again(pairs, members, wanted, FIELDS).select(*fields).withColumn("rid", content).where("rid IS NOT NULL")
    worded = again.select("rid", F.concat_ws(" | ", *FIELDS).alias("content"), *[word_hashes(F.col(f)).alias(f) for f in FIELDS])
    classes = materialise(worded.dropDuplicates(["rid"]), "classes")
    words = classes.select("rid", *FIELDS)
    a = words.toDF("rid_train", *[f"{f}_train" for f in FIELDS])
    b = words.toDF("rid_eval", *[f"{f}_eval" for f in FIELDS])
    near = near.join(a, "rid_train").join(b, "rid_eval")
    for f in FIELDS:
        near = near.where(likeness(F.col(f"{f}_train"), F.col(f"{f}_eval")) >= threshold)
    near = chunk_overlaps(materialise(near.select("rid_train", "rid_eval"), "near"), classes)
    both = members.groupBy("rid").agg(F.bit_or("side").alias("sides")).where("sides = 3")
    same = both.select(F.col("rid").alias("rid_train"), F.col("rid").alias("rid_eval"), F.lit(1.0).alias("overlap"))
    train = members.where("side = 1").select(F.col("rid").alias("rid_train"), F.col("pair_id").alias("train_id"))
    other = members.where("side = 2").select(F.col("rid").alias("rid_eval"), F.col("pair_id").alias("eval_id"))
    return near.union(same).join(train, "rid_train").join(other, "rid_eval").select("train_id", "eval_id", "overlap")


def found_pairs(overlaps: DataFrame) -> DataFrame:
    """(pair_id_a, pair_id_b) with a < b."""
    return overlaps.select(F.least("train_id", "eval_id").alias("pair_id_a"), F.greatest("train_id", "eval_id").alias("pair_id_b"))


def overlap_report(pairs: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Per split and source of the evaluation records: how many there are and how many overlap.

    A null split or source is a group of its own.
    """
    one = latest(pairs, "pair_id", ["ingested_at", "ord"], ["pair_id", "split", "source"])
    one = one.select(F.col("pair_id").alias("eval_id"), split_name(F.col("split")).alias("split"), "source").where(F.col("split").isin(*EVALUATION))
    hit = overlaps.groupBy("eval_id").agg(F.count(F.lit(1)).alias("links"), F.max("overlap").alias("overlap"))
    return (
        one.join(hit, "eval_id", "left")
        .groupBy("split", "source")
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.count("links").alias("overlapping"),
            F.coalesce(F.sum("links"), F.lit(0)).alias("links"),
            F.max("overlap").alias("max_overlap"),
        )
    )
