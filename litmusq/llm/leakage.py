"""Held-out passages inside a corpus, whole or in part, exact or nearly.

Both sides are reduced to their letters and digits, so case, punctuation,
mark-up, spacing and line breaks don't matter.

1. Every item becomes its q-grams, with their places, and two numbers: the
   q-grams that any part with ``PART`` of its words keeps although ``CHANGED`` of
   them differ (the q-gram lemma, over the worst such part), and half the width of
   a band of diagonals, which is the letters those changes can add or take away.
2. One pass over the corpus hashes the q-grams of each document and keeps those
   in a bitmap of the items' q-grams.  The bitmap has at most ``MOST_BITS`` bits,
   whatever the data.  Documents without enough of them close together go.
3. Kept q-grams meet those of the items; a match lies on a diagonal (place in
   the document minus place in the item).  Matches are counted per document and
   item in overlapping bands; bands below the item's number go.  An index of up
   to ``INDEXED`` q-grams is sent to the workers and all this is done in the one
   pass, without a shuffle; a larger one is joined as a table.  Q-grams of many
   items are left out where the item's number, lowered by as many as a part can
   hold of them, stays large enough: no case is lost and a phrase common to many
   items doesn't multiply.
4. What is left is verified by a banded local alignment of the words: the
   aligned part must hold half of the item's words and agree in all but the
   changed ones.

Null and blank texts and items without a word give no row.  An item of under
``TINY`` letters must occur whole, word by word.  Repeated rows give one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmusq.llm.chunking import mix64
from litmusq.plans.lineage import materialise

#: Letters of a q-gram, the second for items whose parts may hold no long one; letters under which an item must occur whole.
QS, TINY = (10, 5), 10
#: Part of an item's words that is a case; part of the words that may be changed; least half width of a band in letters.
PART, CHANGED, LEAST_HALF = 0.5, 0.14, 32
#: Cost of a changed, extra or missing word against 1 for an equal one.
COST = 1.5
#: Items from which a q-gram is left out of the join if it can be; bits of the bitmap for each q-gram, and at most.
HOT, BITS_EACH, MOST_BITS = 64, 16, 1 << 26
#: Q-grams, and letters of items, of the largest index that is sent to the workers (about 25 bytes a q-gram).
INDEXED = 2_000_000
#: Letters and texts of a document batch looked at at once.
PIECE, TEXTS = 1 << 20, 1024

_WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")
_TAG = regex.compile(r"</?[a-zA-Z][^<>]{0,60}>|&(?:[a-zA-Z]{2,8}|#\d{1,6});")
_MULTIPLIER = np.uint64(0x100000001B3)
_ITEM = "iid bigint, item_id bigint, text string, q int, need int, half int, letters int, grams array<bigint>, words array<int>"
_LETTER = np.full(0x110000, -1, np.int8)


def _plain(text: str) -> str:
    return (_TAG.sub(" ", text) if "<" in text or "&" in text else text).casefold()


def words_of(text: str) -> list[str]:
    return _WORD.findall(_plain(text))


def _is_letter(codes: np.ndarray) -> np.ndarray:
    seen = _LETTER[codes]
    if (seen < 0).any():
        for c in np.unique(codes[seen < 0]):
            _LETTER[c] = bool(_WORD.match(chr(c)))
        seen = _LETTER[codes]
    return seen == 1


class Letters:
    """The letters of some texts, joined: code points, the text and the word each is from, and where words begin and end."""

    def __init__(self, texts: list[str]) -> None:
        plain = [_plain(t) for t in texts]
        codes = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
        text = np.repeat(np.arange(len(texts)), [len(p) for p in plain])
        kept = np.flatnonzero(_is_letter(codes))
        self.codes, self.text = codes[kept].astype(np.uint64), text[kept]
        n = len(kept)
        begins = np.ones(n, bool)
        begins[1:] = (kept[1:] != kept[:-1] + 1) | (self.text[1:] != self.text[:-1])
        self.begins, self.ends = begins, np.append(begins[1:], True)[:n]
        first = np.searchsorted(self.text, np.arange(len(texts)))  # each text's first letter
        self.place = np.arange(n) - first[self.text] if n else np.zeros(0, np.int64)
        word = np.cumsum(begins) - 1
        self.word = word - word[first[self.text]] if n else word

    def grams(self, q: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(first letter, hash) of every run of q letters within a text; whole: only runs of whole words."""
        n = len(self.codes) - q + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        ok = self.text[:n] == self.text[q - 1 :]
        if whole:
            ok &= self.begins[:n] & self.ends[q - 1 :]
        at = np.flatnonzero(ok)
        h = np.full(len(at), q, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(q):
                h = h * _MULTIPLIER + self.codes[at + j]
        return at, mix64(h)


def demand(sizes: np.ndarray, q: int) -> tuple[int, int, int]:
    """(q-grams that the worst part keeps, letters its changes add or take away, letters of a part) of words of these lengths."""
    n = len(sizes)
    part = math.ceil(PART * n)
    changed = math.ceil(CHANGED * part) if part >= 4 else math.floor(CHANGED * part)
    rows = np.lib.stride_tricks.sliding_window_view(sizes, part)
    longest = np.sort(rows, 1)[:, part - changed :]
    letters = rows.sum(1)
    need = letters - q + 1 - (longest + q - 1).sum(1)
    drift = int(np.sort(sizes)[::-1][: changed + 1].sum())
    return int(need.min()), max(LEAST_HALF, drift), int(letters.max())


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["iid", "item_id", "text", "q", "need", "half", "letters", "grams", "words"]
    types = [pa.int64(), pa.int64(), pa.string(), *[pa.int32()] * 4, pa.list_(pa.int64()), pa.list_(pa.int32())]
    for batch in batches:
        rows = []
        for iid, item_id, text in zip(*(batch.column(c).to_pylist() for c in ("iid", "item_id", "text"))):
            letters = Letters([text])
            n = len(letters.codes)
            if not n:
                continue
            if n < TINY:
                _, grams = letters.grams(n)
                rows.append((iid, item_id, text, n, 1, LEAST_HALF, n, grams.view(np.int64).tolist(), [0]))
                continue
            sizes = np.bincount(letters.word)
            for q in QS:
                need, half, part = demand(sizes, q)
                if need >= 1:
                    break
            at, grams = letters.grams(q)
            rows.append((iid, item_id, text, q, max(1, need), half, part, grams.view(np.int64).tolist(), letters.word[at].tolist()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names)


def _spared(hot: np.ndarray, frequency: np.ndarray, need: int, width: int) -> tuple[np.ndarray, int]:
    """Which of an item's q-grams leave the join, the most frequent first, and the demand that remains; it keeps half of ``need``."""
    order = np.flatnonzero(hot)[np.argsort(-frequency[hot], kind="stable")]
    least = max(1, need - need // 2)

    def left(count: int) -> int:
        out = np.zeros(len(hot), np.int64)
        out[order[:count]] = 1
        total = np.concatenate(([0], np.cumsum(out)))
        width_ = min(width, len(hot))
        return need - int((total[width_:] - total[:-width_]).max()) if width_ else need

    low, high = 0, len(order)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if left(middle) >= least else (low, middle - 1)
    out = np.zeros(len(hot), bool)
    out[order[:low]] = True
    return out, left(low)


def _spare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        columns = ("iid", "need", "half", "letters", "q", "grams", "words", "places", "frequency")
        for iid, need, half, letters, q, grams, words, places, frequency in zip(*(batch.column(c).to_pylist() for c in columns)):
            frequency = np.array(frequency)
            out, need = _spared(frequency > HOT, frequency, need, letters)
            rows += [(g, iid, p, w, need, half) for g, p, w, o in zip(grams, places, words, out) if not o]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)], ["gram", "iid", "place", "word", "need", "half"])


def item_grams(items: DataFrame) -> DataFrame:
    """(gram, iid, place, word, need, half): the q-grams of every item that take part in the join."""
    cells = items.select("iid", F.arrays_zip("grams", "words").alias("x")).select("iid", F.posexplode("x").alias("place", "x")).select("iid", "place", F.col("x.grams").alias("gram"), F.col("x.words").alias("word"))
    many = cells.groupBy("gram").agg(F.count_distinct("iid").alias("frequency"))
    # the q-grams of one item, in order
    lists = cells.join(many, "gram").groupBy("iid").agg(F.array_sort(F.collect_list(F.struct("place", "gram", "word", "frequency"))).alias("x"))
    known = items.select("iid", "need", "half", "letters", "q").join(lists, "iid")
    known = known.select("iid", "need", "half", "letters", "q", *[F.col(f"x.{c}").alias(n) for c, n in (("gram", "grams"), ("word", "words"), ("place", "places"), ("frequency", "frequency"))])
    return known.mapInArrow(_spare, "gram bigint, iid bigint, place int, word int, need int, half int")


def _bitmap(grams: DataFrame, bits: int) -> np.ndarray:
    place = F.pmod("gram", F.lit(bits))
    words = grams.select(F.shiftright(place, 6).cast("int").alias("i"), F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    found = words.groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.int64)
    out[found.column("i").to_numpy()] = found.column("b").to_numpy()
    return out


def _parts(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """The texts in parts of bounded letters and number, each with its first index; a longer text is a part of its own."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and (size + len(t) > PIECE or i - begin >= TEXTS):
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(t)
    if texts:
        yield begin, texts[begin:]


def _hits(letters: Letters, known) -> tuple[np.ndarray, np.ndarray]:
    """(letter, q-gram) of the q-grams in the bitmap, in order of place."""
    raw, sizes, tiny, _, _ = known
    bits = np.frombuffer(raw, np.uint64)
    mask = np.uint64(len(bits) * 64 - 1)
    found, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for q, whole in [(q, False) for q in sizes] + [(q, True) for q in tiny]:
        at, h = letters.grams(q, whole)
        low = h & mask
        hit = (bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) > 0
        found.append(at[hit])
        keys.append(h[hit])
    at, key = np.concatenate(found), np.concatenate(keys)
    order = np.argsort(at, kind="stable")
    return at[order], key[order]


def _scanner(known):
    """Keeps the documents that hold enough q-grams of items close together, with these q-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, span = known.value[3:]
        for batch in batches:
            for first, texts in _parts(batch.column("text").to_pylist()):
                letters = Letters(texts)
                at, key = _hits(letters, known.value)
                text = letters.text[at]
                # enough of them within the longest item
                near = np.zeros(len(texts), bool)
                if len(at) >= least:
                    a, b = slice(0, len(at) - least + 1), slice(least - 1, None)
                    near[text[a][(text[a] == text[b]) & (at[b] - at[a] <= span)]] = True
                kept = near[text]
                at, key, text = at[kept], key[kept], text[kept]
                chosen = np.flatnonzero(near)
                offsets = pa.array(np.append(np.searchsorted(text, chosen), len(text)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (key.view(np.int64), letters.place[at].astype(np.int32), letters.word[at].astype(np.int32))]
                rows = pa.array(chosen + first)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("text").take(rows), *lists], ["doc_id", "text", "grams", "places", "words"])

    return run


class Index:
    """The q-grams of all items, sorted, with the items and places they are from."""

    def __init__(self, grams: pa.Table, items: list[dict]) -> None:
        number = {x["iid"]: i for i, x in enumerate(items)}
        self.items = items
        key = grams.column("gram").to_numpy().view(np.uint64)
        order = np.argsort(key, kind="stable")
        self.keys, first = np.unique(key[order], return_index=True)
        self.bounds = np.append(first, len(key))
        self.item = np.fromiter((number[i] for i in grams.column("iid").to_pylist()), np.int32, len(key))[order]
        self.place, self.word = (grams.column(c).to_numpy()[order] for c in ("place", "word"))
        self.need, self.half = np.zeros(len(items), np.int64), np.ones(len(items), np.int64)
        for c, out in (("need", self.need), ("half", self.half)):
            out[self.item] = grams.column(c).to_numpy()[order]

    def near(self, letters: Letters, at: np.ndarray, key: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, least, greatest word offset) of the bands with enough q-grams."""
        if not len(at) or not len(self.keys):
            return
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[found] == key
        at, found = at[hit], found[hit]
        n = self.bounds[found + 1] - self.bounds[found]
        flat = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.bounds[found], n)
        at, item = np.repeat(at, n), self.item[flat]
        pair = letters.text[at] * len(self.items) + item
        enough = np.bincount(pair)[pair] >= self.need[item] if len(pair) else np.zeros(0, bool)
        at, item, pair, flat = at[enough], item[enough], pair[enough], flat[enough]
        if not len(at):
            return
        slot = (letters.place[at] - self.place[flat]) // self.half[item]
        slot -= slot.min()
        width, places = int(slot.max()) + 2, int(self.place.max()) + 1
        band = pair * width + slot
        # a repeated q-gram of a document counts once per place of the item in a slot
        slots, counts = np.unique(np.unique(band * places + self.place[flat]) // places, return_counts=True)
        after = np.minimum(np.searchsorted(slots, slots + 1), len(slots) - 1)
        total = counts + np.where(slots[after] == slots + 1, counts[after], 0)
        good = slots[total >= self.need[(slots // width) % len(self.items)]]
        offset = letters.word[at] - self.word[flat]
        order = np.argsort(band, kind="stable")
        band, offset = band[order], offset[order]
        for b, i, j in zip(good.tolist(), np.searchsorted(band, good), np.searchsorted(band, good + 2)):
            text, number = divmod(b // width, len(self.items))
            yield text, number, int(offset[i:j].min()), int(offset[i:j].max())


def _finder(known, index):
    """The whole search in one pass, for an index that fits a worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int]] = []
            for first, texts in _parts(batch.column("text").to_pylist()):
                letters = Letters(texts)
                asked: dict[int, list[tuple]] = {}
                for text, number, low, high in index.value.near(letters, *_hits(letters, known.value)):
                    x = index.value.items[number]
                    asked.setdefault(text, []).append((x["item_id"], x["text"], x["q"] == x["letters"] < TINY, low, high))
                rows += [(first + t, i) for t, a in asked.items() for i in _held(texts[t], a)]
            which, found = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(which, pa.int64())), pa.array(found, pa.int64())], ["doc_id", "item_id"])

    return run


def candidates(hits: DataFrame, grams: DataFrame) -> DataFrame:
    """(did, iid, low, high): bands that hold enough q-grams, as the least and greatest word of the document minus word of the item."""
    cells = hits.select("did", F.explode(F.arrays_zip("grams", "places", "words")).alias("x")).select("did", F.col("x.grams").alias("gram"), F.col("x.places").alias("at"), F.col("x.words").alias("at_word"))
    met = cells.join(grams, "gram").select("did", "iid", "place", "need", F.floor((F.col("at") - F.col("place")) / F.col("half")).alias("slot"), (F.col("at_word") - F.col("word")).alias("offset"))
    # a repeated q-gram of a document counts once per place of the item in a band
    once = met.groupBy("did", "iid", "need", "slot", "place").agg(F.min("offset").alias("low"), F.max("offset").alias("high"))
    bands = once.withColumn("band", F.explode(F.array(F.col("slot"), F.col("slot") - 1))).groupBy("did", "iid", "need", "band", "place").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    counts = bands.groupBy("did", "iid", "band", "need").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return counts.where(F.col("n") >= F.col("need")).select("did", "iid", "low", "high").distinct()


def holds(item: list[str], words: list[str], low: int, high: int) -> bool:
    """Banded local alignment: word i of the item with the words from i + low to i + high, and a little beyond."""
    n, m = len(item), len(words)
    pad = math.ceil(CHANGED * n) + 2
    # a part with at most CHANGED of its words unlike has a stretch of PART with at most twice that share
    part = math.ceil(PART * n)
    there = list(accumulate((w in words[max(0, i + low - pad) : max(0, i + high + pad + 1)] for i, w in enumerate(item)), initial=0))
    if max(b - a for a, b in zip(there, there[part:])) < (1 - 2 * CHANGED) * part:
        return False
    above: dict[int, tuple[float, int, int]] = {}
    for i, w in enumerate(item):
        row: dict[int, tuple[float, int, int]] = {}
        left = None
        for j in range(max(0, i + low - pad), min(m, i + high + pad + 1)):
            diagonal = above.get(j - 1)
            if w == words[j]:
                cell = (diagonal[0] + 1, diagonal[1], diagonal[2] + 1) if diagonal else (1.0, i, 1)
            else:
                cell = (diagonal[0] - COST, diagonal[1], diagonal[2]) if diagonal else (0.0, i, 0)
                up = above.get(j)
                if up and up[0] - COST > cell[0]:
                    cell = (up[0] - COST, up[1], up[2])
                if left and left[0] - COST > cell[0]:
                    cell = (left[0] - COST, left[1], left[2])
            if cell[0] > 0:
                row[j] = cell
                left = cell
                span = i + 1 - cell[1]
                if span >= PART * n and cell[2] >= (1 - CHANGED) * span:
                    return True
            else:
                left = None
        above = row
    return False


_item_words = lru_cache(maxsize=4096)(words_of)


def _held(text: str, asked: list[tuple[int, str, bool, int, int]]) -> list[int]:
    """Ids of the asked (item_id, item, whole only, least, greatest word offset) that the text holds."""
    words = words_of(text)
    joined = f" {' '.join(words)} "
    found: set[int] = set()
    for item_id, item, whole, low, high in asked:
        if item_id not in found:
            own = _item_words(item)
            if f" {' '.join(own)} " in joined or (not whole and holds(own, words, low, high)):
                found.add(item_id)
    return sorted(found)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, asked in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "asked"))):
            rows += [(doc_id, i) for i in _held(text, [(x["item_id"], x["item"], x["q"] == x["letters"] < TINY, x["low"], x["high"]) for x in asked])]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["doc_id", "item_id"])


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): each document that holds an item or an unbroken part of it with at least half of its words."""
    spark = documents.sparkSession
    asked = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.monotonically_increasing_id().alias("iid"), "item_id", "text")
    known = materialise(asked.mapInArrow(_index, _ITEM), "leak_items")
    grams = materialise(item_grams(known), "leak_grams")
    every = grams.agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("need")).first()
    shape = known.agg(
        F.coalesce(F.max(F.size("grams") + 4 * F.col("half") + 2 * QS[0]), F.lit(0)).alias("span"),
        F.sort_array(F.collect_set(F.when(F.col("letters") >= TINY, F.col("q")))).alias("sizes"),
        F.sort_array(F.collect_set(F.when((F.col("letters") < TINY) & (F.col("q") == F.col("letters")), F.col("q")))).alias("tiny"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"),
    ).first()
    bits = min(MOST_BITS, 1 << max(16, math.ceil(math.log2(max(1, every.n) * BITS_EACH))))
    broadcast = spark.sparkContext.broadcast
    bitmap = broadcast((_bitmap(grams, bits).tobytes(), shape.sizes, shape.tiny, every.need or 1, shape.span))
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
    if every.n <= INDEXED and shape.chars <= 4 * INDEXED:
        index = broadcast(Index(grams.toArrow(), [r.asDict() for r in known.select("iid", "item_id", "text", "q", "letters").collect()]))
        return texts.mapInArrow(_finder(bitmap, index), "doc_id bigint, item_id bigint").distinct()
    kept = texts.mapInArrow(_scanner(bitmap), "doc_id bigint, text string, grams array<bigint>, places array<int>, words array<int>")
    hits = materialise(kept.withColumn("did", F.monotonically_increasing_id()), "leak_hits")
    near = candidates(hits, grams).join(known.select("iid", "item_id", F.col("text").alias("item"), "q", "letters"), "iid")
    # a document's list holds no more than the items it nearly holds
    per = near.groupBy("did").agg(F.collect_list(F.struct("item_id", "item", "q", "letters", "low", "high")).alias("asked"))
    return hits.select("did", "doc_id", "text").join(per, "did").select("doc_id", "text", "asked").mapInArrow(_verify, "doc_id bigint, item_id bigint").distinct()


def leaked_items(found: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, split, suite, documents): every item with the number of documents that hold it, 0 included."""
    counts = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return items.select("item_id", "split", "suite").join(counts, "item_id", "left").select("item_id", "split", "suite", F.coalesce("n", F.lit(0)).alias("documents"))
