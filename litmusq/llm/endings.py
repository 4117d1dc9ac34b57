"""Does a text end where it should?  Evidence from the texts of a whole corpus.

Every word, and every run of up to ``RUN`` words, is counted inside sentences and
at their ends.  Runs are 64-bit hashes, made for a whole batch at once; the
vocabulary trie is a table, one row per prefix and word below it, keyed by the
hash of the prefix, of any length.  Only runs and prefixes that some text asks
for leave a task: they are told by a bitmap of ``BITS`` bits, whose size does not
grow with the data; what it lets through by chance goes in the exact join.

A text that stops without a terminator is then judged by its last words: an
unknown word that is a proper prefix of known ones was cut inside a word, words
that (nearly) never end a sentence were cut inside one.  Names and numbers are
counted by their shape, as there is no end of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmusq.llm.chunking import mix64
from litmusq.plans.lineage import materialise

#: Runs ending a sentence less often than this part of their occurrences don't end one; occurrences a run needs to count, and one of over three words; see ``judge``.
LEAST_END, SUPPORT, LONG_SUPPORT, RARE = 0.04, 4, 15, 0.02
#: Words of the longest run; counts and different words a task holds before it passes them on; bits of the bitmap of what is asked.
RUN, HELD, BITS = 6, 2_000_000, 1 << 25

_TOKEN_PART = r"[\p{L}\p{M}]+(?:['’\-][\p{L}\p{M}]+)*|\p{N}+(?:[.,:]\p{N}+)*"
_STOP_PART = r"[.!?。！？؟।…]+[\"'”’»)\]*]*(?=\s|\\|$|[\"'”’»])|\n|\"\s*[,}\]:]"
_TOKEN = regex.compile(_TOKEN_PART)
_STOP = regex.compile(_STOP_PART)
_PIECE = regex.compile(f"{_TOKEN_PART}|{_STOP_PART}")
_CLOSED = regex.compile(r"[.!?。！？؟।][\"'”’»“)\]*_`]*$")
_MULTIPLIER, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)


def shape(token: str, first: bool) -> str:
    """A token as it is counted: numbers and names by shape, words in lower case."""
    if token[0].isnumeric():
        return "<9>"
    return "<N>" if token[0].isupper() and not first else token.lower()


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _extend(shorter: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hash of a run from that of the run without its last word."""
    return mix64(shorter * _MULTIPLIER + last)


def _extend_one(shorter: int, last: int) -> int:
    """``_extend`` of two numbers; the steps are those of ``mix64``."""
    low = (1 << 64) - 1
    x = (shorter * int(_MULTIPLIER) + last) & low
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & low
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & low
    return x ^ (x >> 31)


def run_hashes(hashes: np.ndarray) -> Iterator[np.ndarray]:
    """Of words in a row: the hashes of the runs of 1, 2 ... ``RUN`` words that end at each place (from place n - 1 on)."""
    runs = hashes
    yield runs
    for _ in range(RUN - 1):
        if len(runs) < 2:
            return
        runs = _extend(runs[:-1], hashes[len(hashes) - len(runs) + 1 :])
        yield runs


def prefix_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word index, length, hash) of every prefix of every word, the whole words included."""
    sizes = np.fromiter((len(w) for w in words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(codes)) - begin[owner] if len(codes) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.full(int(sizes.max()) if len(words) and sizes.max() else 1, _STEP))
        total = np.cumsum((codes + np.uint64(1)) * power[place], dtype=np.uint64)
        before = np.concatenate((np.zeros(1, np.uint64), total))[begin] if len(words) else total
        hashes = mix64(total - before[owner] + place.astype(np.uint64))
    return owner, place + 1, hashes


def word_keys(words: list[str | None]) -> pa.Array:
    """The trie key of every word in lower case, null for none."""
    low = [w.lower() if w else "" for w in words]
    keys = np.zeros(len(low), np.uint64)
    owner, length, hashes = prefix_hashes(low)
    whole = length == np.fromiter((len(w) for w in low), np.int64, len(low))[owner]
    keys[owner[whole]] = hashes[whole]
    return pa.array(keys.view(np.int64), mask=np.array([not w for w in low], bool))


class Tail(NamedTuple):
    """The runs at the end of a text, shortest first, and its last word as written, None if that is a number."""

    runs: list[int]
    word: str | None


def last_sentence(text: str) -> str:
    """What follows the last stop inside the text, or all of it; the text is looked at from its end."""
    size = 256
    while True:
        part = text[-size:]
        ends = [m.end() for m in _STOP.finditer(part) if m.end() < len(part)]
        if ends:
            return part[ends[-1] :]
        if size >= len(text):
            return text
        size *= 4


def tail_of(text: str) -> Tail:
    """What a text that stops without a terminator asks the corpus about."""
    sentence = last_sentence(text.lower() if text.isupper() else text)
    tokens = _TOKEN.findall(sentence)
    if not tokens:
        return Tail([], None)
    last = tokens[-RUN:]
    hashes = [_hash(shape(t, len(tokens) <= RUN and i == 0)) for i, t in enumerate(last)]
    runs = []
    for begin in range(len(hashes) - 1, -1, -1):
        run = hashes[begin]
        for h in hashes[begin + 1 :]:
            run = _extend_one(run, h)
        runs.append(run - (1 << 64) if run >> 63 else run)
    return Tail(runs, None if tokens[-1][0].isnumeric() else tokens[-1])


def ends_closed(text: str) -> bool:
    return bool(_CLOSED.search(text))


class _Pieces(dict):
    """A number for every different token and stop, with what is counted of it."""

    def __init__(self) -> None:
        super().__init__()
        self.inner, self.first, self.kind, self.word = [], [], [], []
        self.words: dict[str, int] = {}

    def __missing__(self, piece: str) -> int:
        code = self[piece] = len(self)
        stop = piece[0] in ".!?。！？؟।…\n\""
        if stop:
            closes = piece[0] in ".!?。！？؟।" and not piece.startswith("..") and "…" not in piece
            self.kind.append(2 if closes else 1)
            self.inner.append(0)
            self.first.append(0)
            self.word.append(-1)
        else:
            self.kind.append(0)
            self.inner.append(_hash(shape(piece, False)))
            self.first.append(_hash(shape(piece, True)))
            self.word.append(-1 if piece[0].isnumeric() else self.words.setdefault(piece.lower(), len(self.words)))
        return code


def _asked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(BITS - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


class _Counts:
    """What one task has counted since it last passed anything on."""

    def __init__(self, runs: np.ndarray, words: np.ndarray) -> None:
        self.run_bits, self.word_bits = runs, words
        self.clear()

    def clear(self) -> None:
        self.pieces = _Pieces()
        self.totals = np.zeros(0, np.int64)
        self.inside: list[np.ndarray] = []
        self.ended: list[np.ndarray] = []

    def add(self, texts: list[str | None], ends: list[bool | None]) -> None:
        flat: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                found = _PIECE.findall(text.lower() if text.isupper() else text)
                counts[i] = len(found)
                flat.extend(found)
        if not flat:
            return
        p = self.pieces
        code = np.fromiter(map(p.__getitem__, flat), np.int64, len(flat))
        kind = np.array(p.kind, np.int8)[code]
        owner = np.repeat(np.arange(len(texts)), counts)
        at = np.flatnonzero(kind == 0)
        if not len(at):
            return
        # a sentence goes on where the token before is the piece before, in the same text
        follows = np.zeros(len(at), bool)
        follows[1:] = (at[1:] == at[:-1] + 1) & (owner[at[1:]] == owner[at[:-1]])
        place = np.arange(len(at)) - np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
        final = np.append(~follows[1:], True)
        last = owner[np.minimum(at + 1, len(flat) - 1)] != owner[at]
        last[at + 1 == len(flat)] = True
        next_kind = np.where(last, 0, kind[np.minimum(at + 1, len(flat) - 1)])
        value_ends = np.fromiter((bool(e) for e in ends), bool, len(ends))
        # the end of an unfinished piece says nothing about its last words
        counted = ~final | (next_kind == 2) | (last & value_ends[owner[at]])
        hashes = np.where(place == 0, np.array(p.first, np.uint64)[code[at]], np.array(p.inner, np.uint64)[code[at]])
        with np.errstate(over="ignore"):
            for n, runs in enumerate(run_hashes(hashes)):
                keep = counted[n:] & (place[n:] >= n)
                keep[keep] = _asked(self.run_bits, runs[keep])
                ended = final[n:][keep]
                self.inside.append(runs[keep][~ended])
                self.ended.append(runs[keep][ended])
        word = np.array(p.word, np.int64)[code[at]]
        word = word[(counted | ~last) & (word >= 0)]
        totals = np.bincount(word, minlength=len(p.words))
        totals[: len(self.totals)] += self.totals
        self.totals = totals

    def full(self) -> bool:
        return len(self.pieces) > HELD // 4 or sum(map(len, self.inside)) + sum(map(len, self.ended)) > HELD

    def rows(self) -> Iterator[pa.RecordBatch]:
        runs = np.concatenate([np.zeros(0, np.uint64), *self.inside, *self.ended])
        ended = np.zeros(len(runs), bool)
        ended[len(runs) - sum(map(len, self.ended)) :] = True
        keys, index = np.unique(runs, return_inverse=True)
        at_end, all_ = np.bincount(index[ended], minlength=len(keys)), np.bincount(index, minlength=len(keys))
        yield from _batches(0, keys, np.zeros(len(keys), np.uint64), all_ - at_end, at_end)
        words, totals = list(self.pieces.words), self.totals
        sizes = np.cumsum([len(w) for w in words])
        begin = 0
        while begin < len(words):  # a million characters at a time
            end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + (1 << 20))))
            owner, length, hashes = prefix_hashes(words[begin:end])
            whole = hashes[np.cumsum([len(w) for w in words[begin:end]]) - 1]
            keep = _asked(self.word_bits, hashes)
            keep &= totals[begin:end][owner] > 0
            yield from _batches(1, hashes[keep], whole[owner[keep]], totals[begin:end][owner[keep]], np.zeros(int(keep.sum()), np.int64))
            begin = end
        self.clear()


def _batches(kind: int, key: np.ndarray, full: np.ndarray, inside: np.ndarray, ended: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(key), 1 << 16):
        part = slice(i, i + (1 << 16))
        arrays = [key[part].view(np.int64), full[part].view(np.int64), inside[part], ended[part]]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(arrays[0]), kind, np.int32)), *map(pa.array, arrays)], ["kind", "key", "full", "inside", "ended"])


def _counter(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(*(np.frombuffer(b, np.uint64) for b in bits.value))
        for batch in batches:
            counts.add(batch.column("text").to_pylist(), batch.column("ends").to_pylist())
            if counts.full():
                yield from counts.rows()
        yield from counts.rows()

    return run


def _bitmap(keys: DataFrame) -> bytes:
    """The bits of a column ``key``; at most ``BITS`` / 64 rows reach the driver, whatever the data."""
    place = F.pmod("key", F.lit(BITS))
    words = keys.select(F.shiftright(place, 6).cast("int").alias("i"), F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    found = words.groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[found.column("i").to_numpy()] = found.column("b").to_numpy()
    return out.tobytes()


def statistics(texts: DataFrame, runs: DataFrame, words: DataFrame) -> DataFrame:
    """(kind, key, full, inside, ended) from (text, ends); ends: the end of the text is the end of a sentence.

    kind 0: a run of words, how often inside a sentence and how often at its
    end.  kind 1: a prefix (key) and a word (full) that begins with it or is it,
    ``inside`` is how often the word stands anywhere but cut off.  Only keys in
    ``runs`` and ``words`` (one column ``key`` each) are sure to be counted.
    """
    bits = texts.sparkSession.sparkContext.broadcast((_bitmap(runs), _bitmap(words)))
    counted = texts.select("text", "ends").mapInArrow(_counter(bits), "kind int, key bigint, full bigint, inside bigint, ended bigint")
    return counted.groupBy("kind", "key", "full").agg(F.sum("inside").alias("inside"), F.sum("ended").alias("ended"))


def judge(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """``asked`` (id columns, runs array<bigint>, word string, word_key bigint) with the evidence on how it ends.

    Adds: end_share (share of ends among the occurrences of the longest run that
    occurs often enough, null if none does), run (words of that run), known (times the last
    word occurs), below (different words it is a proper prefix of), stump (it is a
    prefix of words and occurs at most once, or RARE times as often as the most
    frequent of them: the trace of other texts cut at the same place).
    """
    asked = materialise(asked.withColumn("ask", F.monotonically_increasing_id()), "asked")
    wanted = asked.select("ask", F.posexplode("runs").alias("n", "key"))
    words = asked.where("word_key IS NOT NULL").select(F.col("word_key").alias("key")).distinct()
    stats = materialise(statistics(texts, wanted.select("key"), words), "endings")
    runs = stats.where("kind = 0").select("key", "inside", "ended")
    seen = wanted.join(runs, "key").where(F.col("inside") + F.col("ended") >= F.when(F.col("n") > 2, LONG_SUPPORT).otherwise(SUPPORT))
    best = seen.groupBy("ask").agg(F.max(F.struct("n", "inside", "ended")).alias("b"))
    best = best.select("ask", (F.col("b.n") + 1).alias("run"), (F.col("b.ended") / (F.col("b.inside") + F.col("b.ended"))).alias("end_share"))
    own, longer = F.col("full") == F.col("key"), F.col("full") != F.col("key")
    trie = (
        stats.where("kind = 1")
        .join(words, "key", "left_semi")
        .groupBy(F.col("key").alias("word_key"))
        .agg(F.max(F.when(own, F.col("inside"))).alias("known"), F.count(F.when(longer & (F.col("inside") > 1), True)).alias("below"), F.max(F.when(longer, F.col("inside"))).alias("longer"))
    )
    out = asked.join(best, "ask", "left").join(trie, "word_key", "left")
    out = out.withColumn("known", F.coalesce("known", F.lit(0))).withColumn("below", F.coalesce("below", F.lit(0)))
    stump = (F.col("below") > 0) & (F.col("known") <= F.greatest(F.lit(1.0), RARE * F.coalesce("longer", F.lit(0))))
    return out.withColumn("stump", stump).drop("ask", "word_key", "longer")
