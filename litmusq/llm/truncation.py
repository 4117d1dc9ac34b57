"""Values cut off when they were stored or sent.

A value is looked at whole: marks and trailers put behind it are taken off; JSON
in it is followed to its closing bracket, whatever else is wrong with it; fences
outside of JSON must be closed.  Prose that stops without a terminator is judged
by the corpus (``endings``): an unknown last word that is a proper prefix of
known words in the vocabulary trie, or words that never end a sentence.  Length
is evidence too: a source that stores many values of exactly its greatest length
cuts there, so a value of that length that does not end whole was cut.

Null and empty values, and values without any letter, are no cases.  Repeated
rows of a result_id count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litmusq.llm.endings import LEAST_END, ends_closed, judge, tail_of, word_keys
from litmusq.plans.lineage import materialise
from litmusq.sources.tables import latest

FIELDS = ("raw_response", "parse_error")
#: Different values of exactly a source's greatest length from which that length is a limit, and how many times the usual count of the lengths below.
LIMIT_COUNT, LIMIT_TIMES = 5, 3
#: Messages have no stops, so their ends count as ends, cut ones too: a run must end far more of them.
LEAST_MESSAGE_END = 0.3

_TRAILER = regex.compile(r"(?:\n\s*(?:\[[^\[\]\n]{0,60}\]|\([^()\n]{0,40}\)|-{2,}[^\n]{0,40}))+\s*$")
_BRACKET_MARK = regex.compile(r"\s*\[(?:cut|truncated|snip|\.\.\.|…)[^\[\]]{0,20}\]\s*$", regex.I)
_MARK = regex.compile(r"(?:…|\.{3,}|\N{REPLACEMENT CHARACTER}|\\u?[0-9a-fA-F]{0,3}|[\-–—~|^]|\s|[​﻿]|\p{So}|\p{Cn}|\p{Co})+$")
#: Characters at the end of a text in which marks are looked for at once.
_TAIL = 400
_JSON = regex.compile(r"[\[{](?=\s*(?:[\"'{\[\]}]|//|\w+\s*:|$))")


def _json_end(text: str, start: int) -> int:
    """Where the JSON value that begins at ``start`` is closed; -1 if it never is."""
    depth, i = 0, start
    for m in regex.finditer(r'"(?:[^"\\]|\\.)*+("?)|[\[{]|[\]}]', text[start:], flags=regex.S):
        c = m.group()[0]
        if c == '"':
            if not m.group(1):
                return -1
        elif c in "[{":
            depth += 1
        else:
            depth -= 1
            if depth <= 0:
                return start + m.end()
        i = m.end()
    return -1


def _tail_sub(pattern: regex.Pattern, text: str) -> str:
    """Takes a match at the end off.  Only the tail is searched, again and again while all of it goes, so long runs of space cost nothing."""
    while text:
        tail = text[-_TAIL:]
        short = pattern.sub("", tail)
        text = text[: len(text) - len(tail)] + short
        if short or len(short) == len(tail):
            break
    return text


def untrailed(text: str) -> str:
    """The text without trailer lines behind it."""
    text = text.rstrip()
    return _tail_sub(_TRAILER, text) if "\n" in text[-_TAIL:] else text


def bare(text: str) -> tuple[str, bool]:
    """The text without marks and trailers behind it, and if dots or a broken character stood there."""
    kept = untrailed(text)
    if kept.endswith("]"):
        kept = _tail_sub(_BRACKET_MARK, kept)
    if kept and "\\" not in kept[-5:] and (kept[-1].isalnum() or (kept[-1] in ".!?" and not kept.endswith("..."))):
        return kept, False  # nothing that could be a mark
    short = _tail_sub(_MARK, kept)
    return short, short != kept.rstrip()


def look(text: str | None) -> tuple[str, list[int], str | None]:
    """('whole' | 'cut' | 'ask', runs at the end, last word)."""
    if not text or not regex.search(r"\w", text):
        return "whole", [], None
    plain = untrailed(text)
    start = _JSON.search(plain)
    begin = plain
    if start:
        end = _json_end(plain, start.start())
        if end < 0:
            return "cut", [], None
        rest = plain[end:]
        begin = plain[: start.start()]
        if (begin.count("```") + rest.count("```")) % 2:
            return "cut", [], None
        if not regex.search(r"\w", rest):
            return "whole", [], None
        plain = rest
    elif plain.count("```") % 2:
        return "cut", [], None
    if plain.rstrip().endswith("```"):
        return "whole", [], None
    kept, _ = bare(plain)
    if not regex.search(r"\w", kept):
        return "whole", [], None
    straight = kept.count('"') % 2
    if straight:
        return "cut", [], None
    if ends_closed(kept):
        return "whole", [], None
    if kept.count("(") > kept.count(")"):
        return "cut", [], None
    runs, word = tail_of(kept)
    return ("ask" if runs else "whole"), runs, word


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = [look(t) for t in batch.column("text").to_pylist()]
        state, runs, word = zip(*seen) if seen else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("result_id", "source", "field")], pa.array(state, pa.string()), pa.array(runs, pa.list_(pa.int64())), pa.array(word, pa.string()), word_keys(list(word))],
            ["result_id", "source", "field", "state", "runs", "word", "word_key"],
        )


def _limits(values: DataFrame, measure: str) -> DataFrame:
    """(source, field, limit): the greatest length of a source, where far more different values have it than the lengths below."""
    different = values.select("source", "field", F.col(measure).alias("size"), F.xxhash64("text").alias("text")).distinct()
    counts = different.groupBy("source", "field", "size").agg(F.count(F.lit(1)).alias("n"))
    per = Window.partitionBy("source", "field")  # a row per length that occurs
    near = counts.withColumn("top", F.max("size").over(per)).where(F.col("size") >= F.col("top") * 0.8 - 10)
    spike = near.groupBy("source", "field", "top").agg(
        F.coalesce(F.sum(F.when(F.col("size") == F.col("top"), F.col("n"))), F.lit(0)).alias("at"),
        F.coalesce(F.sum(F.when(F.col("size") < F.col("top"), F.col("n"))), F.lit(0)).alias("under"),
    )
    usual = F.col("under") / (F.col("top") * 0.2 + 10)
    return spike.where((F.col("at") >= LIMIT_COUNT) & (F.col("at") >= LIMIT_TIMES * usual)).select(F.col("source").alias("l_source"), F.col("field").alias("l_field"), F.col("top").alias(f"{measure}_limit"))


def judged(results: DataFrame) -> DataFrame:
    """(result_id, source, field, cut) of every stored value."""
    one = latest(results, "result_id", ["ingested_at", "called_at"], ["result_id", "source", *FIELDS])
    values = one.select("result_id", "source", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in FIELDS])).alias("x")).select("result_id", "source", "x.field", "x.text").where("text IS NOT NULL")
    sized = materialise(values.withColumn("chars", F.length("text")).withColumn("bytes", F.octet_length("text")), "values")
    for measure in ("chars", "bytes"):
        limit = _limits(sized.where("chars > 0"), measure)  # a row per source and field; Spark broadcasts it if it is small
        sized = sized.join(limit, F.col("source").eqNullSafe(F.col("l_source")) & (F.col("field") == F.col("l_field")), "left").drop("l_source", "l_field")
    at_limit = (F.col("chars") == F.col("chars_limit")) | F.col("bytes").between(F.col("bytes_limit") - 3, F.col("bytes_limit"))
    sized = materialise(sized.withColumn("at_limit", F.coalesce(at_limit, F.lit(False))), "sized")
    seen = materialise(sized.mapInArrow(_look, "result_id bigint, source string, field string, state string, runs array<bigint>, word string, word_key bigint"), "seen")
    asked = seen.where("state = 'ask'").join(sized.select("result_id", "field", "at_limit"), ["result_id", "field"])
    corpus = sized.select("text", ((F.col("field") == "parse_error") & ~F.col("at_limit")).alias("ends"))
    evidence = judge(asked.select("result_id", "source", "field", "at_limit", "runs", "word", "word_key"), corpus)
    unknown = (F.col("known") <= 1) & F.col("word").rlike(r"^\p{Ll}")
    cut = F.col("at_limit") | F.col("stump") | (F.col("end_share") < F.when(F.col("field") == "parse_error", LEAST_MESSAGE_END).otherwise(LEAST_END)) | (F.col("end_share").isNull() & unknown)
    told = evidence.select("result_id", "source", "field", F.coalesce(cut, F.lit(False)).alias("cut"))
    return seen.where("state <> 'ask'").select("result_id", "source", "field", (F.col("state") == "cut").alias("cut")).unionByName(told)


def cut_values(results: DataFrame) -> DataFrame:
    """(result_id, field) of the values that were cut off."""
    return judged(results).where("cut").select("result_id", "field")


def cut_rates(results: DataFrame) -> DataFrame:
    """Per source and field: stored values, cut values and their share.  A null source is a source."""
    return (
        judged(results)
        .groupBy("source", "field")
        .agg(F.count(F.lit(1)).alias("stored"), F.count_if("cut").alias("cut"))
        .withColumn("share", F.round(F.col("cut") / F.col("stored"), 6))
    )
