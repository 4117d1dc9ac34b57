"""Deeply nested scorer files as four flat tables with parent links.

The JVM parses each payload once into one nested column, whatever layout the
file has; Arrow carries that column to ``flatten``, which never looks at single
rows: child arrays are the flattened buffers of the lists, their parents come
from the parent-index kernel, places from list offsets, and the keys of the
parents are propagated by vectorised take.

Layouts understood: an object of scorers by id, a list of scorers, either of
them under ``scorers``, and a list of ``rounds`` with ``scorers`` each.  Any
field may be missing, null, or (an object where a list is due) single;
``validation`` may be JSON in a string.  A null element is no record but keeps
its place.  A payload that is null, blank or no JSON has no records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLES = ("scorers", "constants_and_thresholds", "validation_rows", "errors")
_SCORER = "scorer_id string, hypothesis string, code string, constants_and_thresholds string, validation string"
_ROW = "pair_id string, pos_score double, neg_score double, margin double, correct boolean, errors string"
_CONSTANT = "name string, value double, reason string"
_ERROR = "side string, message string"


def _elements(text: Column) -> Column:
    """The elements of a JSON list as strings; a single object is a list of one."""
    t = F.ltrim(text)
    return F.when(t.startswith("["), F.from_json(t, "array<string>")).when(t.startswith("{"), F.array(t))


def _objects(texts: Column, schema: str) -> Column:
    """Each string that holds an object as a struct, others as null at their place."""
    return F.transform(texts, lambda t: F.when(F.ltrim(t).startswith("{"), F.from_json(t, schema)))


def _members(container: Column) -> Column:
    """Scorers of a container as (id, text)."""
    t = F.ltrim(container)
    keyed = F.transform(F.map_entries(F.from_json(t, "map<string,string>")), lambda e: F.struct(e["key"].alias("id"), e["value"].alias("text")))
    listed = F.transform(F.from_json(t, "array<string>"), lambda e: F.struct(F.lit(None).cast("string").alias("id"), e.alias("text")))
    return F.when(t.startswith("["), listed).when(t.startswith("{"), keyed).otherwise(F.array().cast("array<struct<id:string,text:string>>"))


def nested(files: DataFrame) -> DataFrame:
    """(file_id, scorers): one row per file, its scorers in one nested column."""
    one = files.where(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.max_by("payload", F.struct("ingested_at", "written_at")).alias("payload"))
    text = F.ltrim("payload")
    known = F.when(F.try_parse_json("payload").isNotNull(), text)
    parts = one.select("file_id", known.alias("text")).withColumn("top", F.from_json("text", "rounds array<struct<scorers:string>>, scorers string"))
    containers = (
        F.when(F.col("text").startswith("["), F.array("text"))
        .when(F.col("top.rounds").isNotNull(), F.transform("top.rounds", lambda r: r["scorers"]))
        .when(F.col("top.scorers").isNotNull(), F.array("top.scorers"))
        .otherwise(F.array("text"))
    )
    found = parts.select("file_id", F.filter(F.flatten(F.transform(containers, _members)), lambda m: F.ltrim(m["text"]).startswith("{")).alias("found"))
    parsed = F.transform("found", lambda m: F.struct(m["id"].alias("id"), F.from_json(m["text"], _SCORER).alias("s")))

    def scorer(m: Column) -> Column:
        s, check = m["s"], m["check"]
        rows = F.transform(
            _objects(_elements(check["validation_rows"]), _ROW),
            lambda r: F.when(r.isNotNull(), F.struct(*[r[c].alias(c) for c in ("pair_id", "pos_score", "neg_score", "margin", "correct")], _objects(_elements(r["errors"]), _ERROR).alias("errors"))),
        )
        return F.struct(
            F.coalesce(m["id"], s["scorer_id"]).alias("scorer_id"),
            s["hypothesis"].alias("hypothesis"),
            s["code"].alias("code"),
            F.lower(check["valid"]).alias("valid"),
            check["reason"].alias("reason"),
            _objects(_elements(s["constants_and_thresholds"]), _CONSTANT).alias("constants_and_thresholds"),
            rows.alias("validation_rows"),
        )

    checked = F.transform("parsed", lambda m: F.struct(m["id"].alias("id"), m["s"].alias("s"), F.from_json(m["s"]["validation"], "valid string, reason string, validation_rows string").alias("check")))
    return found.select("file_id", parsed.alias("parsed")).select("file_id", checked.alias("checked")).select("file_id", F.transform("checked", scorer).alias("scorers"))


def _children(lists: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Values of all lists, the index of the list each is from, and its place there."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    parents = pc.list_parent_indices(lists)
    place = np.arange(int(lengths.sum())) - starts[parents.to_numpy(zero_copy_only=False)]
    return pc.list_flatten(lists), parents, place


def _present(values: pa.Array, *with_: pa.Array) -> tuple[pa.Array, ...]:
    keep = pc.is_valid(values)
    return tuple(pc.filter(x, keep) for x in (values, *with_))


def _levels(batch: pa.RecordBatch) -> dict[str, dict[str, pa.Array]]:
    """The four flat tables of a batch, by column."""
    scorers, parent, _ = _children(batch.column("scorers"))
    scorers, parent = _present(scorers, parent)
    file_id = pc.take(batch.column("file_id"), parent)
    scorer_id = pc.struct_field(scorers, "scorer_id")
    n = len(scorers)
    none = lambda k: pa.array(np.full(k, -1))
    out = {"scorers": {"file_id": file_id, "scorer_id": scorer_id, "parent_pos": none(n), "child_pos": none(n), **{c: pc.struct_field(scorers, c) for c in ("hypothesis", "code", "valid", "reason")}}}

    def level(lists: pa.Array, keys: dict[str, pa.Array]) -> tuple[pa.Array, dict[str, pa.Array], pa.Array]:
        values, parents, place = _children(lists)
        values, parents, at = _present(values, parents, pa.array(place))
        return values, {k: pc.take(v, parents) for k, v in keys.items()}, at

    keys = {"file_id": file_id, "scorer_id": scorer_id}
    values, known, at = level(pc.struct_field(scorers, "constants_and_thresholds"), keys)
    out["constants_and_thresholds"] = {**known, "parent_pos": none(len(values)), "child_pos": at, **{c: pc.struct_field(values, c) for c in ("name", "value", "reason")}}
    rows, known, at = level(pc.struct_field(scorers, "validation_rows"), keys)
    out["validation_rows"] = {**known, "parent_pos": none(len(rows)), "child_pos": at, **{c: pc.struct_field(rows, c) for c in ("pair_id", "pos_score", "neg_score", "margin", "correct")}}
    errors, known, place = level(pc.struct_field(rows, "errors"), known | {"parent_pos": at})
    out["errors"] = {**known, "child_pos": place, **{c: pc.struct_field(errors, c) for c in ("side", "message")}}
    return out


_KEYS = ("file_id", "scorer_id", "parent_pos", "child_pos")
_KEY_SCHEMA = "file_id bigint, scorer_id string, parent_pos bigint, child_pos bigint"
_DATA = {
    "scorers": "hypothesis string, code string, valid string, reason string",
    "constants_and_thresholds": "name string, value double, reason string",
    "validation_rows": "pair_id string, pos_score double, neg_score double, margin double, correct boolean",
    "errors": "side string, message string",
}


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, columns in _levels(batch).items():
            label = pa.array([name] * len(columns["file_id"]), pa.string())
            yield pa.RecordBatch.from_arrays([columns["file_id"], label, *[columns[c] for c in _KEYS[1:]]], ["file_id", "flat_table", *_KEYS[1:]])


def _one(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = _levels(batch)[name]
            order = [*_KEYS, *[c.split()[0] for c in _DATA[name].split(", ")]]
            yield pa.RecordBatch.from_arrays([columns[c] for c in order], order)

    return run


def flat_keys(files: DataFrame) -> DataFrame:
    """(file_id, flat_table, scorer_id, parent_pos, child_pos) of the records of all four tables."""
    return nested(files).mapInArrow(_keys, "file_id bigint, flat_table string, scorer_id string, parent_pos bigint, child_pos bigint")


def flat_table(files: DataFrame, name: str) -> DataFrame:
    """One of ``TABLES`` with its fields; ``valid`` of scorers as boolean."""
    df = nested(files).mapInArrow(_one(name), f"{_KEY_SCHEMA}, {_DATA[name]}")
    return df.withColumn("valid", F.expr("try_cast(valid AS boolean)")) if name == "scorers" else df
