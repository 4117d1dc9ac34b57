"""Flattening and drift against plain Python, with their odd cases."""

import datetime
import json

import pytest

from litmusq.operators import flatten
from litmusq.sources import drift

T = datetime.datetime(2025, 1, 1)
FILES = "file_id bigint, payload string, written_at timestamp, ingested_at timestamp, scorer_id string"


def files(spark, *payloads):
    return spark.createDataFrame([(i, p if p is None or isinstance(p, str) else json.dumps(p), T, T, "clash") for i, p in enumerate(payloads)], FILES)


def keys(df):
    return sorted((r.file_id, r.flat_table, r.scorer_id, r.parent_pos, r.child_pos) for r in df.collect())


SCORER = {"hypothesis": None, "code": "def f(): pass", "constants_and_thresholds": [{"name": "a", "value": 1}, None, {"name": "b"}], "validation": {"valid": True, "validation_rows": [None, {"pair_id": "p", "errors": [{"side": "neg"}, None]}, {"pair_id": "q", "errors": {"side": "pos"}}]}}
WANT = [("constants_and_thresholds", -1, 0), ("constants_and_thresholds", -1, 2), ("errors", 1, 0), ("errors", 2, 0), ("scorers", -1, -1), ("validation_rows", -1, 1), ("validation_rows", -1, 2)]


@pytest.mark.parametrize(
    "payload",
    [
        {"S1": SCORER},
        [{"scorer_id": "S1", **SCORER}],
        {"scorers": {"S1": SCORER}, "run_id": "x"},
        {"scorers": [{**SCORER, "scorer_id": "S1"}], "note": "y"},
        {"rounds": [{"round": 0, "scorers": {"S1": SCORER}}, {"round": 1, "scorers": []}, {"round": 2}]},
        {"S1": {**SCORER, "validation": json.dumps(SCORER["validation"])}},
    ],
)
def test_every_layout(spark, payload):
    assert keys(flatten.flat_keys(files(spark, payload))) == [(0, t, "S1", p, c) for t, p, c in WANT]


def test_no_records_without_json(spark):
    assert keys(flatten.flat_keys(files(spark, None, "", "  ", "{broken", "7", "[]", "{}", '"text"', [None], {"S": None}))) == []


def test_single_objects_and_fields(spark):
    f = files(spark, {"S1": {"constants_and_thresholds": {"name": "only", "value": 2.5, "reason": "r"}, "validation": {"valid": "true", "validation_rows": {"pair_id": "p", "pos_score": 0.5, "correct": False}}}})
    assert flatten.flat_table(f, "constants_and_thresholds").first().asDict() == {"file_id": 0, "scorer_id": "S1", "parent_pos": -1, "child_pos": 0, "name": "only", "value": 2.5, "reason": "r"}
    assert flatten.flat_table(f, "validation_rows").first().pos_score == 0.5
    assert flatten.flat_table(f, "scorers").first().valid is True
    assert flatten.flat_table(f, "errors").count() == 0


def test_repeated_files_and_empty_table(spark):
    f = files(spark, {"S1": SCORER})
    assert keys(flatten.flat_keys(f.union(f))) == keys(flatten.flat_keys(f))
    assert flatten.flat_keys(f.limit(0)).count() == 0


def records(spark, *rows):
    return spark.createDataFrame([(s, q, n, p if p is None or isinstance(p, str) else json.dumps(p), T, T) for s, q, n, p in rows], "stream string, file_seq int, record_no int, payload string, written_at timestamp, received_at timestamp")


def found(spark, *rows):
    return sorted((r.stream, r.file_seq, r.change, r.field, r.new_field) for r in drift.changes(drift.ingested(records(spark, *rows))).collect())


def test_changes_of_every_kind(spark):
    got = found(
        spark,
        ("s", 1, 1, {"scorer_id": "A", "x": 1.5, "gone": "g", "t": 1, "deep": {"a": {"b": 2}}}),
        ("s", 1, 2, {"scorer_id": "B", "x": 2.5, "gone": "h", "t": 2, "deep": {"a": {"b": 3}}}),
        ("s", 3, 1, {"scorer_id": "B", "y": 2.5, "t": "2", "deep": {"a": {"b": [3]}}, "new": None, "empty": {}}),
        ("s", 3, 2, {"scorer_id": "C", "y": 9, "t": None, "deep": {"a": {"b": [4]}}}),
    )
    assert got == [("s", 3, "added", "new", ""), ("s", 3, "removed", "gone", ""), ("s", 3, "renamed", "x", "y"), ("s", 3, "type_changed", "deep.a.b", ""), ("s", 3, "type_changed", "t", "")]


def test_null_values_are_no_type_and_no_evidence(spark):
    got = found(spark, ("s", 1, 1, {"scorer_id": "A", "x": None, "z": 1}), ("s", 2, 1, {"scorer_id": "A", "y": None, "z": None}))
    assert got == [("s", 2, "added", "y", ""), ("s", 2, "removed", "x", "")]


def test_repeated_and_corrupt_records(spark):
    rows = [("s", 1, 1, {"scorer_id": "A", "x": 1}), ("s", 1, 1, {"scorer_id": "A", "x": 1}), ("s", 1, 2, "{no json"), ("s", 1, 3, None), ("s", 2, 1, {"scorer_id": "A", "x": 1}), (None, 1, 1, "{}")]
    assert found(spark, *rows) == []
    leaves = drift.opened(records(spark, *rows))
    table = drift.ingest(leaves)
    assert table.count() == 4
    assert {r.record_no: dict(r.rescued) for r in table.where("file_seq = 1").collect()}[2] == {"$": '"{no json"'}


def test_renames_are_matched_until_none_is_left(spark):
    """Two gone fields fit the same new field first; the second takes its other candidate."""
    got = found(spark, ("s", 1, 1, {"scorer_id": "A", "p": 1, "q": 1}), ("s", 2, 1, {"scorer_id": "A", "x": 1, "y": 1.0}))
    assert got == [("s", 2, "renamed", "p", "x"), ("s", 2, "renamed", "q", "y")]
    got = found(spark, ("s", 1, 1, {"scorer_id": "A", "train_accuracy": 0.50, "hypothesis": 'a "b" \u00e9'}), ("s", 2, 1, {"scorer_id": "A", "acc": 5e-1, "h": 'a "b" \u00e9'}), ("s", 3, 1, {"scorer_id": "A", "acc": "0.5", "h": None}))
    assert got == [("s", 2, "renamed", "hypothesis", "h"), ("s", 2, "renamed", "train_accuracy", "acc"), ("s", 3, "type_changed", "acc", "")]


def test_objects_of_any_depth_are_opened(spark):
    deep = {"x": 1}
    for i in range(9):
        deep = {f"l{i}": deep, "e": {}}
    got = found(spark, ("s", 1, 1, {"scorer_id": "A", **deep}), ("s", 2, 1, {"scorer_id": "B"}))
    assert got == [("s", 2, "removed", ".".join(f"l{i}" for i in range(8, -1, -1)) + ".x", "")]


def test_rescued_values_are_replayed(spark):
    df = drift.consistent_table(
        records(
            spark,
            ("s", 1, 1, {"scorer_id": "A", "train_accuracy": 0.25, "pair_type_accuracy": {"hype_trap": 0.5}, "odd": 1}),
            ("s", 2, 1, {"scorer_id": "A", "trainAccuracy": 0.25, "pair_type_accuracy": {"hype_trap": "0.5"}, "execution_valid": "yes", "generation_round": 1.5}),
            ("s", 3, 1, {"scorer_id": "A", "acc": 0.25, "pair_type_accuracy": {"hype_trap": [0.75]}, "pareto_ineligible_reason": ["a", "b"]}),
        )
    )
    rows = {r.file_seq: r for r in df.collect()}
    assert [rows[q].train_accuracy for q in (1, 2, 3)] == [0.25, 0.25, 0.25]
    assert [rows[q].pair_type_accuracy__hype_trap for q in (1, 2, 3)] == [0.5, 0.5, 0.75]
    assert rows[2].execution_valid is True and rows[3].pareto_ineligible_reason == "a; b"
    assert dict(rows[1].rescued) == {"odd": "1"}
    assert "generation_round" in rows[2].rescued


def test_empty_stream_table(spark):
    none = records(spark, ("s", 1, 1, "{}")).limit(0)
    assert drift.changes(drift.ingested(none)).count() == 0
    assert drift.consistent_table(none).count() == 0
