"""Queries of the general training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmusq.operators import flatten
from litmusq.sources import drift
from litmusq.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return flatten.flat_keys(table(spark, folder, "scorer_function_files"))


def _flat(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: flatten.flat_table(table(spark, folder, "scorer_function_files"), name)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift.changes(drift.ingested(table(spark, folder, "summary_records")))


def p5_summaries(spark: SparkSession, folder: str) -> DataFrame:
    return drift.consistent_table(table(spark, folder, "summary_records"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_found": p3_found,
    "p3_scorers": lambda spark, folder: _flat("scorers")(spark, folder).withColumn("valid", F.col("valid").cast("string")),
    "p3_constants": _flat("constants_and_thresholds"),
    "p3_validation_rows": _flat("validation_rows"),
    "p3_errors": _flat("errors"),
    "p5_found": p5_found,
    "p5_summaries": p5_summaries,
}


def _list(x: str) -> str:
    """The elements of a JSON list; a single object is a list of one."""
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN json_extract({x}, '$[*]') WHEN 'OBJECT' THEN [{x}] ELSE [] END"


def _placed(name: str, source: str, columns: str, x: str) -> str:
    return f"{name}0 AS (SELECT {columns}, {_list(x)} AS l FROM {source}), {name} AS (SELECT {columns}, generate_subscripts(l, 1) - 1 AS {name}_pos, unnest(l) AS {name}_json FROM {name}0)"


_FLAT = f"""f AS (SELECT file_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM scorer_function_files WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ingested_at DESC, written_at DESC) = 1),
c AS (SELECT file_id, unnest(json_extract(j, '$.rounds[*].scorers')) AS c FROM f WHERE (j->'$.rounds') IS NOT NULL UNION ALL SELECT file_id, j->'$.scorers' FROM f WHERE (j->'$.rounds') IS NULL AND (j->'$.scorers') IS NOT NULL
      UNION ALL SELECT file_id, j FROM f WHERE (j->'$.rounds') IS NULL AND (j->'$.scorers') IS NULL),
k AS (SELECT file_id, c, unnest(json_keys(c)) AS id FROM c WHERE json_type(c) = 'OBJECT'),
s0 AS (SELECT file_id, id AS scorer_id, json_extract(c, '$."' || id || '"') AS s FROM k UNION ALL SELECT file_id, s->>'$.scorer_id', s FROM (SELECT file_id, unnest(json_extract(c, '$[*]')) AS s FROM c WHERE json_type(c) = 'ARRAY')),
s AS (SELECT *, s->'$.constants_and_thresholds' AS k, CASE json_type((s->'$.validation')) WHEN 'VARCHAR' THEN (s->>'$.validation')::JSON ELSE s->'$.validation' END AS v FROM s0 WHERE json_type(s) = 'OBJECT'),
{_placed("con", "s", "file_id, scorer_id", "k")}, {_placed("row", "s", "file_id, scorer_id", "(v->'$.validation_rows')")},
{_placed("err", "(SELECT * FROM row WHERE json_type(row_json) = 'OBJECT')", "file_id, scorer_id, row_pos", "(row_json->'$.errors')")}"""
_LEAVES = """d AS (SELECT stream, file_seq, record_no, payload FROM summary_records WHERE stream IS NOT NULL QUALIFY row_number() OVER (PARTITION BY stream, file_seq, record_no ORDER BY received_at DESC, written_at DESC) = 1),
t AS (SELECT stream, file_seq, record_no, payload->>'$.scorer_id' AS scorer, replace(substr(fullkey, 3), '"', '') AS field, CASE type WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS kind, value::VARCHAR AS value
      FROM d, json_tree(d.payload::JSON) WHERE type <> 'OBJECT' AND NOT contains(path, '[') AND NOT contains(fullkey, '[')),
has AS (SELECT stream, file_seq, field, list_sort(list_distinct(list(kind) FILTER (kind IS NOT NULL))) AS kinds FROM t GROUP BY ALL),
st AS (SELECT stream, file_seq, lag(file_seq) OVER (PARTITION BY stream ORDER BY file_seq) AS prev FROM (SELECT DISTINCT stream, file_seq FROM d) QUALIFY prev IS NOT NULL),
o AS (SELECT st.stream, st.file_seq, st.prev, field, kinds FROM st JOIN has ON has.stream = st.stream AND has.file_seq = st.prev), n AS (SELECT st.stream, st.file_seq, field, kinds FROM st JOIN has ON has.stream = st.stream AND has.file_seq = st.file_seq),
gone AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.stream = o.stream AND n.file_seq = o.file_seq AND n.field = o.field)),
come AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.stream = n.stream AND o.file_seq = n.file_seq AND o.field = n.field)),
ren AS (SELECT g.stream, g.file_seq, g.field, c.field AS new_field FROM gone g JOIN come c ON c.stream = g.stream AND c.file_seq = g.file_seq JOIN t a ON a.stream = g.stream AND a.file_seq = g.prev AND a.field = g.field AND a.kind IS NOT NULL
        JOIN t b ON b.stream = g.stream AND b.file_seq = g.file_seq AND b.field = c.field AND b.kind IS NOT NULL AND b.scorer = a.scorer GROUP BY ALL HAVING bool_and(a.value = b.value))"""
#: The rescued table has no counterpart in SQL; tests hold it against plain Python.
SQL: dict[str, str] = {
    "p3_found": f"""WITH {_FLAT} SELECT file_id, 'scorers' AS flat_table, scorer_id, -1::BIGINT AS parent_pos, -1::BIGINT AS child_pos FROM s UNION ALL SELECT file_id, 'constants_and_thresholds', scorer_id, -1, con_pos FROM con WHERE json_type(con_json) = 'OBJECT'
        UNION ALL SELECT file_id, 'validation_rows', scorer_id, -1, row_pos FROM row WHERE json_type(row_json) = 'OBJECT' UNION ALL SELECT file_id, 'errors', scorer_id, row_pos, err_pos FROM err WHERE json_type(err_json) = 'OBJECT'""",
    "p3_scorers": f"WITH {_FLAT} SELECT file_id, scorer_id, -1::BIGINT AS parent_pos, -1::BIGINT AS child_pos, s->>'$.hypothesis' AS hypothesis, s->>'$.code' AS code, v->>'$.reason' AS reason, TRY_CAST(v->>'$.valid' AS BOOLEAN)::VARCHAR AS valid FROM s",
    "p3_constants": f"WITH {_FLAT} SELECT file_id, scorer_id, -1::BIGINT AS parent_pos, con_pos AS child_pos, con_json->>'$.name' AS name, (con_json->>'$.value')::DOUBLE AS value, con_json->>'$.reason' AS reason FROM con WHERE json_type(con_json) = 'OBJECT'",
    "p3_validation_rows": f"""WITH {_FLAT} SELECT file_id, scorer_id, -1::BIGINT AS parent_pos, row_pos AS child_pos, row_json->>'$.pair_id' AS pair_id, (row_json->>'$.pos_score')::DOUBLE AS pos_score, (row_json->>'$.neg_score')::DOUBLE AS neg_score,
        (row_json->>'$.margin')::DOUBLE AS margin, (row_json->>'$.correct')::BOOLEAN AS correct FROM row WHERE json_type(row_json) = 'OBJECT'""",
    "p3_errors": f"WITH {_FLAT} SELECT file_id, scorer_id, row_pos AS parent_pos, err_pos AS child_pos, err_json->>'$.side' AS side, err_json->>'$.message' AS message FROM err WHERE json_type(err_json) = 'OBJECT'",
    "p5_found": f"""WITH {_LEAVES} SELECT stream, file_seq::BIGINT AS file_seq, 'renamed' AS change, field, new_field FROM ren
        UNION ALL SELECT stream, file_seq, 'removed', field, '' FROM gone WHERE NOT EXISTS (SELECT 1 FROM ren WHERE ren.stream = gone.stream AND ren.file_seq = gone.file_seq AND ren.field = gone.field)
        UNION ALL SELECT stream, file_seq, 'added', field, '' FROM come WHERE NOT EXISTS (SELECT 1 FROM ren WHERE ren.stream = come.stream AND ren.file_seq = come.file_seq AND ren.new_field = come.field)
        UNION ALL SELECT o.stream, o.file_seq, 'type_changed', o.field, '' FROM o JOIN n ON n.stream = o.stream AND n.file_seq = o.file_seq AND n.field = o.field WHERE len(o.kinds) > 0 AND len(n.kinds) > 0 AND o.kinds <> n.kinds""",
}
