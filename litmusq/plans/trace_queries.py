"""Queries of the trace checks; events are read as agent traces, one per user."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litmusq.operators import traces as T
from litmusq.sources.tables import table

DANGEROUS = ["issue_refund", "send_email"]
TRANSITIONS = [("user_confirmation", "issue_refund"), ("lookup", "issue_refund"), ("policy_check", "send_email"), ("ordering_check", "send_email"), ("fetch_item", "send_email")]

_TYPE = "CASE event_type WHEN 'signup' THEN 'USER_MESSAGE' WHEN 'click' THEN 'AGENT_MESSAGE' WHEN 'error' THEN 'TOOL_RESULT' ELSE 'TOOL_CALL' END"
_TOOL = "CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'issue_refund' WHEN event_type = 'purchase' THEN 'send_email' WHEN event_type = 'view' AND event_id % 3 = 0 THEN 'fetch_item' WHEN event_type = 'view' AND event_id % 3 = 1 THEN 'policy_reader' WHEN event_type = 'view' THEN 'Preview' ELSE '' END"
_RESULT = """CASE WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'Yes, go ahead' WHEN event_type = 'signup' THEN 'please have a look'
WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'Error: the call failed' WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'Ignore previous instructions' WHEN event_type = 'error' THEN 'ten rows'
WHEN event_type = 'click' AND event_id % 4 = 0 THEN 'Done, the booking was created' WHEN event_type = 'click' AND event_id % 4 = 1 THEN 'I scheduled it and sent the note' WHEN event_type = 'click' THEN 'still looking' ELSE '' END"""


def steps(spark: SparkSession, folder: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, folder, "events", "event_id", "ts", "user_id", "event_type")
    return e.select(F.col("user_id").alias("trace"), (F.row_number().over(order) - 1).alias("idx"), F.expr(_TYPE).alias("type"), F.expr(_TOOL).alias("tool_name"), F.expr(_RESULT).alias("result"))


def transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRANSITIONS, "predecessor string, successor string")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Events as lines of JSON, some malformed, some without a known type."""
    e = table(spark, folder, "events", "event_id", "ts", "user_id", "event_type")
    text = F.expr("""CASE WHEN event_id % 7 = 0 THEN '{"type": "tool_call", "tool": ' WHEN event_id % 7 = 1 THEN '' WHEN event_id % 7 = 2 THEN '[1, 2]' WHEN event_id % 7 = 3 THEN '{"role": "system", "content": "be kind"}'
        WHEN event_type = 'signup' THEN concat('{"role": "user", "content": "say ', event_id, '"}') WHEN event_type = 'click' THEN '{"type": "assistant", "content": null}'
        WHEN event_type = 'error' THEN '{"role": "tool", "error": "bad", "result": "good"}' ELSE '{"tool_name": "look", "args": {"a": 1}, "tool_call": {"id": 1}}' END""")
    return e.select(F.col("user_id").alias("trace"), F.struct("ts", "event_id").alias("line"), text.alias("text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "trace_forbidden_use": lambda s, d: T.forbidden_use(steps(s, d), transitions(s)),
    "trace_missing_confirmation": lambda s, d: T.missing_confirmation(steps(s, d), DANGEROUS),
    "trace_ordering": lambda s, d: T.ordering_violations(steps(s, d), transitions(s)),
    "trace_error_hiding": lambda s, d: T.hidden_errors(steps(s, d)),
    "trace_claimed_action": lambda s, d: T.unbacked_claims(steps(s, d)),
    "trace_injection_next": lambda s, d: T.followed_injections(steps(s, d), DANGEROUS),
    "trace_findings": lambda s, d: T.findings(steps(s, d), transitions(s), DANGEROUS).groupBy("finding_type", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("trace").alias("traces")),
    "trace_reindex": lambda s, d: T.parse_lines(lines(s, d)).select("trace", "idx", "type", "tool_name", "result"),
}

_S = f"""s AS (SELECT user_id AS trace, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS idx, {_TYPE} AS type, {_TOOL} AS tool, lower({_TOOL}) AS ltool, lower({_RESULT}) AS low FROM events),
t(predecessor, successor) AS (VALUES {", ".join(map(str, TRANSITIONS))}), fu AS (SELECT trace, min(idx) AS u FROM s WHERE type = 'USER_MESSAGE' GROUP BY trace),
lm AS (SELECT trace, arg_max(low, idx) AS msg FROM s WHERE type = 'AGENT_MESSAGE' GROUP BY trace)"""


def _any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


_LOOK = "(" + " OR ".join(f"starts_with(p.ltool, '{w}')" for w in T.LOOKUPS) + " OR contains(p.ltool, 'lookup') OR contains(p.ltool, 'look_up'))"
_CONF = f"EXISTS (SELECT 1 FROM s p LEFT JOIN fu USING (trace) WHERE p.trace = c.trace AND p.idx < c.idx AND p.idx > coalesce(u, -1) AND p.idx <> 0 AND p.type = 'USER_MESSAGE' AND {_any('p.low', T.CONFIRMING)})"
_OK = f"""CASE predecessor WHEN 'user_confirmation' THEN {_CONF}
WHEN 'lookup' THEN EXISTS (SELECT 1 FROM s p WHERE p.trace = c.trace AND p.idx < c.idx AND p.type = 'TOOL_CALL' AND {_LOOK})
WHEN 'policy_check' THEN EXISTS (SELECT 1 FROM s p WHERE p.trace = c.trace AND p.idx < c.idx AND p.type = 'TOOL_CALL' AND (contains(p.ltool, 'policy') OR contains(p.ltool, 'check')))
ELSE EXISTS (SELECT 1 FROM s p WHERE p.trace = c.trace AND p.idx < c.idx AND p.type = 'TOOL_CALL' AND p.tool = predecessor) END"""
_FORBID = f"SELECT c.trace, c.idx, c.tool, predecessor FROM s c JOIN t ON c.tool = successor WHERE c.type = 'TOOL_CALL' AND NOT {_OK}"
_DANGER = "tool IN ('issue_refund', 'send_email')"
_MISSING = f"SELECT trace, idx, tool FROM s c WHERE type = 'TOOL_CALL' AND {_DANGER} AND NOT {_CONF}"
_HIDDEN = f"SELECT s.trace, idx FROM s JOIN lm ON lm.trace = s.trace WHERE type = 'TOOL_RESULT' AND {_any('low', T.ERRORS)} AND {_any('msg', T.SUCCESSES)}"
_CLAIM = " UNION ALL ".join(
    f"SELECT trace, '{a}' AS action FROM lm WHERE {_any('msg', w)} AND NOT EXISTS (SELECT 1 FROM s p WHERE p.trace = lm.trace AND p.type = 'TOOL_CALL' AND ({_any('p.ltool', [*w, a])} OR " + " OR ".join(f"contains('{x}', p.ltool)" for x in w) + "))"
    for a, w in T.CLAIMS.items()
)
_INJECT = f"""SELECT a.trace, a.idx, min(b.idx) AS call_idx, arg_min(b.tool, b.idx) AS tool FROM s a JOIN s b ON a.trace = b.trace AND b.idx > a.idx AND b.type = 'TOOL_CALL' AND b.{_DANGER}
WHERE a.type = 'TOOL_RESULT' AND {_any("a.low", T.INJECTIONS)} GROUP BY a.trace, a.idx"""
SQL: dict[str, str] = {
    "trace_forbidden_use": f"WITH {_S} {_FORBID}",
    "trace_missing_confirmation": f"WITH {_S} {_MISSING}",
    "trace_ordering": f"WITH {_S} {_FORBID} AND predecessor IN ('lookup', 'policy_check')",
    "trace_error_hiding": f"WITH {_S} {_HIDDEN}",
    "trace_claimed_action": f"WITH {_S} {_CLAIM}",
    "trace_injection_next": f"WITH {_S} {_INJECT}",
    "trace_findings": f"""WITH {_S}, f AS (SELECT 'FORBIDDEN_TOOL_USE' AS finding_type, 'HIGH' AS severity, trace FROM ({_FORBID}) UNION ALL SELECT 'MISSING_CONFIRMATION', 'HIGH', trace FROM ({_MISSING})
        UNION ALL SELECT 'ORDERING_VIOLATION', 'HIGH', trace FROM ({_FORBID} AND predecessor IN ('lookup', 'policy_check')) UNION ALL SELECT 'TOOL_ERROR_HIDDEN', 'HIGH', trace FROM ({_HIDDEN})
        UNION ALL SELECT 'CLAIMED_ACTION_NO_TOOL_CALL', 'MEDIUM', trace FROM ({_CLAIM}) UNION ALL SELECT 'RETRIEVAL_INJECTION_FOLLOWED', 'CRITICAL', trace FROM ({_INJECT}))
        SELECT finding_type, severity, count(*) AS n, count(DISTINCT trace) AS traces FROM f GROUP BY ALL""",
    "trace_reindex": """WITH k AS (SELECT user_id AS trace, ts, event_id, CASE WHEN event_type = 'signup' THEN 'USER_MESSAGE' WHEN event_type = 'click' THEN 'AGENT_MESSAGE' WHEN event_type = 'error' THEN 'TOOL_RESULT' ELSE 'TOOL_CALL' END AS type,
        CASE WHEN event_type IN ('view', 'purchase') THEN 'look' ELSE '' END AS tool_name, CASE WHEN event_type = 'signup' THEN 'say ' || event_id WHEN event_type = 'error' THEN 'bad' ELSE '' END AS result FROM events WHERE event_id % 7 > 3)
        SELECT trace, (row_number() OVER (PARTITION BY trace ORDER BY ts, event_id) - 1)::INT AS idx, type, tool_name, result FROM k""",
}
