"""Queries of the audit operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmusq.operators import audit as A
from litmusq.operators import findings as W
from litmusq.plans.probe_queries import pairs
from litmusq.sources.tables import latest, table

TYPES = list(A.OBLIGATIONS)


def _obligations(spark: SparkSession, folder: str) -> DataFrame:
    i = table(spark, folder, "eval_items", "item_id", "text")
    return i.select(F.col("item_id").alias("obligation_id"), F.col("text").alias("source_text"), F.element_at(F.array(*map(F.lit, TYPES)), (F.col("item_id") % 7 % 6 + 1).cast("int")).alias("obligation_type"))


def _tools(spark: SparkSession, folder: str) -> DataFrame:
    h = table(spark, folder, "scorer_hypotheses", "scorer_id", "hypothesis", "expected_failure_mode", "taste_map_basis", "constants_and_thresholds")
    name = F.concat_ws("_", "scorer_id", F.element_at(F.split("hypothesis", " "), -1))
    return h.select(
        name.alias("name"), F.col("expected_failure_mode").alias("description"), F.col("taste_map_basis").alias("preconditions"),
        F.when(F.size("constants_and_thresholds") > 0, F.size("constants_and_thresholds") == 2).alias("all_optional"),
    ).withColumn("side_effect", A.side_effect(F.col("name"), F.col("description")))


def risk_class(spark: SparkSession, folder: str) -> DataFrame:
    p = pairs(spark, folder).select("pair_id", F.col("pair_type").alias("name"), F.col("positive").alias("description"))
    return p.groupBy(A.side_effect(F.col("name"), F.col("description")).alias("side_effect"), A.risk_level(F.col("name"), F.col("description")).alias("risk")).agg(F.count(F.lit(1)).alias("n"))


def file_category(spark: SparkSession, folder: str) -> DataFrame:
    s = latest(table(spark, folder, "stage_results"), "result_id", ["ingested_at", "called_at"], ["result_id", "stage_name", "raw_response"])
    path = F.concat(F.lit("runs/"), "stage_name", F.element_at(F.array(*map(F.lit, [".md", ".toml", ".py", ".txt", ".yaml"])), (F.col("result_id") % 5 + 1).cast("int")))
    c = s.select(A.file_categories(path, F.col("raw_response")).alias("c"))
    return c.groupBy(F.get("c", 0).alias("category"), F.array_join("c", ",").alias("all_categories")).agg(F.count(F.lit(1)).alias("files"))


def obligation_counts(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents", "doc_id", "text").select(F.col("doc_id").alias("path"), "text")
    return A.extract_obligations(d).groupBy("obligation_type").agg(F.count(F.lit(1)).alias("matches"), F.count_distinct("path").alias("documents"))


def obligation_tool_link(spark: SparkSession, folder: str) -> DataFrame:
    return A.link(_obligations(spark, folder), _tools(spark, folder))


def forbidden_transitions(spark: SparkSession, folder: str) -> DataFrame:
    o = _obligations(spark, folder)
    return A.transitions(o, A.link(o, _tools(spark, folder))).groupBy("predecessor").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("successor").alias("tools"))


def coverage_score(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "scorer_hypotheses").select(F.col("scorer_id").alias("path"), F.concat_ws(" ", "hypothesis", F.array_join("research_basis", " ")).alias("content"))
    return A.coverage(_obligations(spark, folder), f).withColumn("score", F.round(F.col("score") + 1e-9, 6))


def contract_rules(spark: SparkSession, folder: str) -> DataFrame:
    o, t = _obligations(spark, folder), _tools(spark, folder)
    links = A.link(o, t)
    return A.contract_findings(t, o.select("obligation_id", "obligation_type"), links.select("obligation_id", "tool")).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))


def rubric_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Sources as agents: their texts, each text as a tool named by its kind, and the obligations in their texts."""
    d = table(spark, folder, "documents", "doc_id", "source", "text", "doc_kind")
    tools = d.select("source", A.side_effect(F.col("doc_kind"), F.col("text")).alias("side_effect"))
    found = A.extract_obligations(d.select(F.col("doc_id").alias("path"), "text")).select(F.col("path").cast("bigint").alias("doc_id"), "obligation_type")
    return A.rubric(d, "source", tools, found.join(d.select("doc_id", "source"), "doc_id")).groupBy("gap", "severity").agg(F.count(F.lit(1)).alias("sources"))


def _findings(spark: SparkSession, folder: str) -> DataFrame:
    """Wrong answers as findings: the kind of gap from the pair type, title and description from the pair."""
    p = pairs(spark, folder)
    gaps = ["POLICY_GAP", "ENFORCEMENT_GAP", "COVERAGE_GAP", "TRACE_VIOLATION"]
    gap = F.element_at(F.array(*map(F.lit, gaps)), (F.length("pair_type") % 4 + 1).cast("int"))
    return p.select(F.upper("pair_type").alias("finding_type"), F.lit("HIGH").alias("severity"), gap.alias("gap_type"), F.col("anchor").alias("title"), F.col("negative").alias("description"))


def finding_tests(spark: SparkSession, folder: str) -> DataFrame:
    f = _findings(spark, folder)
    return f.groupBy("gap_type", W.test_type().alias("test_type"), W.repair_type().alias("repair_type")).agg(F.count(F.lit(1)).alias("findings"), F.count_distinct(W.finding_id(F.col("finding_type"), F.col("title"))).alias("ids"))


def findings_with_tests(spark: SparkSession, folder: str) -> DataFrame:
    """Findings joined to the tests made for them by id."""
    f = _findings(spark, folder)
    return W.with_tests(f, W.generated_tests(f)).groupBy("finding_type", F.size("test_ids").alias("tests")).agg(F.count(F.lit(1)).alias("findings"))


def coverage_findings(spark: SparkSession, folder: str) -> DataFrame:
    o = _obligations(spark, folder)
    return A.coverage_findings(coverage_score(spark, folder), o).select("severity", "subject")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "risk_class": risk_class,
    "file_category": file_category,
    "obligation_counts": obligation_counts,
    "obligation_tool_link": obligation_tool_link,
    "forbidden_transitions": forbidden_transitions,
    "coverage_score": coverage_score,
    "contract_rules": contract_rules,
    "rubric_gaps": rubric_gaps,
    "finding_tests": finding_tests,
    "findings_with_tests": findings_with_tests,
    "coverage_findings": coverage_findings,
}


def _any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _effect(name: str, desc: str) -> str:
    t = f"lower(concat_ws(' ', {name}, coalesce({desc}, '')))"
    return f"CASE WHEN list_contains({_list(A.WEAK)}, lower({name})) THEN 'WEAK' WHEN {_any(t, A.DESTRUCTIVE)} THEN 'DESTRUCTIVE' WHEN {_any(t, A.EXTERNAL_WRITE)} THEN 'EXTERNAL_WRITE' WHEN {_any(t, A.WEAK)} THEN 'WEAK' ELSE 'NONE' END"


def _tok(x: str, stops: list[str]) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^a-z0-9]+'), lambda t: t <> '' AND NOT list_contains({_list(stops)}, t)))"


_O = f"o AS (SELECT item_id AS obligation_id, text AS source_text, {_list(TYPES)}[item_id % 7 % 6 + 1] AS obligation_type FROM eval_items)"
_T = f"""t0 AS (SELECT concat_ws('_', scorer_id, string_split(hypothesis, ' ')[-1]) AS name, expected_failure_mode AS description, taste_map_basis AS pre, CASE WHEN len(constants_and_thresholds) > 0 THEN len(constants_and_thresholds) = 2 END AS all_optional FROM scorer_hypotheses),
t AS (SELECT *, {_effect("name", "description")} AS side_effect FROM t0)"""
_L = f"""lo AS (SELECT obligation_id, unnest({_tok("source_text", A.LINK_STOPS)}) AS token FROM o), lt AS (SELECT name AS tool, unnest({_tok("concat_ws(' ', name, description)", A.LINK_STOPS)}) AS token FROM t),
l AS (SELECT obligation_id, tool, count(*) AS shared FROM lo JOIN lt USING (token) GROUP BY ALL), k AS (SELECT l.obligation_id, tool AS name, obligation_type FROM l JOIN o USING (obligation_id))"""


def _holds(words: list[str]) -> str:
    return f"(len(list_filter(coalesce(pre, []), lambda p: {_any('lower(p)', words)})) > 0)"


_FILES = "f AS (SELECT stage_name AS s, result_id, coalesce(raw_response, '') AS text, 'runs/' || stage_name || ['.md', '.toml', '.py', '.txt', '.yaml'][result_id % 5 + 1] AS path FROM stage_results WHERE result_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY ingested_at DESC, called_at DESC) = 1)"
_CATS = [
    ("TOOL_SCHEMA", "ends_with(path, '.yaml') AND ((contains(text, 'functions:') AND contains(text, 'parameters:')) OR (contains(text, 'tools:') AND contains(text, 'input_schema:')))"),
    ("TOOL_SOURCE", r"ends_with(path, '.py') AND regexp_matches(text, '@tool\b|@function_tool\b|@agent\.tool\b|def\s+send_email\b|def\s+delete_\w+|def\s+create_\w+|def\s+send_\w+')"),
    ("PROMPT", f"{_any('path', ['prompt', 'system', 'instructions'])} OR regexp_matches(text, '{A._IMPERATIVE}')"),
    ("POLICY", _any("path", ["policy", "rules", "guardrail", "safety", "compliance"])),
    ("EVAL", _any("path", ["eval", "test_cases", "golden", "benchmark", "cases"])),
    ("CONFIG", f"ends_with(path, '.toml') OR {_any('path', ['config', 'settings'])}"),
    ("DOC", "ends_with(path, '.txt') OR ends_with(path, '.md')"),
]
_RUB = ", ".join(f"bool_or({_any('x', w)}) AS {q}" for q, w in (A.RUBRIC | {"bounds": A.BOUNDS}).items())
_GAPS = {
    "AGENT_OVERVIEW_GAP": "NOT ident", "DECISION_POLICY_GAP": "NOT decision AND NOT stop", "STOP_CONDITION_GAP": "decision AND NOT stop", "TOOL_SELECTION_POLICY_GAP": "NOT selection", "ORCHESTRATION_UNSPECIFIED": "multi AND NOT delegation AND NOT shared_state",
    "UNBOUNDED_DELEGATION": "multi AND delegation AND NOT bounds", "SHARED_STATE_UNSPECIFIED": "multi AND NOT shared_state", "HITL_GAP": "danger AND NOT hitl AND NOT confirmed", "APPROVAL_ENFORCEMENT_GAP": "danger AND hitl AND NOT confirmed", "OVERRIDE_GAP": "danger AND NOT override",
    "RETRY_POLICY_GAP": "NOT retry", "TIMEOUT_POLICY_GAP": "NOT timeout", "FALLBACK_POLICY_GAP": "NOT fallback", "PARTIAL_COMPLETION_GAP": "decision AND NOT partial_completion", "RECOVERY_STATE_GAP": "danger AND NOT recovery",
}
_CONFIRMS = " OR ".join(f"regexp_matches(coalesce(text, ''), '(?i){p}')" for p in A.OBLIGATIONS["CONFIRMATION_REQUIRED"])
_FINDINGS = """p AS (SELECT * FROM adversarial_pairs WHERE pair_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY ingested_at DESC, ord DESC) = 1),
f0 AS (SELECT upper(pair_type) AS finding_type, ['POLICY_GAP', 'ENFORCEMENT_GAP', 'COVERAGE_GAP', 'TRACE_VIOLATION'][length(pair_type) % 4 + 1] AS gap_type, coalesce(anchor, '') AS title, lower(coalesce(anchor, '')) || ' ' || lower(coalesce(negative, '')) AS td FROM p),
f AS (SELECT *, lower(finding_type) || ' ' || td AS x, left(sha256(finding_type || ':' || title), 12) AS id, CASE WHEN gap_type = 'TRACE_VIOLATION' THEN 'regression' WHEN gap_type = 'POLICY_GAP' AND contains(td, 'retrieval') AND contains(td, 'injection') THEN 'injection'
WHEN gap_type = 'ENFORCEMENT_GAP' AND (contains(td, 'policy') OR contains(td, 'eligibility')) THEN 'policy_lookup' WHEN gap_type = 'ENFORCEMENT_GAP' AND (contains(td, 'consistency') OR contains(td, 'verification') OR contains(td, 'verify')) THEN 'consistency'
WHEN gap_type IN ('POLICY_GAP', 'ENFORCEMENT_GAP') THEN 'confirmation' WHEN gap_type = 'COVERAGE_GAP' THEN 'coverage' ELSE 'generic' END AS test_type FROM f0)"""
SQL: dict[str, str] = {
    "risk_class": f"""WITH p AS (SELECT pair_type AS name, positive AS d FROM adversarial_pairs WHERE pair_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY ingested_at DESC, ord DESC) = 1), e AS (SELECT {_effect("name", "d")} AS side_effect, {_any("lower(concat_ws(' ', name, coalesce(d, '')))", A.FINANCIAL)} AS fin FROM p)
        SELECT side_effect, CASE WHEN side_effect = 'DESTRUCTIVE' OR (side_effect = 'EXTERNAL_WRITE' AND fin) THEN 'CRITICAL' WHEN side_effect = 'EXTERNAL_WRITE' THEN 'HIGH' WHEN side_effect = 'WEAK' THEN 'MEDIUM' ELSE 'LOW' END AS risk, count(*) AS n FROM e GROUP BY ALL""",
    "file_category": f"""WITH {_FILES}, c AS (SELECT list_filter([{", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _CATS)}], lambda x: x IS NOT NULL) AS c FROM f), d AS (SELECT CASE WHEN len(c) = 0 THEN ['UNKNOWN'] ELSE c END AS c FROM c)
        SELECT c[1] AS category, array_to_string(c, ',') AS all_categories, count(*) AS files FROM d GROUP BY ALL""",
    "obligation_tool_link": f"WITH {_O}, {_T}, {_L} SELECT obligation_id, tool, shared FROM l",
    "forbidden_transitions": f"""WITH {_O}, {_T}, {_L}, x AS (SELECT CASE obligation_type WHEN 'CONFIRMATION_REQUIRED' THEN 'user_confirmation' WHEN 'POLICY_CHECK_REQUIRED' THEN 'policy_check' WHEN 'LOOKUP_REQUIRED' THEN 'lookup' ELSE CASE WHEN regexp_matches(source_text, '{A.ORDERING}') THEN 'ordering_check' END END AS predecessor, tool FROM o JOIN l USING (obligation_id))
        SELECT predecessor, count(*) AS n, count(DISTINCT tool) AS tools FROM x WHERE predecessor IS NOT NULL GROUP BY predecessor""",
    "coverage_score": f"""WITH {_O}, a AS (SELECT obligation_id, {_tok("source_text", A.COVERAGE_STOPS)} AS t FROM o), f AS (SELECT {_tok("concat_ws(' ', hypothesis, array_to_string(research_basis, ' '))", A.COVERAGE_STOPS)} AS u FROM scorer_hypotheses),
        s AS (SELECT obligation_id, len(list_intersect(t, u)) / len(t) AS s FROM a, f WHERE len(t) > 0), b AS (SELECT obligation_id, max(s) AS score, count(*) FILTER (s >= 0.3) AS files FROM s GROUP BY obligation_id)
        SELECT o.obligation_id, round(coalesce(score, 0) + 1e-9, 6) AS score, coalesce(files, 0) AS files, CASE WHEN score >= 0.6 THEN 'covered' WHEN score >= 0.3 THEN 'partial' ELSE 'missing' END AS status FROM o LEFT JOIN b USING (obligation_id)""",
    "contract_rules": f"""WITH {_O}, {_T}, {_L}, d AS (SELECT * FROM t WHERE side_effect IN ('DESTRUCTIVE', 'EXTERNAL_WRITE')), r AS (
        SELECT 'A_no_obligation' AS rule, CASE WHEN side_effect = 'DESTRUCTIVE' THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM d WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.name = d.name)
        UNION ALL SELECT 'B_unenforced_confirmation', 'HIGH' FROM k JOIN t USING (name) WHERE obligation_type = 'CONFIRMATION_REQUIRED' AND NOT {_holds(["confirm", "approv", "permission"])}
        UNION ALL SELECT 'C_unchecked_money', 'HIGH' FROM t WHERE {_any("lower(name)", A.FINANCIAL)} AND NOT {_holds(["policy", "eligib", "verif", "check"])}
        UNION ALL SELECT 'D_unconfirmed_destruction', 'CRITICAL' FROM t WHERE side_effect = 'DESTRUCTIVE' AND NOT EXISTS (SELECT 1 FROM k WHERE k.name = t.name AND obligation_type = 'CONFIRMATION_REQUIRED')
        UNION ALL SELECT 'E_no_injection_guard', 'HIGH' WHERE EXISTS (SELECT 1 FROM t WHERE {_any("lower(name)", ["search", "retriev", "fetch", "query"])}) AND EXISTS (SELECT 1 FROM d) AND NOT EXISTS (SELECT 1 FROM o WHERE obligation_type = 'RETRIEVAL_INJECTION_GUARD')
        UNION ALL SELECT 'F_unverified_state', 'HIGH' FROM o WHERE obligation_type = 'FINAL_STATE_CONSISTENCY' AND NOT EXISTS (SELECT 1 FROM l WHERE l.obligation_id = o.obligation_id AND {_any("lower(tool)", ["verify", "check", "validate"])})
        UNION ALL SELECT 'G_all_optional', 'HIGH' FROM d WHERE all_optional
        UNION ALL SELECT 'prompt_only', 'MEDIUM' FROM k JOIN t USING (name) WHERE obligation_type NOT IN ('CONFIRMATION_REQUIRED', 'FINAL_STATE_CONSISTENCY') AND coalesce(len(pre), 0) = 0) SELECT rule, severity, count(*) AS n FROM r GROUP BY ALL""",
    "rubric_gaps": f"""WITH d0 AS (SELECT *, {_effect("doc_kind", "text")} AS side_effect FROM documents), x AS (SELECT source, coalesce(text, '') AS text, lower(coalesce(text, '')) AS x, side_effect, {_CONFIRMS} AS conf, regexp_extract_all(lower(coalesce(text, '')), 'you are (?:a |an )?(\\w+)', 1) AS roles FROM d0),
        r AS (SELECT source, {_RUB}, bool_or(regexp_matches(text, '{A.IDENTITY}')) AS ident, bool_or(side_effect IN ('DESTRUCTIVE', 'EXTERNAL_WRITE')) AS danger, bool_or(conf) AS confirmed, count(*) >= 2 AND coalesce(max(list_max(roles)) <> min(list_min(roles)), false) AS roles FROM x GROUP BY source),
        r2 AS (SELECT *, multi_agent OR roles AS multi FROM r), g AS ({" UNION ALL ".join(f"SELECT '{g}' AS gap, '{A.GAP_SEVERITY[g]}' AS severity FROM r2 WHERE {c}" for g, c in _GAPS.items())}) SELECT gap, severity, count(*) AS sources FROM g GROUP BY ALL""",
    "finding_tests": f"""WITH {_FINDINGS} SELECT gap_type, test_type, CASE WHEN gap_type IN ('COVERAGE_GAP', 'TRACE_VIOLATION') THEN 'ADD_TEST'
        WHEN gap_type = 'POLICY_GAP' THEN CASE WHEN NOT (contains(x, 'confirmation') OR contains(x, 'hitl') OR contains(x, 'approval')) AND (contains(x, 'retrieval') OR contains(x, 'injection')) THEN 'ADD_TOOL_PRECONDITION' ELSE 'ADD_HITL_GATE' END
        WHEN gap_type = 'ENFORCEMENT_GAP' AND (contains(x, 'permissive') OR contains(x, 'schema') OR contains(x, 'all-optional')) THEN 'TIGHTEN_SCHEMA' WHEN gap_type = 'ENFORCEMENT_GAP' AND (contains(x, 'consistency') OR contains(x, 'verification')) THEN 'ADD_FINAL_STATE_VERIFIER'
        WHEN gap_type = 'ENFORCEMENT_GAP' THEN 'ADD_TOOL_PRECONDITION' ELSE 'ADD_TEST' END AS repair_type, count(*) AS findings, count(DISTINCT id) AS ids FROM f GROUP BY ALL""",
    "findings_with_tests": f"WITH {_FINDINGS}, n AS (SELECT id, count(DISTINCT test_type) AS tests FROM f GROUP BY id) SELECT finding_type, tests::INT AS tests, count(*) AS findings FROM f JOIN n ON n.id = f.id GROUP BY ALL",
    "obligation_counts": "WITH m AS (" + " UNION ALL ".join(f"SELECT '{k}' AS obligation_type, doc_id, len(regexp_extract_all(text, '(?i){p}')) AS n FROM documents" for k, ps in A.OBLIGATIONS.items() for p in ps) + ") SELECT obligation_type, sum(n)::BIGINT AS matches, count(DISTINCT CASE WHEN n > 0 THEN doc_id END) AS documents FROM m GROUP BY obligation_type HAVING sum(n) > 0",
}
SQL["coverage_findings"] = f"SELECT CASE WHEN {_list(TYPES)}[i.item_id % 7 % 6 + 1] IN ('CONFIRMATION_REQUIRED', 'RETRIEVAL_INJECTION_GUARD') THEN 'CRITICAL' ELSE 'HIGH' END AS severity, c.obligation_id::VARCHAR AS subject FROM ({SQL['coverage_score']}) c JOIN eval_items i ON i.item_id = c.obligation_id WHERE status = 'missing'"
