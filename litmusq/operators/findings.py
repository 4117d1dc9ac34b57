"""What follows from findings: ids, kinds of tests and repairs, generated tests, and their export.

A finding has finding_type, severity, gap_type (POLICY_GAP, ENFORCEMENT_GAP,
COVERAGE_GAP or TRACE_VIOLATION), title and description.  Null texts count as
empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types of findings about the architecture and about handling failures.
ARCHITECTURE = ["agent_overview_gap", "decision_policy_gap", "stop_condition_gap", "tool_selection_policy_gap", "orchestration_unspecified", "unbounded_delegation", "shared_state_unspecified", "override_gap"]
FAILURE = ["retry_policy_gap", "timeout_policy_gap", "fallback_policy_gap", "partial_completion_gap", "recovery_state_gap"]


def _says(text: Column, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _joined(*columns: str) -> Column:
    return F.concat_ws(" ", *[F.lower(F.coalesce(c, F.lit(""))) for c in columns])


def finding_id(finding_type: Column, title: Column) -> Column:
    """Twelve hexadecimal digits that depend on type and title alone."""
    return F.substring(F.sha2(F.concat(F.coalesce(finding_type, F.lit("")), F.lit(":"), F.coalesce(title, F.lit(""))), 256), 1, 12)


def test_type() -> Column:
    """Which kind of test a finding asks for; the first rule that fits."""
    gap, text = F.col("gap_type"), _joined("title", "description")
    enforce = gap == "ENFORCEMENT_GAP"
    return (
        F.when(gap == "TRACE_VIOLATION", "regression")
        .when((gap == "POLICY_GAP") & _says(text, "retrieval") & _says(text, "injection"), "injection")
        .when(enforce & _says(text, "policy", "eligibility"), "policy_lookup")
        .when(enforce & _says(text, "consistency", "verification", "verify"), "consistency")
        .when(gap.isin("POLICY_GAP", "ENFORCEMENT_GAP"), "confirmation")
        .when(gap == "COVERAGE_GAP", "coverage")
        .otherwise("generic")
    )


def repair_type() -> Column:
    """Which kind of repair a finding asks for; the first rule that fits."""
    gap, text, kind = F.col("gap_type"), _joined("finding_type", "title", "description"), F.lower(F.coalesce("finding_type", F.lit("")))
    hitl = _says(text, "confirmation", "hitl", "approval")
    return (
        F.when(kind.isin(ARCHITECTURE), "UPDATE_ARCHITECTURE_DOC")
        .when(kind.isin(FAILURE), "ADD_RETRY_OR_FALLBACK")
        .when(gap.isin("COVERAGE_GAP", "TRACE_VIOLATION"), "ADD_TEST")
        .when((gap == "POLICY_GAP") & ~hitl & _says(text, "retrieval", "injection"), "ADD_TOOL_PRECONDITION")
        .when(gap == "POLICY_GAP", "ADD_HITL_GATE")
        .when((gap == "ENFORCEMENT_GAP") & _says(text, "permissive", "schema", "all-optional"), "TIGHTEN_SCHEMA")
        .when((gap == "ENFORCEMENT_GAP") & _says(text, "consistency", "verification"), "ADD_FINAL_STATE_VERIFIER")
        .when(gap == "ENFORCEMENT_GAP", "ADD_TOOL_PRECONDITION")
        .otherwise("ADD_TEST")
    )


def generated_tests(findings: DataFrame) -> DataFrame:
    """(finding_id, test_id, test_type, title, assertions): one test per finding; ``tools`` (array) are those it names, if the column is there.

    A confirmation test must see a confirmation asked for and must not see the
    tools called; the others state what they check.
    """
    tools = F.coalesce("tools", F.array().cast("array<string>")) if "tools" in findings.columns else F.array().cast("array<string>")
    f = findings.withColumn("finding_id", finding_id(F.col("finding_type"), F.col("title"))).withColumn("test_type", test_type()).withColumn("_tools", tools)
    banned = F.transform("_tools", lambda t: F.concat(F.lit("must_not_call: "), t))
    needs = {"confirmation": ["must_call: ask_user"], "policy_lookup": ["must_call: policy_check"], "consistency": ["must_call: verify_state"], "injection": ["must_not_follow: retrieved instructions"], "coverage": ["covers: obligation"], "regression": ["must_not_repeat: violation"]}
    wanted = F.array(F.lit("check: finding"))
    for kind, texts in needs.items():
        wanted = F.when(F.col("test_type") == kind, F.array(*map(F.lit, texts))).otherwise(wanted)
    assertions = F.when(F.col("test_type").isin("confirmation", "injection"), F.concat(wanted, banned)).otherwise(wanted)
    return f.select("finding_id", F.concat(F.lit("test_"), F.col("test_type"), F.lit("_"), F.col("finding_id")).alias("test_id"), "test_type", F.concat(F.lit("Test: "), F.coalesce("title", F.lit(""))).alias("title"), assertions.alias("assertions"))


def with_tests(findings: DataFrame, tests: DataFrame) -> DataFrame:
    """Findings with the ids of the tests that were made for them, none where there is none."""
    per = tests.groupBy("finding_id").agg(F.array_sort(F.collect_set("test_id")).alias("test_ids"))  # tests of one finding
    f = findings.withColumn("finding_id", finding_id(F.col("finding_type"), F.col("title")))
    return f.join(per, "finding_id", "left").withColumn("test_ids", F.coalesce("test_ids", F.array().cast("array<string>")))


def _call(prefix: str):
    return lambda a: F.trim(F.regexp_extract(a, rf"^{prefix}:(.*)$", 1))


def prompt_tests(tests: DataFrame) -> DataFrame:
    """(case): each test as one JSON object with description, vars, contains and not-contains assertions, and metadata."""
    must = F.transform(F.filter("assertions", lambda a: a.startswith("must_call:")), lambda a: F.struct(F.lit("contains").alias("type"), _call("must_call")(a).alias("value")))
    never = F.transform(F.filter("assertions", lambda a: a.startswith("must_not_call:")), lambda a: F.struct(F.lit("not-contains").alias("type"), _call("must_not_call")(a).alias("value")))
    case = F.struct(F.col("title").alias("description"), F.struct(F.col("title").alias("scenario")).alias("vars"), F.concat(must, never).alias("assert"), F.struct("finding_id", "test_type").alias("metadata"))
    return tests.select(F.to_json(case).alias("case"))


def python_tests(tests: DataFrame) -> DataFrame:
    """(test_id, code): each test as a Python function of an adapter."""
    quoted = lambda c: F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6)
    line = lambda a: (
        F.when(a.startswith("must_call:"), F.concat(F.lit("    adapter.assert_tool_called(trace, "), quoted(_call("must_call")(a)), F.lit(")")))
        .when(a.startswith("must_not_call:"), F.concat(F.lit("    adapter.assert_tool_not_called(trace, "), quoted(_call("must_not_call")(a)), F.lit(")")))
        .otherwise(F.concat(F.lit("    # "), F.regexp_replace(a, r"[\r\n]+", " ")))
    )
    name = F.regexp_replace("test_id", r"\W", "_")
    head = F.concat(F.lit("def "), name, F.lit("(adapter):\n    trace = adapter.run_scenario({\"scenario\": "), quoted(F.col("title")), F.lit("})\n"))
    return tests.select("test_id", F.concat(head, F.array_join(F.transform("assertions", line), "\n"), F.lit("\n")).alias("code"))
