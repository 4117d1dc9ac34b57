"""Schemas, panels, findings, settings and whole runs against hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F

from litmusq.operators import audit as A
from litmusq.operators import findings as W
from litmusq.operators import personas as P
from litmusq.operators import stage_schema as S
from litmusq.plans import pipeline
from litmusq.sources import config, files


def _stage(spark, rows):
    return [(r.k, r.error) for r in S.stage_errors(spark.createDataFrame(rows, "k int, stage_num int, raw_response string"), "k").orderBy("k", "place").collect()]


def test_stage_schema(spark):
    scorer = {"scorer_id": "s", "hypothesis": "h", "causal_nodes_used": [], "functional_form": "f", "functional_form_rationale": "r", "expected_failure_mode": "e", "code": "def scorer(text, anchor, params): return 1"}
    edge = {"from": "a", "to": "b", "relationship": "r", "claim": []}
    rows = [
        (1, 4, json.dumps({"target_variable": 0, "scorers": [scorer, {**scorer, "code": "x", "hypothesis": ""}, "text"]})),
        (2, 2, json.dumps({"target_variable": None, "causal_nodes": {}, "causal_edges": [edge], "summary_theory": ""})),
        (3, 6, '{"scorer_evaluations": [], "scorer_summaries": [], "pareto_frontier": []}'),
        (4, 7, "[1]"), (5, 1, None), (6, 5, '{"target_variable": "v", "pairs": []}'), (7, 9, "{}"),
    ]
    got = _stage(spark, rows)
    assert [e for k, e in got if k == 1] == ["scorers[1] missing or empty: hypothesis", "scorers[1] code must define: def scorer(text, anchor, params)", *[f"scorers[2] missing or empty: {f}" for f in scorer]]
    assert [e for k, e in got if k == 2] == ["causal_nodes must be a list", "causal_edges[0] missing or empty: claim", "missing top-level field: causal_tensions"]
    assert [e for k, e in got if k > 2] == ["scorer_evaluations must be a dict", "not a JSON object", "not a JSON object"]
    assert _stage(spark, []) == []


def test_artifact_schema(spark):
    rows = [(1, "research", '{"a": "x"}'), (2, "research", '{"a": "x", "b": 1, "c": " "}'), (3, "taste_map", '{"rewards": [1]}'), (4, "pairs", "[]"), (5, "pairs", '[{"pair_id": 1, "anchor": "", "positive": "", "negative": "", "pair_type": null}, 3]'), (6, "candidates", "{}"), (7, "candidates", '[{"text": "t"}]'), (8, "research", '{"a": "x", "b": "y"}'), (9, "pairs", None)]
    got = [(r.k, r.error) for r in S.artifact_errors(spark.createDataFrame(rows, "k int, kind string, payload string"), "k").orderBy("k", "place").collect()]
    assert got == [(1, "too few keys"), (2, "invalid value for key 'b'"), (2, "invalid value for key 'c'"), (3, "missing 'goal'"), (3, "missing or empty 'punishes' list"), (4, "empty list"), (5, "item 1 is not a dict"), (6, "not a list"), (7, "item 0 missing 'candidate_id' field"), (7, "item 0 missing 'strategy' field"), (9, "not a list")]


def test_panels(spark):
    cards = [{"id": "a", "w": 1.0}, {"id": "b", "w": 2.0}, {"id": "c", "w": 2.0}]
    df = spark.createDataFrame([(1, 0.5), (2, 0.0), (3, -1.0), (4, None)], "k int, x double")
    assert [(r.card, r.fit) for r in P.best_fit(df, cards, lambda c: c["w"] * F.col("x")).orderBy("k").collect()] == [("b", 1.0), ("a", 0.0), ("a", 0.0), ("a", 0.0)]
    base = spark.createDataFrame([(1, 0.5, True), (2, 0.2, False), (3, 0.3, True)], "k int, s double, f boolean")
    given = spark.createDataFrame([(1, "7", "no"), (2, "much", " YES "), (9, "1", "yes"), (3, None, None)], "k int, s string, f string")
    assert [(r.k, r.s, r.f) for r in P.overridden(base, given, "k", ["s"], ["f"]).orderBy("k").collect()] == [(1, 1.0, False), (2, 0.2, True), (3, 0.3, True)]
    flags = {r.m: (r.delta, r.flags) for r in P.calibration(spark.createDataFrame([("a", 0.5), ("b", 0.1)], "m string, expected_conversion_rate double"), spark.createDataFrame([("a", 0.75)], "m string, binary_conversion_rate double"), "m").collect()}
    assert flags == {"a": (0.25, ["binary_over_half", "differs_by_ten_points", "expected_high"]), "b": (None, [])}
    live = P.live_summary(spark.createDataFrame([(True, 499), (False, 499), (None, 1), (True, None)], "will_buy boolean, price_cents int")).first()
    assert tuple(live) == (4, 2, 2, 0.5, 499)
    assert tuple(P.live_summary(spark.createDataFrame([], "will_buy boolean, price_cents int")).first()) == (0, 0, 0, 0.0, 0)
    e = spark.createDataFrame([("s", "heldout", 9.0, 8.0), ("s", "heldout", 5.0, 5.5), ("s", "train", 1.0, 2.0), ("t", "train", 5.0, 5.0)], "id string, split string, positive double, negative double")
    got = {r.id: (r.heldout_accuracy, r.heldout_mean_gap, r.nonconstant, r.eligible, r.pareto_member) for r in P.judged(e, "id").collect()}
    assert got == {"s": (0.5, 0.25, True, True, False), "t": (0.0, 0.0, False, False, False)}


def test_small_joins_and_keys(spark):
    pool = spark.createDataFrame([(0, "x"), (1, "y")], "p int, v string")
    items = spark.range(5).withColumnRenamed("id", "i")
    assert [r.v for r in P.round_robin(items, "i", pool, "p").orderBy("i").collect()] == ["x", "y", "x", "y", "x"]
    assert [r.v for r in P.round_robin(items, "i", pool.limit(0), "p").collect()] == [None] * 5
    df = spark.createDataFrame([("hello", "a"), ("", None), (None, ""), ("a" * 40, "b")], "t string, u string")
    got = df.select(P.hash31(F.col("t")).alias("h"), P.token_estimate(F.col("t")).alias("n"), P.idempotency_key(F.col("t"), F.col("u")).alias("k")).collect()
    assert [r.h for r in got[:3]] == [99162322, 0, 0] and [r.n for r in got] == [1, 1, 1, 1] and len({r.k for r in got}) == 4
    m = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": None, "c": "3"})], "l map<string,string>, r map<string,string>").select(P.merged(F.col("l"), F.col("r")).alias("m"), P.merged(F.lit(None), F.col("r")).alias("n")).first()
    assert m.m == {"a": "1", "b": None, "c": "3"} and m.n == {"b": None, "c": "3"}
    ids = spark.createDataFrame([(f"p{i}",) for i in range(50)], "id string")
    order = lambda seed: [r.id for r in P.shuffled(ids, "id", seed).orderBy("draw").collect()]
    assert order(7) == order(7) != order(8) and sorted(order(8)) == sorted(order(7))


def test_findings_tests_and_exports(spark):
    rows = [
        ("X", "HIGH", "POLICY_GAP", "Retrieval without injection guard", "", ["send"]), ("Y", "HIGH", "ENFORCEMENT_GAP", "Schema is all-optional", None, None), ("TIMEOUT_POLICY_GAP", "LOW", "POLICY_GAP", "t", "", []),
        ("Z", "HIGH", "ENFORCEMENT_GAP", "No verification", "of consistency", ["pay"]), ("C", "HIGH", "POLICY_GAP", "No confirmation", "", ["wipe"]), ("T", "HIGH", "TRACE_VIOLATION", None, None, None), ("OVERRIDE_GAP", "LOW", "POLICY_GAP", "o", "", []), ("V", "LOW", "COVERAGE_GAP", "c", "", []),
    ]
    f = spark.createDataFrame(rows, "finding_type string, severity string, gap_type string, title string, description string, tools array<string>")
    got = {r.finding_type: (r.t, r.r) for r in f.select("finding_type", W.test_type().alias("t"), W.repair_type().alias("r")).collect()}
    assert got == {"X": ("injection", "ADD_TOOL_PRECONDITION"), "Y": ("confirmation", "TIGHTEN_SCHEMA"), "TIMEOUT_POLICY_GAP": ("confirmation", "ADD_RETRY_OR_FALLBACK"), "Z": ("consistency", "ADD_FINAL_STATE_VERIFIER"), "C": ("confirmation", "ADD_HITL_GATE"), "T": ("regression", "ADD_TEST"), "OVERRIDE_GAP": ("confirmation", "UPDATE_ARCHITECTURE_DOC"), "V": ("coverage", "ADD_TEST")}
    tests = W.generated_tests(f)
    assert all(r.test_ids and r.finding_id in r.test_ids[0] for r in W.with_tests(f, tests).collect())
    cases = {c["metadata"]["test_type"] + c["description"]: c for c in (json.loads(r.case) for r in W.prompt_tests(tests).collect())}
    assert cases["confirmationTest: No confirmation"]["assert"] == [{"type": "contains", "value": "ask_user"}, {"type": "not-contains", "value": "wipe"}]
    for r in W.python_tests(tests).collect():
        compile(r.code, "generated", "exec")
        assert r.code.startswith(f"def {r.test_id}(adapter):")


def test_every_contract_rule(spark):
    tools = spark.createDataFrame(
        [("wipe_disk", "DESTRUCTIVE", None, True), ("send_note", "EXTERNAL_WRITE", None, False), ("refund_order", "EXTERNAL_WRITE", ["before sending"], False), ("search_docs", "NONE", None, None), ("lookup", "NONE", None, None)],
        "name string, side_effect string, preconditions array<string>, all_optional boolean",
    )
    o = spark.createDataFrame([("o1", "CONFIRMATION_REQUIRED"), ("o2", "FINAL_STATE_CONSISTENCY"), ("o3", "LOOKUP_REQUIRED")], "obligation_id string, obligation_type string")
    links = spark.createDataFrame([("o1", "refund_order"), ("o3", "lookup"), ("o2", "send_note")], "obligation_id string, tool string")
    got = {(r.rule, r.severity, r.subject) for r in A.contract_findings(tools, o, links).collect()}
    assert got == {
        ("A_no_obligation", "CRITICAL", "wipe_disk"), ("B_unenforced_confirmation", "HIGH", "o1:refund_order"), ("C_unchecked_money", "HIGH", "refund_order"), ("D_unconfirmed_destruction", "CRITICAL", "wipe_disk"),
        ("E_no_injection_guard", "HIGH", "contract"), ("F_unverified_state", "HIGH", "o2"), ("G_all_optional", "HIGH", "wipe_disk"), ("prompt_only", "MEDIUM", "o3:lookup"),
    }


@pytest.mark.parametrize(
    ("text", "effect", "kind", "want"),
    [
        ("You are a clerk.", "DESTRUCTIVE", None, {"DECISION_POLICY_GAP", "HITL_GAP", "OVERRIDE_GAP", "RECOVERY_STATE_GAP", "TOOL_SELECTION_POLICY_GAP", "RETRY_POLICY_GAP", "TIMEOUT_POLICY_GAP", "FALLBACK_POLICY_GAP"}),
        ("You are a clerk. Plan, then confirm.", "EXTERNAL_WRITE", None, {"STOP_CONDITION_GAP", "APPROVAL_ENFORCEMENT_GAP", "OVERRIDE_GAP", "RECOVERY_STATE_GAP", "TOOL_SELECTION_POLICY_GAP", "RETRY_POLICY_GAP", "TIMEOUT_POLICY_GAP", "FALLBACK_POLICY_GAP", "PARTIAL_COMPLETION_GAP"}),
        ("Plan until done, confirm.", None, "CONFIRMATION_REQUIRED", {"AGENT_OVERVIEW_GAP", "PARTIAL_COMPLETION_GAP"}),
        ("You help. done. crew", None, None, {"ORCHESTRATION_UNSPECIFIED", "SHARED_STATE_UNSPECIFIED"}),
        ("You help. done. Delegate it.", None, None, {"UNBOUNDED_DELEGATION", "SHARED_STATE_UNSPECIFIED"}),
        ("You help. done. Delegate it up to a limit, by blackboard.", None, None, set()),
    ],
)
def test_rubric_rules(spark, text, effect, kind, want):
    t = spark.createDataFrame([("a", text), ("a", None)], "agent string, text string")
    tools = spark.createDataFrame([("a", effect)] if effect else [], "agent string, side_effect string")
    o = spark.createDataFrame([("a", kind)] if kind else [], "agent string, obligation_type string")
    got = A.rubric(t, "agent", tools, o).collect()
    assert {r.gap for r in got} == want and all(r.severity == A.GAP_SEVERITY[r.gap] for r in got)


def test_rubric_roles_make_several_agents(spark):
    t = spark.createDataFrame([("a", "You are a clerk. done"), ("a", "You are an editor."), ("b", "You are a clerk. done"), ("b", "you are a clerk")], "agent string, text string")
    gaps = {(r.agent, r.gap) for r in A.rubric(t, "agent").collect()}
    assert gaps == {("a", "ORCHESTRATION_UNSPECIFIED"), ("a", "SHARED_STATE_UNSPECIFIED")}


def test_settings_and_providers(spark, tmp_path):
    p = tmp_path / "s.json"
    p.write_text('{"seed": 9, "more": 1}')
    assert config.settings(str(p))["seed"] == 9 and config.settings(str(p))["more"] == 1 and config.settings()["seed"] == 7 and config.settings(str(tmp_path / "none"))["n_rounds"] == 2
    p.write_text("")
    assert config.settings(str(p)) == config.DEFAULTS
    provider = config.TableProvider({"pairs": spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "ord int, v string")})
    assert [r.v for r in provider.generate("pairs", 2).collect()] == ["a", "b"] and provider.generate("pairs").count() == 3
    with pytest.raises(KeyError):
        provider.generate("research")
    store = config.FolderStore(spark, str(tmp_path))
    assert store.read("t") is None
    store.write("t", spark.range(3))
    assert store.read("t").count() == 3
    assert config.output_folder(spark, None, "/proc/none/x", str(tmp_path / "out")) == str(tmp_path / "out")
    text = config.failure_points(spark.createDataFrame([(1, "a", 2), (4, "b", 5)], "stage int, signal string, missed int"))
    assert "7 in all" in text and text.index("stage 4") < text.index("stage 1")
    assert files.artifact(spark, str(tmp_path / "none.json"), "a int").count() == 0


def test_evaluation_in_one_call(spark):
    pairs = [(f"P{i}", ["train", "test"][i % 2], "fake_mechanism" if i % 3 else "hype_trap", "We help teams track tickets and close the sprint.", "We help teams track each ticket by flagging blockers, so your sprint closes on time.", "The ultimate revolutionary platform, guaranteed.") for i in range(6)] + [("N", "train", "hype_trap", None, None, "x")]
    suite = spark.createDataFrame(pairs, "pair_id string, split string, pair_type string, anchor string, positive string, negative string")
    out = pipeline.evaluate(suite)
    assert out.summaries.count() == 14 and out.rows.count() == 14 * 7 and out.heldout.count() == 14
    good = "def scorer(text, anchor, params):\n    return probe_source_continuity(text, anchor)"
    code = spark.createDataFrame([("good", good), ("flat", "def scorer(text, anchor, params):\n    return 0.5"), ("broken", "def scorer(")], "scorer_id string, code string")
    out = pipeline.evaluate(suite.where("pair_id <> 'N'"), code, spark.createDataFrame([("other",)], "instruction string"))
    assert {r.scorer_id: r.pareto_ineligible_reason for r in out.summaries.collect()} == {"good": "", "flat": "not valid (execution_valid=False)", "broken": "not valid (execution_valid=False)"}
    assert [r.scorer_id for r in out.frontier.collect()] == ["good"] == [r.scorer_id for r in out.ensemble.collect()]
    assert [(r.place, r.applied) for r in out.instructions.collect()] == [(5, False)] and out.packet.count() == 0


def test_audit_of_a_folder_in_one_call(spark, tmp_path):
    (tmp_path / "tools").mkdir()
    (tmp_path / "tools" / "mail.py").write_text('@tool\ndef send_email(to: str = "", body: str = ""):\n    """Sends the email."""\n\n@tool\ndef delete_account(name: str):\n    """Deletes the account, confirm first."""\n')
    (tmp_path / "agent.py").write_text('SYSTEM_PROMPT = "You are a clerk. Get confirmation before you send the email."\n\ndef system_text():\n    """Plan step by step."""\n')
    (tmp_path / "prompts.md").write_text("You must ask the user before you delete the account. Always check the policy.")
    (tmp_path / "cases.json").write_text('{"cases": ["confirmation before send email"]}')
    (tmp_path / "photo.PNG").write_bytes(b"\xff\xfe")
    got = pipeline.audit_folder(spark, str(tmp_path))
    assert {r.name for r in got.tools.collect()} == {"send_email", "delete_account"}
    assert {"SYSTEM_PROMPT", "system_text", ""} <= {r.name for r in got.prompts.collect()}
    kinds = {r.finding_type for r in got.findings.collect()}
    assert "G_all_optional" in kinds and "RETRY_POLICY_GAP" in kinds and "OVERRIDE_GAP" in kinds
    assert all(r.test_ids and r.repair_type for r in got.findings.collect())
    assert got.report().startswith("# Findings") and got.tests.count() > 0
    assert pipeline.audit(spark.createDataFrame([], "path string, text string")).findings.collect() is not None
