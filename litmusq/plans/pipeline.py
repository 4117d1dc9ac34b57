"""Whole runs in one call: evaluating scorers over a suite, and auditing a folder of an agent."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmusq.functions import usercode
from litmusq.functions.scorers import cross_evaluate
from litmusq.operators import audit as A
from litmusq.operators import evaluation as E
from litmusq.operators import findings as W
from litmusq.plans.lineage import materialise
from litmusq.sources import files, sinks


@dataclass(frozen=True)
class Evaluation:
    """What evaluating gives; every table is lazy but ``rows``."""

    rows: DataFrame
    summaries: DataFrame
    by_pair_type: DataFrame
    frontier: DataFrame
    ensemble: DataFrame
    packet: DataFrame
    instructions: DataFrame
    heldout: DataFrame


def _as_facts(rows: DataFrame) -> DataFrame:
    e = rows.withColumn("eval_id", F.xxhash64("pair_id", "scorer_id")).withColumn("failed", F.coalesce("pos_err", "neg_err").isNotNull())
    return e.withColumn("p", F.coalesce("pos_score", F.lit(0.5))).withColumn("n", F.coalesce("neg_score", F.lit(0.5))).withColumn("gap", F.col("p") - F.col("n")).withColumn("right", F.col("p") > F.col("n"))


def code_rows(pairs: DataFrame, scorers: DataFrame) -> DataFrame:
    """Every trusted scorer (scorer_id, code) over every pair, as rows of an evaluation; scorers are a stated, small set."""
    both = pairs.select("pair_id", "split", "pair_type", "anchor", "positive", "negative").crossJoin(F.broadcast(scorers.select("scorer_id", "code")))
    done = both
    for side, field in (("pos", "positive"), ("neg", "negative")):
        done = usercode.run(done, "code", field, "anchor").withColumnsRenamed({"value": f"{side}_score", "error": f"{side}_err"}).drop("ok", "raw_value", "out_of_range")
    return done.drop("code", "anchor", "positive", "negative")


def evaluate(pairs: DataFrame, scorers: DataFrame | None = None, prior: DataFrame | None = None) -> Evaluation:
    """Evaluates the built-in scorers, or trusted code (scorer_id, code), over pairs (pair_id, split, pair_type, anchor, positive, negative).

    Train pairs are the validation pairs; ``prior`` (instruction) are the
    instructions that were applied before.
    """
    spark = pairs.sparkSession
    rows = materialise(_as_facts(cross_evaluate(pairs) if scorers is None else code_rows(pairs, scorers)), "evaluation")
    summaries = E.eligibility(E.validity(E.summaries(rows), E.validation(rows.where("split = 'train'"))))
    front = E.frontier(summaries)
    counts = E.failure_counts(rows, front)
    before = prior if prior is not None else spark.createDataFrame([], "instruction string")
    return Evaluation(rows, summaries, E.by_pair_type(rows), front, E.ensemble_members(front), E.failure_packet(rows, front), E.mutation_instructions(counts, front, before), E.heldout_aggregates(rows))


@dataclass(frozen=True)
class Audit:
    """What auditing a folder gives."""

    classified: DataFrame
    prompts: DataFrame
    tools: DataFrame
    obligations: DataFrame
    coverage: DataFrame
    findings: DataFrame
    tests: DataFrame

    def report(self, limit: int = 200) -> str:
        return sinks.report(self.findings.withColumn("subject", F.col("title")), limit)


#: Kind of gap of each contract rule.
RULE_GAPS = {"A_no_obligation": "POLICY_GAP", "E_no_injection_guard": "POLICY_GAP", "D_unconfirmed_destruction": "POLICY_GAP"}


def audit(texts: DataFrame) -> Audit:
    """Audits the files (path, text) of one agent: categories, prompts, tools, obligations, links, rules, rubric, coverage, tests."""
    classified = materialise(texts.withColumn("categories", A.file_categories(F.col("path"), F.col("text"))), "classified")
    prompts = materialise(A.extract_prompts(classified.where(F.array_contains("categories", "PROMPT") | F.array_contains("categories", "POLICY"))), "prompts")
    found = A.extract_tools(classified).dropDuplicates(["name"])
    optional = F.when(F.size("parameters") > 0, F.forall("parameters", lambda p: ~p["required"]))
    tools = materialise(found.withColumn("side_effect", A.side_effect(F.col("name"), F.col("description"))).withColumn("all_optional", optional), "tools")
    obligations = materialise(A.extract_obligations(prompts.select("path", F.col("prompt").alias("text"))).dropDuplicates(["obligation_id"]), "obligations")
    links = A.link(obligations, tools)
    tests_of = classified.where(F.array_contains("categories", "EVAL")).select("path", F.col("text").alias("content"))
    covered = A.coverage(obligations, tests_of)
    rules = A.contract_findings(tools, obligations.select("obligation_id", "obligation_type"), links.select("obligation_id", "tool"))
    gap = F.lit("ENFORCEMENT_GAP")
    for rule, kind in RULE_GAPS.items():
        gap = F.when(F.col("rule") == rule, kind).otherwise(gap)
    one = rules.select(F.col("rule").alias("finding_type"), "severity", gap.alias("gap_type"), F.concat_ws(" ", "rule", "subject").alias("title"))
    agent = F.lit("agent").alias("agent")
    gaps = A.rubric(prompts.select(agent, F.col("prompt").alias("text")), "agent", tools.select(agent, "side_effect"), obligations.select(agent, "obligation_type"))
    two = gaps.select(F.col("gap").alias("finding_type"), "severity", F.lit("POLICY_GAP").alias("gap_type"), F.col("gap").alias("title"))
    three = A.coverage_findings(covered, obligations).select("finding_type", "severity", F.lit("COVERAGE_GAP").alias("gap_type"), F.concat_ws(" ", F.lit("no test covers"), "subject").alias("title"))
    findings = materialise(one.unionByName(two).unionByName(three).withColumn("description", F.lit("")), "findings")
    tests = W.generated_tests(findings)
    findings = W.with_tests(findings, tests).withColumn("repair_type", W.repair_type())
    return Audit(classified, prompts, tools, obligations, covered, findings, tests)


def audit_folder(spark: SparkSession, folder: str) -> Audit:
    """Scans a folder and audits what is in it."""
    return audit(files.scan(spark, folder).select("path", "text"))
