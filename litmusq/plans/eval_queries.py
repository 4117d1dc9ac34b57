"""Queries of the scorer evaluation over eval_rows, scorer_hypotheses and adversarial_pairs, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litmusq.functions import policy
from litmusq.operators import evaluation as E
from litmusq.operators.skyline import skyline
from litmusq.plans.lineage import materialise
from litmusq.plans.probe_queries import HARD_SQL, TEXTS_SQL, pairs
from litmusq.sources.tables import table


#: Width of the ranges of eval_id within which rows are ordered at once.
RANGE = 10_000


def facts(spark: SparkSession, folder: str) -> DataFrame:
    return E.facts(table(spark, folder, "eval_rows"))


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    """Rounds doubles; a billionth is added first, so that exact halves go one way whatever order they were summed in."""
    return df.withColumns({c: F.round(F.col(c) + 1e-9, digits) for c, t in df.dtypes if t == "double"})


def _checked(e: DataFrame, *by: str) -> DataFrame:
    """Summaries with validity and eligibility; the validation pairs of a scorer are the train rows it was evaluated on."""
    return E.eligibility(E.validity(E.summaries(e, *by), E.validation(e.where("split = 'train'"), *by), *by))


def scorer_summary(spark: SparkSession, folder: str) -> DataFrame:
    s = _round(_checked(facts(spark, folder)))
    known = table(spark, folder, "scorer_hypotheses", "scorer_id", "lineage", "generation_round").dropDuplicates(["scorer_id"])
    return s.join(known, "scorer_id", "left").withColumn("lineage", F.coalesce("lineage", F.lit("initial")))


def eligibility_reason(spark: SparkSession, folder: str) -> DataFrame:
    """Every run evaluates a scorer anew."""
    return _checked(facts(spark, folder), "run_id").select("run_id", "scorer_id", "execution_valid", "pair_quality_valid", "pareto_eligible", "pareto_ineligible_reason")


def _frontier(e: DataFrame) -> DataFrame:
    return E.frontier(_checked(e, "run_id"), "run_id")


def pareto_frontier_5d(spark: SparkSession, folder: str) -> DataFrame:
    return _round(_frontier(facts(spark, folder)).select("run_id", "scorer_id", "rank", *E.FRONTIER_DIMS))


def pareto_frontier_2d(spark: SparkSession, folder: str) -> DataFrame:
    s = E.staged_eligibility(E.staged_summary(facts(spark, folder), "run_id"))
    return _round(E.undominated(s.where("eligible"), ["heldout_accuracy", "heldout_mean_gap"], "run_id").select("run_id", "scorer_id", "heldout_accuracy", "heldout_mean_gap"))


def supplier_skyline(spark: SparkSession, folder: str) -> DataFrame:
    """The same operator on a large fact table: suppliers nobody beats in quantity, revenue and discount."""
    per = table(spark, folder, "lineitem", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount").groupBy("l_suppkey")
    m = per.agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.round(F.avg("l_discount") + 1e-9, 6).alias("discount"))
    return skyline(m, ["quantity", "revenue", "discount"])


def _ensemble(spark: SparkSession, folder: str, packet: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The positives a run evaluated, judged by the ensemble members of its frontier; allowed without unsupported claims."""
    e, front = packet or _packet(spark, folder)
    members = E.ensemble_members(front).select("run_id", "scorer_id")
    scored = E.ensemble(e.join(members, ["run_id", "scorer_id"]), "pair_id", "scorer_id", "p", "run_id")
    ok = pairs(spark, folder).select("pair_id", (~policy.hard(F.col("positive"), F.col("anchor"))).alias("policy_ok"))
    return scored.join(ok, "pair_id")


def _packet(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The evaluation rows and the frontier of each run, each made once."""
    e = materialise(facts(spark, folder), "facts")
    return e, materialise(_frontier(e), "frontier")


def mutation_instructions(spark: SparkSession, folder: str, packet: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """What each run calls for; what the run before it (by run_id) called for has been applied."""
    e, front = packet or _packet(spark, folder)
    counts = E.failure_counts(e, front, "run_id")
    none = spark.createDataFrame([], "run_id string, instruction string")
    called = E.mutation_instructions(counts, front, none, "run_id")
    runs = front.select("run_id").distinct().withColumn("before", F.lag("run_id").over(Window.orderBy("run_id")))  # a row per run
    prior = runs.join(called.select(F.col("run_id").alias("before"), "instruction"), "before").select("run_id", "instruction")
    return E.mutation_instructions(counts, front, prior, "run_id").select("run_id", "place", "applied")


def _first_round(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "scorer_hypotheses", "scorer_id", "generation_round").where("generation_round = 0")


def repair_best_delta(spark: SparkSession, folder: str) -> DataFrame:
    return E.repair_deltas(facts(spark, folder), _first_round(spark, folder))


def repair_claim(spark: SparkSession, folder: str) -> DataFrame:
    """Judged on the frontiers of all runs together."""
    e, front = _packet(spark, folder)
    old = _first_round(spark, folder)
    return E.repair_claim(E.repair_deltas(e, old), front.select("scorer_id").distinct(), old)


def experiment_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Each run's best scorer by mean test margin, over all runs."""
    per = facts(spark, folder).where("split = 'test'").groupBy("run_id", "scorer_id").agg(F.avg("gap").alias("m"))
    best = per.groupBy("run_id").agg(F.max_by(F.struct("scorer_id", "m"), F.struct(F.round("m", 12), F.col("scorer_id"))).alias("b"))
    return _round(E.experiment_summary(best.select("run_id", "b.*"), "run_id", "scorer_id", "m"))


def batch_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """The best scorer of each pair type by mean gap on held-out rows."""
    per = facts(spark, folder).where("split IN ('test', 'heldout')").groupBy("pair_type", "scorer_id").agg(F.avg("gap").alias("gap"))
    best = per.groupBy("pair_type").agg(F.max_by(F.struct("scorer_id", "gap"), F.struct(F.round("gap", 12), F.col("scorer_id"))).alias("b"))
    return _round(best.select("pair_type", "b.*"))


def _context(spark: SparkSession, folder: str) -> DataFrame:
    """The criteria's values of all runs taken together; round 0 and 1 are those of the pairs and scorers."""
    h = table(spark, folder, "scorer_hypotheses", "scorer_id", "generation_round", "research_basis", "taste_map_basis", "expected_failure_mode")
    known = h.agg(
        F.count_distinct(F.get("research_basis", 0)).cast("double").alias("taste_research_present"), F.count_distinct(F.get("taste_map_basis", 0)).cast("double").alias("taste_map_rewards_present"), F.count_distinct("expected_failure_mode").cast("double").alias("taste_map_punishes_present"),
        F.count_if(F.col("generation_round") == 0).cast("double").alias("scorer_hypotheses_r0"), F.count_if(F.col("generation_round") == 1).cast("double").alias("repair_hypotheses_generated"),
    )
    e, front = packet = _packet(spark, folder)
    valid = E.validation(e.where("split = 'train'")).agg(F.count_if("valid").cast("double").alias("scorer_code_valid_r0"))
    first = lambda c: F.count_if(F.col("split").eqNullSafe("test") & c)
    p = pairs(spark, folder).join(table(spark, folder, "adversarial_pairs", "pair_id", "generation_round").groupBy("pair_id").agg(F.max("generation_round").alias("round")), "pair_id")
    suite = p.agg(
        F.count_if(policy.hard(F.col("positive"), F.col("anchor"))).cast("double").alias("pair_policy_violations"), first(F.col("round") == 0).cast("double").alias("initial_heldout_count"), first(F.lit(True)).cast("double").alias("final_heldout_count"),
        (first(F.lit(True)) > first(F.col("round") == 0)).alias("heldout_grew"), F.count_if(F.col("split") == "adversarial").cast("double").alias("adversarial_pairs_generated"), F.count_if(F.col("pair_type") == "fake_mechanism").cast("double").alias("fake_mechanism_pairs"),
    )
    told = front.agg((F.count(F.lit(1)) > 0).alias("pareto_r0_nonempty"), (F.count(F.lit(1)) > 0).alias("failure_packet_has_instructions"), (F.count_if(F.col("scorer_id").startswith("S_r1")) > 0).alias("pareto_r1_nonempty"))
    members = E.ensemble_members(front).agg((F.count(F.lit(1)) > 0).alias("eligible_ensemble_exists"))
    items = _ensemble(spark, folder, packet)
    chosen = items.agg(F.coalesce(F.bool_or("policy_ok"), F.lit(False)).alias("candidate_selected"), (F.min("ensemble_score") < 0.05).alias("hype_baseline_zeroed"), (F.max("ensemble_score") > 0.05).alias("c002_not_zeroed"))
    repeated = mutation_instructions(spark, folder, packet).agg(F.coalesce(F.bool_or(~F.col("applied")), F.lit(False)).alias("mutation_instructions_not_all_repeated"))
    out = known
    for part in (valid, suite, told, members, chosen, repeated):
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out


def criteria_status(spark: SparkSession, folder: str) -> DataFrame:
    return E.criteria(_context(spark, folder))


def trap_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return pairs(spark, folder).groupBy("split", "pair_type").agg(F.count(F.lit(1)).alias("pairs"))


def suite_union(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of a grown suite: train, then adversarial, then test and heldout, by origin."""
    p = pairs(spark, folder)
    parts = [p.where(F.col("split") == s).select(F.lit(i).alias("place"), F.lit(s).alias("part"), "pair_id") for i, s in enumerate(("train", "adversarial", "test", "heldout"))]
    suite = parts[0]
    for part in parts[1:]:
        suite = suite.unionByName(part)
    return suite.groupBy("place", "part").agg(F.count(F.lit(1)).alias("pairs"), F.min("pair_id").alias("first_id"))


def new_scorers(spark: SparkSession, folder: str) -> DataFrame:
    """Scorers of the repair round that the first round didn't have, and whether they were evaluated."""
    h = table(spark, folder, "scorer_hypotheses", "scorer_id", "generation_round")
    new = h.where("generation_round = 1").join(h.where("generation_round = 0").select("scorer_id"), "scorer_id", "left_anti")
    seen = facts(spark, folder).select("scorer_id").distinct().withColumn("evaluated", F.lit(True))
    return new.join(seen, "scorer_id", "left").select("scorer_id", F.coalesce("evaluated", F.lit(False)).alias("evaluated"))


def positional_split(spark: SparkSession, folder: str) -> DataFrame:
    """The last fifth of each run's rows, in order of eval_id, is held out.

    The place of a row is that within its range of ids plus the rows of the
    ranges before, so no run is sorted in one task.
    """
    e = facts(spark, folder).select("run_id", "eval_id").withColumn("range", F.floor(F.col("eval_id") / RANGE))
    ranges = e.groupBy("run_id", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("run_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range of ids
    ranges = ranges.withColumn("before", before).withColumn("rows", F.sum("n").over(Window.partitionBy("run_id")))
    last = ranges.withColumn("held", F.floor(F.col("rows") / 5)).withColumn("place", F.col("rows") - F.col("held")).where("place > before AND place <= before + n")
    within = e.join(last.select("run_id", "range", "rows", "held", (F.col("place") - F.col("before")).alias("k")), ["run_id", "range"])
    return within.groupBy("run_id", "rows", "held", "k").agg(F.sort_array(F.collect_list("eval_id")).alias("ids")).select("run_id", "rows", "held", F.element_at("ids", F.col("k").cast("int")).alias("last_train_id"))


def round_trip_id_split(spark: SparkSession, folder: str) -> DataFrame:
    """Splits told from id prefixes."""
    pid = F.col("pair_id")
    side = F.when(pid.startswith("R0_T") | pid.startswith("R1_T"), "test").when(pid.startswith("R1_A") | pid.startswith("R0_A"), "adversarial").otherwise("train")
    return pairs(spark, folder).select(side.alias("by_id"), "split").groupBy("by_id", "split").agg(F.count(F.lit(1)).alias("pairs"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scorer_summary": scorer_summary,
    "pair_type_accuracy": lambda s, d: _round(E.by_pair_type(facts(s, d))),
    "robustness_warnings": lambda s, d: E.robustness(facts(s, d)).select("scorer_id", "robustness_warning", F.size("pair_type_accuracy").alias("types")),
    "eligibility_reason": eligibility_reason,
    "pareto_frontier_5d": pareto_frontier_5d,
    "pareto_frontier_2d": pareto_frontier_2d,
    "supplier_skyline": supplier_skyline,
    "staged_summary": lambda s, d: _round(E.staged_eligibility(E.staged_summary(facts(s, d), "run_id"))),
    "failure_packet_counts": lambda s, d: E.failure_counts(*_packet(s, d), "run_id"),
    "failure_packet_rows": lambda s, d: E.failure_packet(*_packet(s, d), "run_id"),
    "heldout_aggregates": lambda s, d: E.heldout_aggregates(facts(s, d), "run_id").select("run_id", "scorer_id", "accuracy", "margin", F.aggregate(F.map_values("failures_by_type"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("failures")),
    "mutation_instructions": mutation_instructions,
    "score_collapse": lambda s, d: E.score_collapse(E.summaries(facts(s, d), "run_id"), "run_id"),
    "repair_best_delta": repair_best_delta,
    "repair_claim": repair_claim,
    "ensemble_members": lambda s, d: E.ensemble_members(_frontier(facts(s, d))).select("run_id", "scorer_id", "rank"),
    "ensemble_scores": lambda s, d: _round(_ensemble(s, d)),
    "candidate_selected": lambda s, d: _round(E.selected(_ensemble(s, d), "pair_id", "run_id")),
    "survived_because": lambda s, d: E.survivors(E.summaries(facts(s, d)), ["train_accuracy", "train_margin", "test_accuracy", "test_margin", "score_spread"]),
    "experiment_summary": experiment_summary,
    "batch_comparison": batch_comparison,
    "criteria_status": criteria_status,
    "criteria_counts": lambda s, d: E.criteria_counts(criteria_status(s, d)),
    "smoke_validation": lambda s, d: _round(E.validation(facts(s, d), "run_id")),
    "trap_distribution": trap_distribution,
    "suite_union": suite_union,
    "new_scorers": new_scorers,
    "positional_split": positional_split,
    "id_prefix_split": round_trip_id_split,
}

_E = """e AS (SELECT *, regexp_replace(lower(split), '[^a-z]', '', 'g') AS sp, coalesce(pos_err, neg_err) IS NOT NULL AS failed,
coalesce(pos_score, 0.5) AS p, coalesce(neg_score, 0.5) AS n FROM eval_rows WHERE eval_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY eval_id ORDER BY ingested_at DESC, evaluated_at DESC) = 1)"""


def _summaries_sql(by: str) -> str:
    """s: summaries; v: validation on train rows; k: both with tiers and the first reason; by is '' or 'run_id, '."""
    return f"""{_E}, s AS (SELECT {by}scorer_id, count(*) AS rows, coalesce(avg((p > n)::INT) FILTER (sp = 'train'), 0) AS train_accuracy, coalesce(avg(p - n) FILTER (sp = 'train'), 0) AS train_margin,
coalesce(avg((p > n)::INT) FILTER (sp = 'test'), 0) AS test_accuracy, coalesce(avg(p - n) FILTER (sp = 'test'), 0) AS test_margin,
avg((p > n)::INT) FILTER (sp = 'adversarial') AS adversarial_accuracy, avg(p - n) FILTER (sp = 'adversarial') AS adversarial_margin,
max(greatest(p, n)) - min(least(p, n)) AS score_spread, avg(failed::INT) AS exec_error_rate FROM e GROUP BY ALL),
{_validation_sql("v", by, "WHERE sp = 'train'")},
k0 AS (SELECT s.*, coalesce(v.reason = 'ok', false) AS execution_valid, coalesce(v.reason = 'ok' AND v.accuracy >= 0.5 AND v.margin > 0, false) AS pair_quality_valid FROM s LEFT JOIN v ON v.scorer_id = s.scorer_id{" AND v.run_id = s.run_id" if by else ""}),
k AS (SELECT *, CASE WHEN NOT execution_valid THEN 'not valid (execution_valid=False)' WHEN exec_error_rate > 0 THEN 'exec errors' WHEN score_spread < 0.02 THEN 'score spread too low (<0.02)' WHEN train_margin <= 0 THEN 'train margin <= 0'
        WHEN test_margin <= 0 THEN 'test margin <= 0' WHEN train_accuracy < 0.5 THEN 'train accuracy < 0.5' WHEN test_accuracy < 0.5 THEN 'test accuracy < 0.5' ELSE '' END AS pareto_ineligible_reason, pareto_ineligible_reason = '' AS pareto_eligible FROM k0)"""


def _validation_sql(name: str, by: str, where: str) -> str:
    return f"""{name} AS (SELECT {by}scorer_id, coalesce(arg_min(bad, eval_id) FILTER (bad IS NOT NULL), CASE WHEN max(greatest(p, n)) - min(least(p, n)) < 0.001 THEN 'constant_pair_outputs' END, 'ok') AS reason, count(bad) > 0 AS broken,
CASE WHEN count(bad) = 0 THEN avg((p > n)::INT) ELSE 0 END AS accuracy, CASE WHEN count(bad) = 0 THEN avg(p - n) ELSE 0 END AS margin, CASE WHEN count(bad) = 0 THEN max(greatest(p, n)) - min(least(p, n)) ELSE 0 END AS spread
FROM (SELECT *, CASE WHEN failed THEN 'runtime_error' WHEN least(p, n) < -0.01 OR greatest(p, n) > 1.01 THEN 'out_of_range' END AS bad FROM e {where}) GROUP BY ALL)"""


_PAIRS = "q AS (SELECT *, regexp_replace(lower(split), '[^a-z]', '', 'g') AS sp FROM adversarial_pairs WHERE pair_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY ingested_at DESC, ord DESC) = 1)"
_DIMS = ["test_accuracy", "test_margin", "train_accuracy", "train_margin", "score_spread"]


def _dominates(dims: list[str]) -> str:
    return "(" + " AND ".join(f"b.{d} >= a.{d}" for d in dims) + " AND (" + " OR ".join(f"b.{d} > a.{d}" for d in dims) + "))"


_ALL, _RUNS = _summaries_sql(""), _summaries_sql("run_id, ")
_FRONT = f"""{_RUNS}, front AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY test_margin DESC, test_accuracy DESC, train_margin DESC, scorer_id) AS rank FROM k a WHERE pareto_eligible AND NOT EXISTS (SELECT 1 FROM k b WHERE b.pareto_eligible AND b.run_id = a.run_id AND {_dominates(_DIMS)}))"""
_MEMBERS = f"""{_FRONT}, mem AS (SELECT run_id, scorer_id, rank FROM front WHERE execution_valid AND test_margin > 0 AND test_accuracy >= 0.5 AND score_spread >= 0.02)"""
_ENSEMBLE = f"""{_MEMBERS}, ml AS (SELECT e.run_id, e.scorer_id, e.pair_id, e.p AS sc FROM e JOIN mem ON mem.run_id = e.run_id AND mem.scorer_id = e.scorer_id), mm AS (SELECT *, min(sc) OVER w AS lo, max(sc) OVER w AS hi FROM ml WINDOW w AS (PARTITION BY run_id, scorer_id)),
en0 AS (SELECT run_id, pair_id, avg((sc - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END) AS ensemble_score, avg(sc) AS raw_mean FROM mm GROUP BY ALL),
hp AS (WITH {TEXTS_SQL} SELECT pair_id, {HARD_SQL} AS bad FROM c WHERE field = 'positive'),
en AS (SELECT en0.*, NOT hp.bad AS policy_ok FROM en0 JOIN hp ON hp.pair_id = en0.pair_id)"""
_CALLED = """cnt AS (SELECT e.run_id, pair_type, count(*) FILTER (sp = 'train' AND NOT p > n) AS failed, count(*) FILTER (sp = 'train' AND p > n AND p - n < 0.04) AS low_margin,
        count(*) FILTER (sp = 'test' AND NOT p > n) AS heldout_failed FROM e JOIN front ON front.run_id = e.run_id AND front.scorer_id = e.scorer_id AND rank <= 3 GROUP BY ALL),
fl AS (SELECT run_id, coalesce(sum(failed) FILTER (pair_type = 'fake_mechanism'), 0) AS fake, coalesce(sum(failed) FILTER (pair_type = 'subtle_quality_gap'), 0) AS subtle, coalesce(sum(failed) FILTER (pair_type = 'hype_trap'), 0) AS hype FROM cnt GROUP BY run_id),
fr AS (SELECT f.run_id, spread, coalesce(fake, 0) AS fake, coalesce(subtle, 0) AS subtle, coalesce(hype, 0) AS hype FROM (SELECT run_id, min(score_spread) AS spread FROM front GROUP BY run_id) f LEFT JOIN fl ON fl.run_id = f.run_id),
called AS (SELECT run_id, 1 AS place FROM fr WHERE fake > 0 UNION ALL SELECT run_id, 2 FROM fr WHERE subtle > 1 UNION ALL SELECT run_id, 3 FROM fr WHERE hype > 0 UNION ALL SELECT run_id, 4 FROM fr WHERE spread < 0.1 UNION ALL SELECT run_id, 5 FROM fr),
lg AS (SELECT run_id, lag(run_id) OVER (ORDER BY run_id) AS prev FROM fr),
mut AS (SELECT called.run_id, called.place, EXISTS (SELECT 1 FROM lg JOIN called o ON o.run_id = lg.prev WHERE lg.run_id = called.run_id AND o.place = called.place) AS applied FROM called)"""
_REPAIR = """per AS (SELECT subset, scorer_id, avg(p - n) AS margin, avg((p > n)::INT) AS accuracy, scorer_id NOT IN (SELECT scorer_id FROM scorer_hypotheses WHERE generation_round = 0) AS new FROM (
        SELECT 'common_heldout' AS subset, * FROM e WHERE sp = 'test' AND NOT starts_with(pair_id, 'R1_') UNION ALL SELECT 'new_heldout', * FROM e WHERE sp = 'test' AND starts_with(pair_id, 'R1_')
        UNION ALL SELECT 'adversarial_train', * FROM e WHERE sp = 'adversarial' UNION ALL SELECT 'final_heldout', * FROM e WHERE sp = 'test') GROUP BY ALL),
bm AS (SELECT * FROM per QUALIFY row_number() OVER (PARTITION BY subset, new ORDER BY round(margin, 12) DESC, scorer_id) = 1), ba AS (SELECT * FROM per QUALIFY row_number() OVER (PARTITION BY subset, new ORDER BY round(accuracy, 12) DESC, scorer_id) = 1),
rep AS (SELECT z.subset, om.scorer_id AS best_old_by_margin, round(coalesce(om.margin, 0), 4) AS best_old_margin_value, nm.scorer_id AS best_new_by_margin, round(coalesce(nm.margin, 0), 4) AS best_new_margin_value, round(coalesce(nm.margin, 0) - coalesce(om.margin, 0), 4) AS margin_delta,
        oa.scorer_id AS best_old_by_accuracy, round(coalesce(oa.accuracy, 0), 4) AS best_old_accuracy_value, na.scorer_id AS best_new_by_accuracy, round(coalesce(na.accuracy, 0), 4) AS best_new_accuracy_value, round(coalesce(na.accuracy, 0) - coalesce(oa.accuracy, 0), 4) AS accuracy_delta
        FROM (VALUES ('common_heldout'), ('new_heldout'), ('adversarial_train'), ('final_heldout')) z(subset) LEFT JOIN bm om ON om.subset = z.subset AND NOT om.new LEFT JOIN bm nm ON nm.subset = z.subset AND nm.new
        LEFT JOIN ba oa ON oa.subset = z.subset AND NOT oa.new LEFT JOIN ba na ON na.subset = z.subset AND na.new)"""
_ROUNDED = ", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in ("train_accuracy", "train_margin", "test_accuracy", "test_margin", "adversarial_accuracy", "adversarial_margin", "score_spread", "exec_error_rate"))
_STAGED = f"""{_E}, g0 AS (SELECT run_id, scorer_id, avg((p > n)::INT) FILTER (NOT failed AND sp = 'train') AS train_accuracy, avg(p - n) FILTER (NOT failed AND sp = 'train') AS train_mean_gap,
avg((p > n)::INT) FILTER (NOT failed AND sp = 'heldout') AS heldout_accuracy, avg(p - n) FILTER (NOT failed AND sp = 'heldout') AS heldout_mean_gap,
coalesce(max(greatest(p, n)) FILTER (NOT failed) - min(least(p, n)) FILTER (NOT failed), 0) AS score_spread, avg(failed::INT) AS exec_error_rate,
CASE WHEN len(list_distinct(list_concat(coalesce(list(round(p, 10)) FILTER (NOT failed), []), coalesce(list(round(n, 10)) FILTER (NOT failed), [])))) >= 2 THEN 1.0 ELSE 0.0 END AS nonconstant_rate FROM e GROUP BY ALL),
g AS (SELECT *, CASE WHEN exec_error_rate <> 0 THEN 'exec_error_rate > 0' WHEN nonconstant_rate <= 0 THEN 'constant output' WHEN score_spread < 0.02 THEN 'score_spread < 0.02' WHEN heldout_accuracy IS NULL OR heldout_accuracy < 0.5 THEN 'heldout_accuracy < 0.50'
WHEN heldout_mean_gap IS NULL OR heldout_mean_gap <= 0 THEN 'heldout_mean_gap <= 0' ELSE 'eligible' END AS eligibility_reason FROM g0)"""
_CONTEXT = """ctx AS (SELECT (SELECT count(DISTINCT research_basis[1]) FROM scorer_hypotheses)::DOUBLE AS taste_research_present, (SELECT count(DISTINCT taste_map_basis[1]) FROM scorer_hypotheses)::DOUBLE AS taste_map_rewards_present,
    (SELECT count(DISTINCT expected_failure_mode) FROM scorer_hypotheses)::DOUBLE AS taste_map_punishes_present, (SELECT count(*) FROM scorer_hypotheses WHERE generation_round = 0)::DOUBLE AS scorer_hypotheses_r0, (SELECT count(*) FROM scorer_hypotheses WHERE generation_round = 1)::DOUBLE AS repair_hypotheses_generated,
    (SELECT count(*) FROM va WHERE reason = 'ok')::DOUBLE AS scorer_code_valid_r0, (SELECT count(*) FROM hp WHERE bad)::DOUBLE AS pair_policy_violations,
    (SELECT count(*) FROM q WHERE sp = 'test' AND generation_round = 0)::DOUBLE AS initial_heldout_count, (SELECT count(*) FROM q WHERE sp = 'test')::DOUBLE AS final_heldout_count, (SELECT count(*) > count(*) FILTER (generation_round = 0) FROM q WHERE sp = 'test') AS heldout_grew,
    (SELECT count(*) FROM q WHERE sp = 'adversarial')::DOUBLE AS adversarial_pairs_generated, (SELECT count(*) FROM q WHERE pair_type = 'fake_mechanism')::DOUBLE AS fake_mechanism_pairs, EXISTS (SELECT 1 FROM front) AS pareto_r0_nonempty, EXISTS (SELECT 1 FROM front) AS failure_packet_has_instructions,
    EXISTS (SELECT 1 FROM front WHERE starts_with(scorer_id, 'S_r1')) AS pareto_r1_nonempty, EXISTS (SELECT 1 FROM mem) AS eligible_ensemble_exists, EXISTS (SELECT 1 FROM en WHERE policy_ok) AS candidate_selected, (SELECT min(ensemble_score) < 0.05 FROM en) AS hype_baseline_zeroed,
    (SELECT max(ensemble_score) > 0.05 FROM en) AS c002_not_zeroed, EXISTS (SELECT 1 FROM mut WHERE NOT applied) AS mutation_instructions_not_all_repeated)"""


_TRAIN_ONLY = "WHERE sp = 'train'"


def _criteria_sql() -> str:
    rows = []
    for i, (name, threshold, warn) in enumerate(E.CRITERIA):
        met = f"{name} = {threshold}" if isinstance(threshold, bool) else f"{name} >= {threshold}"
        rows.append(f"SELECT {i + 1} AS place, '{name}' AS criterion, {name}::DOUBLE AS computed_value, '{threshold}' AS threshold, CASE WHEN {met} THEN 'pass' ELSE '{'warning' if warn else 'fail'}' END AS status FROM ctx")
    return f"WITH {_ENSEMBLE}, {_CALLED}, {_PAIRS}, {_validation_sql('va', '', _TRAIN_ONLY)}, {_CONTEXT} {' UNION ALL '.join(rows)}"


SQL: dict[str, str] = {
    "scorer_summary": f"""WITH {_ALL} SELECT k.scorer_id, rows, {_ROUNDED}, execution_valid, pair_quality_valid, pareto_ineligible_reason, pareto_eligible, coalesce(h.lineage, 'initial') AS lineage, h.generation_round
        FROM k LEFT JOIN scorer_hypotheses h ON h.scorer_id = k.scorer_id""",
    "pair_type_accuracy": f"WITH {_E} SELECT scorer_id, pair_type, count(*) AS rows, round(avg((p > n)::INT) + 1e-9, 6) AS accuracy, avg((p > n)::INT) < 0.45 AS weak FROM e GROUP BY ALL",
    "robustness_warnings": f"""WITH {_E}, t AS (SELECT scorer_id, pair_type, avg((p > n)::INT) AS a FROM e GROUP BY ALL)
        SELECT scorer_id, coalesce(string_agg(pair_type, ',' ORDER BY pair_type) FILTER (a < 0.45), '') AS robustness_warning, count(*)::INT AS types FROM t GROUP BY scorer_id""",
    "eligibility_reason": f"WITH {_RUNS} SELECT run_id, scorer_id, execution_valid, pair_quality_valid, pareto_eligible, pareto_ineligible_reason FROM k",
    "pareto_frontier_5d": f"WITH {_FRONT} SELECT run_id, scorer_id, rank::INT AS rank, {', '.join(f'round({d} + 1e-9, 6) AS {d}' for d in _DIMS)} FROM front",
    "pareto_frontier_2d": f"""WITH {_STAGED} SELECT run_id, scorer_id, round(heldout_accuracy + 1e-9, 6) AS heldout_accuracy, round(heldout_mean_gap + 1e-9, 6) AS heldout_mean_gap FROM g a WHERE eligibility_reason = 'eligible'
        AND NOT EXISTS (SELECT 1 FROM g b WHERE b.eligibility_reason = 'eligible' AND b.run_id = a.run_id AND {_dominates(["heldout_accuracy", "heldout_mean_gap"])})""",
    "supplier_skyline": f"""WITH m AS (SELECT l_suppkey, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 2) AS revenue, round(avg(l_discount) + 1e-9, 6) AS discount FROM lineitem GROUP BY l_suppkey)
        SELECT * FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE {_dominates(["quantity", "revenue", "discount"])})""",
    "staged_summary": f"""WITH {_STAGED} SELECT run_id, scorer_id, {", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in ("train_accuracy", "train_mean_gap", "heldout_accuracy", "heldout_mean_gap", "score_spread", "exec_error_rate", "nonconstant_rate"))},
        eligibility_reason, eligibility_reason = 'eligible' AS eligible FROM g""",
    "failure_packet_counts": f"WITH {_FRONT}, {_CALLED} SELECT * FROM cnt",
    "failure_packet_rows": f"""WITH {_FRONT}, f AS (SELECT e.run_id, CASE WHEN NOT p > n THEN 'failed' WHEN p - n < 0.04 THEN 'low_margin' END AS kind, front.rank, e.scorer_id, eval_id, pair_id, pair_type, p, n FROM e JOIN front ON front.run_id = e.run_id AND front.scorer_id = e.scorer_id AND front.rank <= 3 WHERE sp = 'train'),
        o AS (SELECT *, row_number() OVER (PARTITION BY run_id, kind ORDER BY rank, eval_id) AS place FROM f WHERE kind IS NOT NULL)
        SELECT run_id, kind, place::INT AS place, rank::INT AS rank, scorer_id, eval_id, pair_id, pair_type, CASE WHEN kind = 'failed' THEN round(p, 3) END AS pos, CASE WHEN kind = 'failed' THEN round(n, 3) END AS neg, round(p - n, 3) AS margin
        FROM o WHERE place <= CASE WHEN kind = 'failed' THEN 8 ELSE 6 END""",
    "heldout_aggregates": f"""WITH {_E} SELECT run_id, scorer_id, round(avg((p > n)::INT), 3) AS accuracy, round(avg(p - n) + 1e-12, 3) AS margin, count(*) FILTER (NOT p > n) AS failures FROM e WHERE sp = 'test' GROUP BY ALL""",
    "mutation_instructions": f"WITH {_FRONT}, {_CALLED} SELECT run_id, place, applied FROM mut",
    "score_collapse": f"WITH {_RUNS} SELECT run_id, scorer_id, round(score_spread, 3) AS score_spread FROM s WHERE score_spread < 0.05",
    "repair_best_delta": f"WITH {_E}, {_REPAIR} SELECT * FROM rep",
    "repair_claim": f"""WITH {_FRONT}, {_REPAIR}, m AS (SELECT count(DISTINCT scorer_id) AS members, count(DISTINCT CASE WHEN scorer_id NOT IN (SELECT scorer_id FROM scorer_hypotheses WHERE generation_round = 0) THEN scorer_id END) AS fresh FROM front)
        SELECT fresh > 0 AS new_scorer_enters_pareto, margin_delta > 0 AS beats_old_best_margin, accuracy_delta > 0 AS beats_old_best_accuracy, round(fresh / greatest(1, members), 4) AS share_of_eligible_ensemble,
        fresh > 0 AND (margin_delta > 0 OR accuracy_delta > 0) AS overall_improvement_claim_supported FROM m, rep WHERE subset = 'final_heldout'""",
    "ensemble_members": f"WITH {_MEMBERS} SELECT run_id, scorer_id, rank::INT AS rank FROM mem",
    "ensemble_scores": f"WITH {_ENSEMBLE} SELECT run_id, pair_id, round(ensemble_score + 1e-9, 6) AS ensemble_score, round(raw_mean + 1e-9, 6) AS raw_mean, policy_ok FROM en",
    "candidate_selected": f"""WITH {_ENSEMBLE}, ct AS (SELECT run_id, count(*) AS allowed FROM en WHERE policy_ok GROUP BY run_id)
        SELECT en.run_id, pair_id, round(ensemble_score + 1e-9, 6) AS ensemble_score, allowed FROM en JOIN ct ON ct.run_id = en.run_id WHERE policy_ok QUALIFY row_number() OVER (PARTITION BY en.run_id ORDER BY round(ensemble_score, 9) DESC, pair_id) = 1""",
    "survived_because": f"""WITH {_ALL} SELECT scorer_id, array_to_string(list_filter([{", ".join(f"CASE WHEN abs({m} - max({m}) OVER ()) <= 0.001 THEN '{m}' END" for m in ("train_accuracy", "train_margin", "test_accuracy", "test_margin", "score_spread"))}], lambda x: x IS NOT NULL), ',') AS survived_because FROM s""",
    "experiment_summary": f"""WITH {_E}, per AS (SELECT run_id, scorer_id, avg(p - n) AS m FROM e WHERE sp = 'test' GROUP BY ALL), b AS (SELECT * FROM per QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY round(m, 12) DESC, scorer_id DESC) = 1),
        w AS (SELECT scorer_id FROM b GROUP BY scorer_id ORDER BY count(*) DESC, scorer_id LIMIT 1)
        SELECT count(*) AS runs, round(avg(m) + 1e-9, 6) AS mean, round(coalesce(stddev_samp(m), 0) + 1e-9, 6) AS std, round(min(m) + 1e-9, 6) AS least, round(max(m) + 1e-9, 6) AS most, bool_and(m > 0) AS all_positive, (SELECT scorer_id FROM w) AS mode_winner FROM b""",
    "batch_comparison": f"""WITH {_E}, per AS (SELECT pair_type, scorer_id, avg(p - n) AS gap FROM e WHERE sp IN ('test', 'heldout') GROUP BY ALL)
        SELECT pair_type, scorer_id, round(gap + 1e-9, 6) AS gap FROM per QUALIFY row_number() OVER (PARTITION BY pair_type ORDER BY round(gap, 12) DESC, scorer_id DESC) = 1""",
    "criteria_status": _criteria_sql(),
    "criteria_counts": f"SELECT count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'warning') AS warned, count(*) FILTER (status = 'fail') AS failed FROM ({_criteria_sql()})",
    "smoke_validation": f"""WITH {_E}, {_validation_sql("va", "run_id, ", "")} SELECT run_id, scorer_id, reason = 'ok' AS valid, reason, round(accuracy + 1e-9, 6) AS validation_accuracy, round(margin + 1e-9, 6) AS validation_margin, round(spread + 1e-9, 6) AS validation_spread FROM va""",
    "trap_distribution": f"WITH {_PAIRS} SELECT sp AS split, pair_type, count(*) AS pairs FROM q GROUP BY ALL",
    "suite_union": f"""WITH {_PAIRS}, u AS ({" UNION ALL ".join(f"SELECT {i} AS place, '{s}' AS part, pair_id FROM q WHERE sp = '{s}'" for i, s in enumerate(("train", "adversarial", "test", "heldout")))})
        SELECT place, part, count(*) AS pairs, min(pair_id) AS first_id FROM u GROUP BY ALL""",
    "new_scorers": f"""WITH {_E} SELECT scorer_id, scorer_id IN (SELECT scorer_id FROM e) AS evaluated FROM scorer_hypotheses h WHERE generation_round = 1
        AND NOT EXISTS (SELECT 1 FROM scorer_hypotheses o WHERE o.generation_round = 0 AND o.scorer_id = h.scorer_id)""",
    "positional_split": f"""WITH {_E}, r AS (SELECT run_id, eval_id, row_number() OVER (PARTITION BY run_id ORDER BY eval_id) AS k, count(*) OVER (PARTITION BY run_id) AS c FROM e)
        SELECT run_id, c AS rows, c // 5 AS held, max(eval_id) FILTER (k = c - c // 5) AS last_train_id FROM r GROUP BY ALL""",
    "id_prefix_split": f"""WITH {_PAIRS} SELECT CASE WHEN starts_with(pair_id, 'R0_T') OR starts_with(pair_id, 'R1_T') THEN 'test' WHEN starts_with(pair_id, 'R0_A') OR starts_with(pair_id, 'R1_A') THEN 'adversarial' ELSE 'train' END AS by_id,
        sp AS split, count(*) AS pairs FROM q GROUP BY ALL""",
}
