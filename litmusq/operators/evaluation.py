"""Scorer evaluation: summaries, eligibility, frontiers, packets, repair, ensembles, criteria.

Evaluation rows are a flat fact table (scorer_id, pair_id, split, pair_type,
pos_score, neg_score, pos_err, neg_err).  Two policies for failed scorings exist
and differ: a summary counts a failed side as 0.5, the staged summary leaves the
row out.  Empty groups give what each function says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litmusq.operators.skyline import skyline

FRONTIER_DIMS = ["test_accuracy", "test_margin", "train_accuracy", "train_margin", "score_spread"]


def facts(rows: DataFrame) -> DataFrame:
    """One row per eval_id (latest delivery), split names normalised, failed sides as 0.5."""
    one = rows.where(F.col("eval_id").isNotNull()).groupBy("eval_id").agg(F.max_by(F.struct("scorer_id", "pair_id", "split", "pair_type", "pos_score", "neg_score", "pos_err", "neg_err", "run_id"), F.struct("ingested_at", "evaluated_at")).alias("r"))
    e = one.select("eval_id", "r.*").withColumn("split", F.regexp_replace(F.lower("split"), "[^a-z]", ""))
    e = e.withColumn("failed", F.coalesce("pos_err", "neg_err").isNotNull())
    return e.withColumn("p", F.coalesce("pos_score", F.lit(0.5))).withColumn("n", F.coalesce("neg_score", F.lit(0.5))).withColumn("gap", F.col("p") - F.col("n")).withColumn("right", F.col("p") > F.col("n"))


def _share(condition: Column, of: Column) -> Column:
    return F.avg(F.when(of, condition.cast("double")))


def summaries(e: DataFrame, *by: str) -> DataFrame:
    """Per scorer (within ``by``): accuracy and mean margin by split (0 without rows, null for adversarial), spread, error rate."""
    train, test, adv = (F.col("split") == s for s in ("train", "test", "adversarial"))
    return e.groupBy(*by, "scorer_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(_share(F.col("right"), train), F.lit(0.0)).alias("train_accuracy"),
        F.coalesce(F.avg(F.when(train, F.col("gap"))), F.lit(0.0)).alias("train_margin"),
        F.coalesce(_share(F.col("right"), test), F.lit(0.0)).alias("test_accuracy"),
        F.coalesce(F.avg(F.when(test, F.col("gap"))), F.lit(0.0)).alias("test_margin"),
        _share(F.col("right"), adv).alias("adversarial_accuracy"),
        F.avg(F.when(adv, F.col("gap"))).alias("adversarial_margin"),
        (F.max(F.greatest("p", "n")) - F.min(F.least("p", "n"))).alias("score_spread"),
        F.avg(F.col("failed").cast("double")).alias("exec_error_rate"),
    )


def by_pair_type(e: DataFrame) -> DataFrame:
    """Accuracy of each scorer on each pair type; weak below 0.45."""
    return e.groupBy("scorer_id", "pair_type").agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col("right").cast("double")).alias("accuracy")).withColumn("weak", F.col("accuracy") < 0.45)


def robustness(e: DataFrame) -> DataFrame:
    """(scorer_id, pair_type_accuracy map, robustness_warning): the weak types, in order of name."""
    per = by_pair_type(e)
    return per.groupBy("scorer_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("pair_type", "accuracy")))).alias("pair_type_accuracy"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("weak"), F.col("pair_type")))), ",").alias("robustness_warning"),
    )


def validation(e: DataFrame, *by: str) -> DataFrame:
    """Does a scorer work on its validation pairs?  (valid, reason, validation_accuracy, validation_margin, validation_spread).

    The first failed or out-of-range row, in order of eval_id, decides and
    leaves no accuracy, margin or spread (0); a scorer that gives all texts the
    same is invalid too but keeps its figures.
    """
    bad = F.when(F.col("failed"), "runtime_error").when((F.least("p", "n") < -0.01) | (F.greatest("p", "n") > 1.01), "out_of_range")
    per = e.withColumn("bad", bad).groupBy(*by, "scorer_id").agg(
        F.min_by("bad", F.when(F.col("bad").isNotNull(), F.col("eval_id"))).alias("first_bad"),
        F.avg(F.col("right").cast("double")).alias("accuracy"),
        F.avg("gap").alias("margin"),
        (F.max(F.greatest("p", "n")) - F.min(F.least("p", "n"))).alias("spread"),
    )
    reason = F.coalesce(F.col("first_bad"), F.when(F.col("spread") < 0.001, "constant_pair_outputs"), F.lit("ok"))
    kept = [F.when(F.col("first_bad").isNull(), F.col(c)).otherwise(0.0).alias(f"validation_{c}") for c in ("accuracy", "margin", "spread")]
    return per.select(*by, "scorer_id", (reason == "ok").alias("valid"), reason.alias("reason"), *kept)


def validity(s: DataFrame, checked: DataFrame, *by: str) -> DataFrame:
    """Tiers by the validation of each scorer: it works; it also gets at least half of the pairs right with a positive margin.

    A scorer that was not validated doesn't work.
    """
    known = s.join(checked.select(*by, "scorer_id", "valid", "validation_accuracy", "validation_margin"), [*by, "scorer_id"], "left")
    works = F.coalesce("valid", F.lit(False))
    good = works & (F.col("validation_accuracy") >= 0.5) & (F.col("validation_margin") > 0)
    return known.withColumn("execution_valid", works).withColumn("pair_quality_valid", F.coalesce(good, F.lit(False))).drop("valid", "validation_accuracy", "validation_margin")


def eligibility(s: DataFrame) -> DataFrame:
    """pareto_eligible and the first reason against it, in a fixed order."""
    reason = (
        F.when(~F.coalesce("execution_valid", F.lit(False)), "not valid (execution_valid=False)")
        .when(F.coalesce("exec_error_rate", F.lit(1.0)) > 0, "exec errors")
        .when(F.coalesce("score_spread", F.lit(0.0)) < 0.02, "score spread too low (<0.02)")
        .when(F.coalesce("train_margin", F.lit(0.0)) <= 0, "train margin <= 0")
        .when(F.coalesce("test_margin", F.lit(0.0)) <= 0, "test margin <= 0")
        .when(F.coalesce("train_accuracy", F.lit(0.0)) < 0.5, "train accuracy < 0.5")
        .when(F.coalesce("test_accuracy", F.lit(0.0)) < 0.5, "test accuracy < 0.5")
        .otherwise("")
    )
    return s.withColumn("pareto_ineligible_reason", reason).withColumn("pareto_eligible", F.col("pareto_ineligible_reason") == "")


def undominated(s: DataFrame, dims: list[str], *by: str) -> DataFrame:
    """The rows no row of the same ``by`` beats; groups are the scorers of one run, so the join stays small."""
    a, b = s.alias("a"), s.select(*[F.col(c).alias(f"_{c}") for c in (*by, *dims)]).alias("b")
    beaten = F.lit(True)
    for c in by:
        beaten = beaten & (F.col(f"a.{c}") == F.col(f"b._{c}"))
    better = F.lit(False)
    for d in dims:
        beaten = beaten & (F.col(f"b._{d}") >= F.col(f"a.{d}"))
        better = better | (F.col(f"b._{d}") > F.col(f"a.{d}"))
    return a.join(b, beaten & better, "left_anti")


def frontier(s: DataFrame, *by: str) -> DataFrame:
    """Undominated eligible scorers (within ``by``) with their rank: best test margin, test accuracy, train margin; ties by id."""
    allowed = s.where("pareto_eligible")
    front = undominated(allowed, FRONTIER_DIMS, *by) if by else skyline(allowed, FRONTIER_DIMS)
    order = Window.partitionBy(*by).orderBy(F.desc("test_margin"), F.desc("test_accuracy"), F.desc("train_margin"), "scorer_id")
    return front.withColumn("rank", F.row_number().over(order))


def ensemble_members(front: DataFrame) -> DataFrame:
    """The scorers of a frontier that may judge candidates: they work, win on test rows, are right on half and spread."""
    good = F.coalesce("execution_valid", F.lit(False)) & (F.col("test_margin") > 0) & (F.col("test_accuracy") >= 0.5) & (F.col("score_spread") >= 0.02)
    return front.where(good)


def staged_summary(e: DataFrame, *by: str) -> DataFrame:
    """Per scorer without failed rows: accuracy and gap by split, null on an empty split; spread, share of failures, does it vary?

    It varies if it gives at least two different scores, of either side, at ten digits.
    """
    ok = ~F.col("failed")
    train, held = ok & (F.col("split") == "train"), ok & (F.col("split") == "heldout")
    top, low = F.max(F.when(ok, F.greatest("p", "n"))), F.min(F.when(ok, F.least("p", "n")))
    return e.groupBy(*by, "scorer_id").agg(
        _share(F.col("gap") > 0, train).alias("train_accuracy"),
        F.avg(F.when(train, F.col("gap"))).alias("train_mean_gap"),
        _share(F.col("gap") > 0, held).alias("heldout_accuracy"),
        F.avg(F.when(held, F.col("gap"))).alias("heldout_mean_gap"),
        F.coalesce(top - low, F.lit(0.0)).alias("score_spread"),
        F.avg(F.col("failed").cast("double")).alias("exec_error_rate"),
        F.coalesce(F.round(top, 10) > F.round(low, 10), F.lit(False)).cast("double").alias("nonconstant_rate"),
    )


def staged_eligibility(s: DataFrame) -> DataFrame:
    reason = (
        F.when(F.col("exec_error_rate") != 0, "exec_error_rate > 0")
        .when(F.col("nonconstant_rate") <= 0, "constant output")
        .when(F.col("score_spread") < 0.02, "score_spread < 0.02")
        .when(F.col("heldout_accuracy").isNull() | (F.col("heldout_accuracy") < 0.5), "heldout_accuracy < 0.50")
        .when(F.col("heldout_mean_gap").isNull() | (F.col("heldout_mean_gap") <= 0), "heldout_mean_gap <= 0")
        .otherwise("eligible")
    )
    return s.withColumn("eligibility_reason", reason).withColumn("eligible", F.col("eligibility_reason") == "eligible")


def _of_best(e: DataFrame, front: DataFrame, top: int, *by: str) -> DataFrame:
    """The rows of the ``top`` best scorers of each frontier, with their rank."""
    return e.join(front.where(F.col("rank") <= top).select(*by, "scorer_id", "rank"), [*by, "scorer_id"])


def failure_counts(e: DataFrame, front: DataFrame, *by: str, top: int = 3) -> DataFrame:
    """Failed and low-margin training rows, and failed test rows, of the best scorers by pair type."""
    train, test = F.col("split") == "train", F.col("split") == "test"
    return _of_best(e, front, top, *by).groupBy(*by, "pair_type").agg(
        F.count_if(train & ~F.col("right")).alias("failed"),
        F.count_if(train & F.col("right") & (F.col("gap") < 0.04)).alias("low_margin"),
        F.count_if(test & ~F.col("right")).alias("heldout_failed"),
    )


def failure_packet(e: DataFrame, front: DataFrame, *by: str, top: int = 3, failed: int = 8, low: int = 6) -> DataFrame:
    """The first failed and the first low-margin training rows of the best scorers together, by rank and then eval_id.

    A window keeps at most the first rows of a group (kind, and ``by``), so a hot group sorts little.
    """
    rows = _of_best(e.where(F.col("split") == "train"), front, top, *by)
    kind = F.when(~F.col("right"), "failed").when((F.col("gap") > 0) & (F.col("gap") < 0.04), "low_margin")
    rows = rows.withColumn("kind", kind).where("kind IS NOT NULL")
    place = F.row_number().over(Window.partitionBy(*by, "kind").orderBy("rank", "eval_id"))
    shown = rows.withColumn("place", place).where(F.col("place") <= F.when(F.col("kind") == "failed", failed).otherwise(low))
    side = lambda c: F.round(F.when(F.col("kind") == "failed", F.col(c)), 3)
    return shown.select(*by, "kind", "place", "rank", "scorer_id", "eval_id", "pair_id", "pair_type", side("p").alias("pos"), side("n").alias("neg"), F.round("gap", 3).alias("margin"))


def heldout_aggregates(e: DataFrame, *by: str) -> DataFrame:
    """Per scorer with test rows: accuracy and margin at three digits, and failures by pair type; no texts, no pair ids."""
    test = e.where("split = 'test'")
    one = test.groupBy(*by, "scorer_id", "pair_type").agg(F.count(F.lit(1)).alias("rows"), F.count_if("right").alias("right"), F.sum("gap").alias("gap"))
    return one.groupBy(*by, "scorer_id").agg(
        F.round(F.sum("right") / F.sum("rows"), 3).alias("accuracy"),
        F.round(F.sum("gap") / F.sum("rows") + 1e-12, 3).alias("margin"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("pair_type", F.lit("")), F.col("rows") - F.col("right"))))).alias("failures_by_type"),
    )


def score_collapse(s: DataFrame, *by: str) -> DataFrame:
    """Scorers whose scores hardly differ."""
    return s.where(F.col("score_spread") < 0.05).select(*by, "scorer_id", F.round("score_spread", 3).alias("score_spread"))


#: The instructions that follow from failures, in order.
INSTRUCTIONS = [
    "Do not reward causal markers unless followed by concrete action/object terms — detect fake mechanism explicitly.",
    "Add argument_progression × real_mechanism_quality product scorer — surface vs argument distinction.",
    "Ensure persuasion_risk veto fires before continuity weighting reduces score to non-zero.",
    "Loosen source continuity floor — soft gate may be squashing spread on legitimate rephrases.",
    "Recombine best scorer structures: try argument_progression * real_mechanism_quality as primary signal.",
]


def mutation_instructions(counts: DataFrame, front: DataFrame, prior: DataFrame, *by: str) -> DataFrame:
    """(by, place, instruction, applied): what the failures call for; applied if ``prior`` (by, instruction) has it already.

    ``counts`` are those of ``failure_counts``.  A frontier without failures
    still calls for the last one; so does a ``by`` without a frontier.
    """
    of = lambda t: F.coalesce(F.sum(F.when(F.col("pair_type") == t, F.col("failed"))), F.lit(0))
    fails = counts.groupBy(*by).agg(of("fake_mechanism").alias("fake"), of("subtle_quality_gap").alias("subtle"), of("hype_trap").alias("hype"))
    spread = front.groupBy(*by).agg(F.min("score_spread").alias("spread"))
    both = spread.join(fails, list(by), "left") if by else spread.crossJoin(F.broadcast(fails))  # one row each
    called = [F.col("fake") > 0, F.col("subtle") > 1, F.col("hype") > 0, F.col("spread") < 0.1, F.lit(True)]
    cells = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(i + 1).alias("place"), F.lit(t).alias("instruction"))) for i, (c, t) in enumerate(zip(called, INSTRUCTIONS))]))
    rows = both.select(*by, F.explode(cells).alias("x")).select(*by, "x.*")
    known = prior.select(*by, "instruction").distinct().withColumn("applied", F.lit(True))
    return rows.join(known, [*by, "instruction"], "left").select(*by, "place", "instruction", F.coalesce("applied", F.lit(False)).alias("applied"))


#: The subsets of pairs on which old and new scorers are compared, as conditions on split and pair_id.
SUBSETS = {
    "common_heldout": "split = 'test' AND NOT startswith(pair_id, 'R1_')",
    "new_heldout": "split = 'test' AND startswith(pair_id, 'R1_')",
    "adversarial_train": "split = 'adversarial'",
    "final_heldout": "split = 'test'",
}


def repair_deltas(e: DataFrame, old: DataFrame) -> DataFrame:
    """Per subset the best old and best new scorer, by margin and by accuracy on their own, and what was gained.

    ``old`` names the scorers (scorer_id) of the round before; all others are
    new.  Values have four decimals; a cohort without rows counts 0 and has no
    best scorer; ties go to the smaller id.  A subset without rows still has a row.
    """
    known = old.select("scorer_id").distinct().withColumn("was", F.lit(True))
    member = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(name)) for name, c in SUBSETS.items()]))
    rows = e.select("scorer_id", "gap", "right", F.explode(member).alias("subset"))
    per = rows.groupBy("subset", "scorer_id").agg(F.avg("gap").alias("margin"), F.avg(F.col("right").cast("double")).alias("accuracy")).join(known, "scorer_id", "left")
    cells = []
    for cohort, of in (("old", F.col("was")), ("new", F.col("was").isNull())):
        for m in ("margin", "accuracy"):
            # the greatest value, then the smallest id
            best = F.min_by(F.struct("scorer_id", m), F.when(of, F.struct(-F.round(m, 12), F.col("scorer_id"))))
            cells.append(best.alias(f"{cohort}_{m}"))
    names = e.sparkSession.createDataFrame([(n,) for n in SUBSETS], "subset string")
    wide = names.join(per.groupBy("subset").agg(*cells), "subset", "left")
    value = lambda c, m: F.round(F.coalesce(F.col(f"{c}_{m}.{m}"), F.lit(0.0)), 4)
    raw = lambda c, m: F.coalesce(F.col(f"{c}_{m}.{m}"), F.lit(0.0))
    columns = []
    for m in ("margin", "accuracy"):
        for c in ("old", "new"):
            columns += [F.col(f"{c}_{m}.scorer_id").alias(f"best_{c}_by_{m}"), value(c, m).alias(f"best_{c}_{m}_value")]
        columns.append(F.round(raw("new", m) - raw("old", m), 4).alias(f"{m}_delta"))
    return wide.select("subset", *columns)


def repair_claim(deltas: DataFrame, front: DataFrame, old: DataFrame) -> DataFrame:
    """One row: do new scorers enter the frontier, beat the old best on the final held-out rows, and is improvement claimed rightly?"""
    known = old.select("scorer_id").distinct().withColumn("was", F.lit(True))
    members = front.join(known, "scorer_id", "left").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("was").isNull()).alias("new_members"))
    last = deltas.where("subset = 'final_heldout'").select((F.col("margin_delta") > 0).alias("beats_old_best_margin"), (F.col("accuracy_delta") > 0).alias("beats_old_best_accuracy"))
    both = members.crossJoin(F.broadcast(last))  # one row each
    enters = F.col("new_members") > 0
    return both.select(
        enters.alias("new_scorer_enters_pareto"),
        "beats_old_best_margin",
        "beats_old_best_accuracy",
        F.round(F.col("new_members") / F.greatest(F.lit(1), F.col("members")), 4).alias("share_of_eligible_ensemble"),
        (enters & (F.col("beats_old_best_margin") | F.col("beats_old_best_accuracy"))).alias("overall_improvement_claim_supported"),
    )


def ensemble(long: DataFrame, item: str, scorer: str, value: str, *by: str) -> DataFrame:
    """(by, item, ensemble_score, raw_mean): the mean of each item's values, each min-max normalised per scorer.

    A scorer that gives all items the same counts 0.  Least and greatest are
    aggregated and joined back, a row per scorer, so no scorer's items meet in
    one task.
    """
    per = long.groupBy(*by, scorer).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    norm = (F.col(value) - F.col("_low")) / F.when(F.col("_high") == F.col("_low"), 1.0).otherwise(F.col("_high") - F.col("_low"))
    return long.join(per, [*by, scorer]).groupBy(*by, item).agg(F.avg(norm).alias("ensemble_score"), F.avg(value).alias("raw_mean"))


def selected(items: DataFrame, item: str, *by: str) -> DataFrame:
    """The best allowed item of each ``by``: policy_ok, then the score at nine digits; ties to the smaller item; none if none is allowed."""
    allowed = items.where("policy_ok")
    best = F.min_by(F.struct(item, "ensemble_score"), F.struct(-F.round("ensemble_score", 9), F.col(item)))
    return allowed.groupBy(*by).agg(best.alias("b"), F.count(F.lit(1)).alias("allowed")).select(*by, "b.*", "allowed")


def survivors(s: DataFrame, metrics: list[str], tolerance: float = 0.001) -> DataFrame:
    """Which metrics of a row equal the best of all rows, within the tolerance."""
    bests = s.agg(*[F.max(m).alias(f"_best_{m}") for m in metrics])
    why = F.array_compact(F.array(*[F.when(F.abs(F.col(m) - F.col(f"_best_{m}")) <= tolerance, F.lit(m)) for m in metrics]))
    return s.crossJoin(F.broadcast(bests)).select("scorer_id", F.array_join(why, ",").alias("survived_because"))  # one row


def experiment_summary(runs: DataFrame, run: str, winner: str, value: str) -> DataFrame:
    """Mean, sample deviation (0 for one run), extremes and the most frequent winner, ties to the smaller."""
    counted = runs.groupBy(winner).agg(F.count(F.lit(1)).alias("wins"))
    top = counted.agg(F.min_by(winner, F.struct(-F.col("wins"), F.col(winner))).alias("mode_winner"))
    return runs.agg(F.count(F.lit(1)).alias("runs"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"), F.bool_and(F.col(value) > 0).alias("all_positive")).crossJoin(F.broadcast(top))


#: The criteria of a run in order: name, threshold (a truth value asks for equality), only a warning.
CRITERIA: list[tuple[str, float | bool, bool]] = [
    ("taste_research_present", 3, False), ("taste_map_rewards_present", 3, False), ("taste_map_punishes_present", 1, False), ("scorer_hypotheses_r0", 8, False),
    ("scorer_code_valid_r0", 2, False), ("pair_policy_violations", 0, False), ("initial_heldout_count", 8, False), ("pareto_r0_nonempty", True, False),
    ("failure_packet_has_instructions", True, False), ("repair_hypotheses_generated", 6, False), ("adversarial_pairs_generated", 12, False), ("fake_mechanism_pairs", 3, False),
    ("heldout_grew", True, False), ("final_heldout_count", 15, False), ("pareto_r1_nonempty", True, False), ("eligible_ensemble_exists", True, False),
    ("candidate_selected", True, False), ("hype_baseline_zeroed", True, False), ("c002_not_zeroed", True, False), ("mutation_instructions_not_all_repeated", True, True),
]


def criteria(context: DataFrame, rules: list[tuple[str, float | bool, bool]] | None = None) -> DataFrame:
    """(place, criterion, computed_value, threshold, status) of one context row, whose columns are named like the criteria.

    A number passes from its threshold on, a truth value if it equals it; else
    it fails or, where the rule only warns, is a warning.  A null value doesn't pass.
    """
    cells = []
    for i, (name, threshold, warn_only) in enumerate(rules or CRITERIA):
        truth = isinstance(threshold, bool)
        met = F.col(name) == threshold if truth else F.col(name) >= float(threshold)
        status = F.when(F.coalesce(met, F.lit(False)), "pass").otherwise("warning" if warn_only else "fail")
        cells.append(F.struct(F.lit(i + 1).alias("place"), F.lit(name).alias("criterion"), F.col(name).cast("double").alias("computed_value"), F.lit(str(threshold)).alias("threshold"), status.alias("status")))
    return context.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def criteria_counts(checked: DataFrame) -> DataFrame:
    """One row: how many criteria pass, warn and fail."""
    return checked.agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("pass", "passed"), ("warning", "warned"), ("fail", "failed"))])
