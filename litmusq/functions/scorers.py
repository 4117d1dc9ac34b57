"""The built-in scorers as formulas over probe columns.

The probes of a text are computed once, in one projection; the fourteen scores
are a second one over their results.  A text with an unsupported claim scores 0.
A text a scorer can't work on (null) gives an error and the value 0.5.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmusq.functions import policy, probes
from litmusq.functions.probes import clamp

PROBES = ("continuity", "progression", "mechanism", "jargon", "grounded", "causal", "specificity", "relevance", "risk", "calibration")
Formula = Callable[[dict[str, Column]], Column]


def _atleast(x: float, c: Column) -> Column:
    return F.greatest(F.lit(x), c)


def _s1(p):
    body = (0.5 * p["progression"] + 0.3 * p["causal"] + 0.2 * _atleast(0.0, p["mechanism"])) * (0.5 + 0.5 * p["continuity"])
    return F.when(p["jargon"] > 0.3, 0.0).otherwise(clamp(body))


def _s2(p):
    amplified = F.least(p["causal"] * (1 + 0.25 * p["relevance"]), 1.25 * p["causal"])
    base = _atleast(0.0, 0.4 * p["relevance"] + 0.6 * amplified)
    return clamp(base * (0.6 + 0.4 * p["continuity"]) - 0.5 * _atleast(0.0, p["jargon"] - 0.1))


def _s3(p):
    base = 0.4 * p["grounded"] + 0.3 * p["calibration"] + 0.3 * p["progression"]
    return F.when(p["jargon"] > 0.25, clamp(0.1 - p["jargon"])).otherwise(clamp(base * (0.5 + 0.5 * p["continuity"])))


def _s4(p):
    gated = F.when(p["progression"] >= 0.4, p["progression"]).otherwise(0.4 * p["progression"])
    base = 0.4 * gated + 0.4 * p["grounded"] + 0.2 * p["causal"]
    return F.when(p["jargon"] > 0.35, 0.0).otherwise(clamp(base * (0.5 + 0.5 * p["continuity"])))


def _s5(p):
    base = 0.3 * p["causal"] + 0.3 * p["specificity"] + 0.25 * p["progression"] + 0.15 * p["calibration"]
    factor = clamp(1.0 + (p["calibration"] - 0.5) * 0.4)
    return clamp(base * factor * (0.6 + 0.4 * p["continuity"]) * (1 - 0.5 * F.greatest(p["risk"], 0.6 * p["jargon"])))


def _s6(p):
    return clamp((0.5 * p["causal"] + 0.5 * p["progression"]) * (0.4 + 0.6 * _atleast(0.2, p["continuity"])) * (1 - 0.5 * p["jargon"]))


def _s7(p):
    return F.when(p["jargon"] > 0.25, clamp(0.1 * p["progression"] * p["mechanism"])).otherwise(clamp(0.5 * p["progression"] + 0.5 * clamp(p["mechanism"])))


def _s8(p):
    return clamp((0.5 * p["grounded"] - 0.3 * p["jargon"] - 0.2 * p["risk"]) * (0.5 + 0.5 * p["continuity"]))


def _r1(p):
    return F.when(p["jargon"] > 0.25, clamp(0.1 * p["progression"])).otherwise(clamp((0.55 * p["progression"] + 0.45 * p["mechanism"]) * (0.5 + 0.5 * p["continuity"])))


def _r2(p):
    amplified = 1 + 0.3 * p["relevance"] * p["mechanism"]
    return clamp((0.6 * p["causal"] * amplified + 0.4 * p["relevance"]) * (0.6 + 0.4 * p["continuity"]) * (1 - 0.6 * p["jargon"]))


def _r3(p):
    base = F.when(p["progression"] < 0.4, 0.5 * p["progression"] * p["grounded"]).otherwise(0.5 * p["progression"] + 0.5 * p["grounded"])
    return F.when(p["jargon"] > 0.3, 0.0).otherwise(clamp(base * (0.5 + 0.5 * p["continuity"])))


def _r4(p):
    return F.when(p["jargon"] > 0.2, clamp(0.15 * p["progression"])).otherwise(clamp((0.4 * p["progression"] + 0.4 * p["mechanism"] + 0.2 * p["grounded"]) * (0.5 + 0.5 * p["continuity"])))


def _r5(p):
    quality = 0.35 * p["progression"] + 0.35 * p["mechanism"] + 0.3 * p["grounded"] - 0.5 * p["jargon"]
    return clamp(quality * clamp(1.0 + (p["calibration"] - 0.5) * 0.3) * (0.5 + 0.5 * p["continuity"]))


def _r6(p):
    return clamp(0.4 * p["continuity"] + 0.6 * clamp(0.5 * p["progression"] + 0.5 * p["mechanism"] - 0.4 * p["jargon"]))


#: Scorers by id: the initial ones, then those of the repair round.
SCORERS: dict[str, Formula] = {
    "S_r0_001": _s1, "S_r0_002": _s2, "S_r0_003": _s3, "S_r0_004": _s4, "S_r0_005": _s5, "S_r0_006": _s6, "S_r0_007": _s7, "S_r0_008": _s8,
    "S_r1_001": _r1, "S_r1_002": _r2, "S_r1_003": _r3, "S_r1_004": _r4, "S_r1_005": _r5, "S_r1_006": _r6,
}
#: Scorers that fail on a null text, as they count its words or sentences.
NEED_TEXT = frozenset("S_r0_001 S_r0_002 S_r0_003 S_r0_004 S_r0_005 S_r0_006 S_r0_008 S_r1_002 S_r1_005".split())


def with_probes(df: DataFrame, text: str, anchor: str, prefix: str = "") -> DataFrame:
    """Adds ``hard`` and the probes of a text column, each under ``prefix``."""
    if "a_low" not in df.columns:
        df, _ = probes.prepared(df, anchor, "a_")
    a = probes.Prepared(F.col(anchor), F.col("a_low"), F.col("a_toks"), F.col("a_content"))
    df, t = probes.prepared(df, text, prefix)
    df = df.withColumn(f"{prefix}hard", policy.hard(t, a))
    h = F.col(f"{prefix}hard")
    made = {
        "continuity": probes.source_continuity(t, a),
        "progression": probes.argument_progression(t),
        "mechanism": probes.real_mechanism_quality(t),
        "jargon": probes.abstract_jargon_density(t),
        "grounded": probes.specificity_without_invention(t, h),
        "causal": probes.causal_density(t),
        "specificity": probes.specificity(t),
        "relevance": probes.audience_relevance(t),
        "risk": probes.persuasion_risk(t),
        "calibration": probes.epistemic_calibration(t),
    }
    return df.withColumns({prefix + k: v for k, v in made.items()})


def scores(prefix: str = "", scorers: dict[str, Formula] | None = None) -> dict[str, Column]:
    """The score of each scorer over probe columns under ``prefix``."""
    p = {name: F.col(prefix + name) for name in PROBES}
    return {sid: F.when(F.col(f"{prefix}hard"), 0.0).otherwise(f(p)) for sid, f in (scorers or SCORERS).items()}


def cross_evaluate(pairs: DataFrame, keep: tuple[str, ...] = ("pair_id", "split", "pair_type"), scorers: dict[str, Formula] | None = None) -> DataFrame:
    """Scorer x pair without a join: probes once per text, the scores unpivoted.

    Gives ``keep``, scorer_id, pos_score, neg_score, margin, correct, pos_err, neg_err.
    """
    scorers = scorers or SCORERS
    df = with_probes(with_probes(pairs, "positive", "anchor", "p_"), "negative", "anchor", "n_")
    pos, neg = scores("p_", scorers), scores("n_", scorers)
    failed = F.lit("text is null")

    def row(sid: str) -> Column:
        lost = sid in NEED_TEXT
        p = F.when(F.col("positive").isNull(), 0.5).otherwise(pos[sid]) if lost else pos[sid]
        n = F.when(F.col("negative").isNull(), 0.5).otherwise(neg[sid]) if lost else neg[sid]
        none = F.lit(None).cast("string")
        return F.struct(
            F.lit(sid).alias("scorer_id"), p.alias("pos_score"), n.alias("neg_score"),
            (F.when(F.col("positive").isNull(), failed) if lost else none).alias("pos_err"), (F.when(F.col("negative").isNull(), failed) if lost else none).alias("neg_err"),
        )

    out = df.select(*keep, F.explode(F.array(*[row(s) for s in scorers])).alias("e")).select(*keep, "e.*")
    return out.withColumn("margin", F.col("pos_score") - F.col("neg_score")).withColumn("correct", F.col("pos_score") > F.col("neg_score"))
