"""Structural signals of staged JSON outputs, hard gates and soft targets.

Each stage has one function from the exploded items of its outputs to a wide row
of signals per output; ``long`` turns rows into (key, signal, value) and the
gates are a join of that with a table of thresholds.  An absent list is an empty
list: counts are 0 and rates are 0 over at least one item.  A text field counts
as present if it is not empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmusq.functions.bitmaps import asked, bitmap, run_hashes

#: Words and patterns of the signals.
MECHANISTIC = [
    "because", "leads to", "increases", "decreases", "mediates", "moderates", "causes", "drives", "reduces", "through", "by making", "as a result",
    "signals", "facilitates", "triggers", "enables", "undermines", "enhances", "diminishes", "amplifies", "weakens", "strengthens", "resulting in",
    "thereby", "which in turn", "is attributed to", "is misattributed", "functions as", "acts as", "serves as",
]
VAGUE = ["clear", "good", "engaging", "effective", "strong", "better", "important", "high quality"]
GENERIC_FEATURES = ["sentiment", "readability", "keywords", "tone", "style", "quality", "coherence"]
ACTIONABLE = ["count", "measure", "detect", "extract", "compute", "calculate", "ratio", "density", "frequency", "regex", "pattern", "parse", "split", "tokenize"]
GENERIC_METRICS = ["sentiment", "readability", "flesch", "keyword density", "word count only"]
INTERACTION = ["*", "min(", "max(", "if ", "penalty", "gate", "threshold", "ratio", "density"]
NORMALISATION = ["len(text", "len(sentences", "len(clauses", "num_sentences", "num_clauses", "word_count", "token_count", "/ len(", "/ num_", "sentence_count"]
ACTION_VERBS = ["add", "remove", "replace", "combine", "split", "increase", "decrease", "weight", "gate", "normalize", "multiply"]
UNSAFE = [r"\bimport\b", r"open\(", r"exec\(", r"eval\(", r"\brequests\b", r"\burllib\b", r"\bsocket\b"]
DIRECTIONS = ["increases", "decreases", "mediates", "moderates"]
#: Stage, kind (min and max are gates, target is soft), signal, threshold.
GATES: list[tuple[int, str, str, float]] = [
    (1, "min", "num_research_items", 3), (1, "min", "source_trace_rate", 0.5),
    (2, "min", "num_nodes", 3), (2, "min", "num_edges", 2), (2, "min", "edge_validity_rate", 0.5),
    (3, "min", "num_measurement_items", 3), (3, "min", "node_reference_validity_rate", 0.5),
    (4, "min", "num_scorers", 3), (4, "min", "code_exec_rate", 0.3),
    (5, "min", "num_pairs", 6), (5, "min", "pair_schema_completeness_rate", 0.5),
    (6, "min", "num_scorers_evaluated", 3), (6, "min", "execution_valid_rate", 0.3),
    (7, "min", "failure_pattern_count", 1), (7, "max", "heldout_raw_text_leakage_count", 0),
    (8, "min", "num_repair_scorers", 2), (8, "min", "code_exec_rate", 0.3),
    (1, "target", "num_research_items", 8), (1, "target", "num_unique_causal_variables", 5), (1, "target", "mechanism_completeness_rate", 0.75),
    (1, "target", "causal_specificity_score", 0.6), (1, "target", "tension_count", 1), (1, "target", "generic_advice_penalty", 0.25),
    (2, "target", "num_nodes", 5), (2, "target", "num_edges", 4), (2, "target", "node_mechanism_rate", 0.85), (2, "target", "node_evidence_rate", 0.8),
    (2, "target", "edge_explanation_rate", 0.9), (2, "target", "graph_connectedness_score", 0.6), (2, "target", "role_diversity_score", 2), (2, "target", "tension_count", 1),
    (3, "target", "node_measurement_coverage", 0.7), (3, "target", "num_measurement_items", 8), (3, "target", "text_feature_specificity_score", 0.6),
    (3, "target", "implementation_actionability_score", 0.65), (3, "target", "multi_measurement_rate", 0.3),
    (4, "target", "hypothesis_completeness_rate", 1.0), (4, "target", "causal_node_validity_rate", 0.8), (4, "target", "measurement_reference_rate", 0.8),
    (4, "target", "functional_form_diversity", 3), (4, "target", "interaction_usage_rate", 0.4), (4, "target", "normalization_usage_rate", 0.4),
    (4, "target", "nonconstant_behavior_rate", 0.6), (4, "target", "scorer_distinctness_score", 0.75), (4, "target", "hypothesis_code_alignment_score", 0.35),
    (5, "target", "source_trace_rate", 0.8), (5, "target", "causal_node_reference_validity_rate", 0.8), (5, "target", "controlled_variable_pass_rate", 0.7),
    (5, "target", "length_balance_rate", 0.7), (5, "target", "minimal_contrast_rate", 0.6), (5, "target", "target_direction_clarity_rate", 0.8), (5, "target", "positive_policy_pass_rate", 0.9),
    (6, "target", "eligible_scorer_count", 3), (6, "target", "pareto_count", 2), (6, "target", "nonconstant_scorer_rate", 0.5), (6, "target", "heldout_accuracy_presence_rate", 0.8),
    (7, "target", "top_scorer_coverage_rate", 0.8), (7, "target", "visible_failure_reference_rate", 0.5), (7, "target", "failure_pattern_specificity_score", 0.6),
    (7, "target", "mutation_actionability_score", 0.7), (7, "target", "causal_reference_rate", 0.5),
    (8, "target", "failure_pattern_target_rate", 0.8), (8, "target", "lineage_completeness_rate", 0.9), (8, "target", "causal_node_validity_rate", 0.8), (8, "target", "measurement_reference_rate", 0.7),
    (8, "target", "nonconstant_behavior_rate", 0.6), (8, "target", "functional_form_diversity", 3), (8, "target", "parent_distinctness_rate", 0.5),
]


def has(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def filled(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) > 0


def rate(condition: Column) -> Column:
    """Share of items with the condition, 0 without items."""
    return F.coalesce(F.avg(F.coalesce(condition, F.lit(False)).cast("double")), F.lit(0.0))


def holds(text: Column, words: list[str]) -> Column:
    """Does the text contain any of the words, as written?"""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.coalesce(text, F.lit("")), F.lit(w))
    return out


def says(text: Column, words: list[str]) -> Column:
    """Does the lower-cased text contain any of the words?"""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def _counted(out: DataFrame, rows: DataFrame | None, key: str, refs: str) -> DataFrame:
    """``out`` with tension_count: the rows with a claim and at least two ``refs``; 0 where an output has none."""
    if rows is None:
        return out.withColumn("tension_count", F.lit(0).cast("bigint"))
    n = rows.where(has(F.col("claim")) & (F.size(refs) >= 2)).groupBy(key).agg(F.count(F.lit(1)).alias("tension_count"))
    return out.join(n, key, "left").na.fill(0, ["tension_count"])


def research(items: DataFrame, key: str, tensions: DataFrame | None = None) -> DataFrame:
    """Stage 1: (key, source_id, claim, causal_variable, effect_direction, mechanism), tensions (key, claim, variables)."""
    complete = has(F.col("claim")) & has(F.col("causal_variable")) & has(F.col("effect_direction")) & has(F.col("mechanism")) & has(F.col("source_id"))
    out = items.groupBy(key).agg(
        F.count(F.lit(1)).alias("num_research_items"),
        F.count_distinct(F.when(has(F.col("causal_variable")), F.col("causal_variable"))).alias("num_unique_causal_variables"),
        rate(complete).alias("mechanism_completeness_rate"),
        rate(has(F.col("source_id"))).alias("source_trace_rate"),
        *[F.count_if(F.coalesce(F.col("effect_direction") == d, F.lit(False))).alias(f"direction_{d}") for d in DIRECTIONS],
        rate(says(F.concat_ws(" ", "claim", "mechanism"), MECHANISTIC)).alias("causal_specificity_score"),
        rate((F.trim(F.coalesce("mechanism", F.lit(""))) == "") & says(F.col("claim"), VAGUE)).alias("generic_advice_penalty"),
    )
    return _counted(out, tensions, key, "variables")


def graph(nodes: DataFrame, edges: DataFrame, key: str, target: str | None = None, tensions: DataFrame | None = None, summary: DataFrame | None = None) -> DataFrame:
    """Stage 2: nodes (key, node_id, mechanism, role, evidence), edges (key, src, dst, claim), tensions (key, claim, nodes), summary (key, summary).

    An edge is valid if it starts at a node and ends at a node or the target
    variable.  Ends are looked up by joins on (key, id).
    """
    ids = nodes.select(key, "node_id").distinct()
    n = nodes.groupBy(key).agg(
        F.count(F.lit(1)).alias("num_nodes"),
        rate(has(F.col("mechanism"))).alias("node_mechanism_rate"),
        rate(filled(F.col("evidence"))).alias("node_evidence_rate"),
        F.count_distinct(F.when(F.col("role").isin(DIRECTIONS), F.col("role"))).alias("role_diversity_score"),
    )
    from_ids = ids.withColumnRenamed("node_id", "src").withColumn("from_known", F.lit(True))
    to_ids = ids.withColumnRenamed("node_id", "dst").withColumn("to_known", F.lit(True))
    known = edges.join(from_ids, [key, "src"], "left").join(to_ids, [key, "dst"], "left")
    to_ok = F.col("to_known").isNotNull() | (F.col("dst") == target if target else F.lit(False))
    e = known.groupBy(key).agg(F.count(F.lit(1)).alias("num_edges"), rate(F.col("from_known").isNotNull() & to_ok).alias("edge_validity_rate"), rate(has(F.col("claim"))).alias("edge_explanation_rate"))
    ends = edges.select(key, F.col("src").alias("node_id")).union(edges.select(key, F.col("dst").alias("node_id"))).distinct()
    joined = ids.join(ends, [key, "node_id"], "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("connected"))
    out = n.join(e, key, "left").join(joined, key, "left").na.fill(0, ["num_edges", "edge_validity_rate", "edge_explanation_rate", "connected"])
    out = out.withColumn("graph_connectedness_score", F.col("connected") / F.greatest(F.lit(1), F.col("num_nodes"))).drop("connected")
    out = _counted(out, tensions, key, "nodes")
    if summary is None:
        return out.withColumn("summary_uses_graph_terms", F.lit(False))
    terms = nodes.where(has(F.col("node_id"))).select(key, F.lower("node_id").alias("term")).distinct()
    told = terms.join(summary.select(key, F.lower("summary").alias("low")), key).where(F.contains("low", "term")).select(key).distinct()
    return out.join(told.withColumn("summary_uses_graph_terms", F.lit(True)), key, "left").na.fill(False, ["summary_uses_graph_terms"])


def top_nodes(nodes: DataFrame, edges: DataFrame, key: str, count: int) -> DataFrame:
    """The nodes with most edge ends, ties by ``ord``, back in their order."""
    from pyspark.sql import Window

    ends = edges.select(key, F.col("src").alias("node_id")).union(edges.select(key, F.col("dst").alias("node_id")))
    degree = ends.groupBy(key, "node_id").agg(F.count(F.lit(1)).alias("degree"))
    order = Window.partitionBy(key).orderBy(F.desc("degree"), "ord")
    ranked = nodes.join(degree, [key, "node_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0))).withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= count).select(key, "node_id", "ord", "degree", "place")


def measurement(items: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Stage 3: items (key, causal_node, measurement_claim, text_features, implementation_ideas), nodes (key, node_id)."""
    features, ideas = F.col("text_features"), F.col("implementation_ideas")
    specific = F.size(F.filter(features, lambda f: ~F.lower(f).isin(GENERIC_FEATURES) & (F.length(f) > 3))) / F.size(features)
    actionable = F.size(F.filter(ideas, lambda i: says(i, ACTIONABLE))) / F.size(ideas)
    generic = says(F.concat_ws(" ", "measurement_claim", F.array_join(features, " ")), GENERIC_METRICS) & (F.coalesce(F.size(ideas), F.lit(0)) < 2)
    ids = nodes.select(key, F.col("node_id").alias("causal_node")).distinct().withColumn("known", F.lit(True))
    total = ids.groupBy(key).agg(F.count(F.lit(1)).alias("nodes"))
    known = items.join(ids, [key, "causal_node"], "left")
    per_node = known.where("known").groupBy(key, "causal_node").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.count(F.lit(1)).alias("covered"), F.count_if(F.col("n") >= 2).alias("multi"))
    s = known.groupBy(key).agg(
        F.count(F.lit(1)).alias("num_measurement_items"),
        rate(F.col("known").isNotNull()).alias("node_reference_validity_rate"),
        (F.coalesce(F.sum(F.when(filled(features), specific)), F.lit(0.0)) / F.count(F.lit(1))).alias("text_feature_specificity_score"),
        (F.coalesce(F.sum(F.when(filled(ideas), actionable)), F.lit(0.0)) / F.count(F.lit(1))).alias("implementation_actionability_score"),
        rate(generic).alias("generic_metric_penalty"),
    )
    s = s.join(per_node, key, "left").join(total, key, "left").na.fill(0, ["covered", "multi", "nodes"])
    return s.withColumn("node_measurement_coverage", F.col("covered") / F.greatest(F.lit(1), F.col("nodes"))).withColumn("multi_measurement_rate", F.coalesce(F.try_divide("multi", "covered"), F.lit(0.0))).drop("covered", "multi", "nodes")


def behaviour(items: DataFrame, key: str, tried: DataFrame) -> DataFrame:
    """How the code of an output's scorers behaves: the shares that run on every text, always give a number, and vary.

    ``tried`` (key, ord, runs, numeric, nonconstant) are the scorers whose code
    was run (``usercode.smoke``); the others neither run nor vary.
    """
    rates = [rate(F.col(c)).alias(n) for c, n in (("runs", "code_exec_rate"), ("numeric", "numeric_return_rate"), ("nonconstant", "nonconstant_behavior_rate"))]
    return items.select(key, "ord").join(tried, [key, "ord"], "left").groupBy(key).agg(*rates)


def scorers(items: DataFrame, nodes: DataFrame, key: str, tried: DataFrame | None = None) -> DataFrame:
    """Stage 4: (key, ord, hypothesis, functional_form, functional_form_rationale, expected_failure_mode, code, causal_nodes_used, measurement_ideas_used).

    The signals of running code are there only with ``tried`` (``behaviour``).
    """
    used, ideas = F.coalesce("causal_nodes_used", F.array().cast("array<string>")), F.coalesce("measurement_ideas_used", F.array().cast("array<string>"))
    complete = has(F.col("hypothesis")) & filled(used) & filled(ideas) & has(F.col("functional_form")) & has(F.col("functional_form_rationale")) & has(F.col("expected_failure_mode")) & has(F.col("code"))
    code = F.lower(F.coalesce("code", F.lit("")))
    terms = F.filter(F.split(F.lower(F.regexp_replace(F.concat_ws(" ", used, ideas), "_", " ")), r"\s+"), lambda t: F.length(t) > 3)
    aligned = F.coalesce(F.try_divide(F.size(F.filter(terms, lambda t: F.contains(code, t))), F.size(terms)), F.lit(0.0))
    out = items.groupBy(key).agg(
        F.count(F.lit(1)).alias("num_scorers"),
        rate(complete).alias("hypothesis_completeness_rate"),
        rate(filled(ideas)).alias("measurement_reference_rate"),
        F.count_distinct(F.when(has(F.col("functional_form")), F.lower("functional_form"))).alias("functional_form_diversity"),
        rate(holds(F.col("code"), INTERACTION)).alias("interaction_usage_rate"),
        rate(holds(F.col("code"), NORMALISATION)).alias("normalization_usage_rate"),
        (F.count_distinct(F.coalesce("functional_form", F.lit("")), F.array_sort(F.array_distinct(used)), F.array_sort(F.array_distinct(ideas))) / F.count(F.lit(1))).alias("scorer_distinctness_score"),
        F.avg(aligned).alias("hypothesis_code_alignment_score"),
    )
    out = out.join(_valid_refs(items, nodes, key), key, "left").na.fill(0.0, ["causal_node_validity_rate"])
    return out.join(behaviour(items, key, tried), key) if tried is not None else out


def _valid_refs(items: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """(key, causal_node_validity_rate): the share of all references in causal_nodes_used that are nodes of the output."""
    refs = items.select(key, F.explode("causal_nodes_used").alias("node_id"))
    known = nodes.where("node_id IS NOT NULL").select(key, "node_id").distinct().withColumn("known", F.lit(True))
    return refs.join(known, [key, "node_id"], "left").groupBy(key).agg(rate(F.col("known")).alias("causal_node_validity_rate"))


def near_duplicates(items: DataFrame, key: str, ident: str, text: str, threshold: float = 0.8) -> DataFrame:
    """Items of an output with a later one (by ``ident``) whose word sets are more alike than the threshold.

    Pairs come from shared words of a prefix: the rarest words of each text, so
    many that two alike texts share one of them; then the exact likeness.
    """
    from pyspark.sql import Window

    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s ]+"), lambda w: w != ""))
    sets = items.select(key, ident, words.alias("words")).where(F.size("words") > 0)
    rows = sets.select(key, ident, F.size("words").alias("size"), F.explode("words").alias("word"))
    counts = rows.groupBy(key, "word").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy(key, ident).orderBy("df", "word")
    kept = rows.join(counts, [key, "word"]).withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * threshold) + 1)
    a, b = kept.select(key, "word", F.col(ident).alias("a")), kept.select(key, "word", F.col(ident).alias("b"))
    pairs = a.join(b, [key, "word"]).where("a < b").select(key, "a", "b").distinct()
    both = pairs.join(sets.toDF(key, "a", "wa"), [key, "a"]).join(sets.toDF(key, "b", "wb"), [key, "b"])
    same = F.size(F.array_intersect("wa", "wb"))
    return both.where(same / (F.size("wa") + F.size("wb") - same) > threshold).select(key, F.col("a").alias(ident)).distinct()


def pairs(items: DataFrame, nodes: DataFrame, key: str, max_words: int = 80) -> DataFrame:
    """Stage 5: (key, pair_id, anchor, positive, negative, split, target_delta, label_contract, source_id, source_trace, controlled_variables, causal_nodes_tested, policy_violations)."""
    length = lambda c: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"[\s ]+"), lambda w: w != ""))
    complete = F.lit(True)
    for c in ("pair_id", "anchor", "positive", "negative", "split", "target_delta"):
        complete = complete & has(F.col(c))
    tested = F.coalesce("causal_nodes_tested", F.array().cast("array<string>"))
    known = nodes.where("node_id IS NOT NULL").select(key, "node_id").distinct().withColumn("known", F.lit(True))
    found = items.select(key, "ord", F.explode("causal_nodes_tested").alias("node_id")).join(known, [key, "node_id"], "left").groupBy(key, "ord").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("nodes_known"))
    twice = near_duplicates(items, key, "ord", "anchor").withColumn("twice", F.lit(True))
    df = items.join(found, [key, "ord"], "left").join(twice, [key, "ord"], "left")
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("num_pairs"),
        F.count_if(F.coalesce(F.col("split") == "heldout", F.lit(False))).alias("heldout_count"),
        rate(complete & filled(F.col("controlled_variables"))).alias("pair_schema_completeness_rate"),
        rate(has(F.col("source_trace")) | has(F.col("source_id"))).alias("source_trace_rate"),
        rate(F.col("nodes_known")).alias("causal_node_reference_validity_rate"),
        rate(F.abs(length(F.col("positive")) - length(F.col("negative"))) <= max_words * 0.3).alias("length_balance_rate"),
        rate(F.size(tested).isin(1, 2)).alias("minimal_contrast_rate"),
        rate(has(F.col("label_contract"))).alias("target_direction_clarity_rate"),
        rate(filled(F.col("controlled_variables"))).alias("controlled_variable_pass_rate"),
        rate(~filled(F.col("policy_violations"))).alias("positive_policy_pass_rate"),
        rate(F.col("twice").isNotNull()).alias("near_duplicate_pair_rate"),
        F.lit(0.0).alias("heldout_leakage_risk"),
    )


def evaluated(summaries: DataFrame, key: str) -> DataFrame:
    """Stage 6: scorer summaries (key, exec_error_rate, nonconstant_rate, score_spread, train_accuracy, heldout_accuracy, train_mean_gap, heldout_mean_gap, eligible, pareto)."""
    clean = F.coalesce("exec_error_rate", F.lit(1.0)) == 0
    present = lambda c: rate(F.col(c).isNotNull())
    return summaries.groupBy(key).agg(
        F.count(F.lit(1)).alias("num_scorers_evaluated"),
        rate(clean).alias("execution_valid_rate"),
        rate(clean).alias("numeric_return_rate"),
        rate(F.col("nonconstant_rate") > 0).alias("nonconstant_scorer_rate"),
        rate(F.col("score_spread") > 0).alias("score_range_valid_rate"),
        present("train_accuracy").alias("train_accuracy_presence_rate"),
        present("heldout_accuracy").alias("heldout_accuracy_presence_rate"),
        present("train_mean_gap").alias("train_gap_presence_rate"),
        present("heldout_mean_gap").alias("heldout_gap_presence_rate"),
        F.count_if(F.coalesce("eligible", F.lit(False))).alias("eligible_scorer_count"),
        F.count_if(F.coalesce("pareto", F.lit(False))).alias("pareto_count"),
        F.count_if(F.coalesce("train_accuracy", F.lit(0.0)) > F.coalesce("heldout_accuracy", F.lit(0.0)) + 0.2).alias("overfit_warning_count"),
    )


def failures(patterns: DataFrame, instructions: DataFrame, key: str, named: DataFrame | None = None) -> DataFrame:
    """Stage 7: patterns (key, scorer_ids, visible_pair_ids, causal_nodes_implicated, reasoning_error) and instructions (key, instruction, targets).

    ``named`` (key, top, heldout: arrays of scorer ids) gives the coverage of the
    scorers with held-out figures by the packet's top scorers; without held-out
    figures it is 1 if there are top scorers; an output without both has 0.
    """
    specific = filled(F.col("scorer_ids")) & filled(F.col("visible_pair_ids")) & filled(F.col("causal_nodes_implicated")) & has(F.col("reasoning_error"))
    p = patterns.groupBy(key).agg(
        F.count(F.lit(1)).alias("failure_pattern_count"),
        rate(filled(F.col("visible_pair_ids"))).alias("visible_failure_reference_rate"),
        rate(specific).alias("failure_pattern_specificity_score"),
        F.count_if(filled(F.col("causal_nodes_implicated"))).alias("p_refs"),
    )
    i = instructions.groupBy(key).agg(
        F.count(F.lit(1)).alias("i_count"),
        rate(says(F.col("instruction"), ACTION_VERBS)).alias("mutation_actionability_score"),
        F.count_if(filled(F.col("targets")) & says(F.col("instruction"), ["causal", "node", "mechanism"])).alias("i_refs"),
    )
    out = p.join(i, key, "full").na.fill(0, ["failure_pattern_count", "visible_failure_reference_rate", "failure_pattern_specificity_score", "p_refs", "i_count", "mutation_actionability_score", "i_refs"])
    total = F.greatest(F.lit(1), F.col("failure_pattern_count") + F.col("i_count"))
    out = out.withColumn("causal_reference_rate", (F.col("p_refs") + F.col("i_refs")) / total).drop("p_refs", "i_refs", "i_count")
    if named is None:
        return out.withColumn("top_scorer_coverage_rate", F.lit(0.0))
    covered = F.size(F.array_intersect("top", "heldout")) / F.size(F.array_distinct("heldout"))
    share = F.when(filled(F.col("heldout")), F.coalesce(covered, F.lit(0.0))).otherwise(filled(F.col("top")).cast("double"))
    return out.join(named.select(key, share.alias("top_scorer_coverage_rate")), key, "left").na.fill(0.0, ["top_scorer_coverage_rate"])


#: Bits of the bitmap of probes; characters of a probe.
PROBE_BITS, PROBE = 1 << 22, 10


def _probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every text the run of characters with the smallest hash."""
    for batch in batches:
        probes = [int(run_hashes(t, PROBE).min().view(np.int64)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(probes, pa.int64())], [*batch.schema.names, "probe"])


def _probed(bits):
    """The runs of every packet that some text asks for, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for packet in batch.column("packet").to_pylist():
                runs = run_hashes(packet, PROBE)
                found.append(np.unique(runs[asked(bits.value, runs)]).view(np.int64))
            owner = pa.array(np.repeat(np.arange(batch.num_rows), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([batch.column("pid").take(owner), pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], ["pid", "probe"])

    return run


def leakage(packets: DataFrame, heldout: DataFrame, key: str, least: int = PROBE) -> DataFrame:
    """How many held-out texts (key, text) of at least ``least`` characters stand literally in the packet texts of their key (key, packet).

    A text is looked up by one run of its characters among those of the packets,
    then compared literally; a packet gives only runs that some text asks for.
    """
    kind = dict(heldout.dtypes)[key]
    texts = heldout.where(F.length("text") >= max(least, PROBE)).select(key, "text").mapInArrow(_probes, f"{key} {kind}, text string, probe bigint")
    bits = packets.sparkSession.sparkContext.broadcast(bitmap(texts, "probe", PROBE_BITS))
    parts = packets.where("packet IS NOT NULL").withColumn("pid", F.xxhash64(key, "packet"))
    index = parts.select("pid", "packet").mapInArrow(_probed(bits), "pid bigint, probe bigint")
    near = index.join(parts.select("pid", key), "pid").join(texts, [key, "probe"]).select(key, "pid", "text")
    hits = near.join(parts.select("pid", "packet"), "pid").where(F.contains(F.col("packet"), F.col("text"))).select(key, "text").distinct()
    return packets.select(key).distinct().join(hits.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("heldout_raw_text_leakage_count"))


def repairs(items: DataFrame, pattern_ids: DataFrame, key: str, nodes: DataFrame | None = None, tried: DataFrame | None = None) -> DataFrame:
    """Stage 8: repair scorers (key, ord, ...) with targets, lineage, parents, form, code, feature map and strategy.

    The signals of running code are there only with ``tried``, that of valid nodes only with ``nodes``.
    """
    known = pattern_ids.where("pattern_id IS NOT NULL").select(key, F.col("pattern_id").alias("target")).distinct()
    hit = items.select(key, "ord", F.explode("targets_failure_patterns").alias("target")).join(known, [key, "target"]).select(key, "ord").distinct().withColumn("hit", F.lit(True))
    unsafe = F.lit(False)
    for p in UNSAFE:
        unsafe = unsafe | F.coalesce("code", F.lit("")).rlike(p)
    used = F.array_sort(F.array_distinct(F.coalesce("causal_nodes_used", F.array().cast("array<string>"))))
    out = (
        items.join(hit, [key, "ord"], "left")
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("num_repair_scorers"),
            rate(F.col("hit")).alias("failure_pattern_target_rate"),
            rate(filled(F.col("measurement_ideas_used"))).alias("measurement_reference_rate"),
            rate(has(F.col("lineage")) & filled(F.col("parent_scorer_ids"))).alias("lineage_completeness_rate"),
            F.count_distinct(F.when(has(F.col("functional_form")), F.lower("functional_form"))).alias("functional_form_diversity"),
            rate(unsafe).alias("unsafe_code_penalty"),
            (F.count_distinct(F.coalesce("functional_form", F.lit("")), used) / F.count(F.lit(1))).alias("parent_distinctness_rate"),
            rate(filled(F.col("code_feature_map"))).alias("code_feature_map_completeness_rate"),
            rate(has(F.col("repair_strategy")) & says(F.col("repair_strategy"), ACTION_VERBS)).alias("repair_strategy_specificity_score"),
        )
    )
    if nodes is not None:
        out = out.join(_valid_refs(items, nodes, key), key, "left").na.fill(0.0, ["causal_node_validity_rate"])
    return out.join(behaviour(items, key, tried), key) if tried is not None else out


def long(wide: DataFrame, key: str, stage: int) -> DataFrame:
    """(key, stage, signal, value) of a wide row of signals."""
    cells = F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).cast("double").alias("value")) for c in wide.columns if c != key])
    return wide.select(key, F.lit(stage).alias("stage"), F.explode(cells).alias("c")).select(key, "stage", "c.*")


def check(signals: DataFrame, key: str, kinds: tuple[str, ...] = ("min", "max")) -> DataFrame:
    """(key, stage, kind, signal, value, threshold, computed) of gates not met, or of targets missed.

    An absent signal counts as 0 for a minimum or target and as 1 for a maximum,
    and is reported as not computed; targets of penalties are met from below.
    """
    rules = signals.sparkSession.createDataFrame([(s, k, n, float(t)) for s, k, n, t in GATES if k in kinds], "stage int, kind string, signal string, threshold double")
    outputs = signals.select(key, "stage").distinct()
    wanted = outputs.join(F.broadcast(rules), "stage")  # the rules are a fixed table
    got = wanted.join(signals, [key, "stage", "signal"], "left").withColumn("computed", F.col("value").isNotNull())
    got = got.withColumn("value", F.coalesce("value", F.when(F.col("kind") == "max", 1.0).otherwise(0.0)))
    above = (F.col("kind") == "max") | ((F.col("kind") == "target") & F.contains(F.col("signal"), F.lit("penalty")))
    missed = F.when(above, F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
    return got.where(missed).select(key, "stage", "kind", "signal", "value", "threshold", "computed")
