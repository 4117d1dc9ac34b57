"""Queries of personas, stage schemas and the small joins around them, with their SQL; customers are the personas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmusq.operators import personas as P
from litmusq.operators import stage_schema as S
from litmusq.plans.signal_queries import _R, answers
from litmusq.sources.tables import table

#: Four cards with what they weigh of a customer's balance and nation.
CARDS = [{"id": "clarity", "base": 0.2, "rich": 0.5, "near": 0.0}, {"id": "proof", "base": 0.3, "rich": 0.1, "near": 0.3}, {"id": "pace", "base": 0.25, "rich": 0.3, "near": 0.1}, {"id": "tone", "base": 0.3, "rich": 0.1, "near": 0.3}]
_RICH, _NEAR = "c_acctbal / 10000.0", "(c_nationkey % 5) / 4.0"


def _fits(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer", "c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    return P.best_fit(c, CARDS, lambda card: card["base"] + card["rich"] * F.expr(_RICH) + card["near"] * F.expr(_NEAR))


def persona_fit(spark: SparkSession, folder: str) -> DataFrame:
    return _fits(spark, folder).groupBy("card").agg(F.count(F.lit(1)).alias("personas"), F.round(F.avg("fit") + 1e-9, 6).alias("mean_fit"))


def persona_overrides(spark: SparkSession, folder: str) -> DataFrame:
    """Orders answer for their customers: the greatest total as a share, the status as a flag."""
    base = _fits(spark, folder).select("c_custkey", "c_mktsegment", (F.col("fit") / 2).alias("share"), F.lit(False).alias("buys"))
    given = table(spark, folder, "orders", "o_custkey", "o_totalprice", "o_orderstatus").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.max("o_totalprice") / 400000).alias("share"), F.max(F.when(F.col("o_orderstatus") == "P", "Yes").otherwise("no")).alias("buys"))
    return P.overridden(base, given, "c_custkey", ["share"], ["buys"])


def _overrides_summary(spark: SparkSession, folder: str) -> DataFrame:
    return persona_overrides(spark, folder).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("personas"), F.count_if("buys").alias("buyers"), F.round(F.avg("share") + 1e-9, 6).alias("mean_share"))


def calibration(spark: SparkSession, folder: str) -> DataFrame:
    o = persona_overrides(spark, folder)
    expected = o.groupBy("c_mktsegment").agg(F.avg("share").alias("expected_conversion_rate"))
    binary = o.where("c_mktsegment <> 'BUILDING'").groupBy("c_mktsegment").agg(F.avg(F.col("buys").cast("double")).alias("binary_conversion_rate"))
    out = P.calibration(expected, binary, "c_mktsegment").withColumn("flags", F.array_join("flags", ","))
    return out.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("expected_conversion_rate", "binary_conversion_rate", "delta")})


def live_summary(spark: SparkSession, folder: str) -> DataFrame:
    return P.live_summary(persona_overrides(spark, folder).select(F.col("buys").alias("will_buy"), F.floor(F.col("share") * 1000).cast("bigint").alias("price_cents")))


def segment_demand(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer", "c_mktsegment", "c_acctbal").groupBy("c_mktsegment").agg(F.avg(F.expr(_RICH)).alias("intent"))
    grid = c.select("*", F.explode(F.array(*[F.lit(p) for p in (299, 499, 799, 1299)])).alias("price_cents"))
    return grid.select("c_mktsegment", "price_cents", F.round(P.demand(F.col("intent"), F.col("price_cents"), F.col("c_mktsegment") == "BUILDING") + 1e-9, 6).alias("probability"))


def judged_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of zero to ten; test rows are the held-out ones."""
    e = table(spark, folder, "eval_rows", "scorer_id", "run_id", "split", "pos_score", "neg_score").where("pos_score IS NOT NULL AND neg_score IS NOT NULL")
    side = F.regexp_replace(F.lower("split"), "[^a-z]", "")
    out = P.judged(e.select("run_id", "scorer_id", F.when(side == "test", "heldout").otherwise(side).alias("split"), (F.col("pos_score") * 10).alias("positive"), (F.col("neg_score") * 10).alias("negative")), "run_id", "scorer_id")
    return out.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c, t in out.dtypes if t == "double"})


def round_robin(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers dealt out to nations in turn."""
    s = table(spark, folder, "supplier", "s_suppkey").select("s_suppkey", F.col("s_suppkey").cast("bigint").alias("i"))
    n = table(spark, folder, "nation", "n_nationkey", "n_name").select(F.col("n_nationkey").cast("bigint").alias("at"), "n_name")
    return P.round_robin(s, "i", n, "at").groupBy("n_name").agg(F.count(F.lit(1)).alias("suppliers"))


def basis_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return P.histogram(table(spark, folder, "scorer_hypotheses", "research_basis"), "research_basis")


def token_estimates(spark: SparkSession, folder: str) -> DataFrame:
    """Of texts without marks of other white space, so that both languages agree on what a word is."""
    d = table(spark, folder, "documents", "doc_kind", "text")
    return d.groupBy("doc_kind").agg(F.sum(P.token_estimate(F.translate("text", "\u00a0\u3000\u2009\u202f\u2028\u2029\u0085", "       "))).alias("tokens"), F.count(F.lit(1)).alias("documents"))


def stage_schema_errors(spark: SparkSession, folder: str) -> DataFrame:
    """How often each error occurs, places of items left out."""
    found = S.stage_errors(answers(spark, folder), "result_id")
    return found.groupBy("stage", F.regexp_replace("error", r"\[[0-9]+\]", "[]").alias("error")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("result_id").alias("outputs"))


def seeded_order(spark: SparkSession, folder: str) -> DataFrame:
    """A shuffle of all pairs by seed, as the share of each half that each split has; the order itself is told by key and seed."""
    p = table(spark, folder, "adversarial_pairs", "pair_id", "split").where("pair_id IS NOT NULL").groupBy("pair_id").agg(F.max(F.regexp_replace(F.lower("split"), "[^a-z]", "")).alias("split"))
    return P.shuffled(p, "pair_id", 7).groupBy("split", (F.col("draw") >= 0).alias("upper")).agg(F.count(F.lit(1)).alias("pairs"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "persona_fit": persona_fit,
    "persona_overrides": _overrides_summary,
    "calibration": calibration,
    "live_summary": live_summary,
    "segment_demand": segment_demand,
    "judged_pairs": judged_pairs,
    "round_robin": round_robin,
    "basis_histogram": basis_histogram,
    "token_estimates": token_estimates,
    "stage_schema_errors": stage_schema_errors,
    "seeded_order": seeded_order,
}

_FITS = ", ".join(f"{c['base']} + {c['rich']} * {_RICH} + {c['near']} * {_NEAR}" for c in CARDS)
_FIT = f"""f0 AS (SELECT *, [{_FITS}] AS fs FROM customer), f AS (SELECT *, greatest(0.0, list_max(fs)) AS fit, CASE WHEN list_max(fs) > 0 THEN [{", ".join(f"'{c['id']}'" for c in CARDS)}][list_position(fs, list_max(fs))] ELSE '{CARDS[0]['id']}' END AS card FROM f0)"""
_OVER = f"""{_FIT}, g AS (SELECT o_custkey, max(o_totalprice) / 400000 AS s, max(CASE WHEN o_orderstatus = 'P' THEN 'Yes' ELSE 'no' END) AS b FROM orders GROUP BY o_custkey),
o AS (SELECT c_custkey, c_mktsegment, coalesce(greatest(0.0, least(1.0, s)), fit / 2) AS share, coalesce(lower(b) = 'yes', false) AS buys FROM f LEFT JOIN g ON o_custkey = c_custkey)"""


def _schema_sql() -> str:
    parts = []
    for stage, fields in S.FIELDS.items():
        for name, kind, required, allowed in fields:
            here = f"v WHERE stage_num = {stage}"
            parts.append(f"SELECT result_id, {stage} AS stage, 'missing top-level field: {name}' AS error FROM {here} AND NOT list_contains(json_keys(j), '{name}')")
            if kind in ("list", "items", "dict"):
                want, word = ("OBJECT", "dict") if kind == "dict" else ("ARRAY", "list")
                parts.append(f"SELECT result_id, {stage}, '{name} must be a {word}' FROM {here} AND list_contains(json_keys(j), '{name}') AND json_type(j, '$.{name}') <> '{want}'")
            for f in required:
                empties = ["", "false", "0", "0.0", *[e for e in ("[]", "{}") if e not in allowed]]
                x = f"(i->>'$.{f}')"
                bad = f"({x} IS NULL OR trim({x}) IN ({', '.join(chr(39) + e + chr(39) for e in empties)}))"
                parts.append(f"SELECT result_id, {stage}, '{name}[] missing or empty: {f}' FROM (SELECT result_id, unnest(json_extract(j, '$.{name}[*]')) AS i FROM {here}) WHERE {bad}")
            if "code" in required:
                parts.append(f"SELECT result_id, {stage}, '{name}[] code must define: {S.SIGNATURE}' FROM (SELECT result_id, unnest(json_extract(j, '$.{name}[*]')) AS i FROM {here}) WHERE coalesce(i->>'$.code', '') <> '' AND NOT contains(i->>'$.code', '{S.SIGNATURE}')")
    return f"WITH {_R} SELECT stage, error, count(*) AS n, count(DISTINCT result_id) AS outputs FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


SQL: dict[str, str] = {
    "persona_fit": f"WITH {_FIT} SELECT card, count(*) AS personas, round(avg(fit) + 1e-9, 6) AS mean_fit FROM f GROUP BY card",
    "persona_overrides": f"WITH {_OVER} SELECT c_mktsegment, count(*) AS personas, count(*) FILTER (buys) AS buyers, round(avg(share) + 1e-9, 6) AS mean_share FROM o GROUP BY ALL",
    "calibration": f"""WITH {_OVER}, e AS (SELECT c_mktsegment, avg(share) AS ex FROM o GROUP BY ALL), b AS (SELECT c_mktsegment, avg(buys::INT) AS bi FROM o WHERE c_mktsegment <> 'BUILDING' GROUP BY ALL)
        SELECT e.c_mktsegment, round(ex + 1e-9, 6) AS expected_conversion_rate, round(bi + 1e-9, 6) AS binary_conversion_rate, round(bi - ex + 1e-9, 6) AS delta,
        concat_ws(',', CASE WHEN bi > 0.5 THEN 'binary_over_half' END, CASE WHEN abs(bi - ex) > 0.1 THEN 'differs_by_ten_points' END, CASE WHEN ex > 0.45 THEN 'expected_high' END) AS flags FROM e LEFT JOIN b ON b.c_mktsegment = e.c_mktsegment""",
    "live_summary": f"WITH {_OVER} SELECT count(*) AS personas_total, count(*) FILTER (buys) AS buyers, count(*) FILTER (NOT buys) AS bounced, round(count(*) FILTER (buys) / count(*), 3) AS conversion_rate, coalesce(sum(floor(share * 1000)) FILTER (buys), 0)::BIGINT AS total_revenue_cents FROM o",
    "segment_demand": f"""WITH c AS (SELECT c_mktsegment, avg({_RICH}) AS intent FROM customer GROUP BY ALL) SELECT c_mktsegment, price_cents,
        round(greatest(0.01, least(0.95, intent * 0.65 + CASE WHEN c_mktsegment = 'BUILDING' THEN 0.15 ELSE 0 END + 0.1)) * (1 / (1 + exp((price_cents / 100 - 6.0) / 2.1))) * 0.85 + 1e-9, 6) AS probability FROM c, (VALUES (299), (499), (799), (1299)) p(price_cents)""",
    "judged_pairs": """WITH e AS (SELECT run_id, scorer_id, CASE regexp_replace(lower(split), '[^a-z]', '', 'g') WHEN 'test' THEN 'heldout' ELSE regexp_replace(lower(split), '[^a-z]', '', 'g') END AS sp, pos_score * 10 AS p, neg_score * 10 AS n FROM eval_rows WHERE pos_score IS NOT NULL AND neg_score IS NOT NULL),
        s AS (SELECT run_id, scorer_id, count(*) AS pairs_evaluated, coalesce(avg((p - n > 0)::INT) FILTER (sp = 'train'), 0) AS ta, coalesce(avg(p - n) FILTER (sp = 'train'), 0) AS tg, coalesce(avg((p - n > 0)::INT) FILTER (sp = 'heldout'), 0) AS ha, coalesce(avg(p - n) FILTER (sp = 'heldout'), 0) AS hg, bool_or(p <> n) AS nonconstant FROM e GROUP BY ALL)
        SELECT run_id, scorer_id, pairs_evaluated, round(ta + 1e-9, 6) AS train_accuracy, round(tg + 1e-9, 6) AS train_mean_gap, round(ha + 1e-9, 6) AS heldout_accuracy, round(hg + 1e-9, 6) AS heldout_mean_gap, nonconstant, ha >= 0.5 AND hg > 0 AS eligible, ha >= 0.6 AND hg > 0.5 AS pareto_member FROM s""",
    "round_robin": "SELECT n_name, count(*) AS suppliers FROM supplier JOIN nation ON n_nationkey = s_suppkey % (SELECT count(*) FROM nation) GROUP BY n_name",
    "basis_histogram": "SELECT value, count(*) AS n FROM (SELECT unnest(research_basis) AS value FROM scorer_hypotheses) GROUP BY value",
    "token_estimates": "SELECT doc_kind, sum(greatest(1, floor(1.35 * len(regexp_extract_all(translate(coalesce(text, ''), chr(160) || chr(12288) || chr(8201) || chr(8239) || chr(8232) || chr(8233) || chr(133), '       '), '[^ \\t\\n\\r\\f\\v]+')))))::BIGINT AS tokens, count(*) AS documents FROM documents GROUP BY doc_kind",
    "stage_schema_errors": _schema_sql(),
}
