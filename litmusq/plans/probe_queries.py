"""Queries over the text probes, claim detectors and scorers, with their SQL.

The texts are the anchors, positives and negatives of adversarial_pairs, one
record per pair_id (the latest delivery).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litmusq.functions import lexicons as L
from litmusq.functions import policy, probes
from litmusq.functions.scorers import cross_evaluate
from litmusq.sources.tables import latest, table

PAIR = ["pair_id", "anchor", "positive", "negative", "split", "pair_type", "source"]


def split_name(c: Column) -> Column:
    """Split names without case, blanks, hyphens and underscores."""
    return F.regexp_replace(F.lower(c), "[^a-z]", "")


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    one = latest(table(spark, folder, "adversarial_pairs"), "pair_id", ["ingested_at", "ord"], PAIR)
    return one.withColumn("split", split_name(F.col("split")))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(pair_id, anchor, field, text): both responses of every pair."""
    sides = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("positive", "negative")])
    return pairs(spark, folder).select("pair_id", "anchor", F.explode(sides).alias("x")).select("pair_id", "anchor", "x.field", "x.text")


PROBES: dict[str, Callable[[Column, Column], Column]] = {
    "probe_continuity": probes.source_continuity,
    "probe_progression": lambda t, a: probes.argument_progression(t),
    "probe_mechanism": lambda t, a: probes.real_mechanism_quality(t),
    "probe_jargon": lambda t, a: probes.abstract_jargon_density(t),
    "probe_grounded_specificity": lambda t, a: probes.specificity_without_invention(t, policy.hard(t, a)),
    "probe_mechanism_result": lambda t, a: probes.mechanism_result_alignment(t),
    "probe_causal": lambda t, a: probes.causal_density(t),
    "probe_specificity": lambda t, a: probes.specificity(t),
    "probe_audience": lambda t, a: probes.audience_relevance(t),
    "probe_risk": lambda t, a: probes.persuasion_risk(t),
    "probe_calibration": lambda t, a: probes.epistemic_calibration(t),
}


def _probe(formula: Callable[[Column, Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: texts(spark, folder).select("pair_id", "field", F.round(formula(F.col("text"), F.col("anchor")), 6).alias("value"))


def policy_violations(spark: SparkSession, folder: str) -> DataFrame:
    found = texts(spark, folder).select("pair_id", "field", F.explode(policy.violations(F.col("text"), F.col("anchor"))).alias("v"))
    return found.groupBy("pair_id", "field", F.col("v.violation_type").alias("violation_type")).agg(F.count(F.lit(1)).alias("n"))


def policy_hard_rate(spark: SparkSession, folder: str) -> DataFrame:
    hard = policy.hard(F.col("text"), F.col("anchor"))
    return texts(spark, folder).groupBy("field").agg(F.count(F.lit(1)).alias("texts"), F.count_if(hard).alias("hard"))


def pair_policy_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Valid pairs per type: a pair is dropped if its positive makes an unsupported claim; negatives are only counted."""
    df = pairs(spark, folder).select("pair_type", policy.hard(F.col("positive"), F.col("anchor")).alias("bad"), policy.hard(F.col("negative"), F.col("anchor")).alias("noted"))
    return df.groupBy("pair_type").agg(F.count_if(~F.col("bad")).alias("valid"), F.count_if("bad").alias("dropped"), F.count_if("noted").alias("negatives_noted"))


def cross_eval(spark: SparkSession, folder: str) -> DataFrame:
    rows = cross_evaluate(pairs(spark, folder))
    return rows.groupBy("scorer_id", "split").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if("correct").alias("right"),
        F.round(F.avg("margin"), 6).alias("mean_margin"),
        F.round(F.max(F.greatest("pos_score", "neg_score")) - F.min(F.least("pos_score", "neg_score")), 6).alias("spread"),
        F.count_if(F.coalesce("pos_err", "neg_err").isNotNull()).alias("errors"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _probe(f) for name, f in PROBES.items()} | {
    "policy_violations": policy_violations,
    "policy_hard_rate": policy_hard_rate,
    "pair_policy_filter": pair_policy_filter,
    "cross_eval": cross_eval,
}


# --- the same in DuckDB's SQL ---------------------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {_q(w)})" for w in words) + ")"


def _cnt(x: str, words: list[str]) -> str:
    return "(" + " + ".join(f"contains({x}, {_q(w)})::INT" for w in words) + ")"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(map(_q, words)) + "]"


def _hit(toks: str, words: list[str]) -> str:
    return f"len(list_filter({toks}, lambda w: list_contains({_list(words)}, w)))"


def _clamp(x: str) -> str:
    return f"greatest(0.0, least(1.0, coalesce({x}, 0)))"


#: Letters of other scripts count as word characters, other signs don't; RE2 only knows ASCII words.
_ASCII = r"regexp_replace(regexp_replace({x}, '[^\p{{L}}\p{{N}}\x00-\x7F]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g')"
TEXTS_SQL = f"""
p AS (SELECT * FROM adversarial_pairs WHERE pair_id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY ingested_at DESC, ord DESC) = 1),
s AS (SELECT pair_id, pair_type, regexp_replace(lower(split), '[^a-z]', '', 'g') AS split, coalesce(anchor, '') AS anchor, 'positive' AS field, positive AS text FROM p
      UNION ALL SELECT pair_id, pair_type, regexp_replace(lower(split), '[^a-z]', '', 'g'), coalesce(anchor, ''), 'negative', negative FROM p),
t AS (SELECT *, lower(coalesce(text, '')) AS low, lower(anchor) AS alow, regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z]{{3,}}') AS toks,
      {_ASCII.format(x="coalesce(text, '')")} AS plain, {_ASCII.format(x="anchor")} AS aplain,
      greatest(1, len(regexp_extract_all(text, '[^\\s\\x{{A0}}]+'))) AS words FROM s),
c AS (SELECT *, list_distinct(list_filter(toks, lambda w: NOT list_contains({_list(L.STOP_WORDS)}, w))) AS ct,
      list_distinct(list_filter(regexp_extract_all(alow, '[a-zA-Z]{{3,}}'), lambda w: NOT list_contains({_list(L.STOP_WORDS)}, w))) AS ca,
      len(regexp_extract_all(plain, '{L.CAPITALISED}')) AS caps,
      list_filter(list_distinct(regexp_extract_all(plain, '{L.NUMBER}')), lambda n: NOT list_contains(regexp_extract_all(aplain, '{L.NUMBER}'), n)) AS new_numbers,
      lower(plain) AS lplain, lower(aplain) AS laplain FROM t)"""

_WORD_RULES = [("invented_numeric_word", L.NUMERIC_WORDS), ("invented_award_or_certification_claim", L.AWARDS), ("guarantee_claim", L.GUARANTEES)]
_COMPANY = f"len(list_filter(regexp_extract_all(plain, '{L.COMPANY_NAME}'), lambda m: NOT contains(laplain, lower(m))))"


def _new_words(words: list[str]) -> str:
    return f"len(list_filter({_list(words)}, lambda w: contains(low, w) AND NOT contains(alow, w)))"


def _new_matches(patterns: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN regexp_matches(laplain, '{p}') THEN 0 ELSE len(regexp_extract_all(lplain, '{p}')) END" for p in patterns) + ")"


HARD_SQL = f"(len(new_numbers) > 0 OR {' OR '.join(f'{_new_words(w)} > 0' for _, w in _WORD_RULES)} OR {_new_matches(L.TIME_QUANTITY)} > 0 OR {_new_matches(L.CUSTOMER_CLAIMS)} > 0 OR {_COMPANY} > 0)"


def _part(words: list[str]) -> str:
    own = f"list_intersect(ca, {_list(words)})"
    return f"CASE WHEN len({own}) = 0 THEN 0.5 ELSE len(list_intersect({own}, ct)) / len({own}) END"


def _windows(marker: str, after: bool, width: int) -> str:
    begin = f"i + {len(marker)}" if after else "i"
    return f"list_transform(list_filter(range(1, len(low) + 1), lambda i: substr(low, i, {len(marker)}) = {_q(marker)}), lambda i: substr(low, {begin}, {width}))"


def _mechanism_sql() -> str:
    found = "regexp_extract_all(v, '[a-zA-Z]{3,}')"
    worth = f"0.15 * {_hit(found, L.CONCRETE_TERMS)} - 0.4 * {_cnt('v', L.FAKE_MECHANISMS)}"
    return _clamp(" + ".join(f"coalesce(list_sum(list_transform({_windows(m, False, 80)}, lambda v: {worth})), 0)" for m in L.WINDOW_MARKERS))


def _alignment_sql() -> str:
    def side(markers, first, second, gain, cost, missing):
        clauses = "flatten([" + ", ".join(_windows(m, True, 80) for m in markers) + "])"
        cut = f"list_transform({clauses}, lambda k: regexp_extract_all(regexp_extract(k, '^[^.!?]*'), '[a-z]{{3,}}'))"
        a, b = f"({_hit('k', first)} > 0)", f"({_hit('k', second)} > 0)"
        worth = f"{gain} * {a}::INT + {gain} * {b}::INT - CASE WHEN {_hit('k', L.CLAUSE_JARGON)} > 2 AND NOT {a} AND NOT {b} THEN {cost} ELSE 0 END"
        return f"coalesce(list_sum(list_transform({cut}, lambda k: {worth})), -{missing})"

    return _clamp(side(L.CLAUSE_MECHANISMS, L.CLAUSE_ACTIONS, L.CLAUSE_OBJECTS, 0.2, 0.25, 0.3) + " + " + side(L.CLAUSE_RESULTS, L.CLAUSE_CONSEQUENCES, L.CLAUSE_OPERATIONS, 0.15, 0.2, 0.2))


TOKS, LOW = "toks", "low"
_P, _M, _R = _any("low", L.PROBLEM_MARKERS), _any("low", L.MECHANISM_MARKERS), _any("low", L.RESULT_MARKERS)
_SUPER = f"({_cnt('low', L.SUPERLATIVES)} / greatest(1.0, words / 20))"
_SENTENCES = r"greatest(1, len(regexp_split_to_array(regexp_replace(text, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g'), '[.!?]')))"
PROBE_SQL = {
    "probe_continuity": f"CASE WHEN len(ca) = 0 THEN 0.5 ELSE {_clamp(f'0.5 * len(list_intersect(ca, ct)) / len(ca) + 0.25 * ({_part(L.ACTION_WORDS)}) + 0.25 * ({_part(L.DOMAIN_NOUNS)})')} END",
    "probe_progression": f"CASE WHEN {_P} AND {_M} AND {_R} THEN 1.0 WHEN {_M} AND {_R} THEN 0.7 WHEN {_P} AND {_R} THEN 0.5 WHEN {_M} THEN 0.4 ELSE 0.0 END",
    "probe_mechanism": _mechanism_sql(),
    "probe_jargon": _clamp(f"{_hit('toks', L.JARGON)} / greatest(1.0, len(toks) / 10)"),
    "probe_grounded_specificity": f"CASE WHEN {HARD_SQL} THEN 0.0 ELSE {_clamp(f'caps * 0.08 + {_hit(TOKS, L.SPECIFIC_VERBS)} * 0.15 - {_hit(TOKS, L.JARGON)} * 0.06')} END",
    "probe_mechanism_result": _alignment_sql(),
    "probe_causal": f"CASE WHEN text IS NOT NULL THEN {_clamp(f'{_cnt(LOW, L.CAUSAL_MARKERS)} / greatest(1.0, {_SENTENCES} * 1.5)')} END",
    "probe_specificity": _clamp(f"caps * 0.08 + {_hit('toks', L.GENERAL_VERBS)} * 0.15 - {_hit('toks', L.ABSTRACT_WORDS)} * 0.05"),
    "probe_audience": "CASE WHEN text IS NOT NULL THEN " + _clamp(_cnt("low", L.BEFORE_STATE) + r" * 0.3 + len(regexp_extract_all(lplain, '\b(?:you|your)\b')) / greatest(1.0, words / 8) * 0.5") + " END",
    "probe_risk": f"CASE WHEN text IS NOT NULL THEN {_clamp(_cnt('low', L.HYPE_FLAGS) + ' / greatest(1.0, words / 15)')} END",
    "probe_calibration": f"CASE WHEN text IS NULL THEN NULL WHEN {_SUPER} > 0.4 THEN {_clamp(f'0.1 - {_SUPER} * 0.1')} ELSE {_clamp('0.5 + ' + _cnt('low', L.HEDGES) + ' * 0.1 - ' + _cnt('low', L.SUPERLATIVES) + ' * 0.1')} END",
}
SQL: dict[str, str] = {name: f"WITH {TEXTS_SQL} SELECT pair_id, field, round(({sql})::DOUBLE, 6) AS value FROM c" for name, sql in PROBE_SQL.items()}
SQL["policy_hard_rate"] = f"WITH {TEXTS_SQL} SELECT field, count(*) AS texts, count(*) FILTER ({HARD_SQL}) AS hard FROM c GROUP BY field"
SQL["pair_policy_filter"] = f"""WITH {TEXTS_SQL}, h AS (SELECT pair_id, pair_type, field, {HARD_SQL} AS hard FROM c)
SELECT pair_type, count(*) FILTER (field = 'positive' AND NOT hard) AS valid, count(*) FILTER (field = 'positive' AND hard) AS dropped,
       count(*) FILTER (field = 'negative' AND hard) AS negatives_noted FROM h GROUP BY pair_type"""

_KINDS = {"invented_numeric_digit": "len(new_numbers)", "invented_time_or_quantity_claim": _new_matches(L.TIME_QUANTITY), "invented_customer_or_company_claim": f"{_new_matches(L.CUSTOMER_CLAIMS)} + {_COMPANY}"} | {k: _new_words(w) for k, w in _WORD_RULES}
SQL["policy_violations"] = f"WITH {TEXTS_SQL}, k AS (" + " UNION ALL ".join(f"SELECT pair_id, field, '{k}' AS violation_type, ({x})::BIGINT AS n FROM c" for k, x in _KINDS.items()) + ") SELECT * FROM k WHERE n > 0"
_C = {
    "S_r0_001": "CASE WHEN jar > 0.3 THEN 0 ELSE CL((0.5*prog + 0.3*mech + 0.2*greatest(0, rmq)) * (0.5 + 0.5*cont)) END",
    "S_r0_002": "CL(greatest(0, 0.4*rel + 0.6*least(mech*(1+0.25*rel), 1.25*mech)) * (0.6 + 0.4*cont) - 0.5*greatest(0, jar - 0.1))",
    "S_r0_003": "CASE WHEN jar > 0.25 THEN CL(0.1 - jar) ELSE CL((0.4*swi + 0.3*ep + 0.3*prog) * (0.5 + 0.5*cont)) END",
    "S_r0_004": "CASE WHEN jar > 0.35 THEN 0 ELSE CL((0.4*(CASE WHEN prog >= 0.4 THEN prog ELSE 0.4*prog END) + 0.4*swi + 0.2*mech) * (0.5 + 0.5*cont)) END",
    "S_r0_005": "CL((0.3*mech + 0.3*spec + 0.25*prog + 0.15*ep) * CL(1 + (ep - 0.5)*0.4) * (0.6 + 0.4*cont) * (1 - 0.5*greatest(risk, 0.6*jar)))",
    "S_r0_006": "CL((0.5*mech + 0.5*prog) * (0.4 + 0.6*greatest(0.2, cont)) * (1 - 0.5*jar))",
    "S_r0_007": "CASE WHEN jar > 0.25 THEN CL(0.1*prog*rmq) ELSE CL(0.5*prog + 0.5*CL(rmq)) END",
    "S_r0_008": "CL((0.5*swi - 0.3*jar - 0.2*risk) * (0.5 + 0.5*cont))",
    "S_r1_001": "CASE WHEN jar > 0.25 THEN CL(0.1*prog) ELSE CL((0.55*prog + 0.45*rmq) * (0.5 + 0.5*cont)) END",
    "S_r1_002": "CL((0.6*mech*(1 + 0.3*rel*rmq) + 0.4*rel) * (0.6 + 0.4*cont) * (1 - 0.6*jar))",
    "S_r1_003": "CASE WHEN jar > 0.3 THEN 0 ELSE CL((CASE WHEN prog < 0.4 THEN 0.5*prog*swi ELSE 0.5*prog + 0.5*swi END) * (0.5 + 0.5*cont)) END",
    "S_r1_004": "CASE WHEN jar > 0.2 THEN CL(0.15*prog) ELSE CL((0.4*prog + 0.4*rmq + 0.2*swi) * (0.5 + 0.5*cont)) END",
    "S_r1_005": "CL((0.35*prog + 0.35*rmq + 0.3*swi - 0.5*jar) * CL(1 + (ep - 0.5)*0.3) * (0.5 + 0.5*cont))",
    "S_r1_006": "CL(0.4*cont + 0.6*CL(0.5*prog + 0.5*rmq - 0.4*jar))",
}
_NULL_SAFE = ("S_r0_007", "S_r1_001", "S_r1_003", "S_r1_004", "S_r1_006")
_SHORT = {"cont": "continuity", "prog": "progression", "rmq": "mechanism", "jar": "jargon", "swi": "grounded_specificity", "mech": "causal", "spec": "specificity", "rel": "audience", "risk": "risk", "ep": "calibration"}
SCORED_SQL = f"""{TEXTS_SQL},
pr AS MATERIALIZED (SELECT pair_id, pair_type, split, field, text, {HARD_SQL} AS hard, {", ".join(f"({PROBE_SQL['probe_' + v]})::DOUBLE AS {k}" for k, v in _SHORT.items())} FROM c),
sc AS ({" UNION ALL ".join(f"SELECT pair_id, pair_type, split, field, '{k}' AS scorer_id, " + (f"CASE WHEN text IS NULL THEN 0.5 WHEN hard THEN 0 ELSE {v} END" if k not in _NULL_SAFE else f"CASE WHEN hard THEN 0 ELSE {v} END").replace("CL(", "clamp01(") + f" AS score, (text IS NULL AND {str(k not in _NULL_SAFE).lower()}) AS failed FROM pr" for k, v in _C.items())}),
ev AS (SELECT a.pair_id, a.pair_type, a.split, a.scorer_id, a.score AS pos_score, b.score AS neg_score, a.failed OR b.failed AS failed
       FROM sc a JOIN sc b USING (pair_id, scorer_id) WHERE a.field = 'positive' AND b.field = 'negative')"""


def _inlined(sql: str) -> str:
    """Writes out the clamping of every formula."""
    while (at := sql.find("clamp01(")) >= 0:
        depth, i = 0, at + len("clamp01(")
        begin = i
        while depth >= 0:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        sql = f"{sql[:at]}greatest(0.0, least(1.0, coalesce({sql[begin : i - 1]}, 0))){sql[i:]}"
    return sql


SQL["cross_eval"] = _inlined(
    f"""WITH {SCORED_SQL} SELECT scorer_id, split, count(*) AS pairs, count(*) FILTER (pos_score > neg_score) AS "right",
round(avg(pos_score - neg_score), 6) AS mean_margin, round(max(greatest(pos_score, neg_score)) - min(least(pos_score, neg_score)), 6) AS spread,
count(*) FILTER (failed) AS errors FROM ev GROUP BY scorer_id, split"""
)
