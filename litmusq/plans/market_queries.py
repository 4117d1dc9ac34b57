"""Queries of the marketplace analytics, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from litmusq.operators import market as M
from litmusq.plans.eval_queries import RANGE, _round, facts
from litmusq.sources.tables import table

SEED, PRICES, DAYS = 42, [500, 900, 1400], 5
MOVES = {"new": ["checkout"], "checkout": ["paid", "new"], "paid": ["done"], "done": ["back"], "back": []}


def buyers(spark: SparkSession, folder: str) -> DataFrame:
    return M.population(table(spark, folder, "customer", "c_custkey").select((F.col("c_custkey") - 1).alias("i")), SEED)


def conversion_prob(spark: SparkSession, folder: str) -> DataFrame:
    return buyers(spark, folder).select("i", "segment", "pays_cents", *[F.round(M.conversion(F.lit(p)), 6).alias(f"p_{p}") for p in PRICES])


def price_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return M.price_sweep(buyers(spark, folder), 1000, SEED, PRICES)


def revenue_by_segment(spark: SparkSession, folder: str) -> DataFrame:
    won = M.impressions(buyers(spark, folder), DAYS, SEED, 900).where("converts")
    return won.groupBy("segment").agg(F.count(F.lit(1)).alias("conversions"), (F.count(F.lit(1)) * 900).alias("revenue_cents"))


def session_cap(spark: SparkSession, folder: str) -> DataFrame:
    won = M.impressions(buyers(spark, folder), DAYS, SEED, 900).where("converts").select("day", "i", "segment")
    return M.capped(won, ["day", "i"], 50).groupBy("real").agg(F.count(F.lit(1)).alias("sessions"), F.max("day").alias("last_day"))


def running_satisfaction(spark: SparkSession, folder: str) -> DataFrame:
    """Running mean of the scores of each scorer in order of evaluation."""
    return _round(M.running_mean(facts(spark, folder), "scorer_id", "eval_id", "p", RANGE))


def _sales(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem", "l_suppkey", "l_returnflag", "l_extendedprice").withColumn("cents", F.round(F.col("l_extendedprice") * 100).cast("bigint"))


def listing_page(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part", "p_partkey", "p_brand", "p_retailprice").where(F.col("p_retailprice").between(950, 1400))
    return M.page(rows, [F.col("p_partkey")], 20, 10)


def date_range(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders", "o_orderkey", "o_orderdate", "o_totalprice").where(F.col("o_orderdate").between(F.lit("1995-01-01").cast("timestamp"), F.lit("1996-12-31").cast("timestamp")))
    return o.agg(F.count(F.lit(1)).alias("orders"), F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"))


def segment_groupings(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer", "c_nationkey", "c_mktsegment", "c_acctbal").join(table(spark, folder, "nation", "n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    c.createOrReplaceTempView("_litmusq_groupings")
    return spark.sql("""SELECT n_regionkey, c_mktsegment, coalesce(cast(n_nationkey AS string), 'all') AS nation, count(*) AS n, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal) + 1e-9, 4) AS mean FROM _litmusq_groupings
        GROUP BY GROUPING SETS ((n_regionkey), (n_regionkey, c_mktsegment), (n_regionkey, n_nationkey))""")


def best_price_per_market(spark: SparkSession, folder: str) -> DataFrame:
    """The discount with the greatest revenue in each return flag."""
    per = table(spark, folder, "lineitem", "l_returnflag", "l_discount", "l_extendedprice").groupBy("l_returnflag", "l_discount").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("take"))
    order = Window.partitionBy("l_returnflag").orderBy(F.desc("take"), "l_discount")
    return per.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def quota_allocation(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "customer", "c_mktsegment").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    w = n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select("c_mktsegment", (F.col("n") / F.col("t")).alias("w"))  # one row
    return M.quota(w, "c_mktsegment", "w", 101)


_TO = "CASE event_type WHEN 'signup' THEN 'new' WHEN 'view' THEN 'checkout' WHEN 'purchase' THEN 'paid' WHEN 'click' THEN 'done' ELSE 'back' END"


def state_fold(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events", "event_id", "user_id", "ts", "event_type").select("user_id", F.struct("ts", "event_id").alias("at"), F.expr(_TO).alias("to"))
    return M.fold_states(e, "user_id", "at", "to", "new", MOVES, F.to_date("at.ts"))


def transition_audit(spark: SparkSession, folder: str) -> DataFrame:
    """How often each step follows another in a user's events."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, folder, "events", "event_id", "user_id", "ts", "event_type").select(F.expr(_TO).alias("to"), F.lag(F.expr(_TO)).over(order).alias("before"))
    return e.where("before IS NOT NULL").groupBy("before", "to").agg(F.count(F.lit(1)).alias("n"))


def keep_first(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events", "event_id", "user_id", "event_type", "ts")
    return M.keep_first(e, ["user_id", "event_type"], ["ts", "event_id"])


def json_props(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, folder, "events", "event_type", "props").groupBy("event_type").agg(F.sum(k).alias("total"), F.max(k).alias("greatest"), F.count_if(k.isNull()).alias("missing"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "buyer_population": lambda s, d: _round(buyers(s, d)),
    "conversion_prob": conversion_prob,
    "price_sweep": price_sweep,
    "revenue_by_segment": revenue_by_segment,
    "session_cap": session_cap,
    "running_satisfaction": running_satisfaction,
    "creator_dashboard": lambda s, d: M.dashboard(_sales(s, d), "l_suppkey", "l_returnflag", "cents").withColumn("l_suppkey", F.coalesce(F.col("l_suppkey").cast("string"), F.lit("all"))),
    "listing_page": listing_page,
    "date_range": date_range,
    "segment_groupings": segment_groupings,
    "dominant_share": lambda s, d: _round(M.dominant_share(table(s, d, "documents", "source", "doc_kind"), "source", "doc_kind")),
    "best_price_per_market": best_price_per_market,
    "quota_allocation": quota_allocation,
    "state_fold": state_fold,
    "transition_audit": transition_audit,
    "webhook_dedup": keep_first,
    "json_props": json_props,
}


def _mul(a: str, b: str) -> str:
    return f"(((({a}) & 65535) * ({b}) + (((({a}) >> 16) * ({b})) & 65535) * 65536) & 4294967295)"


def _draws(source: str, seed: str, k: str, out: str, name: str) -> str:
    """CTEs that add the draw ``out`` to a source."""
    return f"""{name}1 AS (SELECT *, (({seed})::BIGINT + (({k})::BIGINT + 1) * 1831565813) & 4294967295 AS s_ FROM {source}),
{name}2 AS (SELECT * EXCLUDE (s_), {_mul("xor(s_, s_ >> 15)", "s_ | 1")} AS t_ FROM {name}1),
{name}3 AS (SELECT * EXCLUDE (t_), xor((t_ + {_mul("xor(t_, t_ >> 7)", "t_ | 61")}) & 4294967295, t_) AS u_ FROM {name}2),
{name} AS (SELECT * EXCLUDE (u_), xor(u_, u_ >> 14) / 4294967296.0 AS {out} FROM {name}3)"""


_POP = "b0 AS (SELECT c_custkey - 1 AS i FROM customer)," + ",".join(_draws(f"b{j}", str(SEED), f"i * 8 + {j}", f"d{j}", f"b{j + 1}") for j in range(8))
_POP += f""", pop AS (SELECT i, [{", ".join(f"'{x}'" for x in M.SEGMENTS)}][floor(d0 * 8)::INT + 1] AS segment, d1 AS pain, d2 AS price_resistance, d3 * 0.5 AS trust_gap, d4 AS social, d5 AS affinity, 1 + floor(d6 * 2)::BIGINT AS preferences, 800 + floor(d7 * 1200)::BIGINT AS pays_cents FROM b8)"""


def _conv(price: str) -> str:
    return f"(1 / (1 + exp(-(-2.0 + 1.2 * pain + affinity + 0.9 * 0.8 + 0.7 * 0.2 * social + CASE WHEN preferences > 1 THEN 0.8 ELSE 0.3 END - 1.4 * price_resistance * greatest(0, {price} / greatest(1, pays_cents) - 0.7) - 0.5 * trust_gap))))"


_IMP = f"{_POP}, gi AS (SELECT *, unnest(range({DAYS})) AS day FROM pop), {_draws('gi', f'{SEED} + day * 7919', 'i', 'z', 'im')}, won AS (SELECT * FROM im WHERE z < {_conv('900')})"
_FACTS = "e AS (SELECT *, coalesce(pos_score, 0.5) AS p FROM eval_rows WHERE eval_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY eval_id ORDER BY ingested_at DESC, evaluated_at DESC) = 1)"
SQL: dict[str, str] = {
    "buyer_population": f"WITH {_POP} SELECT i, segment, {', '.join(f'round({c} + 1e-9, 6) AS {c}' for c in ('pain', 'price_resistance', 'trust_gap', 'social', 'affinity'))}, preferences, pays_cents FROM pop",
    "conversion_prob": f"WITH {_POP} SELECT i, segment, pays_cents, {', '.join(f'round({_conv(str(p))}, 6) AS p_{p}' for p in PRICES)} FROM pop",
    "price_sweep": f"WITH {_POP}, g AS (SELECT *, unnest({PRICES}) AS price FROM pop), {_draws('g', f'{SEED} + price', '8000 + i', 'z', 'w')} SELECT price, count(*) AS buyers, count(*) FILTER (z < {_conv('price')}) AS conversions, sum(CASE WHEN z < {_conv('price')} THEN price ELSE 0 END)::BIGINT AS revenue_cents FROM w GROUP BY price",
    "revenue_by_segment": f"WITH {_IMP} SELECT segment, count(*) AS conversions, count(*) * 900 AS revenue_cents FROM won GROUP BY segment",
    "session_cap": f"WITH {_IMP}, r AS (SELECT day, row_number() OVER (ORDER BY day, i) <= 50 AS real FROM won) SELECT real, count(*) AS sessions, max(day)::INT AS last_day FROM r GROUP BY real",
    "running_satisfaction": f"WITH {_FACTS} SELECT scorer_id, eval_id, round(avg(p) OVER (PARTITION BY scorer_id ORDER BY eval_id ROWS UNBOUNDED PRECEDING) + 1e-9, 6) AS running FROM e",
    "creator_dashboard": "SELECT coalesce(l_suppkey::VARCHAR, 'all') AS l_suppkey, l_returnflag, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS total, count(*) AS n, grouping(l_suppkey, l_returnflag)::BIGINT AS level FROM lineitem GROUP BY ROLLUP (l_suppkey, l_returnflag)",
    "listing_page": "WITH r AS (SELECT p_partkey, p_brand, p_retailprice FROM part WHERE p_retailprice BETWEEN 950 AND 1400) SELECT *, (SELECT count(*) FROM r) AS total, (SELECT count(*) FROM r) > 30 AS has_next FROM r ORDER BY p_partkey LIMIT 10 OFFSET 20",
    "date_range": "SELECT count(*) AS orders, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'",
    "segment_groupings": "SELECT n_regionkey, c_mktsegment, coalesce(n_nationkey::VARCHAR, 'all') AS nation, count(*) AS n, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal) + 1e-9, 4) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((n_regionkey), (n_regionkey, c_mktsegment), (n_regionkey, n_nationkey))",
    "dominant_share": "WITH n AS (SELECT source, doc_kind, count(*) AS n FROM documents GROUP BY ALL), k AS (SELECT *, sum(n) OVER (PARTITION BY source) AS t FROM n QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, doc_kind) = 1) SELECT source, doc_kind AS dominant, round(n / t + 1e-9, 6) AS share, n / t >= 0.8 AS dominates FROM k",
    "best_price_per_market": "WITH p AS (SELECT l_returnflag, l_discount, round(sum(l_extendedprice * (1 - l_discount)), 2) AS take FROM lineitem GROUP BY ALL) SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY take DESC, l_discount) = 1",
    "quota_allocation": "WITH n AS (SELECT c_mktsegment, count(*) * 101 / sum(count(*)) OVER () AS raw FROM customer GROUP BY c_mktsegment) SELECT c_mktsegment, (floor(raw) + CASE WHEN row_number() OVER (ORDER BY round(raw - floor(raw), 12) DESC, c_mktsegment DESC) <= 101 - sum(floor(raw)) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM n",
    "transition_audit": f"WITH l AS (SELECT {_TO} AS \"to\", lag({_TO}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT before, \"to\", count(*) AS n FROM l WHERE before IS NOT NULL GROUP BY ALL",
    "webhook_dedup": "SELECT user_id, event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "json_props": "SELECT event_type, sum((props->>'$.k')::INT)::BIGINT AS total, max((props->>'$.k')::INT) AS greatest, count(*) FILTER ((props->>'$.k') IS NULL) AS missing FROM events GROUP BY event_type",
    "state_fold": f"""WITH RECURSIVE s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, {_TO} AS m FROM events),
        f AS (SELECT DISTINCT user_id, 0::BIGINT AS k, 'new' AS state, 0 AS applied, 0 AS rejected FROM s UNION ALL
        SELECT f.user_id, s.k, CASE WHEN ok THEN m ELSE state END, applied + ok::INT, rejected + (NOT ok)::INT FROM f JOIN (SELECT s.*, t.a, t.b FROM s CROSS JOIN (SELECT 1 AS a, 1 AS b) t) s ON s.user_id = f.user_id AND s.k = f.k + 1,
        LATERAL (SELECT ({" OR ".join(f"(state = '{a}' AND m = '{b}')" for a, v in MOVES.items() for b in v)}) AS ok) o)
        SELECT user_id, state, applied, rejected FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1""",
}
