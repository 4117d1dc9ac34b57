"""Panels of personas: best fits, overrides, calibration, summaries, and the small joins around them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token_estimate(text: Column) -> Column:
    """About as many tokens as 1.35 times the words, at least 1; a null text has none and counts 1."""
    words = F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0)))
    return F.greatest(F.lit(1), F.floor(words * 1.35).cast("int"))


def hash31(text: Column) -> Column:
    """The 32-bit hash that multiplies by 31 and adds each code point, as a signed integer; 0 for null and empty."""
    codes = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    low = F.aggregate(codes, F.lit(0).cast("bigint"), lambda s, c: (s * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(low >= 2**31, low - 2**32).otherwise(low)


def idempotency_key(*parts: Column) -> Column:
    """The same for the same parts, nulls told from empty texts."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts]), {"ignoreNullFields": "false"}), 256)


def best_fit(personas: DataFrame, cards: list[dict], fit: Callable[[Column], Column], least: float = 0.0) -> DataFrame:
    """``personas`` with the card (its ``id``) that fits best and how well; ties to the earlier card, the first card where none is above ``least``.

    Cards are few and stated, so they are an array in the row, not a join.
    """
    structs = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in c.items()]) for c in cards])
    scored = F.transform(structs, lambda c: F.struct(fit(c).cast("double").alias("fit"), c["id"].alias("id")))
    start = F.struct(F.lit(float(least)).alias("fit"), F.lit(cards[0]["id"]).alias("id"))
    best = F.aggregate(scored, start, lambda a, b: F.when(b["fit"] > a["fit"], b).otherwise(a))
    return personas.withColumn("_b", best).select("*", F.col("_b.id").alias("card"), F.col("_b.fit").alias("fit")).drop("_b")


def overridden(base: DataFrame, answers: DataFrame, key: str, shares: list[str], flags: list[str]) -> DataFrame:
    """Every row of ``base`` with the fields an answer has in place of its own.

    Shares that are numbers are cut to [0, 1], others stay the base's; flags as
    text are true for true, yes and 1.  Answers of unknown keys go; of several
    answers of a key one is kept, the greatest by its fields.
    """
    given = answers.select(key, F.struct(*[F.col(c).cast("string").alias(c) for c in (*shares, *flags)]).alias("_g")).groupBy(key).agg(F.max("_g").alias("_g"))
    out = base.join(given, key, "left")
    number = lambda c: F.col(f"_g.{c}").try_cast("double")
    cells = {c: F.when(number(c).isNull() | F.isnan(number(c)), F.col(c)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number(c)))) for c in shares}
    cells |= {c: F.when(F.col(f"_g.{c}").isNull(), F.col(c)).otherwise(F.lower(F.trim(F.col(f"_g.{c}"))).isin("true", "yes", "1")) for c in flags}
    return out.withColumns(cells).drop("_g")


def calibration(expected: DataFrame, binary: DataFrame, by: str) -> DataFrame:
    """(by, expected_conversion_rate, binary_conversion_rate, delta, flags) of expected rates (by, expected_conversion_rate) and decisions (by, binary_conversion_rate).

    A market without decisions keeps its row, without flags about them.
    """
    both = expected.join(binary, by, "left").withColumn("delta", F.col("binary_conversion_rate") - F.col("expected_conversion_rate"))
    flags = [
        (F.col("binary_conversion_rate") > 0.5, "binary_over_half"),
        (F.abs("delta") > 0.1, "differs_by_ten_points"),
        (F.col("expected_conversion_rate") > 0.45, "expected_high"),
    ]
    return both.select(by, "expected_conversion_rate", "binary_conversion_rate", "delta", F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in flags])).alias("flags"))


def live_summary(results: DataFrame) -> DataFrame:
    """One row of (will_buy, price_cents): personas, buyers, bounced, conversion_rate, total_revenue_cents; no personas give rate 0."""
    buys = F.coalesce("will_buy", F.lit(False))
    return results.agg(F.count(F.lit(1)).alias("personas_total"), F.count_if(buys).alias("buyers"), F.coalesce(F.sum(F.when(buys, F.coalesce("price_cents", F.lit(0)))), F.lit(0)).cast("bigint").alias("total_revenue_cents")).select(
        "personas_total", "buyers", (F.col("personas_total") - F.col("buyers")).alias("bounced"), F.round(F.coalesce(F.try_divide("buyers", "personas_total"), F.lit(0.0)), 3).alias("conversion_rate"), "total_revenue_cents"
    )


def demand(intent: Column, price_cents: Column, fits: Column) -> Column:
    """The probability that a segment of a base intent reveals at a price; ``fits`` tells if the card names what it is best for."""
    price = price_cents / 100
    curve = 1 / (1 + F.exp((price - 6.0) / (6.0 * 0.35)))
    base = F.coalesce(intent, F.lit(0.4)) * 0.65 + F.when(fits, 0.15).otherwise(0.0) + 0.1
    return F.greatest(F.lit(0.01), F.least(F.lit(0.95), base)) * curve * 0.85


def judged(e: DataFrame, *by: str) -> DataFrame:
    """Accuracy and mean gap of judged pairs (split, positive, negative: 0 to 10) per scorer, with the judge's own membership rule.

    Membership is a threshold here, not dominance; a scorer without held-out pairs has 0 of both.
    """
    gap = F.col("positive") - F.col("negative")
    part = lambda s: F.when(F.col("split") == s, gap)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = e.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pairs_evaluated"),
        zero(F.avg((part("train") > 0).cast("double"))).alias("train_accuracy"),
        zero(F.avg(part("train"))).alias("train_mean_gap"),
        zero(F.avg((part("heldout") > 0).cast("double"))).alias("heldout_accuracy"),
        zero(F.avg(part("heldout"))).alias("heldout_mean_gap"),
        F.bool_or(F.col("positive") != F.col("negative")).alias("nonconstant"),
    )
    a, g = F.col("heldout_accuracy"), F.col("heldout_mean_gap")
    return out.withColumn("eligible", (a >= 0.5) & (g > 0)).withColumn("pareto_member", (a >= 0.6) & (g > 0.5))


def round_robin(items: DataFrame, place: str, pool: DataFrame, position: str) -> DataFrame:
    """Items (place from 0) each with the pool's row at place modulo its size; an empty pool leaves them without."""
    size = pool.agg(F.count(F.lit(1)).alias("_n"))  # one row
    return items.crossJoin(F.broadcast(size)).withColumn("_at", F.expr(f"try_mod({place}, _n)")).join(pool.withColumnRenamed(position, "_at"), "_at", "left").drop("_at", "_n")


def histogram(items: DataFrame, column: str) -> DataFrame:
    """How often each value (each element, of a list) occurs."""
    many = dict(items.dtypes)[column].startswith("array")
    return items.select((F.explode(column) if many else F.col(column)).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """``df`` with ``draw``, whose order is a shuffle told by key and seed alone; nothing is sorted here."""
    return df.withColumn("draw", F.xxhash64(F.col(key), F.lit(seed)))


def merged(left: Column, right: Column) -> Column:
    """Two maps in one; where both have a key the right one's value holds, even if null.  A null map is empty."""
    none = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(left, none), F.coalesce(right, none)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
