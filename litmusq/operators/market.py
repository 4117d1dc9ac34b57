"""Marketplace analytics: random-access draws, buyers, conversions, sweeps, roll-ups, pages, shares and ordered folds.

The random stream is a counter generator whose k-th draw is a function of the
seed and k alone, so a million draws need no loop: any executor can make any of
them, and they equal those of the sequential stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MASK, _STEP = 0xFFFFFFFF, 0x6D2B79F5
SEGMENTS = ["sg_ai_founder", "sg_creator_editor", "sea_b2b_marketer", "hackathon_builder", "indie_hacker", "vc_analyst", "student_creator", "agency_copywriter"]


def _mul32(a: Column, b: Column) -> Column:
    """The low 32 bits of a product; halves keep it inside a bigint."""
    low = a.bitwiseAND(F.lit(0xFFFF)) * b
    high = (F.shiftright(a, 16) * b).bitwiseAND(F.lit(0xFFFF)) * F.lit(65536)
    return (low + high).bitwiseAND(F.lit(_MASK))


def draw(seed: Column | int, k: Column) -> Column:
    """The k-th draw (from 0) in [0, 1) of the stream of a seed."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    s = (seed.cast("bigint") + (k.cast("bigint") + 1) * F.lit(_STEP)).bitwiseAND(F.lit(_MASK))
    # a one-element transform names an intermediate value, so it is computed once
    mixed = F.transform(F.array(s), lambda x: _mul32(x.bitwiseXOR(F.shiftright(x, 15)), x.bitwiseOR(F.lit(1))))
    turned = F.transform(mixed, lambda t: (t + _mul32(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(_MASK)).bitwiseXOR(t))
    return F.get(F.transform(turned, lambda t: t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(4294967296.0)), 0)


def population(ids: DataFrame, seed: int) -> DataFrame:
    """Buyers from (i): the eight attributes of buyer i are draws 8i to 8i + 7."""
    d = [draw(seed, F.col("i") * 8 + j) for j in range(8)]
    return ids.select(
        "i",
        F.element_at(F.array(*map(F.lit, SEGMENTS)), F.floor(d[0] * 8).cast("int") + 1).alias("segment"),
        d[1].alias("pain"), d[2].alias("price_resistance"), (d[3] * 0.5).alias("trust_gap"), d[4].alias("social"), d[5].alias("affinity"),
        (F.lit(1) + F.floor(d[6] * 2)).alias("preferences"), (F.lit(800) + F.floor(d[7] * 1200)).alias("pays_cents"),
    )


def conversion(price: Column, quality: float = 0.8, reveals: float = 20.0) -> Column:
    """Logistic probability that a buyer converts at a price in cents."""
    ratio = price / F.greatest(F.lit(1), F.col("pays_cents"))
    x = -2.0 + 1.2 * F.col("pain") + F.col("affinity") + 0.9 * quality + 0.7 * (reveals / 100) * F.col("social") + F.when(F.col("preferences") > 1, 0.8).otherwise(0.3) - 1.4 * F.col("price_resistance") * F.greatest(F.lit(0.0), ratio - 0.7) - 0.5 * F.col("trust_gap")
    return 1 / (1 + F.exp(-x))


def price_sweep(buyers: DataFrame, n: int, seed: int, prices: list[int]) -> DataFrame:
    """Conversions and revenue at each price; the decision of buyer i is draw 8n + i of the stream seed + price."""
    grid = buyers.select("*", F.explode(F.array(*[F.lit(p) for p in prices])).alias("price"))
    won = draw(F.lit(seed) + F.col("price"), F.lit(8 * n) + F.col("i")) < conversion(F.col("price"))
    return grid.groupBy("price").agg(F.count(F.lit(1)).alias("buyers"), F.count_if(won).alias("conversions"), F.sum(F.when(won, F.col("price")).otherwise(0)).alias("revenue_cents"))


def impressions(buyers: DataFrame, days: int, seed: int, price: int) -> DataFrame:
    """One row per day and buyer with a decision drawn by a counter of both; statistically the day loop, without its order."""
    grid = buyers.select("*", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("day"))
    return grid.withColumn("converts", draw(F.lit(seed) + F.col("day") * 7919, F.col("i")) < conversion(F.lit(price)))


def capped(rows: DataFrame, order: list[str], cap: int) -> DataFrame:
    """Marks the first ``cap`` rows in order; only those are gathered, never the rest."""
    first = rows.orderBy(*order).limit(cap).select(*order).withColumn("real", F.lit(True))
    return rows.join(F.broadcast(first), order, "left").withColumn("real", F.coalesce("real", F.lit(False)))  # at most ``cap`` rows


def dashboard(sales: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """Totals per inner, per outer and overall, in one pass."""
    return sales.rollup(outer, inner).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of rows with the number of all and whether more follow."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total)).withColumn("has_next", F.col("total") > offset + limit)  # one row


def dominant_share(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group, its share, and if it is at least 0.8; ties to the smaller value."""
    n = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    out = n.groupBy(group).agg(F.sum("n").alias("rows"), F.max("n").alias("most"), F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("dominant"))
    return out.select(group, "dominant", (F.col("most") / F.col("rows")).alias("share"), (F.col("most") / F.col("rows") >= 0.8).alias("dominates"))


def quota(weights: DataFrame, name: str, weight: str, total: int) -> DataFrame:
    """Largest-remainder allocation of ``total``; ties of the remainder to the greater name."""
    raw = F.col(weight) * total
    left = F.lit(total) - F.sum(F.floor(raw)).over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc(F.round(raw - F.floor(raw), 12)), F.desc(name)))
    return weights.select(name, (F.floor(raw) + F.when(place <= left, 1).otherwise(0)).alias("quota"))


def running_mean(rows: DataFrame, key: str, order: str, value: str, width: int) -> DataFrame:
    """(key, order, running): the mean of all values of a key up to each row, in order of a whole number.

    Rows are sorted within ranges of ``width`` only; what came before a range is
    a sum over ranges, so a hot key is many small sorts.  Nulls count for nothing.
    """
    r = rows.select(key, order, F.col(value).alias("_v"), F.floor(F.col(order) / width).alias("_range"))
    within = Window.partitionBy(key, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    sums = r.groupBy(key, "_range").agg(F.sum("_v").alias("_s"), F.count("_v").alias("_n"))
    sums = sums.select(key, "_range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before{c}") for c in ("_s", "_n")])
    out = r.withColumn("_s", F.coalesce(F.sum("_v").over(within), F.lit(0.0))).withColumn("_n", F.count("_v").over(within)).join(sums, [key, "_range"])
    return out.select(key, order, F.try_divide(F.col("_before_s") + F.col("_s"), F.col("_before_n") + F.col("_n")).alias("running"))


def fold_states(events: DataFrame, key: str, order: str, to: str, start: str, allowed: dict[str, list[str]], part: Column | None = None) -> DataFrame:
    """(key, state, applied, rejected): events of a key applied in order, those not allowed from the state skipped.

    ``part`` splits the order (a date of a time, say; it must not run against
    it).  The events of one part are folded from every state they may find, and
    the parts of a key are put together after, so no task holds a whole key.
    """
    table = F.create_map(*[x for k, v in allowed.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>"))])
    states = sorted({start, *allowed, *[t for v in allowed.values() for t in v]})
    moves = events.groupBy(key, (part if part is not None else F.lit(0)).alias("_part")).agg(F.array_sort(F.collect_list(F.struct(order, to))).alias("moves"))
    zero = lambda s: F.struct(s.alias("state"), F.lit(0).alias("applied"), F.lit(0).alias("rejected"))

    def step(acc: Column, m: Column) -> Column:
        ok = F.coalesce(F.array_contains(F.coalesce(F.try_element_at(table, acc["state"]), F.array().cast("array<string>")), m[to]), F.lit(False))
        return F.struct(F.when(ok, m[to]).otherwise(acc["state"]).alias("state"), (acc["applied"] + ok.cast("int")).alias("applied"), (acc["rejected"] + (~ok).cast("int")).alias("rejected"))

    folded = F.map_from_arrays(F.array(*map(F.lit, states)), F.array(*[F.aggregate("moves", zero(F.lit(s)), step) for s in states]))
    parts = moves.select(key, F.struct("_part", folded.alias("from")).alias("p")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("p._part").alias("part"), F.map_entries("p.from").alias("from")))).alias("parts"))

    def join(acc: Column, p: Column) -> Column:
        f = F.get(F.filter(p["from"], lambda e: e["key"] == acc["state"]), 0)["value"]
        return F.struct(f["state"].alias("state"), (acc["applied"] + f["applied"]).alias("applied"), (acc["rejected"] + f["rejected"]).alias("rejected"))

    return parts.select(key, F.aggregate("parts", zero(F.lit(start)), join).alias("f")).select(key, "f.*")


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of every key, by order."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")
