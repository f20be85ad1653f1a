"""Order without one task for all rows: order statistics by key, the first n of an order, and as-of attachment.

Keys may be null; rows whose value is null take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import stored

#: rank error of the sketches that point at an order statistic, as a share of a key's rows, and how many times that lies between the borders
_ACCURACY, _MARGIN = 10_000, 10


def with_facts(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with facts on keys, of which null equals null."""
    other = facts.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[c for c in facts.columns if c not in keys])
    if not keys:
        return rows.crossJoin(F.broadcast(other))  # one row
    on = F.lit(True)
    for k in keys:
        on = on & rows[k].eqNullSafe(other[f"_of_{k}"])
    return rows.join(other, on, how).drop(*[f"_of_{k}" for k in keys])


def order_statistics(rows: DataFrame, keys: list[str], x: str, ranks: list[tuple[str, float, Column]], weight: str | None = None) -> DataFrame:
    """keys, _n and a column a rank: for (name, share, rank) the value at place `rank` (from 0, an expression of _n) of a key's sorted values.

    Selection in parts: mergeable sketches give each key borders around the share of its rows where the rank must be; one pass
    counts what lies between borders by value and the rest by part, and only the few values between borders are ordered. Rows are
    shuffled as counts; a key that holds most of the table leaves some thousandths of its values to one task. share should be near rank / _n.
    The borders are written, so that their size is known and few of them go to the rows instead of rows to them. weight: how many equal rows a row stands for.
    """
    if weight:
        return _weighted_statistics(rows, keys, x, ranks, weight)
    rows = rows.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"))
    e = _MARGIN / _ACCURACY
    shares = [max(0.0, min(1.0, s + d)) for _, s, _ in sorted(ranks, key=lambda r: r[1]) for d in (-e, e)]
    bounds = rows.groupBy(*keys).agg(F.percentile_approx("_x", shares, _ACCURACY).alias("_b"), F.count(F.lit(1)).alias("_n"))
    bounds = stored(bounds, "borders") if keys else bounds
    inside = F.expr(" or ".join(f"(_x >= _b[{i}] and _x <= _b[{i + 1}])" for i in range(0, len(shares), 2)))
    part = F.coalesce(F.array_max(F.filter("_b", lambda b: b < F.col("_x"))), F.lit(float("-inf")))
    marked = with_facts(rows, bounds, keys).select(*keys, "_n", F.when(inside, F.col("_x")).otherwise(part).alias("_v"), (~inside).cast("int").alias("_rest"))
    counted = marked.groupBy(*keys, "_n", "_v", "_rest").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(*keys).orderBy("_v", "_rest").rowsBetween(W.unboundedPreceding, 0))
    placed = counted.withColumn("_upto", upto)
    at = lambda rank: F.max(F.when((F.col("_rest") == 0) & (rank >= F.col("_upto") - F.col("_c")) & (rank < F.col("_upto")), F.col("_v")))
    return placed.groupBy(*keys).agg(F.max("_n").alias("_n"), *[at(rank).alias(name) for name, _, rank in ranks])


def _weighted_statistics(rows: DataFrame, keys: list[str], x: str, ranks: list[tuple[str, float, Column]], weight: str, parts: int = 200) -> DataFrame:
    """Order statistics of rows that stand for `weight` rows each. Sketched borders cut a key's values into parts; sums of weights tell the parts in which a rank lies, and
    only their values are ordered. Any borders give the same values."""
    rows = rows.where(F.col(x).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("_x")).agg(F.sum(weight).alias("_w"))
    rows = stored(rows, "weighted")
    shares = [i / parts for i in range(1, parts)]
    bounds = stored(rows.groupBy(*keys).agg(F.percentile_approx("_x", shares, 10 * parts).alias("_b"), F.sum("_w").alias("_n")), "borders")
    marked = with_facts(rows, bounds, keys).select(*keys, "_n", "_x", "_w", F.size(F.filter("_b", lambda b: b < F.col("_x"))).alias("_part"))
    here = lambda rank: (rank >= F.col("_upto") - F.col("_c")) & (rank < F.col("_upto"))
    any_here = F.lit(False)
    for _, _, rank in ranks:
        any_here = any_here | here(rank)
    sums = marked.groupBy(*keys, "_n", "_part").agg(F.sum("_w").alias("_c")).withColumn("_upto", F.sum("_c").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, 0)))
    chosen = sums.where(any_here).select(*keys, "_part", (F.col("_upto") - F.col("_c")).alias("_before"))
    inside = F.sum("_w").over(W.partitionBy(*keys, "_part").orderBy("_x").rowsBetween(W.unboundedPreceding, 0))
    placed = with_facts(marked, stored(chosen, "parts"), [*keys, "_part"]).withColumn("_upto", F.col("_before") + inside).withColumn("_c", F.col("_w"))
    return placed.groupBy(*keys).agg(F.max("_n").alias("_n"), *[F.max(F.when(here(rank), F.col("_x"))).alias(name) for name, _, rank in ranks])


def medians(rows: DataFrame, keys: list[str], x: str, name: str = "median", weight: str | None = None) -> DataFrame:
    """keys and the mean of the middle two values of x; keys without a value are absent. weight: how many equal rows a row stands for."""
    n = F.col("_n")
    found = order_statistics(rows, keys, x, [("_low", 0.5, F.floor((n - 1) / 2)), ("_high", 0.5, F.floor(n / 2))], weight)
    return found.select(*keys, ((F.col("_low") + F.col("_high")) / 2).alias(name))


def running_counts(rows: DataFrame, x: str, parts: int = 64) -> DataFrame:
    """x, _c, _upto for each distinct value that is not null: its rows, and all rows up to it.

    Values are split at approximate quantiles into parts that are summed apart; a part's offset comes from the sums of the `parts`
    before it. Any borders give the same counts, so their being approximate does not matter.
    """
    counts = rows.where(F.col(x).isNotNull()).groupBy(x).agg(F.count(F.lit(1)).alias("_c"))
    borders = counts.agg(F.percentile_approx(F.col(x).cast("double"), [i / parts for i in range(1, parts)], 1000)).first()[0] or []
    borders = sorted(set(borders))
    part = F.size(F.filter(F.array(*map(F.lit, borders)), lambda b: b < F.col(x))) if borders else F.lit(0)
    counts = counts.withColumn("_part", part)
    before = counts.groupBy("_part").agg(F.sum("_c").alias("_n")).select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.sum("_c").over(W.partitionBy("_part").orderBy(x))
    return counts.withColumn("_inside", inside).join(F.broadcast(before), "_part").select(x, "_c", (F.col("_before") + F.col("_inside")).alias("_upto"))


def first_half(rows: DataFrame, x: str, then: str) -> DataFrame:
    """Adds first_half: whether a row is among the first n // 2 in order of x, then of `then`. Rows without x are left out.

    Numbering all rows takes one order over all of them; it takes two numbers to cut it: the value of x at the border, and among rows of that value
    the value of `then`. Each is an order statistic. `then` is a number, and tells rows of equal x apart.
    """
    rows = rows.where(F.col(x).isNotNull())
    n = F.col("_n")
    border = order_statistics(rows, [], x, [("_x", 0.5, F.floor(n / 2))]).select("_x", F.floor(n / 2).alias("_half"))
    below = with_facts(rows, border, []).select(x, then, "_x", "_half")
    ties = below.groupBy().agg(F.sum((F.col(x) < F.col("_x")).cast("long")).alias("_less"), F.max("_half").alias("_half"))
    tied = below.where(F.col(x) == F.col("_x")).select(then)
    upto = running_counts(tied, then)
    cut = upto.crossJoin(F.broadcast(ties)).where("_upto <= _half - _less").agg(F.max(then).alias("_then"))
    marked = with_facts(with_facts(rows, border.select("_x"), []), cut, [])
    return marked.withColumn("first_half", (F.col(x) < F.col("_x")) | ((F.col(x) == F.col("_x")) & F.coalesce(F.col(then) <= F.col("_then"), F.lit(False)))).drop("_x", "_then")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, time: str, values: list[str], span: int = 64) -> DataFrame:
    """left with `time` and `values` of the row of right with the same key and the latest time at or before `at`; null where there is none.

    at and time are integers (day numbers, positions). Right rows are one per key and time. Time is cut into buckets of `span`: in a bucket
    a window over (key, bucket) carries the last right row forward, and what a bucket inherits comes from one row a bucket that has any. So neither a
    grid of keys and days nor all rows of a key in one task is needed.
    """
    bucket = lambda c: F.floor(F.col(c) / span)
    fact = F.struct(F.col(time).alias("_t"), *[F.col(v).alias(f"_v_{v}") for v in values])
    facts = right.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("_key"), F.col(time).alias("_at"), bucket(time).alias("_bucket"), fact.alias("_fact"))
    asked = left.select(F.col(key).alias("_key"), F.col(at).alias("_at"), bucket(at).alias("_bucket"), F.struct(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(left.columns)]).alias("_row"))
    ends = facts.groupBy("_key", "_bucket").agg(F.max_by("_fact", "_at").alias("_end"))
    stops = ends.unionByName(asked.select("_key", "_bucket").distinct(), allowMissingColumns=True).groupBy("_key", "_bucket").agg(F.first("_end", ignorenulls=True).alias("_end"))
    before = F.last("_end", ignorenulls=True).over(W.partitionBy("_key").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    inherited = stops.withColumn("_before", before).where("_before is not null").select(F.col("_key").alias("_k"), F.col("_bucket").alias("_b"), "_before")
    both = asked.unionByName(facts, allowMissingColumns=True)
    here = F.last("_fact", ignorenulls=True).over(W.partitionBy("_key", "_bucket").orderBy("_at", F.col("_fact").isNull()).rowsBetween(W.unboundedPreceding, 0))
    filled = both.withColumn("_here", here).where("_row is not null").join(inherited, (F.col("_key") == F.col("_k")) & (F.col("_bucket") == F.col("_b")), "left")
    found = F.coalesce("_here", "_before")
    return filled.select(*[F.col(f"_row._c{i}").alias(c) for i, c in enumerate(left.columns)], found["_t"].alias(time), *[found[f"_v_{v}"].alias(v) for v in values])
