"""The capital portfolio: value curves of sleeves, validated, observed at completed month ends and blended with equal weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def errors(nav: DataFrame, as_of) -> DataFrame:
    """sleeve, error: values that are not finite and positive, double dates, fewer than two points. Later rows than as_of don't count."""
    now = nav.where(F.col("d") <= F.lit(as_of).cast("date"))
    bad = now.where(F.col("nav").isNull() | F.isnan("nav") | (F.col("nav") <= 0) | (F.col("nav") == float("inf"))).groupBy("sleeve").agg(F.count(F.lit(1)).alias("n")).select("sleeve", F.lit("invalid value").alias("error"), "n")
    double = now.groupBy("sleeve", "d").agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy("sleeve").agg(F.count(F.lit(1)).alias("n")).select("sleeve", F.lit("duplicate date").alias("error"), "n")
    few = nav.select("sleeve").distinct().join(now.groupBy("sleeve").agg(F.count(F.lit(1)).alias("n")), "sleeve", "left").where("coalesce(n, 0) < 2").select("sleeve", F.lit("too few points").alias("error"), F.coalesce("n", F.lit(0)).alias("n"))
    return bad.unionByName(double).unionByName(few)


def moves(nav: DataFrame, up: float = 1.0, down: float = -0.8) -> DataFrame:
    """Moves of more than +100 % or less than -80 %: a warning, values stay as they are."""
    step = F.col("nav") / F.lag("nav").over(W.partitionBy("sleeve").orderBy("d")) - 1
    return nav.withColumn("move", step).where((F.col("move") > up) | (F.col("move") < down)).select("sleeve", "d", "move")


def weekdays_to_month_end(day):
    """Weekdays after a day up to its month's end."""
    return F.size(F.filter(F.sequence(day, F.last_day(day)), lambda x: (x > day) & (F.weekday(x) < 5)))


def month_observations(nav: DataFrame, as_of, most_weekdays: int = 5) -> DataFrame:
    """sleeve, month (its last day), d, nav: the last value of each month that is complete at as_of, at most five weekdays before its end."""
    last = nav.where(F.col("d") <= F.lit(as_of).cast("date")).groupBy("sleeve", F.last_day("d").alias("month")).agg(F.max("d").alias("d"), F.max_by("nav", "d").alias("nav"))
    return last.where((F.col("month") <= F.lit(as_of).cast("date")) & (weekdays_to_month_end(F.col("d")) <= most_weekdays))


def common_window(observed: DataFrame, cutoffs: DataFrame | None = None) -> DataFrame:
    """month, gap: month ends that all sleeves have, from the latest cutoff on; gap marks that the next is not the next month."""
    n = observed.select("sleeve").distinct().agg(F.count(F.lit(1)).alias("_n"))
    months = observed.groupBy("month").agg(F.count_distinct("sleeve").alias("_has")).crossJoin(F.broadcast(n)).where("_has = _n").select("month")
    if cutoffs is not None:
        months = months.crossJoin(F.broadcast(cutoffs.agg(F.max("cutoff").alias("_cut")))).where("_cut is null or month >= _cut").select("month")
    following = F.lead("month").over(W.orderBy("month"))
    return months.withColumn("gap", F.coalesce(following != F.last_day(F.add_months("month", 1)), F.lit(False)))


def blended(observed: DataFrame, window: DataFrame, start: float = 1_000_000.0) -> DataFrame:
    """month, growth, value: each month the total grows by the mean return of the sleeves, as they are rebalanced to equal shares."""
    inside = observed.join(F.broadcast(window.select("month")), "month")
    ratio = F.col("nav") / F.lag("nav").over(W.partitionBy("sleeve").orderBy("month"))
    monthly = inside.withColumn("ratio", ratio).groupBy("month").agg(F.avg("ratio").alias("growth"))
    return monthly.select("month", "growth", (start * F.exp(F.sum(F.log(F.coalesce("growth", F.lit(1.0)))).over(W.orderBy("month")))).alias("value"))


def transfers(observed: DataFrame, window: DataFrame, start: float = 1_000_000.0) -> DataFrame:
    """month, sleeve, drifted, target, transfer: what moves to bring each sleeve back to its equal share; sums to 0 after the first month."""
    total = blended(observed, window, start)
    w = W.orderBy("month")
    total = total.withColumn("before", F.lag("value").over(w))
    inside = observed.join(F.broadcast(window.select("month")), "month").withColumn("ratio", F.col("nav") / F.lag("nav").over(W.partitionBy("sleeve").orderBy("month")))
    n = inside.select("sleeve").distinct().agg(F.count(F.lit(1)).alias("n"))
    placed = inside.join(F.broadcast(total), "month").crossJoin(F.broadcast(n))
    drifted = F.coalesce(F.col("before") / F.col("n") * F.col("ratio"), F.lit(0.0))
    return placed.select("month", "sleeve", drifted.alias("drifted"), (F.col("value") / F.col("n")).alias("target"), (F.col("value") / F.col("n") - drifted).alias("transfer"))


def final_holdings(ledger: DataFrame) -> DataFrame:
    last = ledger.agg(F.max("month").alias("month"))
    held = ledger.join(F.broadcast(last), "month")
    return held.select("sleeve", F.col("target").alias("value"), (F.col("target") / F.sum("target").over(W.partitionBy("month"))).alias("share"))


def monthly_metrics(curve: DataFrame, key: str, value: str) -> DataFrame:
    """Months, cagr (180 days or more), volatility, drawdown of month-end curves(key, month, value)."""
    w = W.partitionBy(key).orderBy("month")
    steps = curve.withColumn("_r", F.col(value) / F.lag(value).over(w) - 1).withColumn("_dd", F.col(value) / F.max(value).over(w) - 1)
    days = F.datediff(F.max("month"), F.min("month"))
    return steps.groupBy(key).agg(F.count(F.lit(1)).alias("months"), F.when(days >= 180, F.pow(F.max_by(value, "month") / F.min_by(value, "month"), 365.25 / days) - 1).alias("cagr"), (F.stddev_samp("_r") * 12**0.5).alias("volatility"), F.min("_dd").alias("drawdown"))


def dropped_months(nav: DataFrame, as_of) -> DataFrame:
    """sleeve, month, d: months whose last value does not stand for their end, or that are not complete."""
    last = nav.where(F.col("d") <= F.lit(as_of).cast("date")).groupBy("sleeve", F.last_day("d").alias("month")).agg(F.max("d").alias("d"))
    return last.join(month_observations(nav, as_of).select("sleeve", "month"), ["sleeve", "month"], "left_anti")


def binding_sleeve(observed: DataFrame) -> DataFrame:
    """The sleeve that ends first, and where."""
    ends = observed.groupBy("sleeve").agg(F.max("month").alias("last_month"))
    return ends.agg(F.min_by("sleeve", F.struct("last_month", "sleeve")).alias("sleeve"), F.min("last_month").alias("last_month"))
