"""Data-quality status: freshness, coverage, replacement and refresh gates, acquisition ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def freshness(last: Column, as_of: Column, limit) -> Column:
    """MISSING, STALE (older than the limit, or in the future) or FRESH."""
    age = F.datediff(as_of, last)
    return F.when(last.isNull(), "MISSING").when((age > limit) | (age < 0), "STALE").otherwise("FRESH")


def status(exports: DataFrame, limits: DataFrame, as_of) -> DataFrame:
    """Per listed strategy first and last day and status; an error beats missing beats stale beats OK. limits(strategy, ord, limit_days)."""
    span = exports.groupBy("strategy").agg(F.min("d").alias("first_d"), F.max("d").alias("last_d"), F.max(F.size("errors")).alias("n_errors"))
    found = limits.join(span, "strategy", "left")
    state = freshness(F.col("last_d"), F.lit(as_of).cast("date"), F.col("limit_days"))
    return found.select("ord", "strategy", "first_d", "last_d", F.when(F.coalesce("n_errors", F.lit(0)) > 0, "ERROR").when(state == "FRESH", "OK").otherwise(state).alias("status"))


def included(states: DataFrame) -> DataFrame:
    """included and excluded: comma lists in the fixed order."""
    names = lambda ok: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("status") == "OK") == ok, F.struct("ord", "strategy")))), lambda x: x["strategy"]), ",")
    return states.agg(names(True).alias("included"), names(False).alias("excluded"))


def month_coverage(observed: DataFrame, as_of) -> DataFrame:
    """sleeve, month, behind: every completed month after the last usable one, and how many days it lies behind."""
    last = observed.groupBy("sleeve").agg(F.max("month").alias("last_month"))
    months = F.explode(F.expr(f"filter(transform(sequence(add_months(trunc(last_month, 'MM'), 1), greatest(add_months(trunc(last_month, 'MM'), 1), date'{as_of}'), interval 1 month), x -> last_day(x)), x -> x <= date'{as_of}')"))
    return last.select("sleeve", "last_month", months.alias("month")).select("sleeve", "month", F.datediff("month", "last_month").alias("behind"))


def joint_window(curves: DataFrame) -> DataFrame:
    """first_d, last_d that all sleeves cover, and who binds at either end."""
    span = curves.groupBy("sleeve").agg(F.min("d").alias("a"), F.max("d").alias("z"))
    return span.agg(F.max("a").alias("first_d"), F.min("z").alias("last_d"), F.max_by("sleeve", F.struct("a", "sleeve")).alias("first_by"), F.min_by("sleeve", F.struct("z", "sleeve")).alias("last_by"))


def problems(by_source: DataFrame, uses: DataFrame) -> DataFrame:
    """strategy and the sorted problems of the sources that it uses."""
    met = uses.join(by_source, "source").groupBy("strategy").agg(F.array_sort(F.collect_set(F.concat_ws(": ", "source", "problem"))).alias("_p"))
    return met.select("strategy", F.array_join("_p", "; ").alias("problems"))


def needs_refresh(last: Column, as_of: Column, most_days: int) -> Column:
    return last.isNull() | (F.datediff(as_of, last) > most_days)


def replacement_is_safe(old: DataFrame, new: DataFrame, share: float = 0.8) -> DataFrame:
    """old_n, new_n, verdict: EMPTY, FEWER (below the share of rows), SHORTER (ends earlier) or SAFE."""
    a = old.agg(F.count(F.lit(1)).alias("old_n"), F.max("d").alias("old_d"))
    b = new.agg(F.count(F.lit(1)).alias("new_n"), F.max("d").alias("new_d"))
    verdict = F.when(F.col("new_n") == 0, "EMPTY").when(F.col("new_n") < share * F.col("old_n"), "FEWER").when(F.col("new_d") < F.col("old_d"), "SHORTER").otherwise("SAFE")
    return a.crossJoin(b).select("old_n", "new_n", verdict.alias("verdict"))


def acquisition(sources: DataFrame, as_of) -> DataFrame:
    """source, outcome of sources(source, enabled, last_d, most_days, fetched, safe, failed): WRITTEN, REUSED, DEGRADED (kept the old after a
    refused or failed load), SKIPPED, FAILED (nothing to keep)."""
    stale = needs_refresh(F.col("last_d"), F.lit(as_of).cast("date"), F.col("most_days"))
    outcome = F.when(~F.col("enabled"), "SKIPPED").when(~stale, "REUSED").when(F.col("fetched") & F.col("safe"), "WRITTEN").when(F.col("last_d").isNotNull(), "DEGRADED").otherwise("FAILED")
    return sources.withColumn("outcome", outcome)


def with_unreadable(limits: DataFrame, exports: DataFrame) -> DataFrame:
    """Every listed strategy; where no export could be read, a row with that error."""
    found = exports.select("strategy", "errors")
    return limits.select("strategy").join(found, "strategy", "left").select("strategy", F.coalesce("errors", F.array(F.lit("export not readable"))).alias("errors"))
