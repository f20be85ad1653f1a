"""Choice of a strategy variant from its comparison row; only training columns decide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .order import medians, with_facts


def _first(rows: DataFrame, order: list) -> DataFrame:
    return rows.orderBy(*order).limit(1)


def _or_baseline(best: DataFrame, variants: DataFrame, baseline: str) -> DataFrame:
    base = variants.where(F.col("variant") == baseline).select(F.col("variant").alias("_base")).limit(1)
    return base.join(best.select("variant"), F.lit(True), "left").select(F.coalesce("variant", "_base").alias("variant"), F.col("variant").isNull().alias("is_fallback"))


MINIMUM = "train_days >= 252 and train_entries >= 20 and train_tickers >= 5"


def robust(variants: DataFrame, baseline: str) -> DataFrame:
    """Of those with enough training that earn at moderate cost the best worst half under stress; then turnover, then order."""
    ok = variants.where(f"{MINIMUM} and train_moderate_cagr > 0 and worst_half_stress_cagr is not null")
    return _or_baseline(_first(ok, [F.desc("worst_half_stress_cagr"), "train_turnover", "ord"]), variants, baseline)


def zero_cost(variants: DataFrame, baseline: str) -> DataFrame:
    """Best training growth without costs; then worst half (a missing one never wins a tie), turnover, order."""
    ok = variants.where(f"{MINIMUM} and train_cagr is not null")
    return _or_baseline(_first(ok, [F.desc("train_cagr"), F.desc_nulls_last("worst_half_cagr"), "train_turnover", "ord"]), variants, baseline)


def simple(variants: DataFrame, baseline: str) -> DataFrame:
    ok = variants.where("train_entries >= 20 and train_days >= 126 and train_cagr is not null")
    return _or_baseline(_first(ok, [F.desc("train_cagr"), "variant"]), variants, baseline)


def resolved(recommended: DataFrame, override: DataFrame) -> DataFrame:
    """recommended, chosen, overridden: a manual choice stands beside the recommendation."""
    both = recommended.select(F.col("variant").alias("recommended")).join(override.select(F.col("variant").alias("manual")), F.lit(True), "left")
    return both.select("recommended", F.coalesce("manual", "recommended").alias("chosen"), F.col("manual").isNotNull().alias("overridden"))


def best(variants: DataFrame, n: int = 3) -> DataFrame:
    """The n best with their place; each partition gives its own n, so only these are numbered in one task."""
    order = [F.desc_nulls_last("full_cagr"), F.col("ord")]
    return variants.orderBy(*order).limit(n).withColumn("place", F.row_number().over(W.orderBy(*order)))


def honesty(variants: DataFrame) -> DataFrame:
    """Best variant by training, its own training and test growth, and the distance of median and best in training."""
    best_ = variants.agg(F.max_by("variant", "train_cagr").alias("variant"), F.max("train_cagr").alias("train_cagr"), F.max_by("test_cagr", "train_cagr").alias("test_cagr"))
    return with_facts(best_, medians(variants, [], "train_cagr"), []).withColumn("spread", F.col("train_cagr") - F.col("median")).drop("median")


def still_valid(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """valid: policy version, cutoff and override are those wanted, nulls equal."""
    a = stored.select(*[F.col(c).alias(f"_{c}") for c in ("policy", "cutoff", "override")])
    same = F.col("_policy").eqNullSafe(F.col("policy")) & F.col("_cutoff").eqNullSafe(F.col("cutoff")) & F.col("_override").eqNullSafe(F.col("override"))
    return wanted.join(a, F.lit(True), "left").select(same.alias("valid"))
