"""Scores of several sources: status, expanding percentiles without look-ahead, as-of blend, sentiment changes, factor ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .calendar import effective
from .prices import trend


def with_drop_reason(rows: DataFrame) -> DataFrame:
    """Adds drop_reason (date, ticker, score; null for usable rows) to raw score rows of all sources."""
    reason = F.when(F.col("d").isNull(), "date").when(F.col("ticker").isNull() | (F.trim("ticker") == ""), "ticker").when(F.col("raw").isNull() | F.isnan("raw"), "score")
    return rows.withColumn("drop_reason", reason)


def source_status(sources: DataFrame, scores: DataFrame) -> DataFrame:
    """Per listed source its rows, tickers, dates; none is an error."""
    counted = scores.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ticker").alias("tickers"), F.min("d").alias("first_d"), F.max("d").alias("last_d"))
    out = sources.join(counted, "source", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("status", F.when(F.col("n") == 0, "ERROR").otherwise("OK"))


def expanding_percentiles(scores: DataFrame, rows_a_part: int = 200_000) -> DataFrame:
    """Adds pct: 100 (less + equal / 2) / n against all strictly earlier dates of the source; 50 on its first date.

    Dominance counting over dyadic blocks of dates. All dates before the i-th are one block for each bit of i that is set, the left neighbour of the block of
    that size that holds i. So at each level a row either asks or is counted, in a pair of neighbouring blocks, and the count of what is below it
    is a running sum over the pair in order of value: n log(dates) rows in all, and no row meets another. Where a source has many rows its values are cut
    into parts at approximate quantiles, a pair's parts are summed apart, and what lies in lower parts is added: any borders give the same counts.
    """
    cell = scores.groupBy("source", "d", "raw").agg(F.count(F.lit(1)).alias("c"))
    days = cell.groupBy("source", "d").agg(F.sum("c").alias("_day_n"))
    by_day = W.partitionBy("source").orderBy("d")
    days = days.select(
        "source", "d", (F.row_number().over(by_day) - 1).alias("_i"), F.coalesce(F.sum("_day_n").over(by_day.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("n"),
        F.greatest(F.ceil(F.log2(F.count(F.lit(1)).over(W.partitionBy("source")))), F.lit(1)).cast("int").alias("_levels"),
    )
    placed = cell.join(days, ["source", "d"])
    parts = min(1000, -(-scores.count() // rows_a_part))
    if parts > 1:
        borders = cell.groupBy("source").agg(F.percentile_approx("raw", [i / parts for i in range(1, parts)], 10_000).alias("_borders"))
        placed = placed.join(F.broadcast(borders), "source").withColumn("_part", F.size(F.filter("_borders", lambda b: b < F.col("raw")))).drop("_borders")
    else:
        placed = placed.withColumn("_part", F.lit(0))
    at = placed.select("source", "d", "raw", "_part", "c", "_i", F.explode(F.sequence(F.lit(0), F.col("_levels") - 1)).alias("_level"))
    at = at.withColumn("_pair", F.expr("shiftright(_i, _level + 1)")).withColumn("_asks", F.expr("(shiftright(_i, _level) & 1) = 1"))
    counted = F.when(F.col("_asks"), 0).otherwise(F.col("c"))
    inside = W.partitionBy("source", "_level", "_pair", "_part")
    upto, equal = F.sum(counted).over(inside.orderBy("raw")), F.sum(counted).over(W.partitionBy("source", "_level", "_pair", "_part", "raw"))
    asked = at.withColumn("_below", upto - equal / 2).where("_asks")
    if parts > 1:
        sums = at.where("not _asks").groupBy("source", "_level", "_pair", "_part").agg(F.sum("c").alias("_n"))
        order = W.partitionBy("source", "_level", "_pair").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
        every = at.select("source", "_level", "_pair", "_part").distinct().join(sums, ["source", "_level", "_pair", "_part"], "left")
        lower = every.select("source", "_level", "_pair", "_part", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_lower"))
        asked = asked.join(lower, ["source", "_level", "_pair", "_part"]).withColumn("_below", F.col("_below") + F.col("_lower"))
    below = asked.groupBy("source", "d", "raw").agg(F.sum("_below").alias("_below"))
    keys = ["source", "d", "raw"]
    pct = placed.select(*keys, "n").join(below, keys, "left").select(*keys, F.when(F.col("n") == 0, 50.0).otherwise(100 * F.coalesce("_below", F.lit(0.0)) / F.col("n")).alias("pct"))
    return scores.join(pct, keys)


def as_of_blend(scores: DataFrame, days: DataFrame, sources: DataFrame, least_sources: int = 1, k: int | None = 30) -> DataFrame:
    """d, ticker, blend, n_sources, place: per day the k best (None: all) of the weighted means of each source's latest score strictly before
    the day, not older than the source's validity. A source without an opinion counts 50; of equal dates the higher score.

    Every score becomes the days on which it is the latest, so the join is by day. sources(source, weight, valid_days).
    """
    one = scores.groupBy("source", "ticker", "d").agg(F.max("pct").alias("pct")).join(F.broadcast(sources), "source")
    until = F.least(F.date_add("d", F.col("valid_days")), F.coalesce(F.lead("d").over(W.partitionBy("source", "ticker").orderBy("d")), F.date_add("d", F.col("valid_days"))))
    lived = one.withColumn("until", until).where("until > d").withColumn("day", F.explode(F.sequence(F.date_add("d", 1), F.col("until"))))
    lived = lived.join(F.broadcast(days.select(F.col("d").alias("day"))), "day")
    total = sources.agg(F.sum("weight").alias("total"))
    summed = lived.groupBy("day", "ticker").agg(F.sum(F.col("weight") * (F.col("pct") - 50)).alias("over"), F.count_distinct("source").alias("n_sources")).crossJoin(F.broadcast(total))
    blend = summed.where(F.col("n_sources") >= least_sources).select(F.col("day").alias("d"), "ticker", (50 + F.col("over") / F.col("total")).alias("blend"), "n_sources")
    return blend.withColumn("place", F.row_number().over(W.partitionBy("d").orderBy(F.desc(F.round("blend", 9)), "ticker"))).where(F.lit(k is None) | (F.col("place") <= (k or 0)))


def latest(blend: DataFrame, k: int = 20) -> DataFrame:
    return blend.join(F.broadcast(blend.agg(F.max("d").alias("d"))), "d").where(F.col("place") <= k)


def sentiment_changes(articles: DataFrame, placeholder: str = "no news") -> DataFrame:
    """company, d, url, final_score, change (0 for a company's first), ordinal; placeholder titles and rows without company, date or score go."""
    good = articles.where(F.col("company").isNotNull() & F.col("d").isNotNull() & F.col("final_score").isNotNull() & ~F.isnan("final_score") & (F.lower(F.trim("title")) != placeholder))
    w = W.partitionBy("company").orderBy("d", "url")
    return good.select("company", "d", "url", "final_score", (F.col("final_score") - F.coalesce(F.lag("final_score").over(w), F.col("final_score"))).alias("change"), F.row_number().over(w).alias("ordinal"))


def sentiment_events(changes: DataFrame, threshold: float = 25.0) -> DataFrame:
    """Changes of at least `threshold` % of the previous score (0.05 at least). By stated rule; no parity with another engine is claimed."""
    before = F.col("final_score") - F.col("change")
    pct = 100 * F.col("change") / F.greatest(F.abs(before), F.lit(0.05))
    return changes.withColumn("pct_change", pct).where((F.col("ordinal") > 1) & (F.col("pct_change") >= threshold))


def sentiment_entries(events: DataFrame, prices_: DataFrame, calendar: DataFrame, least_prior: int = 120, with_trend: bool = False) -> DataFrame:
    """company, d, url, pct_change, entry_d, px: entries at the close of the first trading day strictly after an article. The company needs a price
    on that day and `least_prior` before it; with_trend also the price before it over its mean of 50."""
    placed = effective(events.withColumn("minute", F.lit(None).cast("int")), calendar).where("trade_d is not null")
    state = prices_.join(trend(prices_), ["ticker", "d"]).where(F.col("prior") >= least_prior)
    if with_trend:
        state = state.where("above")
    state = state.select(F.col("ticker").alias("company"), F.col("d").alias("trade_d"), F.col("close").alias("px"))
    return placed.join(state, ["company", "trade_d"]).select("company", "d", "url", "pct_change", F.col("trade_d").alias("entry_d"), "px")


#: Factor weights of the rank blend.
FACTORS = {"f1": 0.25, "f2": 0.25, "f3": 0.20, "f4": 0.10, "f5": 0.12, "f6": 0.08}


def factor_ranks(rows: DataFrame, factors: dict[str, float] = FACTORS, names: int = 5, per_industry: int = 3, cap: float = 0.35) -> DataFrame:
    """d, ticker, score, w: percentile blend by date, at most 3 of an industry and 5 in all, weights by inverse volatility, capped, then normalised."""
    pct = {f: F.percent_rank().over(W.partitionBy("d").orderBy(F.asc_nulls_first(f))) for f in factors}
    scored = rows.withColumn("score", sum((w * pct[f] for f, w in factors.items()), F.lit(0.0)))
    within = F.row_number().over(W.partitionBy("d", "industry").orderBy(F.desc("score"), "ticker"))
    some = scored.withColumn("_i", within).where(F.col("_i") <= per_industry)
    few = some.withColumn("_n", F.row_number().over(W.partitionBy("d").orderBy(F.desc("score"), "ticker"))).where(F.col("_n") <= names)
    day = W.partitionBy("d")
    raw = few.withColumn("_w", F.try_divide(F.lit(1.0), "volatility")).withColumn("_w", F.least(F.lit(cap), F.col("_w") / F.sum("_w").over(day)))
    return raw.select("d", "ticker", "score", (F.col("_w") / F.sum("_w").over(day)).alias("w"))


def news_momentum(rows: DataFrame, weights: tuple[float, ...] = (0.45, 0.20, 0.20, 0.15)) -> DataFrame:
    """d, ticker, score, chosen: weighted z-scores of drift, acceleration, attention and consensus; the best hundredth where a day has 25 names."""
    day = W.partitionBy("d")
    z = [F.try_divide(F.col(c) - F.avg(c).over(day), F.stddev_samp(c).over(day)) for c in ("drift", "acceleration", "attention", "consensus")]
    scored = rows.withColumn("score", sum((w * F.coalesce(x, F.lit(0.0)) for w, x in zip(weights, z, strict=True)), F.lit(0.0)))
    cut = F.percentile("score", 0.99).over(day)
    return scored.select("d", "ticker", "score", ((F.count(F.lit(1)).over(day) >= 25) & (F.col("score") >= cut)).alias("chosen"))


def blend_signals(blended: DataFrame, calendar: DataFrame, turnover: DataFrame) -> DataFrame:
    """ticker, pos0, d, score, turnover: the blend's rows as signals that act on the calendar position of their own day, with the mean
    turnover before that day (null where there is none). Days that are not in the calendar give no signal."""
    on = blended.join(F.broadcast(calendar.select("d", "pos")), "d")
    return on.join(turnover, ["ticker", "d"], "left").select("ticker", F.col("pos").alias("pos0"), "d", F.col("blend").alias("score"), "turnover")
