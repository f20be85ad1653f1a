"""Price-series operators: repair of unit breaks, restatement, indices, averages, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F



def by_day():
    return W.partitionBy("ticker").orderBy("d")


def returns(prices: DataFrame, n: int = 1) -> DataFrame:
    """Trailing return over n rows, up to and including the day."""
    return prices.withColumn("ret", F.try_divide(F.col("close"), F.lag("close", n).over(by_day())) - 1)


def equal_weight_index(prices: DataFrame, start: float = 100.0, field: str = "close") -> DataFrame:
    """d, level: the mean of the available daily returns, chained. field: the price basis."""
    mean = returns(prices.withColumn("close", F.col(field))).where("ret is not null").groupBy("d").agg(F.avg("ret").alias("ret"))
    return mean.select("d", (start * F.exp(F.sum(F.log1p("ret")).over(W.orderBy("d")))).alias("level"))


def mean_benchmark(prices: DataFrame) -> DataFrame:
    """d, level from 1: the mean of the returns since the day before, of tickers with a price on both, chained over all days; a day without any counts as 0."""
    days = prices.select("d").distinct().select("d", F.row_number().over(W.orderBy("d")).alias("_i"))
    placed = prices.join(F.broadcast(days), "d")
    w = W.partitionBy("ticker").orderBy("_i")
    step = F.when(F.col("_i") - F.lag("_i").over(w) == 1, F.try_divide(F.col("close"), F.lag("close").over(w)) - 1)
    mean = placed.withColumn("_r", step).groupBy("d").agg(F.coalesce(F.avg("_r"), F.lit(0.0)).alias("_r"))
    return mean.select("d", F.exp(F.sum(F.log1p("_r")).over(W.orderBy("d"))).alias("level"))


def restated(old: DataFrame, new: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """ticker, shared, deviating, restated: two or more shared days, of which max(2, n div 4) or more deviate."""
    both = old.select("ticker", "d", F.col("close").alias("a")).join(new.select("ticker", "d", F.col("close").alias("b")), ["ticker", "d"])
    off = F.abs(F.try_divide(F.col("b"), F.col("a")) - 1) > tolerance
    counted = both.groupBy("ticker").agg(F.count(F.lit(1)).alias("shared"), F.sum(off.cast("long")).alias("deviating"))
    return counted.withColumn("restated", (F.col("shared") >= 2) & (F.col("deviating") >= F.greatest(F.lit(2), F.floor(F.col("shared") / 4))))


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """New days are added, days in both are overwritten by the new ones."""
    both = old.select("ticker", "d", "close", "volume", F.lit(0).alias("_age")).unionByName(new.select("ticker", "d", "close", "volume", F.lit(1).alias("_age")))
    return both.groupBy("ticker", "d").agg(F.max_by(F.struct("close", "volume"), "_age").alias("_v")).select("ticker", "d", "_v.close", "_v.volume")


def loaded(old: DataFrame, new: DataFrame) -> DataFrame:
    """An incremental load: restated tickers are replaced whole by the new series, others merged."""
    whole = restated(old, new).where("restated").select("ticker")
    return merged(old.join(whole, "ticker", "left_anti"), new)


def coverage(prices: DataFrame, calendar_days: int) -> DataFrame:
    """Days, ends, years and class by share of the calendar: FULL from 95 %, PART from 40 %, else THIN."""
    share = 100.0 * F.col("days") / calendar_days
    counted = prices.groupBy("ticker").agg(F.count_distinct("d").alias("days"), F.min("d").alias("first_d"), F.max("d").alias("last_d"), F.count_distinct(F.year("d")).alias("years"))
    return counted.withColumn("class", F.when(share >= 95, "FULL").when(share >= 40, "PART").otherwise("THIN"))


def unit_breaks(prices: DataFrame, jump: float = 4.0, tolerance: float = 0.005) -> DataFrame:
    """Adds previous (last valid close before), power and flag. A ratio of `jump` or more, or its inverse, is a break: REPAIRABLE
    where it is a power of ten within the tolerance, else UNVERIFIED. A close that is not positive and finite is INVALID."""
    ok = (F.col("close") > 0) & (F.col("close") < float("inf"))
    previous = F.last(F.when(ok, F.col("close")), ignorenulls=True).over(by_day().rowsBetween(W.unboundedPreceding, -1))
    ratio = F.try_divide(F.col("close"), F.col("previous"))
    power = F.round(F.log10("ratio")).cast("int")
    exact = F.abs(F.col("ratio") / F.pow(F.lit(10.0), F.col("power")) - 1) <= tolerance
    marked = prices.withColumn("previous", previous).withColumn("ratio", F.when(ok, ratio)).withColumn("power", power)
    flag = F.when(F.col("close").isNull() | F.isnan("close"), None).when(~ok, "INVALID").when((F.col("ratio") >= jump) | (F.col("ratio") <= 1 / jump), F.when(exact & (F.col("power") != 0), "REPAIRABLE").otherwise("UNVERIFIED"))
    return marked.withColumn("flag", flag)


def repaired(prices: DataFrame, fields: tuple[str, ...] = ("close",)) -> DataFrame:
    """Earlier rows are rescaled by all later repairable breaks; the newest prices never change."""
    later = F.sum(F.when(F.col("flag") == "REPAIRABLE", F.col("power")).otherwise(0)).over(by_day().rowsBetween(1, W.unboundedFollowing))
    scaled = unit_breaks(prices).withColumn("multiplier", F.pow(F.lit(10.0), F.coalesce(later, F.lit(0))))
    return scaled.select(*[(F.col(c) * F.col("multiplier")).alias(c) if c in fields else F.col(c) for c in prices.columns], "multiplier")


def repair_audit(prices: DataFrame) -> DataFrame:
    """ticker, d, flag, power of every finding, and whether it blocks the ticker."""
    return unit_breaks(prices).where("flag is not null").select("ticker", "d", "flag", "power", (F.col("flag") != "REPAIRABLE").alias("blocks"))


def trailing_mean(column: Column, rows: int, before: bool = False) -> Column:
    return F.avg(column).over(by_day().rowsBetween(-rows, -1) if before else by_day().rowsBetween(1 - rows, 0))


def exponential_mean(prices: DataFrame, span: int = 20, block: int = 512) -> DataFrame:
    """ticker, d, ema: e(i) = a x(i) + (1 - a) e(i - 1) from e(0) = x(0), over the whole series, a = 2 / (span + 1).

    Rows are summed in blocks; what a block passes on is a fold over the blocks before it, so no array is longer than a series' blocks."""
    a = 2 / (span + 1)
    q = F.lit(1 - a)
    rows = prices.where(F.col("close").isNotNull()).select("ticker", "d", "close", (F.row_number().over(by_day()) - 1).alias("_i")).withColumn("_b", F.floor(F.col("_i") / block)).withColumn("_k", F.col("_i") % block)
    inside = W.partitionBy("ticker", "_b").orderBy("_k")
    rows = rows.withColumn("_s", a * F.pow(q, F.col("_k")) * F.sum(F.col("close") * F.pow(q, -F.col("_k"))).over(inside))
    ends = rows.groupBy("ticker", "_b").agg(F.max(F.struct("_k", "_s")).alias("end"), F.min(F.struct("_k", "close")).alias("start"))
    series = ends.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("_b", F.col("end._k").alias("k"), F.col("end._s").alias("s"), F.col("start.close").alias("x")))).alias("e"))
    begin = F.array(F.element_at("e", 1)["x"])
    carried = F.aggregate("e", begin, lambda acc, e: F.concat(acc, F.array(F.element_at(acc, -1) * F.pow(q, e["k"] + 1) + e["s"])))
    carry = series.select("ticker", F.posexplode(carried).alias("_b", "_carry")).withColumn("_b", F.col("_b").cast("long"))
    return rows.join(carry, ["ticker", "_b"]).select("ticker", "d", (F.col("_carry") * F.pow(q, F.col("_k") + 1) + F.col("_s")).alias("ema"))


def averages(prices: DataFrame) -> DataFrame:
    """SMA10, SMA50, mean true range of closes over 20 rows (5 at least), and the exponential mean of span 20."""
    change = F.abs(F.col("close") - F.lag("close").over(by_day()))
    with_change = prices.withColumn("_change", change)
    n = F.count("_change").over(by_day().rowsBetween(-19, 0))
    simple = with_change.select("ticker", "d", trailing_mean(F.col("close"), 10).alias("sma10"), trailing_mean(F.col("close"), 50).alias("sma50"), F.when(n >= 5, trailing_mean(F.col("_change"), 20)).alias("atr20"))
    return simple.join(exponential_mean(prices, 20).withColumnRenamed("ema", "ema20"), ["ticker", "d"], "left")


def volume_lift(prices: DataFrame, least: int = 30) -> DataFrame:
    """Mean volume of the last 5 rows by that of the last 61; null with fewer than `least` valid ones."""
    ok = F.count("volume").over(by_day().rowsBetween(-60, 0)) >= least
    return prices.select("ticker", "d", F.when(ok, F.try_divide(trailing_mean(F.col("volume"), 5), trailing_mean(F.col("volume"), 61))).alias("lift"))


def prior_turnover(prices: DataFrame, rows: int = 20) -> DataFrame:
    """Mean volume times mean price over the rows before the day."""
    return prices.select("ticker", "d", (trailing_mean(F.col("volume"), rows, True) * trailing_mean(F.col("close"), rows, True)).alias("turnover"))


def trend(prices: DataFrame, rows: int = 50) -> DataFrame:
    """ticker, d, prior: prices before the day, above: whether the last of these is over the mean of the last `rows` of them (null without any)."""
    before = by_day().rowsBetween(-rows, -1)
    above = F.round(F.lag("close").over(by_day()) - F.avg("close").over(before), 9) > 0
    return prices.where(F.col("close") > 0).select("ticker", "d", (F.row_number().over(by_day()) - 1).alias("prior"), above.alias("above"))


def last_close(prices: DataFrame) -> DataFrame:
    return prices.groupBy("ticker").agg(F.max("d").alias("d"), F.max_by("close", "d").alias("close"))


def stale_marks(aligned: DataFrame, most: int = 5) -> DataFrame:
    """Days on which a ticker's mark is older than `most` sessions: they block publishing."""
    return aligned.where(F.col("pos") - F.col("own_pos") > most).select("ticker", "d", (F.col("pos") - F.col("own_pos")).alias("missing"))


def reference_series(candidates: DataFrame, least: int = 100) -> DataFrame:
    """Of series(name, priority, d, level) the first by priority with more than `least` days."""
    best = candidates.groupBy("name", "priority").agg(F.count_distinct("d").alias("n")).where(F.col("n") > least).agg(F.min_by("name", "priority").alias("name"))
    return candidates.join(F.broadcast(best), "name", "left_semi")


def long_rows(wide: DataFrame, tickers: list[str]) -> DataFrame:
    """A vendor's wide frame (d, close_T, adj_T, volume_T) as rows; closes that are not positive go, adjusted falls back to close."""
    parts = F.explode(F.array(*[F.struct(F.lit(t).alias("ticker"), F.col(f"close_{t}").cast("double").alias("close"), F.col(f"adj_{t}").cast("double").alias("adj"), F.col(f"volume_{t}").cast("double").alias("volume")) for t in tickers]))
    rows = wide.select("d", parts.alias("p")).select("p.ticker", "d", "p.close", F.coalesce(F.nanvl("p.adj", F.lit(None)), "p.close").alias("adjclose"), "p.volume")
    return rows.where("close > 0 and not isnan(close)")
