"""Result analytics: trades, positions, funnels, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .order import as_of, medians, with_facts


def month_ends(curve: DataFrame, key: str, value: str) -> DataFrame:
    """Last value of every month."""
    return curve.groupBy(key, F.last_day("d").alias("month")).agg(F.max_by(value, "d").alias("value")).withColumnRenamed("month", "d")


def harmonised_sharpe(curve: DataFrame, key: str, value: str, least: int = 4) -> DataFrame:
    """Sharpe ratio of month-end values, the same for curves of any frequency; null with fewer than `least` months."""
    w = W.partitionBy(key).orderBy("d")
    steps = month_ends(curve, key, value).withColumn("_r", F.col("value") / F.lag("value").over(w) - 1)
    return steps.groupBy(key).agg(F.count(F.lit(1)).alias("months"), F.try_divide(F.avg("_r") * 12**0.5, F.stddev_samp("_r")).alias("_s")).select(key, "months", F.when(F.col("months") >= least, F.col("_s")).alias("sharpe"))


def monthly_risk(curve: DataFrame, key: str, value: str, per_year: float = 252.0, risk_free: float = 0.04) -> DataFrame:
    """Growth of a daily curve with the risk of its month ends: key, cagr, months, volatility, downside (sd of negative months), and (cagr - risk_free) over either."""
    growth = curve.groupBy(key).agg((F.pow(F.max_by(value, "d") / F.min_by(value, "d"), per_year / F.nullif(F.count(F.lit(1)) - 1, F.lit(0))) - 1).alias("cagr"))
    steps = month_ends(curve, key, value).withColumn("_r", F.col("value") / F.lag("value").over(W.partitionBy(key).orderBy("d")) - 1)
    risk = steps.groupBy(key).agg(F.count("_r").alias("months"), (F.stddev_samp("_r") * 12**0.5).alias("volatility"), (F.stddev_samp(F.when(F.col("_r") < 0, F.col("_r"))) * 12**0.5).alias("downside"))
    above = F.col("cagr") - risk_free
    return growth.join(risk, key).select(key, "cagr", "months", "volatility", "downside", F.when(F.col("volatility") > 0, above / F.col("volatility")).alias("sharpe"), F.when(F.col("downside") > 0, above / F.col("downside")).alias("sortino"))


def daily_metrics(curve: DataFrame, key: str, value: str, start: float, risk_free: float = 0.04) -> DataFrame:
    """Arithmetic metrics of a daily curve against a fixed start capital: total, cagr (calendar days), sharpe and sortino (mean daily return times 252 less risk_free),
    drawdown, calmar, volatility; ratios without spread are 0."""
    w = W.partitionBy(key).orderBy("d")
    steps = curve.withColumn("_r", F.col(value) / F.lag(value).over(w) - 1).withColumn("_dd", F.col(value) / F.max(value).over(w) - 1)
    days = F.greatest(F.datediff(F.max("d"), F.min("d")), F.lit(1))
    last = F.max_by(value, "d") / start
    found = steps.groupBy(key).agg((last - 1).alias("total"), (F.pow(last, 365.25 / days) - 1).alias("cagr"), (F.avg("_r") * 252 - risk_free).alias("_above"), (F.stddev_samp("_r") * 252**0.5).alias("volatility"), (F.stddev_samp(F.when(F.col("_r") < 0, F.col("_r"))) * 252**0.5).alias("_down"), F.min("_dd").alias("drawdown"))
    ratio = lambda by: F.when(by > 0, F.col("_above") / by).otherwise(0.0)
    return found.select(key, "total", "cagr", ratio(F.col("volatility")).alias("sharpe"), ratio(F.col("_down")).alias("sortino"), "drawdown", F.when(F.col("drawdown") < 0, F.col("cagr") / -F.col("drawdown")).otherwise(0.0).alias("calmar"), "volatility")


def paired(trades: DataFrame) -> DataFrame:
    """Every sell with the price of the latest buy of its ticker on an earlier day, and the return. One window instead of a range join."""
    w = W.partitionBy("ticker").orderBy(F.datediff("d", F.lit("1970-01-01").cast("date"))).rangeBetween(W.unboundedPreceding, -1)
    bought = F.last(F.when(F.col("side") == "BUY", F.col("price")), ignorenulls=True).over(w)
    return trades.withColumn("bought", bought).where("side = 'SELL'").withColumn("ret", F.try_divide(F.col("price"), F.col("bought")) - 1)


def trade_stats(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, hit, mean, median, best, worst of the returns that are known."""
    r, known = F.col("ret"), pairs.where("ret is not null")
    out = known.groupBy(*keys).agg(F.count(r).alias("n"), F.avg((r > 0).cast("double")).alias("hit"), F.avg(r).alias("mean"), F.max(r).alias("best"), F.min(r).alias("worst"))
    return with_facts(out, medians(known, keys, "ret"), keys).select(*keys, "n", "hit", "mean", "median", "best", "worst")


def filled(reported: DataFrame, computed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Reported statistics, blanks filled with computed ones."""
    other = computed.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    return reported.join(other, key, "left").select(key, *[F.coalesce(f, f"_{f}").alias(f) for f in fields])


def exit_reasons(trades: DataFrame) -> DataFrame:
    """Realised result by the first word of the reason."""
    return trades.groupBy(F.split("reason", " ")[0].alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("pnl"), F.avg("pnl").alias("mean_pnl"))


def open_positions(trades: DataFrame) -> DataFrame:
    """The last trade per ticker where that is a buy."""
    last = trades.groupBy("ticker").agg(F.max_by(F.struct("side", "d", "price", *[c for c in ("shares",) if c in trades.columns]), F.struct("d", "seq")).alias("x"))
    return last.where("x.side = 'BUY'").select("ticker", "x.d", "x.price", *[f"x.{c}" for c in ("shares",) if c in trades.columns])


def marked_positions(open_: DataFrame, marks: DataFrame, signals: DataFrame, day: Column) -> DataFrame:
    """open positions (ticker, d, price, shares) on a report day: days held, the latest mark (ticker, d, close) at or before that day with its date, return and value now,
    and the signal (ticker, d, signal) of the day the position was opened; null where there is none."""
    number = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    held = open_.withColumn("_day", number(day)).withColumn("_opened", number(F.col("d"))).withColumn("days", F.col("_day") - F.col("_opened"))
    prices = marks.groupBy("ticker", "d").agg(F.max("close").alias("mark")).select("ticker", number(F.col("d")).alias("_mark_day"), F.col("d").alias("mark_d"), "mark")
    found = as_of(held, prices, "ticker", "_day", "_mark_day", ["mark", "mark_d"])
    told = signals.groupBy("ticker", "d").agg(F.max("signal").alias("signal")).select("ticker", number(F.col("d")).alias("_told"), "signal")
    found = as_of(found, told, "ticker", "_opened", "_told", ["signal"]).withColumn("signal", F.when(F.col("_told") == F.col("_opened"), F.col("signal")))
    return found.withColumn("ret", F.try_divide(F.col("mark"), F.col("price")) - 1).withColumn("value", F.col("mark") * F.col("shares")).drop("_day", "_opened", "_mark_day", "_told")


def positions(lots: DataFrame) -> DataFrame:
    """Lots of a ticker become one position with share-weighted price; where any lot lacks shares or price they stay apart."""
    whole = lots.groupBy("ticker").agg(F.count(F.lit(1)).alias("lots"), F.count(F.col("shares") * F.col("price")).alias("_ok"), F.sum("shares").alias("shares"), (F.sum(F.col("shares") * F.col("price")) / F.sum("shares")).alias("price"))
    apart = lots.join(whole.where("lots <> _ok").select("ticker"), "ticker", "left_semi").select("ticker", F.lit(1).cast("long").alias("lots"), "shares", "price")
    return whole.where("lots = _ok").select("ticker", "lots", "shares", "price").unionByName(apart)


def funnel(daily: DataFrame, stages: list[str]) -> DataFrame:
    """stage, place, mean a day, active days, drop from the stage before."""
    sums = daily.agg(*[F.avg(s).alias(s) for s in stages], *[F.sum((F.col(s) > 0).cast("long")).alias(f"a_{s}") for s in stages])
    long = sums.select(F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(s).alias("stage"), F.col(s).cast("double").alias("mean"), F.col(f"a_{s}").alias("active")) for i, s in enumerate(stages)])).alias("x")).select("x.*")
    return long.withColumn("drop", F.lag("mean").over(W.orderBy("place")) - F.col("mean"))


def overlaps(holdings: DataFrame, least: int = 2) -> DataFrame:
    """ticker and the sorted strategies that hold it, where these are at least two."""
    held = holdings.groupBy("ticker").agg(F.array_sort(F.collect_set("strategy")).alias("_s"))
    return held.where(F.size("_s") >= least).select("ticker", F.array_join("_s", ",").alias("strategies"), F.size("_s").alias("n"))


def listed_holdings(rows: DataFrame, column: str = "holdings", cash: tuple[str, ...] = ("CASH", "KONTANT")) -> DataFrame:
    """A comma-separated list as rows with rank from 1; cash markers are left out."""
    return rows.select("key", F.posexplode(F.split(column, ",")).alias("rank", "ticker")).select("key", (F.col("rank") + 1).alias("rank"), F.upper(F.trim("ticker")).alias("ticker")).where((F.col("ticker") != "") & ~F.col("ticker").isin(*cash))


def invested(daily: DataFrame) -> DataFrame:
    return daily.groupBy("key").agg(F.avg("invested").alias("mean_invested"), F.avg((F.col("invested") <= 0).cast("double")).alias("risk_off"))


def export_errors(exports: DataFrame, least_version: int = 2) -> DataFrame:
    """strategy, errors: old accounting versions and exports not declared valid."""
    old = F.when(F.coalesce("version", F.lit(0)) < least_version, F.lit("old accounting version"))
    bad = F.when(~F.coalesce(F.col("valid"), F.lit(False)), F.lit("not declared valid"))
    return exports.select("strategy", F.array_compact(F.array(old, bad)).alias("errors"))


def last_trades(trades: DataFrame, key: str = "variant", most: int = 40, then: tuple[str, ...] = ("seq", "ticker")) -> DataFrame:
    """Each key's last `most` trades with their place, latest first; of one day by `then`: the first column descending, the rest ascending. Ties beyond
    these columns are broken by none, so name enough. Every task keeps its own `most` before rows are shuffled."""
    order = [F.desc("d"), F.desc(then[0]), *then[1:]]
    return trades.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("place") <= most)
