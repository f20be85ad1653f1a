"""Statistics of events: clustered errors, event study rows, quantile labels, bootstrap."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.tables import stored
from .order import first_half, medians, order_statistics, running_counts, with_facts


def summary(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys, n, mean, median, up (share above zero), sd of x."""
    c = F.col(x)
    moments = rows.groupBy(*keys).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.avg((c > 0).cast("double")).alias("up"), F.stddev_samp(c).alias("sd"))
    return with_facts(moments, medians(rows, keys, x), keys, "left").select(*keys, "n", "mean", "median", "up", "sd")


def clustered_variance(rows: DataFrame, keys: list[str], x: str, cluster: list[str]) -> DataFrame:
    """keys, var: variance of the mean of x clustered by `cluster`, G / (G - 1); null with one cluster."""
    mean = rows.groupBy(*keys).agg(F.avg(x).alias("_m"), F.count(x).alias("_n"))
    sums = rows.join(mean, keys).groupBy(*keys, *cluster).agg(F.sum(F.col(x) - F.col("_m")).alias("_s"), F.first("_n").alias("_n"))
    g = F.count(F.lit(1))
    return sums.groupBy(*keys).agg((F.sum(F.col("_s") * F.col("_s")) * F.when(g > 1, g / (g - 1)) / F.first(F.col("_n") * F.col("_n"))).alias("var"))


def cells_of(rows: DataFrame, keys: list[str], x: str, a: str, b: str, weight: str | None = None) -> DataFrame:
    """Sum, count and rows above zero per (keys, a, b): all that means, clustered errors and resampling need. The one shuffle of rows. weight: how many equal
    rows a row stands for."""
    w = F.col(weight) if weight else F.lit(1)
    return rows.where(F.col(x).isNotNull()).groupBy(*keys, a, b).agg(F.sum(F.col(x) * w).alias("_s"), F.sum(w).cast("long").alias("_c"), F.sum((F.col(x) > 0).cast("long") * w).alias("_up"))


def two_way_error(rows: DataFrame, keys: list[str], x: str, a: str, b: str) -> DataFrame:
    """keys, se, how: error of the mean clustered both ways, var(a) + var(b) - var(a and b); where that is negative the stricter
    one-way error. One shuffle of rows, to sums and counts per (a, b)."""
    return _two_way(cells_of(rows, keys, x, a, b), keys, a, b)


def _two_way(cells: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """A cluster's residual sum is its sum less its count times the mean."""
    mean = cells.groupBy(*keys).agg((F.sum("_s") / F.sum("_c")).alias("_m"), F.sum("_c").alias("_n"))
    parts = [cells.groupBy(*keys, *by).agg(F.sum("_s").alias("_s"), F.sum("_c").alias("_c")).select(*keys, "_s", "_c", F.lit(name).alias("_k")) for name, by in (("a", [a]), ("b", [b]), ("ab", [a, b]))]
    every = with_facts(parts[0].unionByName(parts[1]).unionByName(parts[2]), mean, keys)
    g, rest = F.count(F.lit(1)), F.col("_s") - F.col("_c") * F.col("_m")
    by_kind = every.groupBy(*keys, "_k").agg((F.sum(rest * rest) * F.when(g > 1, g / (g - 1)) / F.first(F.col("_n") * F.col("_n"))).alias("v"))
    v = by_kind.groupBy(*keys).agg(*[F.max(F.when(F.col("_k") == k, F.col("v"))).alias(k) for k in ("a", "b", "ab")])
    total = F.col("a") + F.col("b") - F.col("ab")
    how = F.when(total > 0, "two-way").when(F.col("a") >= F.col("b"), "one-way a").otherwise("one-way b")
    return v.select(*keys, F.sqrt(F.when(total > 0, total).otherwise(F.greatest("a", "b"))).alias("se"), how.alias("how"))


def study(rows: DataFrame, keys: list[str], x: str = "excess", company: str = "ticker", day: str = "trade_d", least: int = 10, rounds: int = 0, weight: str | None = None) -> DataFrame:
    """keys, n, companies, mean, median, up, se, t, significant; with rounds also low, high and crosses_zero, the interval of the mean when companies are drawn
    again. Errors and what follows are null with fewer than `least` rows. Rows are read for cells of (company, day) and for medians, nothing else.
    weight: how many equal rows a row stands for."""
    rows = rows.where(F.col(x).isNotNull())
    cells = cells_of(rows, keys, x, company, day, weight)
    base = cells.groupBy(*keys).agg(F.sum("_c").alias("n"), F.count_distinct(company).alias("companies"), (F.sum("_s") / F.sum("_c")).alias("mean"), (F.sum("_up") / F.sum("_c")).alias("up"))
    full = with_facts(with_facts(base, medians(rows, keys, x, weight=weight), keys, "left"), _two_way(cells, keys, company, day), keys, "left")
    enough = F.col("n") >= least
    t = F.when(enough, F.try_divide(F.col("mean"), F.col("se")))
    out = full.select(*keys, "n", "companies", "mean", "median", "up", F.when(enough, F.col("se")).alias("se"), t.alias("t"), (F.abs(t) > 1.96).alias("significant"))
    if not rounds:
        return out
    drawn = _resampled(cells.groupBy(*keys, company).agg(F.sum("_s").alias("_s"), F.sum("_c").alias("_c")), keys, company, rounds)
    low, high = (F.when(enough, F.col(c)) for c in ("low", "high"))
    return with_facts(out, drawn, keys, "left").withColumn("low", low).withColumn("high", high).withColumn("crosses_zero", (F.col("low") <= 0) & (F.col("high") >= 0))


#: borders of Poisson(1) counts on 32-bit numbers: how often a cluster is drawn in a round
DRAWS = [int(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2**32) for k in range(13)]


def weights(cluster: str, rounds: int) -> np.ndarray:
    """How often a cluster is drawn in each round: Poisson counts from MD5 hashes of its name, four rounds a hash."""
    words = b"".join(hashlib.md5(f"{cluster}:{q}".encode()).digest() for q in range(-(-rounds // 4)))
    return np.searchsorted(np.array(DRAWS), np.frombuffer(words, ">u4")[:rounds].astype(np.int64), side="right")


def _resampled(sums: DataFrame, keys: list[str], cluster: str, rounds: int, level: float = 0.95, least: int = 5) -> DataFrame:
    """keys, low, high from the clusters' sums and counts (_s, _c).

    A cluster's weights depend on its name and the round alone, so all keys are drawn at once and no row is made for a draw: a task adds the weighted sums of a key's
    clusters into one array of rounds, and keys' arrays are added up over tasks.
    """
    schema = sums.select(*keys).schema
    names = [f.name for f in schema]

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, {}
        total = np.zeros((2, rounds))

        def out(key):
            columns = [pa.array([v], to_arrow_type(f.dataType)) for v, f in zip(key, schema, strict=True)]
            return pa.record_batch([*columns, *[pa.array([row.tolist()], pa.list_(pa.float64())) for row in total]], [*names, "sums", "counts"])

        for batch in batches:
            for *key, name, s, c in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if key != now:
                    if now is not None:
                        yield out(now)
                    now = key
                    total[:] = 0
                if name not in known:
                    if len(known) >= 10_000:
                        known.clear()
                    known[name] = weights(name, rounds)
                total[0] += s * known[name]
                total[1] += c * known[name]
        if now is not None:
            yield out(now)

    salt = F.pmod(F.xxhash64(cluster), F.lit(16))
    dealt = sums.select(*keys, F.coalesce(F.col(cluster).cast("string"), F.lit("")).alias("_cluster"), F.col("_s").cast("double"), F.col("_c").cast("double"), salt.alias("_salt"))
    dealt = dealt.repartition(*keys, "_salt").sortWithinPartitions(*keys).drop("_salt")
    fields = [*schema.fields, T.StructField("sums", T.ArrayType(T.DoubleType())), T.StructField("counts", T.ArrayType(T.DoubleType()))]
    each = dealt.mapInArrow(drawn, T.StructType(fields)).select(*keys, F.posexplode(F.arrays_zip("sums", "counts")).alias("_round", "_x"))
    means = each.groupBy(*keys, "_round").agg((F.sum("_x.sums") / F.nullif(F.sum("_x.counts"), F.lit(0.0))).alias("_m")).where("_m is not null")
    ranked = means.select(*keys, "_m", (F.row_number().over(W.partitionBy(*keys).orderBy("_m")) - 1).alias("_i"), F.count(F.lit(1)).over(W.partitionBy(*keys)).alias("_rounds"))
    at = lambda p: F.max(F.when(F.col("_i") == F.bround(F.lit(p) * (F.col("_rounds") - 1), 0), F.col("_m")))
    found = ranked.groupBy(*keys).agg(at((1 - level) / 2).alias("low"), at((1 + level) / 2).alias("high"))
    enough = sums.groupBy(*keys).agg(F.count(F.lit(1)).alias("_g")).where(F.col("_g") >= least).drop("_g")
    return with_facts(found, enough, keys)


def samples(rows: DataFrame, split, day: str = "trade_d") -> DataFrame:
    """Each row twice: in the sample `all` and in `in` or `out`, by date."""
    side = F.when(F.col(day) < F.lit(split).cast("date"), "in").otherwise("out")
    return rows.withColumn("sample", F.explode(F.array(F.lit("all"), side)))


def quantile_labels(rows: DataFrame, x: str, k: int) -> DataFrame:
    """Adds bucket 1 .. k by order statistics x[n i / k]: equal values share a bucket. Null with fewer than 4 k rows. The bounds are k - 1
    numbers; ranks come from counts of distinct values, summed in parts."""
    upto = running_counts(rows, x)
    total = rows.agg(F.count(x).alias("_n"))
    cuts = upto.crossJoin(F.broadcast(total)).where(F.col("_n") >= 4 * k).select(x, "_c", "_upto", "_n", F.explode(F.sequence(F.lit(1), F.lit(k - 1))).alias("i")).withColumn("_at", F.floor(F.col("_n") * F.col("i") / k))
    bounds = cuts.where("_at >= _upto - _c and _at < _upto").agg(F.array_sort(F.collect_list(x)).alias("_bounds"))
    bucket = F.when((F.size("_bounds") == k - 1) & F.col(x).isNotNull(), F.size(F.filter("_bounds", lambda b: b < F.col(x))) + 1)
    return rows.crossJoin(F.broadcast(bounds)).withColumn("bucket", bucket).drop("_bounds")


def keyed_labels(rows: DataFrame, keys: list[str], x: str, k: int, name: str) -> DataFrame:
    """Adds `name`, 1 .. k by the order statistics x[n i / k] of a row's key; null without x, and where a key has fewer than 4 k values."""
    n = F.col("_n")
    bounds = order_statistics(rows, keys, x, [(f"_b{i}", i / k, F.floor(n * i / k)) for i in range(1, k)])
    bounds = bounds.select(*keys, F.when(n >= 4 * k, F.array(*[F.col(f"_b{i}") for i in range(1, k)])).alias("_bounds"))
    bounds = stored(bounds, "borders")  # few, so they go to the rows
    label = F.when(F.col("_bounds").isNotNull() & F.col(x).isNotNull(), F.size(F.filter("_bounds", lambda b: b < F.col(x))) + 1)
    return with_facts(rows, bounds, keys, "left").withColumn(name, label).drop("_bounds")


def subgroups(rows: DataFrame, keys: list[str], dims: dict[str, Column], quartiles: dict[str, str], x: str = "excess", company: str = "ticker", day: str = "trade_d", least: int = 10, least_all: int = 40) -> DataFrame:
    """keys, dim, val, n, mean, up, t for every value of every dimension with at least `least` rows, where the key has `least_all` in all.

    dims: label expressions by name; quartiles: numbers that are cut into four per key. Rows are expanded to their labels once, and on the map side
    summed to cells of (company, day); means and errors of all dimensions come from the cells.
    """
    rows = rows.where(F.col(x).isNotNull())
    for name, column in quartiles.items():
        rows = keyed_labels(rows, keys, column, 4, f"_q_{name}")
    labels = [(name, c.cast("string")) for name, c in dims.items()] + [(name, F.col(f"_q_{name}").cast("string")) for name in quartiles]
    each = F.filter(F.array(*[F.struct(F.lit(n).alias("dim"), F.nullif(v, F.lit("")).alias("val")) for n, v in labels]), lambda s: s["val"].isNotNull())
    total = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all")).where(F.col("_all") >= least_all).drop("_all")
    long = rows.select(*keys, x, company, day, F.explode(each).alias("_l")).select(*keys, x, company, day, "_l.dim", "_l.val")
    by = [*keys, "dim", "val"]
    cells = cells_of(long, by, x, company, day)
    base = cells.groupBy(*by).agg(F.sum("_c").alias("n"), (F.sum("_s") / F.sum("_c")).alias("mean"), (F.sum("_up") / F.sum("_c")).alias("up")).where(F.col("n") >= least)
    full = with_facts(with_facts(base, total, keys), _two_way(cells, by, company, day), by, "left")
    return full.select(*by, "n", "mean", "up", F.when(F.col("se") > 0, F.col("mean") / F.col("se")).alias("t"))


def score_halves(rows: DataFrame, score: str = "score", value: str = "excess", order: str = "number") -> DataFrame:
    """half (low, high), n, mean, median of value, the rows cut in the middle of the order of score; low has one less where n is odd."""
    known = first_half(rows.where(F.col(value).isNotNull()), score, order)
    return summary(known.withColumn("half", F.when(F.col("first_half"), "low").otherwise("high")), ["half"], value).select("half", "n", "mean", "median")


def bucket_test(rows: DataFrame, x: str, k: int, value: str = "excess", share: str | None = None, **columns: str) -> DataFrame:
    """A study of `value` in each of k buckets of x, with the bucket's range, and the verdict on all: RISING or FALLING where every mean is
    above or below the one before, else MIXED. share: a column of which the bucket's mean is given too. Rows without a value or a bucket are left out; the
    verdict looks at k rows."""
    labelled = quantile_labels(rows.where(F.col(value).isNotNull()), x, k).where("bucket is not null")
    span = labelled.groupBy("bucket").agg(F.min(x).alias("low"), F.max(x).alias("high"), *([F.avg(share).alias(share)] if share else []))
    up = F.col("mean") > F.lag("mean").over(W.orderBy("bucket"))
    steps = study(labelled, ["bucket"], value, **columns).withColumn("_up", up)
    every = W.partitionBy()
    verdict_ = F.when(F.bool_and("_up").over(every), "RISING").when(~F.bool_or("_up").over(every), "FALLING").otherwise("MIXED")
    return steps.withColumn("verdict", verdict_).drop("_up").join(span, "bucket")


def bootstrap_interval(rows: DataFrame, x: str, cluster: str, rounds: int = 2000, level: float = 0.95, least: int = 5, keys: list[str] | None = None) -> DataFrame:
    """keys, low, high, rounds: percentile interval of the mean when clusters are drawn again, for all keys at once. A cluster is drawn a Poisson number of times
    a round, from hashes of its name, so draws repeat; null with fewer than `least` clusters."""
    keys = keys or []
    sums = rows.where(F.col(x).isNotNull()).groupBy(*keys, cluster).agg(F.sum(x).alias("_s"), F.count(x).alias("_c"))
    if not keys:
        sums = sums.withColumn("_all", F.lit(1))
    found = _resampled(sums, keys or ["_all"], cluster, rounds, level, least)
    every = rows.select(*keys).distinct() if keys else rows.sparkSession.range(1).select(F.lit(1).alias("_all"))
    return with_facts(every, found, keys or ["_all"], "left").withColumn("rounds", F.lit(rounds)).drop("_all")


def verdict(row: DataFrame, least: int = 30) -> DataFrame:
    """Adds gate: TOO_FEW, OPEN (significantly positive out of sample) or CLOSED."""
    return row.withColumn("gate", F.when(F.col("n") < least, "TOO_FEW").when(F.col("significant") & (F.col("mean") > 0), "OPEN").otherwise("CLOSED"))


def event_curve(rows: DataFrame, keys: list[str] | None = None, x: str = "excess", least: int = 10, weight: str | None = None) -> DataFrame:
    """keys, h, n (all events that reach the horizon), mean of x (of those that have one); horizons with fewer than `least` events are left out. weight: how many
    equal rows a row stands for."""
    w = F.col(weight) if weight else F.lit(1)
    mean = F.try_divide(F.sum(F.col(x) * w), F.sum(F.when(F.col(x).isNotNull(), w)))
    return rows.groupBy(*(keys or []), "h").agg(F.sum(w).cast("long").alias("n"), mean.alias("mean")).where(F.col("n") >= least)


def buy_sell_control(rows: DataFrame, x: str = "excess", margin: float = 0.005, least: int = 10, weight: str | None = None) -> DataFrame:
    """h, n_buys, n_sells, buys, sells (means of x), difference, verdict. Buys should do better than sells; where they do not, something earlier is
    wrong. NO_CONTROL with fewer than `least` of either, APART where buys lead by more than `margin`, ALIKE within it, else REVERSED."""
    w = F.col(weight) if weight else F.lit(1)
    n = lambda side: F.sum(F.when((F.col("class") == side) & F.col(x).isNotNull(), w).otherwise(0)).cast("long")
    mean = lambda side: F.try_divide(F.sum(F.when(F.col("class") == side, F.col(x) * w)), n(side))
    both = rows.groupBy("h").agg(n("BUY").alias("n_buys"), n("SELL").alias("n_sells"), mean("BUY").alias("buys"), mean("SELL").alias("sells"))
    gap = F.col("buys") - F.col("sells")
    verdict = F.when((F.col("n_buys") < least) | (F.col("n_sells") < least), "NO_CONTROL").when(gap > margin, "APART").when(F.abs(gap) <= margin, "ALIKE").otherwise("REVERSED")
    return both.select("h", "n_buys", "n_sells", "buys", "sells", gap.alias("difference"), verdict.alias("verdict"))


def threshold_grid(rows: DataFrame, score: str, thresholds: list[float], above: str, x: str = "excess", least: int = 10) -> DataFrame:
    """threshold, trend, h and the columns of `study` for every choice of a least score, with (trend = 'above') and without ('any') the filter that
    column `above` is true. Equal rows of a company and day are counted first, and
    dealt out only to the choices that take them; null scores are in none."""
    level = sum(((F.col(score) >= t).cast("int") for t in thresholds), F.lit(0))
    counted = rows.where(F.col(x).isNotNull()).groupBy("h", "ticker", "trade_d", x, F.coalesce(F.col(above), F.lit(False)).alias("_above"), level.alias("_level")).agg(F.count(F.lit(1)).alias("_n"))
    choices = [F.struct(F.lit(float(t)).alias("threshold"), F.lit(k).alias("trend"), ((F.col("_level") > i) & ok).alias("in")) for i, t in enumerate(sorted(thresholds)) for k, ok in (("any", F.lit(True)), ("above", F.col("_above")))]
    dealt = counted.withColumn("_c", F.explode(F.filter(F.array(*choices), lambda c: c["in"]))).select("*", "_c.threshold", "_c.trend").drop("_c")
    return study(stored(dealt, "dealt"), ["threshold", "trend", "h"], x, least=least, weight="_n")
