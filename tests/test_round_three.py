"""Findings of round 3: whole seconds, work once per place, weighted rows, and texts read within their row."""

import datetime as dt

from pyspark.sql import functions as F
from tidemark.functions import text as X
from tidemark.operators import announcements, stats
from tidemark.plans import queries


def test_chart_seconds_are_the_nearest(spark, tmp_path):
    at = [dt.datetime(2024, 1, 1, 21, 59, 59, 700_000), dt.datetime(2024, 1, 1, 21, 59, 59, 300_000)]
    spark.createDataFrame([(i, t, 1, "view", 2.0) for i, t in enumerate(at)], "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.d: r.n for r in queries.QUERIES["a7_chart_json"](spark, str(tmp_path)).collect()}
    assert got == {dt.date(2024, 1, 2): 1, dt.date(2024, 1, 1): 1}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbers_are_read_without_replacing_patterns(spark):
    df = spark.createDataFrame([("(1 234,50)",), ("-1.234,5",), ("1,234,567",), ("1. 5",), ("",), ("()",)], "t string").select(X.human_number(F.col("t")).alias("x"), X.share_count(F.col("t")).alias("n"))
    assert [r.x for r in df.collect()] == [-1234.5, -1234.5, 1234567.0, 1.5, None, None]
    assert "regexp_replace" not in _plan(df).lower()


def test_announcements_are_read_within_their_row(spark):
    labelled = "Nature of the transaction: Disposal\nPrice: 10.25\nVolume: 100\nNature of the transaction: Acquisition\nPrice: 11.50\nVolume: 40\n"
    rows = [("1", "Notification of trade", labelled), ("1", "Notification of trade", "The CFO bought 200 shares at a price of NOK 5.25."), ("2", "Annual report", "Nothing."), ("3", None, None)]
    m = spark.createDataFrame(rows, "msg_id string, title string, text string")
    read = announcements.read(m)
    assert "Exchange" not in _plan(read) and "Exchange" not in _plan(announcements.trade_lines(m))
    assert [(r.net, r["class"]) for r in read.collect()] == [(-60, "UNKNOWN"), (200, "BUY"), (None, "UNKNOWN"), (None, "UNKNOWN")]
    assert [(r.side, r.price, r.volume) for r in announcements.trade_lines(m).collect()] == [("SELL", 10.25, 100), ("BUY", 11.5, 40), ("BUY", 5.25, 200)]


def test_words_with_shared_starts(spark):
    words = ["share", "shares", "sha-re", "adm.dir", "adm. dir", "chief ", "økning"]
    texts = ["two shares", "ashare", "sharex", "xadm.dirx", "sha-re", "the chiefs", "økning", "chief x", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(announcements.any_of(F.col("t"), words).alias("x"))
    assert [r.x for r in got.collect()] == [True, False, False, True, True, False, True, True, False]


def test_weighted_rows_stand_for_equal_rows(spark):
    rows = [("a" if i % 3 else "b", f"t{i % 7}", dt.date(2024, 1, 1 + i % 11), float((i * 37) % 101 - 50) if i % 13 else None, 1 + i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "h string, ticker string, trade_d date, excess double, n long")
    each = df.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("_", "n")
    tidy = lambda d: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect())
    assert tidy(stats.study(df, ["h"], rounds=50, weight="n")) == tidy(stats.study(each, ["h"], rounds=50))
    assert tidy(stats.event_curve(df, weight="n")) == tidy(stats.event_curve(each))


def test_returns_are_worked_out_once_a_place(spark, sf_dir):
    found = queries.event_returns(spark, sf_dir, (5, 20))
    assert "Window" not in _plan(found) and "SortMergeJoin" not in _plan(found)
    assert found.where("h not in (5, 20)").isEmpty() and not found.isEmpty()
