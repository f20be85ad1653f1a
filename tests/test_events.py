"""The event operators on small fixtures with known answers, and the invariants that hold for any input."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from tidemark.functions import text as X
from tidemark.operators import announcements, blend, calendar, capital, clusters, keys, merge, pages, prices, quality, results, selection, signals, stats
from tidemark.sources import tables
from tidemark.streaming import incremental


def day(n, start=dt.date(2024, 1, 1)):
    return start + dt.timedelta(days=n)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_text_functions(spark):
    rows = [("1 234,50", None, 1234.5), ("1,234.50", None, 1234.5), ("1.234", None, 1234.0), ("1.5", None, 1.5), ("(12)", None, -12.0), ("-3,25", None, -3.25), ("1.234", "EN", 1.234), ("1,234", "NB", 1.234), ("abc", None, None), (None, None, None)]
    got = frame(spark, [r[:2] for r in rows], "t string, s string").select(X.human_number(F.col("t"), F.col("s")).alias("x")).collect()
    assert [r.x for r in got] == [r[2] for r in rows]
    dates = ["2024-03-05", "5.3.2024", "05/03/2024", "5 March 2024", "March 5, 2024", "5. mars 2024", "31.2.2024", "1980-01-01", None]
    got = [r.x for r in frame(spark, [(d,) for d in dates], "t string").select(X.calendar_date(F.col("t")).alias("x")).collect()]
    assert got == [dt.date(2024, 3, 5)] * 6 + [None] * 3
    one = frame(spark, [("kl. 16.35", "a​b “x” –", "1.000 and 2.500,75", 0.73)], "a string, b string, c string, n double")
    r = one.select(X.minute_of_day(F.col("a")).alias("a"), X.one_line(F.col("b")).alias("b"), X.convention(F.col("c")).alias("c"), X.serial_date(F.col("n")).alias("n"), X.serial_date(F.lit(45000.5)).alias("m"), X.amount(F.lit("kr 1 200 000")).alias("k")).first()
    assert (r.a, r.b, r.c, r.n, r.m, r.k.value, r.k.currency) == (995, 'ab "x" -', "NB", None, dt.date(2023, 3, 15), 1_200_000, "NOK")


def test_anchored_clusters_and_running_facts(spark):
    rows = [(f"m{n}", day(n), 600, "T", p, "BUY", 100.0 * (i + 1)) for i, (n, p) in enumerate([(0, "ONE"), (19, "TWO"), (39, "ONE"), (44, None), (79, "ONE")])]
    schema = "msg_id string, d date, minute int, ticker string, person string, class string, amount double"
    got = {r.msg_id: r for r in clusters.running(clusters.anchored(frame(spark, rows, schema))).collect()}
    assert [got[f"m{n}"].cluster for n in (0, 19, 39, 44, 79)] == [1, 1, 2, 2, 3]
    assert (got["m0"].persons, got["m19"].persons, got["m19"].amount_so_far) == (1, 2, 300.0)
    assert got["m0"].is_primary and not got["m19"].is_primary and got["m39"].is_primary
    fewer = {r.msg_id: r for r in clusters.running(clusters.anchored(frame(spark, rows[:3], schema))).collect()}
    assert all(fewer[k] == got[k] for k in fewer)  # later rows change nothing


def test_calendar_effective_dates_and_fill(spark):
    dates = [d for d in (day(i) for i in range(40)) if d.weekday() < 5]
    rows = [("A", d, 10.0 + i, 5.0) for i, d in enumerate(dates)] + [("B", d, 20.0, 5.0) for i, d in enumerate(dates) if i < 3 or i > 10] + [("C", dates[2], 1.0, 1.0)]
    p = frame(spark, rows, "ticker string, d date, close double, volume double")
    cal = calendar.trading_days(p)
    assert [r.d for r in cal.orderBy("pos").collect()] == dates
    events = frame(spark, [("early", day(4), 500), ("late", day(4), 980), ("unknown", day(4), None), ("weekend", day(5), 10), ("far", day(200), 10)], "msg_id string, d date, minute int")
    got = {r.msg_id: r.trade_d for r in calendar.effective(events, cal).collect()}
    assert got == {"early": day(4), "late": day(7), "unknown": day(7), "weekend": day(7), "far": None}
    b = [r.px for r in calendar.aligned(p, cal).where("ticker = 'B'").orderBy("pos").collect()]
    assert b[3:11] == [20.0] * 5 + [None] * 3 and b[11] == 20.0


def test_merge_and_returns(spark):
    dates = [day(i) for i in range(30)]
    rows = [("A", d, 100.0 + i, 10.0) for i, d in enumerate(dates)] + [("B", d, 50.0, 10.0) for d in dates[:12]]
    p = frame(spark, rows, "ticker string, d date, close double, volume double")
    cal = calendar.trading_days(p)
    events = frame(spark, [("a", day(10), 100, "A"), ("gone", day(20), 100, "B"), ("soon", day(8), 100, "B"), ("none", day(8), 100, None), ("new", day(29), 100, "A"), ("unknown", day(8), 1, "Z")], "msg_id string, d date, minute int, ticker string")
    m = merge.merged(events, p, cal)
    assert {r.msg_id: r.status for r in m.collect()} == {"a": "OK", "gone": "DELISTED", "soon": "OK", "none": "NO_TICKER", "new": "TOO_NEW", "unknown": "UNKNOWN_TICKER"}
    level = frame(spark, [(d, 100.0) for d in dates], "d date, level double")
    got = {(r.msg_id, r.h): r for r in merge.horizon_returns(m, p, cal, level).collect()}
    assert got["a", 5].ret == pytest.approx(115 / 110 - 1) and got["a", -5].ret == pytest.approx(105 / 110 - 1) and ("a", 60) not in got
    assert got["soon", 10].delisted and got["soon", 10].ret == 0.0 and not got["soon", 1].delisted


def test_price_repair(spark):
    def flags(values):
        p = frame(spark, [("T", day(i), float(v)) for i, v in enumerate(values)], "ticker string, d date, close double")
        return [r.flag for r in prices.unit_breaks(p).orderBy("d").collect()], [r.close for r in prices.repaired(p).orderBy("d").collect()]

    flag, fixed = flags([0.101440, 10.144007, 10.20])
    assert flag == [None, "REPAIRABLE", None] and fixed == pytest.approx([10.144, 10.144007, 10.20])
    for ratio, expect in ((4.0, "UNVERIFIED"), (4.7, "UNVERIFIED"), (9, "UNVERIFIED"), (0.25, "UNVERIFIED"), (3.9, None), (100.4, "REPAIRABLE"), (103, "UNVERIFIED")):
        assert flags([1.0, ratio])[0][1] == expect
    _, fixed = flags([1.00, 1.10, 1.05, 105.0, 110.25])
    assert fixed == pytest.approx([100, 110, 105, 105, 110.25])
    again = frame(spark, [("T", day(i), v) for i, v in enumerate(fixed)], "ticker string, d date, close double")
    assert prices.unit_breaks(again).where("flag is not null").count() == 0


def test_daily_rebalancing_equals_a_day_by_day_loop(spark):
    rng = random.Random(5)
    n, tickers = 40, [f"T{i}" for i in range(6)]
    px = {t: [100.0] for t in tickers}
    for t in tickers:
        for _ in range(n - 1):
            px[t].append(px[t][-1] * (1 + rng.uniform(-0.05, 0.05)))
    px["T5"][25:] = [None] * (n - 25)  # a lost price
    cal = frame(spark, [(day(i), i) for i in range(n)], "d date, pos int")
    aligned = frame(spark, [(t, i, day(i), px[t][i]) for t in tickers for i in range(n) if px[t][i] is not None or i == 25], "ticker string, pos int, d date, px double")
    picks = {i: sorted(rng.sample(tickers, rng.randint(1, 5))) for i in range(n)}
    cand = frame(spark, [("v", i, day(i), t, 60.0) for i, ts in picks.items() for t in ts if px[t][i] is not None], "variant string, pos int, d date, ticker string, strength double")
    got = [r.value for r in signals.daily_returns(signals.weights(cand), aligned, cal).orderBy("pos").collect()]
    value, held = 1.0, {}
    for i in range(n):
        value *= 1 + sum(w * (px[t][i] / px[t][i - 1] - 1 if px[t][i] is not None else -1.0) for t, w in held.items())
        assert got[i] == pytest.approx(value, rel=1e-12)
        ts = [t for t in picks[i] if px[t][i] is not None]
        held = {t: min(1 / 3, 1 / len(ts)) for t in ts} if len(ts) >= 3 else {}
    names = signals.weights(cand).groupBy("pos").count().collect()
    assert min(r["count"] for r in names) >= 3  # whole or empty


def test_percentiles_have_no_look_ahead(spark):
    rng = random.Random(2)
    rows = [(s, day(rng.randint(0, 40)), f"t{i}", float(rng.randint(0, 20))) for s in "ab" for i in range(300)]
    schema = "source string, d date, ticker string, raw double"
    got = {tuple(r)[:4]: r.pct for r in blend.expanding_percentiles(frame(spark, rows, schema), rows_a_part=5).select("source", "d", "ticker", "raw", "pct").collect()}
    for s, d, t, x in rows[::17]:
        base = [r[3] for r in rows if r[0] == s and r[1] < d]
        expect = 100 * sum((b < x) + (b == x) / 2 for b in base) / len(base) if base else 50
        assert got[s, d, t, x] == pytest.approx(expect)
    cut = day(20)
    part = {tuple(r)[:4]: r.pct for r in blend.expanding_percentiles(frame(spark, [r for r in rows if r[1] <= cut], schema), rows_a_part=7).select("source", "d", "ticker", "raw", "pct").collect()}
    assert all(got[k] == pytest.approx(v) for k, v in part.items())


def test_blend_is_strict_and_expires(spark):
    s = frame(spark, [("x", day(0), "T", 100.0)], "source string, d date, ticker string, pct double")
    src = frame(spark, [("x", 0.25, 3), ("y", 0.25, 3), ("z", 0.25, 3), ("w", 0.25, 3)], "source string, weight double, valid_days int")
    days = frame(spark, [(day(i),) for i in range(6)], "d date")
    got = {r.d: (r.blend, r.n_sources) for r in blend.as_of_blend(s, days, src).collect()}
    assert got == {day(i): (62.5, 1) for i in (1, 2, 3)}


def test_capital_blend(spark):
    ends = [dt.date(2025, 1, 31), dt.date(2025, 2, 28), dt.date(2025, 3, 31)]
    curves = {"a": [100, 110, 121], "b": [100, 90, 90], "c": [100, 100, 100], "d": [100, 100, 100]}
    nav = frame(spark, [(k, d, float(v)) for k, vs in curves.items() for d, v in zip(ends, vs, strict=True)], "sleeve string, d date, nav double")
    o = capital.month_observations(nav, "2025-04-15")
    w = capital.common_window(o)
    got = [r.value for r in capital.blended(o, w).orderBy("month").collect()]
    assert got == pytest.approx([1_000_000, 1_000_000, 1_025_000])
    moved = capital.transfers(o, w).groupBy("month").agg(F.sum("transfer").alias("s")).orderBy("month").collect()
    assert [r.s for r in moved][1:] == pytest.approx([0, 0], abs=1e-6)
    scaled = capital.month_observations(nav.withColumn("nav", F.col("nav") * F.when(F.col("sleeve") == "a", 7).otherwise(2)), "2025-04-15")
    assert [r.value for r in capital.blended(scaled, w).orderBy("month").collect()] == pytest.approx(got)
    assert capital.month_observations(frame(spark, [("a", dt.date(2025, 8, 29), 1.0), ("b", dt.date(2026, 8, 19), 1.0)], "sleeve string, d date, nav double"), "2026-09-01").count() == 1
    bad = frame(spark, [("a", day(0), 0.0), ("a", day(1), 1.0), ("b", day(0), 1.0), ("b", day(0), 1.0), ("c", day(0), 1.0)], "sleeve string, d date, nav double")
    assert {(r.sleeve, r.error) for r in capital.errors(bad, day(9)).collect()} == {("a", "invalid value"), ("b", "duplicate date"), ("c", "too few points")}


def test_selection_uses_training_only(spark):
    schema = "variant string, ord int, train_days int, train_entries int, train_tickers int, train_moderate_cagr double, worst_half_stress_cagr double, train_turnover double, test_cagr double, full_cagr double"
    rows = [("daily", 1, 445, 40, 9, 1.0, 1.0, 1000.0, 9.0, 1.0), ("decay", 2, 445, 40, 9, 1.0, 3.0, 800.0, 0.0, 2.0), ("score", 3, 445, 40, 9, 1.0, 2.0, 600.0, 99.0, 3.0)]
    assert selection.robust(frame(spark, rows, schema), "daily").first().variant == "decay"
    tie = [(*r[:6], 3.0, *r[7:]) for r in rows]
    assert selection.robust(frame(spark, tie, schema), "daily").first().variant == "score"
    short = [(*r[:2], 120, *r[3:]) for r in rows]
    got = selection.robust(frame(spark, short, schema), "daily").first()
    assert got.variant == "daily" and got.is_fallback


def test_trades_and_cost_basis(spark):
    lots = frame(spark, [("k", 1, 10.0, 100.0), ("k", 2, 10.0, 200.0), ("k", 3, -5.0, 500.0), ("gone", 1, 5.0, 10.0), ("gone", 2, -5.0, 20.0)], "key string, seq int, shares double, price double")
    got = {r.key: (r.shares, r.cost) for r in signals.cost_basis(lots).collect()}
    assert got == {"k": (15.0, 150.0), "gone": (0.0, None)}
    acts = frame(spark, [("v", i, "T", a) for i, a in enumerate(["BUY", "BUY", "TRIM", "SELL", "BUY"])], "variant string, pos int, ticker string, action string")
    assert signals.entries(acts).first().entries == 2
    t = frame(spark, [("A", day(0), "BUY", 10.0), ("A", day(2), "SELL", 12.0), ("A", day(2), "BUY", 11.0), ("B", day(1), "SELL", 5.0)], "ticker string, d date, side string, price double")
    assert {r.ticker: r.ret for r in results.paired(t).collect()} == {"A": pytest.approx(0.2), "B": None}


def test_quality(spark):
    as_of = F.lit("2026-09-20").cast("date")
    rows = frame(spark, [("2026-09-18", "FRESH"), ("2026-08-19", "STALE"), ("2026-09-25", "STALE"), (None, "MISSING")], "d string, expect string")
    assert rows.where(quality.freshness(F.col("d").cast("date"), as_of, 7) != F.col("expect")).count() == 0
    old = frame(spark, [(day(i),) for i in range(10)], "d date")
    assert quality.replacement_is_safe(old, old.limit(0)).first().verdict == "EMPTY"
    assert quality.replacement_is_safe(old, old.where("d < '2024-01-08'")).first().verdict == "FEWER"
    assert quality.replacement_is_safe(old, old.where("d < '2024-01-10'")).first().verdict == "SHORTER"
    assert quality.replacement_is_safe(old, old).first().verdict == "SAFE"


def test_language_duplicates(spark):
    rows = [("X", day(0), 600, "n1", "NB"), ("X", day(0), 602, "e1", "EN"), ("X", day(0), 620, "e2", "EN"), ("X", day(0), 621, "e3", "EN"), ("Y", day(0), 600, "n2", "NB"), ("X", day(0), 622, "u", None)]
    got = keys.language_duplicates(frame(spark, rows, "company string, d date, minute int, msg_id string, lang string"))
    assert [r.msg_id for r in got.collect()] == ["n1"]


def test_language_duplicates_of_long_days(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["X", "Y", None]), day(rng.randrange(2)), rng.randrange(300), f"m{i:04}", rng.choice(["EN", "NB", "DE", None])) for i in range(1500)]
    gone, opened = [], {}
    for company, d, minute, msg_id, lang in sorted((r for r in rows if r[4]), key=lambda r: (r[2], r[3])):
        waiting = opened.setdefault((company, d), [])
        partner = next((w for w in waiting if w[2] != lang and minute - w[0] <= 3), None)
        if partner:
            waiting.remove(partner)
            gone.append(partner[1] if lang == "EN" else msg_id)
        else:
            waiting.append((minute, msg_id, lang))
    got = keys.language_duplicates(frame(spark, rows, "company string, d date, minute int, msg_id string, lang string").repartition(3))
    assert sorted(r.msg_id for r in got.collect()) == sorted(gone) and len(gone) > 300
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_announcement_reading(spark):
    text = "Name: Jane Doe\nPosition: Chief Executive Officer\nIssuer: X ASA\nNature of transaction: Purchase of shares\nVolume: 1,035\nPrice: NOK 105.50\n\nAfter the transaction she holds 50,055 shares."
    rows = [("a", "Mandatory notification", text), ("b", "Notice", text.replace("Purchase", "Sale")), ("c", "Private placement", text), ("d", "t", "nothing here"), ("e", None, None)]
    got = {r.msg_id: r for r in announcements.read(frame(spark, rows, "msg_id string, title string, text string")).collect()}
    assert (got["a"]["class"], got["a"].net, got["a"].price, got["a"].role, got["a"].rank, got["a"].after) == ("BUY", 1035, 105.5, "CEO", 1, 50055)
    assert got["a"].increase == pytest.approx(100 * 1035 / (50055 - 1035))
    assert got["b"]["class"] == "SELL" and got["c"]["class"] == got["d"]["class"] == got["e"]["class"] == "UNKNOWN"


def test_announcements_in_other_words(spark):
    form = "Name\nJane Doe\nPosition/status\nChair of the board\nNature of transaction\n{}\n{}\nHolding after the transaction: 12 000\n"
    rows = [
        ("pairs", "t", form.format("Purchase of shares", "Price: NOK 10.50 Volume: 1,000\nPrice: NOK 11.50 Volume: 3,000\nAggregated information: Price: NOK 11.25 Volume: 4,000")),
        ("only total", "t", form.format("Purchase of shares", "Aggregated: volume 4,000 price NOK 11.25")),
        ("table", "t", form.format("Acquisition", "Price      Volume\nNOK 10.50    1,000\nNOK 11.50    3,000")),
        ("tax", "t", form.format("Sale of shares, sold to cover tax", "Volume\n500\nPrice\n10.50")),
        ("prose", "t", "Jane Doe, chief financial officer, has today purchased 5,000 shares in the company at an average price of NOK 12.50 per share. She now holds 9,000 shares."),
        ("late price", "t", "John, close associate of the CEO, sold 700 shares" + " in the market" * 8 + " for a price of 3.25. " + "x" * 40),
        ("too late", "t", "John sold 700 shares" + " in the market" * 14 + " for a price of 3.25."),
        ("scrip", "Scrip dividend", form.format("Acquisition", "Volume: 5 Price: 1")),
        ("stolen", "t", "Nature of transaction: purchase\nThis sentence ends in price\n77\nVolume: 10\nPrice: 2.5"),
    ]
    got = {r.msg_id: r for r in announcements.read(frame(spark, rows, "msg_id string, title string, text string")).collect()}
    for name in ("pairs", "only total", "table"):
        assert (got[name]["class"], got[name].net, got[name].price, got[name].role, got[name].after) == ("BUY", 4000, 11.25, "CHAIR", 12000), name
    assert (got["tax"]["class"], got["tax"].excluded, got["scrip"].excluded) == ("UNKNOWN", "tax", "dividend")
    assert (got["prose"]["class"], got["prose"].net, got["prose"].price, got["prose"].role, got["prose"].after) == ("BUY", 5000, 12.5, "CFO", 9000)
    assert (got["late price"]["class"], got["late price"].price, got["late price"].role, got["late price"]["rank"]) == ("SELL", 3.25, "CEO", 6)
    assert got["too late"].net is None and got["stolen"].price == 2.5


def test_residual_text_keeps_labels(spark):
    pages_ = [(i, n, t, False, len(t), 0) for i in range(30) for n, t in enumerate(["A menu of many entries that all pages have", "Volume", f"{1000 + i}", "Price", f"{i} kroner and some words of this page alone", "All rights reserved by someone"])]
    found = frame(spark, pages_, "page_id int, block_no int, text string, soft boolean, chars int, link_chars int")
    shared = pages.boilerplate(found)
    got = {r.page_id: r.text for r in pages.residual(found, shared).collect()}
    assert got[3].split("\n")[:2] != ["A menu of many entries that all pages have"] and "Price" in got[3] and "3 kroner" in got[3] and "rights" not in got[3]
    wider = {r.page_id: r.text for r in pages.residual(found, shared, least=60).collect()}
    assert "Volume" in wider[3] and "rights" in wider[3]
    assert pages.residual(found, shared, least=1000).count() == 0


def test_filters_slices_and_exponential_means(spark):
    closes = [(t, f"2020-{1 + i // 28:02d}-{1 + i % 28:02d}", 10 + (i * 7 + k * 3) % 11) for k, t in enumerate("ab") for i in range(300 if t == "a" else 5)]
    p = frame(spark, closes, "ticker string, d string, close int").selectExpr("ticker", "to_date(d) d", "double(close) close")
    got = {(r.ticker, str(r.d)): r.ema for r in prices.exponential_mean(p, 20, block=64).collect()}
    for t in "ab":
        ema = None
        for k, d, c in (x for x in closes if x[0] == t):
            ema = c if ema is None else ema + 2 / 21 * (c - ema)
            assert got[k, d] == pytest.approx(ema)
    s = frame(spark, [("a", 5, 1.0), ("b", 5, 2.0), ("c", 5, 3.0)], "ticker string, pos0 int, score double")
    m = frame(spark, [("a", 4, 0.1, 0.0, 2.0), ("b", 4, -0.2, 0.1, None)], "ticker string, pos int, long double, short double, lift double")
    names = lambda **how: sorted(r.ticker for r in signals.filtered(s, m, **how).collect())
    assert names() == ["a", "b", "c"] and names(momentum=0.1) == ["a"] and names(reversal=(-0.1, 0.1)) == ["b"] and names(lift=1.0) == ["a"] and names(momentum=0.1, lift=3.0) == []
    tables_ = signals.chosen_slice({"x": frame(spark, [("v", 1), ("w", 2)], "variant string, n int")}, frame(spark, [("w",)], "variant string"))
    assert [tuple(r) for r in tables_["x"].collect()] == [(2,)]


def test_boilerplate_and_best_block(spark):
    body = "The primary insider Jane bought {n} shares at a price of NOK {p}. " * 6
    rows = [(i, f"<html><head><script>var a='<p>x</p>'</script></head><body><nav><a href=x>Menu entry one</a></nav><div class=cookie>We use cookies on this site to serve you better, accept or leave now.</div><div>{body.format(n=1000 + 7 * i, p=100 + i)}</div><footer>&copy; Exchange, all rights are reserved</footer></body></html>") for i in range(30)]
    p = frame(spark, rows, "page_id int, html string")
    found = pages.blocks(p)
    shared = {r.sample for r in pages.boilerplate(found).collect()}
    assert any("cookies" in s for s in shared) and not any("insider" in s for s in shared)
    got = {r.page_id: r for r in pages.text_index(p).collect()}
    assert len(got) == 30 and "1035 shares" in got[5].text and "cookie" not in got[5].text and got[5].how == "block"
    assert pages.index_status(pages.text_index(p)).first().status == "OK"


def test_statistics(spark):
    rows = frame(spark, [("a", day(0), 1.0), ("a", day(1), 2.0), ("b", day(0), 4.0), ("b", day(2), 5.0)], "ticker string, d date, x double")
    keyed = rows.withColumn("k", F.lit(1))
    # mean 3; residual sums a: -3, b: 3 -> 2/1 * 18 / 16
    assert stats.clustered_variance(keyed, ["k"], "x", ["ticker"]).first()["var"] == pytest.approx(2.25)
    r = stats.two_way_error(keyed, ["k"], "x", "ticker", "d").first()
    by_day = 3 / 2 * ((-1) ** 2 + (-1) ** 2 + 2**2) / 16
    both = 4 / 3 * (4 + 1 + 1 + 4) / 16
    assert r.se == pytest.approx((2.25 + by_day - both) ** 0.5)
    ties = frame(spark, [(float(x),) for x in [1] * 10 + [2] * 5 + [3] * 5], "x double")
    assert {(r.x, r.bucket) for r in stats.quantile_labels(ties, "x", 4).collect()} == {(1.0, 1), (2.0, 2), (3.0, 3)}
    low, high, _ = stats.bootstrap_interval(frame(spark, [(f"c{i}", float(i % 7)) for i in range(200)], "c string, x double"), "x", "c", rounds=300).first()
    assert low < sum(i % 7 for i in range(200)) / 200 < high


def test_sources(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write("Ticker,Close\nA,1.5\nB,x\n")
    got = tables.read_text_csv(spark, path, ["ticker", "close", "volume"]).select("ticker", X.machine_number(F.col("close")).alias("c"), "volume").collect()
    assert [tuple(r) for r in got] == [("A", 1.5, None), ("B", None, None)]
    assert tables.read_text_csv(spark, path + ".none", ["ticker"]).count() == 0
    rows = frame(spark, [("A", day(0), 1.0, 1.0, 1.0), ("IDX_O", day(0), 2.0, 2.0, 2.0)], tables.PRICES)
    tables.write_table(rows, str(tmp_path / "p"), tables.PRICES.names, "ticker")
    tables.write_table(rows.where("ticker = 'A'").withColumn("close", F.lit(9.0)), str(tmp_path / "p"), tables.PRICES.names, "ticker")
    assert [r.close for r in tables.read_prices(spark, str(tmp_path / "p")).collect()] == [9.0]
    assert [r.close for r in tables.read_prices(spark, str(tmp_path / "p"), ["IDX_O"], indices=True).collect()] == [2.0]


def test_incremental(spark, tmp_path):
    marks = frame(spark, [("g", "a", day(10), None), ("g", "b", day(10), "old")], "grp string, key string, complete_to date, last_error string")
    loads = frame(spark, [("g", "a", day(5), None), ("g", "b", day(20), "failed"), ("g", "c", day(3), None)], "grp string, key string, loaded_to date, error string")
    got = {r.key: (r.complete_to, r.last_error) for r in incremental.advanced(marks, loads).collect()}
    assert got == {"a": (day(10), None), "b": (day(10), "failed"), "c": (day(3), None)}
    source, schema = str(tmp_path / "in"), "ticker string, class string, msg_id string, d date, ts timestamp, body string"
    rows = [("T", "BUY", f"m{n}", day(n), dt.datetime(2024, 1, 1) + dt.timedelta(hours=n), "x") for n in (0, 19, 39)]
    frame(spark, [*rows, rows[0]], schema).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    query = incremental.corrections(stream, "msg_id", "body").writeStream.format("memory").queryName("fixed").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(90)
    assert spark.table("fixed").count() == 3
    stored = {"rows": frame(spark, [("m0", 1, "old")], "id string, ts int, v string")}
    each = incremental.upsert_batches(lambda: stored["rows"], lambda df: stored.update(rows=df), ["id"])
    for _ in range(2):
        each(frame(spark, [("m0", 2, "new"), ("m1", 1, "x")], "id string, ts int, v string"), 0)
    assert {tuple(r) for r in stored["rows"].collect()} == {("m0", 2, "new"), ("m1", 1, "x")}


def test_entry_and_registered_queries(spark, sf_dir):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.queries()["h7_event_study"](spark, sf_dir).count() > 0
