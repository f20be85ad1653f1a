"""Operators of single rows of the inventory: enrichment, unions, control, grid, entries, trades, attachments."""

import datetime as dt

from tidemark.operators import blend, calendar, keys, merge, pages, prices, results, signals, stats


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_enriched_keeps_every_row_once(spark):
    rows = frame(spark, [(1, "a"), (1, "b"), (2, "c"), (None, "d")], "id int, v string")
    facts = frame(spark, [(1, "Z", "u"), (1, "A", "w"), (3, "C", "x"), (None, "N", "y")], "id int, isin string, url string")
    got = sorted((r.id or 0, r.v, r.isin, r.url) for r in keys.enriched(rows, facts, "id", ["isin", "url"]).collect())
    assert got == [(0, "d", None, None), (1, "a", "A", "w"), (1, "b", "A", "w"), (2, "c", None, None)]
    assert {r.isin for r in keys.enriched(rows.where("id = 1"), facts, "id", ["isin"], ["url"]).collect()} == {"Z"}
    assert keys.enriched(rows, facts.limit(0), "id", ["isin"]).count() == 4 and keys.enriched(rows.limit(0), facts, "id", ["isin"]).count() == 0


def test_unions_common_and_missing(spark):
    a, b = frame(spark, [(1, "x"), (1, "x"), (None, "y")], "k int, n string"), frame(spark, [(1,), (2,), (2,)], "k int")
    got = sorted((r.source, r.k or 0, r.n) for r in keys.bag_union({"a": a, "b": b}, ["k", "n"]).collect() if r.source == "a")
    assert got == [("a", 0, "y"), ("a", 1, "x"), ("a", 1, "x")]
    assert keys.bag_union({"a": a, "b": b}, ["k", "n"]).count() == 6 and keys.bag_union({"b": b}, ["k", "none"]).columns == ["source", "k", "none"]
    assert [r.k for r in keys.common([a, b], "k").collect()] == [1] and keys.common([a, b.limit(0)], "k").count() == 0
    assert [r.k for r in keys.missing(b, a, "k").collect()] == [2] and keys.missing(a, b, "k").count() == 0 and keys.missing(a, b.limit(0), "k").count() == 1


def test_latest_by_ticker(spark):
    rows = frame(spark, [("T", "m1", day(1)), ("T", "m3", day(2)), ("T", "m2", day(2)), ("T", "m9", None), ("U", "m4", None), (None, "m5", day(1))], "ticker string, msg_id string, trade_d date")
    assert [tuple(r) for r in merge.latest_by_ticker(rows).collect()] == [("T", "m3", day(2))]


def test_curve_control_and_grid(spark):
    rows = [(f"m{i}", "BUY" if i % 2 else "SELL", f"T{i % 5}", day(i), h, (0.02 if i % 2 else 0.0) * (h == 5) + 0.001 * (i % 3), float(i), [True, False, None][i % 3]) for i in range(40) for h in (1, 5)]
    r = frame(spark, rows, "msg_id string, class string, ticker string, trade_d date, h int, excess double, amount double, above boolean")
    curve = {x.h: (x.n, x.mean) for x in stats.event_curve(r).collect()}
    assert curve[1][0] == 40 and abs(curve[5][1] - sum(x[5] for x in rows if x[4] == 5) / 40) < 1e-12 and stats.event_curve(r, least=41).count() == 0
    assert {x["class"] for x in stats.event_curve(r, ["class"]).collect()} == {"BUY", "SELL"}
    control = {x.h: x for x in stats.buy_sell_control(r).collect()}
    assert control[1].verdict == "ALIKE" and control[5].verdict == "APART" and control[5].n_buys == control[5].n_sells == 20
    swapped = r.replace({"BUY": "SELL", "SELL": "BUY"}, subset=["class"])
    assert {x.h: x.verdict for x in stats.buy_sell_control(swapped).collect()} == {1: "ALIKE", 5: "REVERSED"}
    assert {x.verdict for x in stats.buy_sell_control(r.where("class = 'BUY'")).collect()} == {"NO_CONTROL"}
    grid = {(x.threshold, x.trend, x.h): x for x in stats.threshold_grid(r, "amount", [0, 20], "above").collect()}
    for (t, k, h), x in grid.items():
        taken = [v for v in rows if v[4] == h and v[6] >= t and (k == "any" or v[7])]
        assert x.n == len(taken) and abs(x.mean - sum(v[5] for v in taken) / len(taken)) < 1e-12
    assert len(grid) == 8 and grid[20.0, "above", 5].se is None and grid[0.0, "any", 5].se is not None


def test_sentiment_entries(spark):
    days = [n for n in range(200) if n % 7 < 5]
    p = frame(spark, [("T", day(n), 100.0 + n, 1.0) for n in days] + [("U", day(n), 300.0 - n, 1.0) for n in days if n > 20], "ticker string, d date, close double, volume double")
    cal = calendar.trading_days(p)
    e = frame(spark, [(c, day(n), f"{c}{n}", 30.0) for c in "TUV" for n in (60, 180, 183, 199)], "company string, d date, url string, pct_change double")
    got = {r.url: r for r in blend.sentiment_entries(e, p, cal, 120).collect()}
    first = lambda n: next(x for x in days if x > n)
    assert {u: r.entry_d for u, r in got.items()} == {f"{c}{n}": day(first(n)) for c, n in (("T", 180), ("T", 183))}
    few = {r.url for r in blend.sentiment_entries(e, p, cal, 100).collect()}
    assert few == {"T180", "T183", "U180", "U183"} and {r.url for r in blend.sentiment_entries(e, p, cal, 100, with_trend=True).collect()} == {"T180", "T183"}
    t = {r.d: r for r in prices.trend(p.where("ticker = 'T'")).collect()}
    assert t[day(0)].prior == 0 and t[day(0)].above is None and t[day(1)].above is False and t[day(2)].above is True and t[day(199 - 199 % 7)].prior == len([n for n in days if n < 199 - 199 % 7])


def test_last_trades_and_variants(spark):
    rows = [("v", day(n % 9), n, f"T{n}") for n in range(60)] + [("w", day(1), 1, "B"), ("w", day(1), 1, "A")]
    t = frame(spark, rows, "variant string, d date, seq int, ticker string")
    got = [(r.variant, r.place, r.seq, r.ticker) for r in results.last_trades(t, most=5).orderBy("variant", "place").collect()]
    assert got[:5] == [("v", i + 1, s, f"T{s}") for i, s in enumerate([53, 44, 35, 26, 17])] and got[5:] == [("w", 1, 1, "A"), ("w", 2, 1, "B")]
    cal = frame(spark, [(day(n), n) for n in range(6)], "d date, pos int")
    p = frame(spark, [("A", day(n), 100.0 * 1.01**n, 1.0) for n in range(6)] + [("B", day(n), 50.0 + n % 2, 1.0) for n in range(6)], "ticker string, d date, close double, volume double")
    w = frame(spark, [("x", n, t_, 0.5) for n in range(5) for t_ in "AB"], "variant string, pos int, ticker string, w double")
    rates = frame(spark, [("free", 0.0), ("dear", 0.01)], "scenario string, rate double")
    found = {r.key: r for r in signals.variant_comparison(w, calendar.aligned(p, cal), cal, rates).collect()}
    assert set(found) == {"x/free", "x/dear"} and found["x/dear"].cagr < found["x/free"].cagr and found["x/free"].points == found["x/dear"].points


def test_attachments_are_the_third_leg(spark):
    menu = "<nav><a href=x>A menu that all pages have in common</a></nav><footer>All rights reserved by someone</footer>"
    rows = [(i, f"<body>{menu}<p>{'Own words of page %d, and more of them. ' % i * (12 if i % 3 == 0 else 2)}</p></body>" if i % 3 < 2 else f"<body>{menu}</body>") for i in range(30)]
    p = frame(spark, [*rows, (30, None)], "page_id int, html string")
    att = frame(spark, [(2, 2, "second  part"), (2, 1, "first\npart"), (2, 3, " "), (5, None, None), (8, 1, ""), (0, 1, "unused"), (99, 1, "no page")], "page_id int, attachment_no int, text string")
    got = {r.page_id: r for r in pages.text_index(p, att, least=60).collect()}
    assert len(got) == 31 and got[0].how == "block" and got[1].how == "residual" and (got[2].how, got[2].text) == ("attachment", "first part\nsecond part")
    assert got[5].how == got[8].how == got[30].how == "none" and got[5].text == ""
    status = pages.index_status(pages.text_index(p, att, least=60)).first()
    assert (status.pages, status.n_block, status.n_residual, status.n_attachment, status.n_none, status.status) == (31, 10, 10, 1, 10, "OK")
    assert pages.index_status(pages.text_index(p.limit(0), att)).first().status == "FAIL"
    same = frame(spark, [(i, f"<p>{'The same words on every page of these. ' * 5}{i % 4}</p>") for i in range(10)], "page_id int, html string")
    assert pages.index_status(pages.text_index(same)).first().status == "PARTIAL"
