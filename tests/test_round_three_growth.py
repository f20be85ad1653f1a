"""Findings of round 3 on growth: what is held and what reaches one task follows days and keys, not rows."""

import datetime as dt

from tidemark.operators import pages
from tidemark.streaming import incremental


def test_stream_clusters_fold_times_not_events(spark, tmp_path):
    """2,000 events of four days wait as four rows; without a time an event is in no cluster, without an id it still counts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "ticker string, class string, msg_id string, d date, ts timestamp"
    day = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(k)
    rows = [("A", "BUY", f"{i:04d}", day(k).date(), day(k)) for i in range(2000) for k in [(0, 30, 31, 62)[i % 4]]]
    rows += [("A", "BUY", None, day(0).date(), day(0)), ("A", "BUY", "x", None, None), ("A", "BUY", 'a"\\,b', day(0).date(), day(0)), ("A", "BUY", "end", day(90).date(), day(90))]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    out = []
    query = incremental.stream_clusters(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
    query = query.foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).start()
    query.awaitTermination()
    most = max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"])
    assert most == 5, "four days and the one that is not due yet"
    at = lambda k: sorted((m for _, _, m, _, t in rows if t == day(k)), key=lambda m: (m is not None, m))
    first = [*at(0), *at(30)]
    want = [(m, day(0).date(), i + 1) for i, m in enumerate(first)] + [(m, day(31).date(), i + 1) for i, m in enumerate(at(31))] + [(m, day(62).date(), i + 1) for i, m in enumerate(at(62))]
    assert sorted(((m, a, n) for _, _, m, _, a, n in out), key=repr) == sorted(want, key=repr)


def test_text_index_reads_pages_once_and_wanted_attachments_only(spark):
    """Blocks come from what is written; shared blocks are sent to them; an attachment of a page that has a text is not read, others are as before."""
    note = "The primary insider purchased shares at a price of NOK 10. " * 8
    html = lambda i: "<html><body><nav><a>Home</a></nav><p>Our terms hold</p>" + (f"<p>{note} No {i}.</p>" if i % 3 else "") + "</body></html>"
    pages_ = spark.createDataFrame([(i, html(i)) for i in range(30)], "page_id long, html string")
    attached = [(i, n, t) for i in range(30) for n, t in ((2, f"second  {i}"), (1, f"first {i}"), (3, " "))] + [(3, 4, None), (99, 1, "of no page"), (None, 1, "of none")]
    attached = [(i, n, " " if i == 6 else t) for i, n, t in attached]
    found = pages.text_index(pages_, spark.createDataFrame(attached, "page_id long, attachment_no int, text string").repartition(2), least=100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan and "LeftSemi" in plan
    want = {i: ("block", f"{note}No {i}.") if i % 3 else ("none", "") if i == 6 else ("attachment", f"first {i}\nsecond {i}") for i in range(30)}
    assert {r.page_id: (r.how, r.text) for r in found.collect()} == want
