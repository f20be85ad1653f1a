"""Order statistics, as-of attachment, intervals, subgroups, scans in blocks, sessions and streams against plain Python."""

import datetime as dt
import hashlib
import os
import random
import statistics
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import keys, order, results, signals, stats
from tidemark.plans import queries
from tidemark.sources import tables
from tidemark.streaming import incremental


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


def test_medians_by_key_with_a_hot_one(spark):
    rng = random.Random(1)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(30_000)] + [("few", 1.0), ("few", 2.0), ("one", 5.0), ("none", None), (None, 3.0), (None, 9.0), (None, 4.0)] + [("ties", float(i % 3)) for i in range(999)]
    rows += [("huge", x) for x in (-1e300, 1e300, 1.0)]
    want = defaultdict(list)
    for k, x in rows:
        if x is not None:
            want[k].append(x)
    df = frame(spark, rows, "k string, x double")
    got = {r.k: r["median"] for r in order.medians(df, ["k"], "x").collect()}
    assert got == {k: statistics.median(v) for k, v in want.items()}
    assert order.medians(df.where("false"), ["k"], "x").count() == 0
    ranks = [(f"r{i}", i / 10, F.floor(F.col("_n") * i / 10)) for i in range(10)]
    found = {r.k: r for r in order.order_statistics(df, ["k"], "x", ranks).collect()}
    assert all(found[k][f"r{i}"] == sorted(v)[len(v) * i // 10] for k, v in want.items() for i in range(10))


def test_first_half_splits_ties_by_number(spark):
    rng = random.Random(2)
    for values in ([5.0] * 101, [float(rng.randrange(3)) for _ in range(200)], [1.0], [2.0, 2.0]):
        rows = [(x, i) for i, x in zip(rng.sample(range(10_000), len(values)), values, strict=True)]
        got = {r.i for r in order.first_half(frame(spark, [*rows, (None, -1)], "x double, i long"), "x", "i").where("first_half").collect()}
        assert got == {i for _, i in sorted(rows)[: len(rows) // 2]}


def test_as_of_takes_the_latest_before(spark):
    rng = random.Random(3)
    right = {(k, t): rng.random() for k in ("a", "b", None) for t in rng.sample(range(-300, 300), 40)}
    left = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(-320, 320)]), i) for i in range(400)]
    r = frame(spark, [(k, t, v) for (k, t), v in right.items()], "k string, t int, v double")
    df = frame(spark, left, "k string, at int, id int").select("*", F.lit(1).alias("_x"), F.lit("s").alias("value"))
    for span in (1, 64, 10_000):
        got = {x.id: (x.t, x.v) for x in order.as_of(df, r, "k", "at", "t", ["v"], span).collect()}
        for k, at, i in left:
            times = [t for (kk, t) in right if kk == k and k is not None and at is not None and t <= at]
            assert got[i] == ((max(times), right[k, max(times)]) if times else (None, None))


def test_intervals_of_all_keys_at_once(spark):
    rng = random.Random(4)
    rows = [(g, f"c{rng.randrange(12 if g != 'few' else 4)}", rng.gauss(1 if g == "up" else 0, 1)) for g in ("up", "flat", "few") for _ in range(300)]
    got = {r.g: r for r in stats.bootstrap_interval(frame(spark, rows, "g string, c string, x double"), "x", "c", rounds=400, keys=["g"]).collect()}
    assert got["few"].low is None
    for g in ("up", "flat"):
        sums = defaultdict(lambda: [0.0, 0])
        for gg, c, x in rows:
            if gg == g:
                sums[c][0] += x
                sums[c][1] += 1
        w = {c: stats.weights(c, 400) for c in sums}
        means = sorted(sum(w[c][r] * s for c, (s, _) in sums.items()) / n for r in range(400) if (n := sum(w[c][r] * k for c, (_, k) in sums.items())))
        at = lambda p: means[round(p * (len(means) - 1))]  # noqa: B023, E731
        assert got[g].low == pytest.approx(at(0.025)) and got[g].high == pytest.approx(at(0.975))
    assert got["up"].low > 0.5 and got["flat"].low < 0.2 and got["flat"].high > -0.2
    drawn = np.concatenate([stats.weights(f"name{i}", 2000) for i in range(50)])
    assert abs(drawn.mean() - 1) < 0.02 and abs(drawn.var() - 1) < 0.03


def test_study_with_interval_and_subgroups_find_a_planted_effect(spark):
    """Buys of the first role and a small size rise; only the groupings show it."""
    rng = random.Random(6)
    rows = []
    for i in range(2000):
        role, amount = rng.choice("AB"), rng.random() * 1000
        rows.append((20, f"T{rng.randrange(30)}", dt.date(2020 + i % 3, 1 + i % 12, 1 + i % 28), role, amount, rng.gauss(0.05 if role == "A" and amount < 250 else 0.0, 0.05)))
    df = frame(spark, [*rows, (20, "T1", dt.date(2020, 1, 1), "A", None, None)], "h int, ticker string, trade_d date, role string, amount double, excess double")
    got = {(r.dim, r.val): r for r in stats.subgroups(df, ["h"], {"year": F.year("trade_d"), "role": F.col("role")}, {"amount": "amount"}).collect()}
    assert set(got) == {("year", "2020"), ("year", "2021"), ("year", "2022"), ("role", "A"), ("role", "B"), *[("amount", str(q)) for q in (1, 2, 3, 4)]}
    assert got["amount", "1"].t > 5 and abs(got["amount", "4"].t) < 4 and got["role", "A"].t > got["role", "B"].t
    cut = sorted(r[4] for r in rows)
    first = [r[5] for r in rows if r[4] <= cut[len(rows) // 4]]
    assert got["amount", "1"].n == len(first) and got["amount", "1"].mean == pytest.approx(statistics.mean(first))
    assert stats.subgroups(df.limit(30), ["h"], {"role": F.col("role")}, {}).count() == 0
    row = stats.study(df, ["h"], rounds=300).first()
    assert row.low < row["mean"] < row.high and row.crosses_zero == (row.low <= 0 <= row.high) and row["median"] == pytest.approx(statistics.median(r[5] for r in rows))


def test_score_halves(spark):
    rows = [(float(i % 5), i / 100, i) for i in range(41)]
    got = {r.half: r for r in stats.score_halves(frame(spark, rows, "score double, excess double, number long")).collect()}
    low = [e for _, e, _ in sorted(rows, key=lambda r: (r[0], r[2]))[:20]]
    assert got["low"].n == 20 and got["high"].n == 21 and got["low"]["mean"] == pytest.approx(statistics.mean(low)) and got["low"]["median"] == pytest.approx(statistics.median(low))


@pytest.mark.parametrize("blocks", [1, 3, 17])
def test_cost_basis_in_blocks_is_the_fold(spark, blocks):
    rng = random.Random(blocks)
    rows = []
    for key, n in (("hot", 900), ("b", 30), ("c", 1), ("short", 12)):
        held = 0
        for i in range(n):
            x = rng.randrange(1, 20) if key == "short" and i else rng.choice([rng.randrange(1, 30), -rng.randrange(0, held + 1), -held])
            x = -5 if key == "short" and not i else x
            held += x
            rows.append((key, i, float(x), rng.uniform(5, 50)))
    rows += [("hot", 5000, None, 1.0), ("none", 1, 1.0, None)]
    want = {}
    for key, _, x, p in sorted((r for r in rows if None not in r), key=lambda r: r[1]):
        s, c = want.get(key, (0.0, None))
        after = s + x
        want[key] = (after, None if abs(after) < 1e-9 else (s * (c or 0) + x * p) / after if x > 0 else c)
    got = {r.key: (r.shares, r.cost) for r in signals.cost_basis(frame(spark, rows, "key string, seq long, shares double, price double"), blocks).collect()}
    assert set(got) == set(want)
    for key, (s, c) in want.items():
        assert got[key][0] == pytest.approx(s) and (got[key][1] == pytest.approx(c, rel=1e-6) if c is not None else got[key][1] is None or got[key][1] == 0)


def test_language_duplicates_fall_into_sessions(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["x", "y", None]), dt.date(2024, 1, 1 + rng.randrange(2)), rng.choice([None, *range(120)]), str(i), rng.choice(["EN", "NB", "SV", None])) for i in range(500)]
    rows += [("dense", dt.date(2024, 1, 1), m, f"d{m}{lang}", lang) for m in range(0, 60, 2) for lang in ("EN", "NB")]
    gone, open_ = set(), defaultdict(list)
    known = sorted((r for r in rows if r[2] is not None and r[4] is not None), key=lambda r: (str(r[0]), r[1], r[2], r[3], r[4]))
    for company, d, minute, msg, lang in known:
        near = [o for o in open_[company, d] if minute - o[0] <= 3]
        other = next((o for o in near if o[2] != lang), None)
        if other is None:
            near.append((minute, msg, lang))
        else:
            near.remove(other)
            gone.add(other[1] if lang == "EN" else msg)
        open_[company, d] = near
    got = [r.msg_id for r in keys.language_duplicates(frame(spark, rows, "company string, d date, minute int, msg_id string, lang string")).collect()]
    assert len(got) == len(set(got)) and set(got) == gone


def test_positions_with_marks_and_signals(spark):
    d = lambda i: dt.date(2024, 1, 1) + dt.timedelta(i)
    trades = frame(spark, [("A", d(3), 1, "BUY", 10.0, 5.0), ("B", d(1), 1, "BUY", 10.0, 5.0), ("B", d(2), 2, "SELL", 11.0, 5.0), ("C", d(90), 1, "BUY", 4.0, None)], "ticker string, d date, seq long, side string, price double, shares double")
    marks = frame(spark, [("A", d(4), 12.0), ("A", d(200), 99.0), ("B", d(4), 1.0)], "ticker string, d date, close double")
    told = frame(spark, [("A", d(3), 0.7), ("C", d(89), 0.1)], "ticker string, d date, signal double")
    got = {r.ticker: r for r in results.marked_positions(results.open_positions(trades), marks, told, F.lit(d(150))).collect()}
    assert set(got) == {"A", "C"}
    assert (got["A"].days, got["A"].mark, got["A"].mark_d, got["A"].signal, got["A"].value) == (147, 12.0, d(4), 0.7, 60.0) and got["A"].ret == pytest.approx(0.2)
    assert (got["C"].mark, got["C"].signal, got["C"].value) == (None, None, None)


def test_candidates_name_their_announcement(spark):
    d = lambda i: dt.date(2024, 1, 1) + dt.timedelta(i)
    told = frame(spark, [("A", d(1), "m1", 5.0), ("A", d(9), "m2", 6.0), ("A", d(9), "m3", 7.0), ("A", d(30), "m4", 8.0), ("B", None, "m5", 1.0)], "ticker string, trade_d date, msg_id string, amount double")
    got = {r.ticker: r for r in signals.with_source(frame(spark, [("v", "A", d(20)), ("v", "B", d(20))], "variant string, ticker string, d date"), told).collect()}
    assert (got["A"].msg_id, got["A"].amount, got["A"].trade_d, got["A"].age) == ("m3", 7.0, d(9), 11) and got["B"].msg_id is None


def test_file_facts_and_digests(spark, tmp_path):
    df = spark.range(100).select("id", F.col("id").cast("string").alias("name"))
    df.repartition(3).write.parquet(str(tmp_path / "a"))
    df.orderBy(F.desc("id")).coalesce(1).write.parquet(str(tmp_path / "b"))
    df.where("id < 99").write.parquet(str(tmp_path / "c"))
    a, b, c = (tables.source_fingerprint(spark.read.parquet(str(tmp_path / x)), ["id", "name"], "2020-01-01").first() for x in "abc")
    assert a.digest == b.digest != c.digest and (a.rows, a.files, b.files) == (100, 3, 1) and a.refreshed
    assert a.bytes == sum(f.stat().st_size for f in (tmp_path / "a").glob("*.parquet"))
    assert not tables.source_fingerprint(spark.read.parquet(str(tmp_path / "a")), ["id"], "2999-01-01").first().refreshed
    total = sum(int(hashlib.md5(f"{i}|{i}".encode()).hexdigest()[:12], 16) for i in range(100))
    assert a.digest == hashlib.md5(f"100:{total}".encode()).hexdigest()


# --- streams


def batches(spark, tmp_path, name, schema, parts):
    """A stream of one file a batch, in order."""
    folder = tmp_path / name
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        for f in folder.glob("*.parquet"):
            if not (folder / f"{f.name}.seen").exists():
                (folder / f"{f.name}.seen").touch()
                os.utime(f, (1_600_000_000 + 100 * i, 1_600_000_000 + 100 * i))
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(folder))


def at(day):
    return dt.datetime(2024, 1, 1) + dt.timedelta(day)


def test_corrections_close_and_upserts_touch_their_partitions(spark, tmp_path):
    schema = "id string, body string, part int, ts timestamp"
    parts = [
        [("k1", "A", 0, at(0)), ("k2", "B", 1, at(20)), ("k4", "D", 2, at(20))],
        [("k1", "A2", 0, at(12)), ("k2", "B", 1, at(21))],  # a correction, and a repeat of what is there
        [("k3", "Z", 3, at(1)), ("k1", "A3", 0, at(24))],  # too late: the watermark is past it; a second correction
    ]
    path = str(tmp_path / "stored")
    found = incremental.corrections(batches(spark, tmp_path, "in", schema, parts), "id", "body", late="10 days").drop("content_hash")
    sink, seen = incremental.upsert_partitions(path, ["id", "part"], "part"), []

    def each(batch, i):
        seen.append((i, {r.id for r in batch.collect()}))
        sink(batch, i)
        if i == 1:
            sink(batch, i)  # a batch that runs again

    found.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
    assert [ids for _, ids in seen if ids] == [{"k1", "k2", "k4"}, {"k1"}, {"k1"}]
    got = {r.id: (r.body, r.ts) for r in spark.read.parquet(path).collect()}
    assert got == {"k1": ("A3", at(24)), "k2": ("B", at(20)), "k4": ("D", at(20))}
    files = {p: {f.stat().st_mtime for f in (tmp_path / "stored" / f"part={p}").glob("*.parquet")} for p in (0, 1, 2)}
    assert max(files[1] | files[2]) <= min(files[0]), "untouched partitions are not written again"


def test_upsert_repairs_a_run_that_broke_off(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id int, part int, v string, ts int"
    each = incremental.upsert_partitions(path, ["id", "part"], "part")
    each(spark.createDataFrame([(1, 0, "a", 1), (2, 1, "b", 1)], schema), 0)
    second = spark.createDataFrame([(1, 0, "a2", 2), (2, 1, "old", 0), (3, 1, "c", 1)], schema)
    each(second, 1)
    for f in (tmp_path / "t" / "part=1").glob("*"):  # as if the run had ended while it put partitions in place
        f.unlink()
    each(second, 1)
    assert sorted((r.id, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a2"), (2, "b"), (3, "c")]
    each(spark.createDataFrame([], schema), 2)
    assert spark.read.parquet(path).count() == 3


def test_clusters_wait_for_order_and_end(spark, tmp_path):
    """An event that comes a batch late is counted in its place; after thirty days without news a key's state is gone."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    row = lambda t, m, d: (t, "BUY", m, at(d).date(), at(d))
    parts = [
        [row("A", "a1", 0), row("A", "a3", 8), row("B", "b1", 2)],
        [row("A", "a2", 5), row("A", "a4", 25)],  # a2 is late, though not past the watermark
        [row("A", "gone", 1), row("A", "a5", 70), row("B", "b2", 72)],  # one past the watermark; the others open new clusters
        [row("C", "c1", 200)],
    ]
    stream = batches(spark, tmp_path, "in", "ticker string, class string, msg_id string, d date, ts timestamp", parts)
    state = str(tmp_path / "state")
    out = []
    incremental.stream_clusters(stream).writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(lambda df, i: out.extend(map(tuple, df.collect()))).start().awaitTermination()
    assert sorted((m, d, anchor, n) for _, _, m, d, anchor, n in out) == [
        ("a1", at(0).date(), at(0).date(), 1), ("a2", at(5).date(), at(0).date(), 2), ("a3", at(8).date(), at(0).date(), 3), ("a4", at(25).date(), at(0).date(), 4),
        ("a5", at(70).date(), at(70).date(), 1), ("b1", at(2).date(), at(2).date(), 1), ("b2", at(72).date(), at(72).date(), 1),
    ]
    left = spark.read.format("statestore").option("stateVarName", "cluster").load(state)
    assert left.count() == 0, "clusters of A and B are over"


@pytest.mark.parametrize("name", ["n3_stream_corrections", "n3_stream_upsert", "n4_stream_clusters", "n5_stream_block_counts"])
def test_streams_read_files_and_folders_alike(spark, sf_dir, tmp_path, name):
    for table in ("events", "orders", "customer", "documents"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").repartition(2).write.parquet(str(tmp_path / f"{table}.parquet"))
    run = lambda where: sorted(map(tuple, queries.QUERIES[name](spark, where).collect()), key=repr)
    rows = run(sf_dir)
    assert rows and run(str(tmp_path)) == rows


@pytest.mark.parametrize("rows_a_part", [10, 10**6])
def test_expanding_percentiles_over_dyadic_blocks(spark, rows_a_part):
    from tidemark.operators import blend

    rng = random.Random(8)
    rows = [(source, dt.date(2024, 1, 1) + dt.timedelta(rng.randrange(days)), f"t{i}", float(rng.randrange(9))) for source, days in (("a", 40), ("b", 1), ("c", 9)) for i in range(150)]
    df = frame(spark, rows, "source string, d date, ticker string, raw double")
    got = {(r.source, r.ticker): r.pct for r in blend.expanding_percentiles(df, rows_a_part).collect()}
    assert len(got) == len(rows)
    for source, d, ticker, raw in rows:
        before = [x for s, dd, _, x in rows if s == source and dd < d]
        want = 100 * (sum(x < raw for x in before) + sum(x == raw for x in before) / 2) / len(before) if before else 50.0
        assert got[source, ticker] == pytest.approx(want)
