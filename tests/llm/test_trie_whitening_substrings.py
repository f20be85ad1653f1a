"""Prefix trie, whitening and repeated passages against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import substrings, trie, whitening
from tidemark.llm.queries import op11_prefix_trie, op12_whitening, op13_fixed_anchors

TURNS = "conv_id long, turn long, role string, text string"


def crc(c):
    return zlib.crc32(str(c).encode())


def turn_name(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def built(rows):
    """The rebuilt conversations by id."""
    own = defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            own[c].append((n is not None, n or 0, turn_name(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[-1] for x in sorted(t)] for c, t in own.items()}
    # an integer's remainder has its sign in SQL
    rest = lambda c: abs(c) % 100 * (1 if c >= 0 else -1)
    return {c: (*own.get(c - rest(c), [])[: crc(c) % 6], *t[crc(c) % 6 :]) for c, t in own.items()}


def nodes(conversations):
    """Every node by going through all prefixes."""
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def below(p):
        saved, leaves, stack = 0, 0, [p]
        while stack:
            q = stack.pop()
            saved += (len(members[q]) - 1) * (len(q[-1][1]) if q else 0)
            leaves += not kids[q]
            stack += kids[q]
        return leaves, saved

    out = []
    for p, m in members.items():
        leaves, saved = below(p)
        ends = ",".join(map(str, sorted(c for c in m if len(conversations[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def some_turns(rng, n, ids, depth=9):
    """Conversations that share beginnings: walks over few texts, some with null and equal turn numbers."""
    rows = []
    for _ in range(n):
        c = rng.randrange(ids)
        for i in range(rng.randrange(depth)):
            rows.append((c, rng.choice([i, i, i, i, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "é€x", "", None])))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_trie_against_all_prefixes(spark, seed):
    rng = random.Random(seed)
    rows = some_turns(rng, 250, 420) + [(None, 1, "user", "lost"), (-205, 0, "user", "a"), (-200, 0, "user", "a"), (100, 0, "user", "a")]
    # a crowd with one and the same conversation, and one of the same beginning
    rows += [(1000 * k + 100 * j, t, "user", "copy") for k in range(1, 9) for j in range(5) for t in range(7)] + [(9_000_000, t, "user", "copy") for t in range(40)]
    df = spark.createDataFrame(rows, TURNS).select("*", *[F.lit(1).alias(c) for c in ("seq", "name", "said", "h", "head", "part", "key")]).repartition(3)
    got = trie.trie(trie.rebuilt(trie.packed(df)))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert rows_of(got) == nodes(built(rows))


def test_trie_of_every_cut_into_ranges(spark):
    """However sorted sequences are cut into ranges, contracted forests add up to the same nodes."""
    rng = random.Random(5)
    conversations = {}
    for c in range(60):
        conversations[c] = tuple(("user", rng.choice("ab")) for _ in range(rng.randrange(6)))
    conversations[60] = ()
    want = nodes(conversations)
    rows = [(c, b"".join(bytes.fromhex(turn_name(*t)) for t in turns), b"".join(len(t[1]).to_bytes(4, "big") for t in turns)) for c, turns in conversations.items()]
    df = spark.createDataFrame([(c, bytearray(s), bytearray(n)) for c, s, n in rows], "conv_id long, seq binary, chars binary")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 2, 7, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert rows_of(trie.trie(df)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ids_of_one_sequence_stream_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(trie, "_PIECE", 50)
    ids = random.Random(1).sample(range(10**6), 700)
    rows = spark.createDataFrame([(bytearray(b"x" if i % 50 else i.to_bytes(8, "big")), c) for i, c in enumerate(ids)], "name binary, conv_id long")
    got = {bytes(r.name): r.ends for r in trie._ends(rows, 5).collect()}
    want = defaultdict(list)
    for i, c in enumerate(ids):
        want[b"x" if i % 50 else i.to_bytes(8, "big")].append(c)
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in want.items()}


def test_trie_of_nothing_and_of_a_long_conversation(spark, sf_dir):
    none = spark.createDataFrame([], TURNS)
    assert trie.trie(trie.rebuilt(trie.packed(none))).count() == 0
    long = [(c, t, "user", f"turn {t}") for c in (100, 300) for t in range(3000)]
    got = trie.trie(trie.packed(spark.createDataFrame(long, TURNS)))
    top = got.where("depth = 0").collect()
    assert got.count() == 3001 and [(r.n_convs, r.n_leaves) for r in top] == [(2, 1)]
    assert top[0].saved_tokens == sum(len(f"turn {t}") for t in range(3000))
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(op11_prefix_trie(spark, sf_dir)) == nodes(built(rows))


# --- whitening

VECTORS = "vec_id long, embedding array<float>, n int, vector string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 7, "x") for i, v in rows], VECTORS).repartition(3)


def integers(v):
    return [int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v]


def test_planes_give_exact_products():
    rng = np.random.default_rng(0)
    for rows, dim, top in ((1, 3, 5), (70, 5, 1000), (1000, 8, 1 << 20), (300, 4, 1 << 59), (5, 2, 1), (130, 3, 1 << 45)):
        x = rng.integers(-top, top, (rows, dim))
        n, sums, cross = whitening.scatter(iter([x[: rows // 3], x[rows // 3 :]] if rows > 3 else [x]), dim)
        plain = x.astype(object)
        want = plain.T @ plain
        assert n == rows and sums == plain.sum(axis=0).tolist()
        assert all(cross[i][j] == want[i][j] for i in range(dim) for j in range(i, dim))


def test_whitening_against_plain_covariance(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 12)) @ rng.standard_normal((12, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(3, rows[3][1]), (None, rows[5][1]), (900, None), (901, []), (902, [None] * 12), (903, [float("nan"), *[0.0] * 11]), (904, [float("inf"), *[0.0] * 11]), (905, [1.0, 2.0])]
    fit = [(i, integers(v)) for i, v in rows[:402]]
    n, dim = len(fit), 12
    sums = [sum(v[j] for _, v in fit) for j in range(dim)]
    m = np.array([v for _, v in fit], np.float64)
    c = m - m.mean(axis=0)
    values, parts = np.linalg.eigh(c.T @ c / n)
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    by_id = defaultdict(list)
    for r in got:
        by_id[r.vec_id, r.component].append(r)
    for i, v in fit:
        want = sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        for k in range(1, 9):
            r = by_id[i, k][0]
            assert r.deviation == want and int(r.deviation_exact) == want
            plain = (np.array(v) - m.mean(axis=0)) @ parts[:, -k] / np.sqrt(values[-k])
            assert abs(abs(r.whitened) - abs(plain)) < 1e-8
            assert abs(r.explained - values[-k] / values.sum()) < 1e-9
    assert len(by_id[3, 1]) == 2 and len(by_id[None, 1]) == 1
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    w = np.array([[by_id[i, k][0].whitened for k in range(1, 9)] for i, _ in fit])
    assert np.abs(w.T @ w / n - np.eye(8)).max() < 1e-9


def test_whitening_of_few_equal_and_no_vectors(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, [float("nan")])])).count() == 0
    assert whitening.whiten(vectors(spark, [(i, [0.5, 0.25]) for i in range(5)])).count() == 0
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)])).collect()
    assert {r.component for r in line} == {1} and len(line) == 9 and abs(line[0].explained - 1) < 1e-12


def test_deviations_beyond_64_bits_are_decimals(spark):
    rows = [(i, [1e9 * (-1) ** i, 2e9 * (i % 3)]) for i in range(200)]
    got = {r.vec_id: r for r in whitening.whiten(vectors(spark, rows)).where("component = 1").collect()}
    fit = [integers(v) for _, v in rows]
    sums = [sum(v[j] for v in fit) for j in (0, 1)]
    for i, v in enumerate(fit):
        want = sum((200 * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        assert int(got[i].deviation_exact) == want and got[i].deviation == (want if want < 1 << 63 else None)


def test_whitening_query(spark, sf_dir):
    got = op12_whitening(spark, sf_dir)
    assert got.count() == 8 * spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert got.agg(F.max("identity_error")).first()[0] < 1e-4


# --- repeated passages


def removed(rows, window):
    """Words of each row that a window of a smaller document covers."""
    split = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    key = lambda d: (d is None, d or 0)
    least = {}
    for (d, _), w in zip(rows, split, strict=True):
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            least[g] = min(least.get(g, key(d)), key(d))
    out = []
    for (d, _), w in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < key(d):
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [2, 6, 7])
def test_repeats_against_all_windows(spark, window):
    rng = random.Random(window)
    passages = [[rng.choice("abcdefghij") + str(rng.randrange(4)) for _ in range(rng.randrange(3, 30))] for _ in range(12)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randrange(6)):
            words += rng.choice(passages) if rng.random() < 0.6 else [f"own{rng.randrange(10**6)}" for _ in range(rng.randrange(9))]
        rows.append((rng.choice([i, i, i, None, 7]), rng.choice([" ", "\n", "  \t"]).join(words)))
    rows += [(500, None), (501, ""), (502, " \n "), rows[0], (503, "é x " * 40), (2, "é x " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(0).alias(c) for c in ("piece", "docs", "range", "keys", "held_out", "n_words")]).repartition(4)
    for piece_bytes in (300, 1 << 20):
        got = substrings.deduplicated(df, window=window, piece_bytes=piece_bytes).collect()
        assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got], key=repr) == removed(rows, window)
        for r in got:
            assert sum(s.end - s.start for s in r.spans) == r.n_removed
            assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_repeats_of_odd_documents(spark, docs, rows, no_docs):
    got = substrings.digest(substrings.deduplicated(docs))
    want = [(d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in removed([r[:2] for r in rows], 50)]
    assert rows_of(got) == sorted(want, key=repr)
    assert substrings.deduplicated(no_docs).count() == 0


def test_passage_in_very_many_documents(spark):
    """One passage in all documents is sent once a piece; the smallest document keeps it."""
    passage = " ".join(f"common{i}" for i in range(60))
    rows = [(i, f"start{i} {passage} end{i}") for i in range(3000)]
    got = {r.doc_id: r.n_removed for r in substrings.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: 60 if i else 0 for i in range(3000)}


def test_repeats_query(spark, sf_dir):
    got = op13_fixed_anchors(spark, sf_dir)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(got) == sorted([(d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in removed(rows, 50)], key=repr)
