"""The prefix trie of conversations, from union-find over the common prefixes of sorted neighbours.

1. A turn becomes 16 bytes of the SHA-256 of its role and text; a conversation is the bytes of its turns in order, so sorted
   conversations with a common beginning stand together. Equal conversations are counted into one sequence first.
2. Sequences are cut into ranges of their order, each small enough for a task. In a range, neighbours are edges as deep as their common
   prefix is long. Edges are taken from the deepest to the shallowest: joining two components makes the branching node at that
   depth, or widens it. What lies between a component's node and the node it is joined at is a chain of nodes with the same members.
3. Across a boundary between two ranges only the prefixes shared by the sequences on its two sides are cut apart. These nodes leave a range
   contracted to sums over its share of their members; sums of all ranges add up. Each node's own length, and each child, is
   counted in the first range that has it, which a range knows from its neighbour's last sequence. A node of saved_tokens needs no walk
   over its subtree: the members' code points from its depth on, less those of the subtree's distinct nodes, are sums too.
4. The members that end at a node are hashed as a stream: ids sorted over ranges, a sequence's pieces put together in order. A task
   keeps one piece of a list, never the list.

Turns are ordered by turn number (null first), equal numbers by the turns' hashes. A null role or text is empty. Rows with a null
conversation belong to none and are left out. Repeated rows are repeated turns. A conversation of any number of turns is one row of
20 bytes a turn. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import looked_up, shuffled_to, trimmed, written

WIDE = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: bytes of sequences in a range, and of ids in a piece of a list
_RANGE, _PIECE = 16 << 20, 1 << 20
_NODES = "key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, total long, own long, ends string"


# --- sequences


def packed(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, seq (16 bytes a turn), chars (the code points of each text in 4 bytes)."""
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    said = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), role_.alias("role"), text_.alias("text")).where("conv_id is not null")
    name = F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 2 * WIDE)
    said = said.select("conv_id", F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", name.alias("name"), F.lpad(F.hex(F.length("text").cast("long")), 8, "0").alias("chars")).alias("said"))
    grouped = said.groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("said"))
    return grouped.select("conv_id", F.unhex(F.array_join("said.name", "")).alias("seq"), F.unhex(F.array_join("said.chars", "")).alias("chars"))


def rebuilt(own: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """packed() rows with their first h turns taken from conversation c - c % every instead; h = crc32(c as text) % most."""
    c = F.col("conv_id")
    h = F.pmod(F.crc32(c.cast("string")), F.lit(most))
    part = lambda x, wide, at, n: F.substring(x, wide * at + 1, wide * n)
    heads = own.where(c % every == 0).select(c.alias("head"), *[F.substring(x, 1, wide * most).alias(f"head_{x}") for x, wide in (("seq", WIDE), ("chars", 4))])
    joined = own.withColumn("h", h.cast("int")).join(heads, c - c % every == F.col("head"), "left")
    out = lambda x, wide: F.concat(F.coalesce(part(F.col(f"head_{x}"), wide, F.lit(0), F.col("h")), F.lit(b"")), F.substring(F.col(x), wide * F.col("h") + 1, F.length(x))).alias(x)
    return joined.select("conv_id", out("seq", WIDE), out("chars", 4))


# --- ids that end at a sequence


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by name and id: the hash of each name's ids where the partition surely has all of them, else pieces of its list."""
    schema = pa.schema([("name", pa.binary()), ("first", pa.int64()), ("ids", pa.string()), ("ends", pa.string())])
    now, run, first, size, opened, begun = None, [], None, 0, False, False
    out: list[tuple] = []

    def close(last: bool) -> None:
        """The list so far: whole if it neither began before this partition nor can go on after it."""
        if now is None:
            return
        ids = ",".join(run)
        if opened or last:
            out.append((now, first, ids, None))
        else:
            out.append((now, None, None, hashlib.sha256(ids.encode()).hexdigest()))

    for batch in batches:
        for name, c in zip(batch.column("name").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if name != now:
                close(last=False)
                # the first name of a partition may have begun in the one before
                now, run, first, size, opened, begun = name, [], c, 0, not begun, True
            elif size > _PIECE:
                out.append((now, first, ",".join(run), None))
                run, first, size, opened = [], c, 0, True
            run.append(str(c))
            size += len(run[-1]) + 1
        if out:
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
    close(last=True)
    if out:
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by name and first id: the hash of each name's list."""
    now, digest = None, None
    for batch in batches:
        names, ends = [], []
        for name, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if name != now:
                if now is not None:
                    names.append(now)
                    ends.append(digest.hexdigest())
                now, digest = name, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pa.record_batch([pa.array(names, pa.binary()), pa.array(ends, pa.string())], ["name", "ends"])
    if now is not None:
        yield pa.record_batch([pa.array([now], pa.binary()), pa.array([digest.hexdigest()], pa.string())], ["name", "ends"])


def _ends(rows: DataFrame, n_parts: int) -> DataFrame:
    """name, ends: SHA-256 of the ids with that name, ascending and joined by commas."""
    dealt = rows.select("name", "conv_id").repartitionByRange(n_parts, "name", "conv_id").sortWithinPartitions("name", "conv_id")
    pieces = written(dealt.mapInArrow(trimmed(_pieces), "name binary, first long, ids string, ends string"), "pieces")
    cut = pieces.where("ends is null").repartition(n_parts, "name").sortWithinPartitions("name", "first")
    return pieces.where("ends is not null").select("name", "ends").unionByName(cut.mapInArrow(trimmed(_streamed), "name binary, ends string"))


# --- one range of sequences


def _common(flat: np.ndarray, at: np.ndarray, to: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Turns that pairs of runs of flat have in common from their beginnings; runs begin at `at` and `to`, the shorter has `size` turns."""
    if not size.sum():
        return np.zeros(len(size), np.int64)
    pair = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
    same = (flat[at[pair] + place] == flat[to[pair] + place]).all(axis=1)
    first = np.where(same, size[pair], place)
    out, some = np.zeros(len(size), np.int64), np.flatnonzero(size)
    out[some] = np.minimum.reduceat(first, (np.cumsum(size) - size)[some])
    return out


def _shared(a: bytes | None, b: bytes) -> int:
    """Turns that two sequences have in common; -1 where there is no other."""
    if a is None:
        return -1
    x, y = (np.frombuffer(s[: min(len(a), len(b))], np.uint8).reshape(-1, WIDE) for s in (a, b))
    differ = np.flatnonzero((x != y).any(axis=1))
    return int(differ[0]) if len(differ) else len(x)


def _prefix_names(seq: bytes, depth: int) -> list[bytes]:
    """Names of the prefixes of 0 .. depth turns."""
    digest, out = hashlib.sha256(), []
    for d in range(depth + 1):
        out.append(digest.digest()[:WIDE])
        digest.update(seq[WIDE * d : WIDE * d + WIDE])
    return out


def _forest(key: tuple, rows: pa.Table, bound: pa.Table) -> pa.Table:
    """The nodes of one range: closed ones whole, those it shares with a neighbour as this range's share under their names."""
    seqs = rows.column("seq").to_pylist()
    order = sorted(range(len(seqs)), key=seqs.__getitem__)
    seqs, m = [seqs[i] for i in order], len(seqs)
    if not m:
        return pa.schema([("key", pa.binary())]).empty_table()
    rows = rows.take(pa.array(order))
    n, low = (rows.column(c).to_numpy().tolist() for c in ("n", "low"))
    ends = rows.column("ends").to_pylist()
    depth = np.array([len(s) // WIDE for s in seqs], np.int64)
    first = np.cumsum(depth) - depth
    flat = np.frombuffer(b"".join(seqs), "<u8").reshape(-1, 2)
    # code points before each depth: row i's begin at at[i]
    at = first + np.arange(m)
    chars = np.zeros(depth.sum() + m, np.int64)
    inner = np.ones(len(chars), bool)
    inner[at] = False
    chars[inner] = np.frombuffer(b"".join(rows.column("chars").to_pylist()), ">u4")
    chars = np.cumsum(chars)
    chars -= np.repeat(chars[at], depth + 1)
    before = _shared(bound.column("before")[0].as_py(), seqs[0])
    after = _shared(bound.column("after")[0].as_py(), seqs[-1])
    own = chars.copy()  # lengths of nodes that this range is the first to have
    if before > 0:
        head = own[: depth[0] + 1]
        head[:] = np.maximum(head - head[before], 0)
    lcp = _common(flat, first[:-1], first[1:], np.minimum(depth[:-1], depth[1:]))
    nexts = np.append(lcp, after)
    # components by the row that stands for them: the leftmost
    up = list(range(m))
    top, right, leaves, kids, end = depth.tolist(), list(range(m)), (nexts < depth).astype(np.int64).tolist(), [0] * m, list(range(m))
    members, least = list(n), list(low)
    total = [c * x for c, x in zip(n, chars[at + depth].tolist(), strict=True)]
    below = [0] * m
    at_, own_ = at.tolist(), own.tolist()

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    chains: list[tuple] = []
    above: list[tuple] = []

    def raised(i: int, to: int) -> None:
        """Ends component i's chain just below depth `to`; its node there then has one child more, unless an earlier range counts it."""
        if top[i] > to:
            chains.append((i, right[i], top[i], to + 1, members[i], least[i], leaves[i], total[i], below[i], kids[i], end[i]))
            below[i] += own_[at_[i] + top[i]] - own_[at_[i] + max(to, 0)]
            top[i], kids[i], end[i] = to, int(i > 0 or to + 1 > before), -1

    by_depth = np.argsort(-lcp, kind="stable")
    cuts = np.flatnonzero(np.diff(lcp[by_depth])) + 1
    for edges in np.split(by_depth, cuts) if m > 1 else []:
        to = int(lcp[edges[0]])
        for i in edges.tolist():
            a, b = find(i), find(i + 1)
            raised(a, to)
            raised(b, to)
            up[b], right[a] = a, right[b]
            members[a] += members[b]
            least[a] = min(least[a], least[b])
            leaves[a] += leaves[b]
            total[a] += total[b]
            below[a] += below[b]
            kids[a] += kids[b]
        for chain in chains[len(above) :]:
            a = find(chain[0])
            above.append((least[a], a, right[a]))
    raised(0, -1)
    above.append((None, -1, -1))
    row, last, hi, lo, n_convs, low_, n_leaves, whole, under, n_kids, end_ = (np.array(x, np.int64) for x in zip(*chains, strict=True))
    above_low, above_row, above_last = (np.array([-1 if x is None else x for x in c], np.int64) for c in zip(*above, strict=True))
    count = hi - lo + 1
    chain = np.repeat(np.arange(len(row)), count)
    d = hi[chain] - (np.arange(len(chain)) - np.repeat(np.cumsum(count) - count, count))
    r, is_top, is_last = row[chain], d == hi[chain], d == lo[chain]
    shared = ((r == 0) & (d <= before)) | ((last[chain] == m - 1) & (d <= after))
    row_up, last_up = np.where(is_last, above_row[chain], r), np.where(is_last, above_last[chain], last[chain])
    shared_up = (d > 0) & (((row_up == 0) & (d - 1 <= before)) | ((last_up == m - 1) & (d - 1 <= after)))
    low_up = np.where(is_last, above_low[chain], low_[chain])
    kids_ = np.where(is_top, n_kids[chain], ((r > 0) | (d + 1 > before)).astype(np.int64))
    base = at[r] + np.maximum(d - 1, 0)
    names = {0: _prefix_names(seqs[0], before), m - 1: _prefix_names(seqs[-1], after)} if m > 1 else {0: _prefix_names(seqs[0], max(before, after))}
    side = lambda row, last, depth: 0 if row == 0 and depth <= before or m == 1 else m - 1
    keys, up_keys, end_names = [None] * len(d), [None] * len(d), [None] * len(d)
    for i in np.flatnonzero(shared).tolist():
        keys[i] = names[side(r[i], last[chain[i]], d[i])][d[i]]
    for i in np.flatnonzero(shared_up).tolist():
        up_keys[i] = names[side(row_up[i], last_up[i], d[i] - 1)][d[i] - 1]
    for i in np.flatnonzero(is_top & (end_[chain] >= 0)).tolist():
        end_names[i] = ends[end_[chain[i]]]
    no_up = shared_up | (d == 0)
    return pa.table({
        "key": pa.array(keys, pa.binary()), "parent_key": pa.array(up_keys, pa.binary()), "conv_id": pa.array(low_[chain]), "depth": pa.array(d), "parent_conv_id": pa.array(low_up, mask=no_up),
        "n_convs": pa.array(n_convs[chain]), "n_children": pa.array(kids_), "n_leaves": pa.array(n_leaves[chain]), "total": pa.array(whole[chain] - n_convs[chain] * chars[base]),
        "own": pa.array(under[chain] + own[at[r] + hi[chain]] - own[base]), "ends": pa.array(end_names, pa.string()),
    })


def trie(sequences: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    sequences: conv_id (distinct), seq and chars, as packed() and rebuilt() give them.
    """
    spark = sequences.sparkSession
    rows = written(sequences.select("conv_id", F.unhex(F.substring(F.sha2("seq", 256), 1, 2 * WIDE)).alias("name"), "seq", "chars"), "sequences")
    counted = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("seq") + F.length("chars")).alias("bytes")).first()
    parts = lambda size: max(shuffled_to(spark), -(-size // _RANGE))
    ends = _ends(rows, parts(24 * counted["n"]))
    distinct = rows.groupBy("name").agg(F.first("seq").alias("seq"), F.first("chars").alias("chars"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low")).join(ends, "name")
    n_ranges = parts((counted["bytes"] or 0) + 100 * counted["n"])
    ranged = written(distinct.repartitionByRange(n_ranges, "seq").withColumn("part", F.spark_partition_id()), "ranges")
    edge = ranged.groupBy("part").agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    bounds = _neighbours(edge)
    found = written(ranged.groupBy("part").cogroup(bounds.groupBy("part")).applyInArrow(_forest, _NODES), "nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "total", "own")]
    merged = found.where("key is not null").groupBy("key", "depth").agg(F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), *sums, F.max("ends").alias("ends"))
    merged = written(merged.withColumn("parent_conv_id", F.lit(None).cast("long")), "merged")
    nodes = found.where("key is null").select(*merged.columns).unionByName(merged)
    above = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    linked = looked_up(nodes, above, "parent_key")
    return linked.select("conv_id", "depth", F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", (F.col("total") - F.col("own")).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))


def _neighbours(edge: DataFrame) -> DataFrame:
    """part, before, after: the last sequence of the range before and the first of the one after. One row a range, ranges may be empty."""
    order = Window.orderBy("part")
    return edge.select("part", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("after"))


ORACLE = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, left(sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS name
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(name ORDER BY turn NULLS FIRST, name) AS names, list(length(text) ORDER BY turn NULLS FIRST, name) AS chars FROM said GROUP BY conv_id
), kept AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, x: list_reduce(list_concat([xor(c, x)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295::BIGINT) % 6 AS h
  FROM own
), built AS (
  SELECT k.conv_id, list_concat(coalesce(b.names[1:k.h], []), k.names[k.h + 1:]) AS names, list_concat(coalesce(b.chars[1:k.h], []), k.chars[k.h + 1:]) AS chars
  FROM kept k LEFT JOIN own b ON b.conv_id = k.conv_id - k.conv_id % 100
), reached AS (
  SELECT conv_id, names, chars, unnest(range(0, len(names) + 1)) AS depth FROM built
), nodes AS (
  SELECT array_to_string(names[1:depth], '') AS key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(min(chars[depth]) FILTER (WHERE depth > 0), 0) AS last_chars,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = len(names)), '')) AS ends_sha256
  FROM reached GROUP BY 1, 2
), kids AS (
  SELECT left(key, (32 * (depth - 1))::INT) AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), whole AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.key = n.key
), up AS (
  SELECT unnest(list_transform(range(0, depth + 1), lambda j: left(key, (32 * j)::INT))) AS key, (n_convs - 1) * last_chars AS saved, (n_children = 0)::INT AS leaf FROM whole
), sums AS (
  SELECT key, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves FROM up GROUP BY key
)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, w.ends_sha256
FROM whole w JOIN sums s ON s.key = w.key LEFT JOIN nodes p ON w.depth > 0 AND p.depth = w.depth - 1 AND p.key = left(w.key, (32 * (w.depth - 1))::INT)
"""
