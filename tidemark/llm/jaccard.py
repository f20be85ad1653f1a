"""N-gram Jaccard self-join by T-occurrence search over inverted lists.

A document's set holds its distinct five-word shingles; 100 |A & B| >= 80 |A u B| links two documents. The join is exact:

1. Documents with equal sets form a class; one of each class is searched with.
2. Document frequencies of all shingles are counted over classes. A link needs at least t = ceil(0.8 n) of a document's n
   shingles in another document's set, so shingles that occur once leave the sets and documents with fewer than t others
   leave the search.
3. What remains is a T-occurrence problem that is divided as DivideSkip does: each document's lists are ordered by frequency,
   the t - 1 longest are set aside, and only the short ones are merged (Spark's sort by list does the merge), since
   who misses all short lists cannot reach t. Candidates must then reach the overlap that their two sizes require:
   the long lists are probed by binary search for them.
4. Classes whose sets differ in shingles of their own alone (a common passage with a few words more) need no pairs: with o shared
   shingles two of them link where n_u + n_v <= (100 / 80 + 1) o, so whoever links to one links to the smallest of these classes, and whoever
   links to another's class links to that one's smallest. In each pair looked at, one is therefore the smallest of its kind.
5. Merging never emits all pairs of a group of near copies. Each document is first tried against one reference, the member of its longest
   short list that others share most of; verified links collapse groups of near copies. What could still link inside a group is
   found by the documents' differences from the reference (see `_inside`), what could link across groups by their short lists. There is no cap;
   what remains quadratic is only the proof that texts which share a rare enough part, differ otherwise and are not linked are not.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a document of one to four words has its whole sequence as one
shingle; no words or null text: empty set, linked with nothing. Shingles are compared by 64-bit hashes, sets of a class by
128 bits. Repeated rows are copies. A null id counts as greater than any id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .tables import HOT, looked_up, shuffled_to, trimmed, whole_rows, written
from .text import NOT_SPACE, grams, mix, slices, split

_TWO = np.uint64(0xA5A5B6B6C7C7D8D8)
#: shingles of one group of classes, some 6 MB of text: what a task holds at a time
_GROUP = 1 << 20


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows one after another, and the rows' offsets."""
    words = split(column, NOT_SPACE)
    h, n = words.hashes(), len(words.rows) - 1
    g, at = grams(h, words.rows, k)
    row = np.searchsorted(words.rows, at, side="right") - 1
    size = np.diff(words.rows)
    for few in range(1, k):
        own = np.flatnonzero(size == few)
        whole = np.zeros(len(own), np.uint64)
        for j in range(few):
            whole = whole * np.uint64(0xD6E8FEB86659FD93) + h[words.rows[own] + j]
        g, row = np.concatenate([g, mix(whole + np.uint64(few))]), np.concatenate([row, own])
    order = np.argsort(g)
    order = order[np.argsort(row[order].astype(np.uint16 if n < 1 << 16 else np.int64), kind="stable")]
    g, row = g[order], row[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    g, row = g[new], row[new]
    return g, np.searchsorted(row, np.arange(n + 1))


def set_names(g: np.ndarray, rows: np.ndarray) -> list[bytes]:
    """16 bytes for each row's set, equal for equal sets."""
    both = []
    for x in (mix(g), mix(g ^ _TWO)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
        both.append(mix(total[rows[1:]] - total[rows[:-1]] + np.diff(rows).astype(np.uint64)))
    raw = np.stack(both, axis=1).astype("<u8").tobytes()
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


def signatures(docs: DataFrame, doc_id: str | None, text: str, k: int, texts: bool) -> DataFrame:
    """doc_id, n_shingles, cls (null for an empty set); with texts instead one row of cls and text per class and task."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches, "text"):
            g, rows = shingle_sets(batch.column("text"), k)
            size = np.diff(rows)
            names = [x if n else None for x, n in zip(set_names(g, rows), size.tolist(), strict=True)]
            if not texts:
                yield pa.record_batch([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(names, pa.binary())], ["doc_id", "n_shingles", "cls"])
                continue
            new = []
            for i, name in enumerate(names):
                if name is not None and name not in seen:
                    seen.add(name)
                    new.append(i)
            yield pa.record_batch([pa.array([names[i] for i in new], pa.binary()), batch.column("text").take(pa.array(new, pa.int64()))], ["cls", "text"])

    chosen = docs.select((F.lit(None) if doc_id is None else F.col(doc_id)).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(trimmed(sign), "cls binary, text string" if texts else "doc_id long, n_shingles long, cls binary")


def _planes(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte of all, so that the shuffle's codec sees the empty high bytes together."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _keys(planes: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def _bytes(n: np.ndarray) -> bytes:
    """Counts as 32-bit integers, byte by byte of all."""
    return np.minimum(n, 0xFFFFFFFF).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _cuts(keys: np.ndarray, n: int) -> np.ndarray:
    """Where sorted keys split into n equal ranges of the 64-bit space."""
    bounds = np.array([(b << 64) // n for b in range(1, n)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


def _group_sets(table: pa.Table, k: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The sets of a group's distinct classes in order of class."""
    names, first = np.unique(np.array(table.column("cls").to_pylist(), dtype=object), return_index=True)
    g, rows = shingle_sets(table.column("text").take(pa.array(first)), k)
    return names.tolist(), g, rows


def shared_sets(docs: DataFrame, n_groups: int, text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """cls, kind, n, need, keys: per class its set size, the least overlap of a link, and the shingles that other classes hold too,
    rarest first; kind names the set of these. Classes without enough of them to be linked are absent.

    Frequencies are counted where a shingle's hash falls, and each group of classes asks once for each distinct shingle,
    so no shingle is hot; the answers return in the order asked. A group sends a row to each of n_groups ranges in which it
    has shingles, so n_groups follows the number of shingles, and rows stay fewer than these.
    """
    texts = signatures(docs, None, text, k, texts=True).select(F.pmod(F.xxhash64("cls"), F.lit(n_groups)).alias("grp"), "cls", "text")

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        _, g, _ = _group_sets(table, k)
        keys, n = np.unique(g, return_counts=True)
        cuts = _cuts(keys, n_groups).tolist()
        parts = [(b, a, z) for b, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if z > a]
        return pa.table({"bucket": pa.array([b for b, _, _ in parts], pa.int64()), "grp": pa.array([key[0].as_py()] * len(parts), pa.int64()), "keys": pa.array([_planes(keys[a:z]) for _, a, z in parts], pa.binary()), "n": pa.array([_bytes(n[a:z]) for _, a, z in parts], pa.binary())})

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        keys = [_keys(x) for x in table.column("keys").to_pylist()]
        n = np.concatenate([_numbers(x) for x in table.column("n").to_pylist()])
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, weights=n).astype(np.int64)[inverse]
        cuts = np.cumsum([0, *map(len, keys)]).tolist()
        return pa.table({"grp": table.column("grp"), "bucket": table.column("bucket"), "n": pa.array([_bytes(total[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})

    def reduce(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {"cls": [], "kind": [], "n": [], "need": [], "keys": []}
        if table.num_rows:
            names, g, rows = _group_sets(table, k)
            answers = answers.sort_by("bucket")
            df = np.concatenate([_numbers(x) for x in answers.column("n").to_pylist()])[np.searchsorted(np.unique(g), g)]
            shared = np.concatenate([[0], np.cumsum(df > 1)])
            size = np.diff(rows)
            need = -(-percent * size // 100)
            for r in np.flatnonzero(shared[rows[1:]] - shared[rows[:-1]] >= need).tolist():
                keys, often = g[rows[r] : rows[r + 1]], df[rows[r] : rows[r + 1]]
                keys = keys[np.argsort(often, kind="stable")][int((often < 2).sum()) :]
                out["cls"].append(names[r])
                out["kind"].append(set_names(np.sort(keys), np.array([0, len(keys)]))[0])
                out["n"].append(int(size[r]))
                out["need"].append(int(need[r]))
                out["keys"].append(keys.view(np.int64))
        return pa.table({"cls": pa.array(out["cls"], pa.binary()), "kind": pa.array(out["kind"], pa.binary()), "n": pa.array(out["n"], pa.int64()), "need": pa.array(out["need"], pa.int64()), "keys": pa.array(out["keys"], pa.list_(pa.int64()))})

    asked = texts.groupBy("grp").applyInArrow(ask, "bucket long, grp long, keys binary, n binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "grp long, bucket long, n binary")
    return texts.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(reduce, "cls binary, kind binary, n long, need long, keys array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v of the pairs that link: the smaller set's keys are probed in the other's by binary search."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (a, b, n) in enumerate(zip(batch.column("a"), batch.column("b"), batch.column("n").to_pylist(), strict=True)):
                a, b = np.sort(a.values.to_numpy()), b.values.to_numpy()
                both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
                if 100 * both >= percent * (n - both):
                    keep.append(i)
            yield batch.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    left = sets.select(F.col("cls").alias("u"), F.col("keys").alias("a"), F.col("n").alias("n_a"))
    right = sets.select(F.col("cls").alias("v"), F.col("keys").alias("b"), F.col("n").alias("n_b"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b", (F.col("n_a") + F.col("n_b")).alias("n")).mapInArrow(probe, "u binary, v binary")


_ADDED = np.int64(0x5555555555555555)


def _differences(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Adds linked, n_u, n_v, lone (shingles that only v has), z (size of the difference of u from v without these) and
    diff: the parts of it that another class could share, taken away or (marked) added."""

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, z, diff = [], [], []
            for a, b, n_u, n_v in zip(batch.column("a"), batch.column("b"), batch.column("n_u").to_pylist(), batch.column("n_v").to_pylist(), strict=True):
                a, b = np.sort(a.values.to_numpy()), np.sort(b.values.to_numpy())
                in_b = b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a
                in_a = a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b
                both = int(in_b.sum())
                linked.append(100 * both >= percent * (n_u + n_v - both))
                z.append(n_u + len(b) - 2 * both)
                diff.append(np.concatenate([b[~in_a], a[~in_b] ^ _ADDED]))
            kept = batch.select(["root", "u", "v", "n_u", "n_v", "lone"])
            yield kept.append_column("linked", pa.array(linked, pa.bool_())).append_column("z", pa.array(z, pa.int64())).append_column("diff", pa.array(diff, pa.list_(pa.int64())))

    left = sets.select(F.col("cls").alias("u"), F.col("keys").alias("a"), F.col("n").alias("n_u"))
    right = sets.select(F.col("cls").alias("v"), F.col("keys").alias("b"), F.col("n").alias("n_v"), (F.col("n") - F.size("keys")).alias("lone"))
    joined = pairs.join(left, "u").join(right, "v").select("root", "u", "v", "a", "b", "n_u", "n_v", "lone")
    return joined.mapInArrow(differ, "root binary, u binary, v binary, n_u long, n_v long, lone long, linked boolean, z long, diff array<long>")


def _inside(found: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs of one group that may link though one of them, x, is not linked to the group's reference.

    With z the sizes of differences from the reference and k = (100 - percent) / (100 + percent), x and y link when
    z_x + z_y - 2 |diff_x & diff_y| <= k (n_x + n_y). So they share t parts of their differences: a T-occurrence problem over
    the differences, which in a group of near copies are short and rare where the sets are long and alike. As x is not linked to
    the reference r, 2 t > z_y + k (n_r - n_y) - lone_r for its partner y; and for any partner of x, from the sizes that a
    link allows, 2 t >= z_x + max(0, z_x - q) - q with q = k (n_x + 100 n_x / percent).
    """
    k = (100 - percent) / (100 + percent)
    some = found.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum((~F.col("linked")).cast("int")).alias("loose")).where("size > 1 and loose > 0").select("root")
    found = looked_up(found, some.withColumn("_some", F.lit(True)), "root").where("_some").drop("_some")
    found = written(found.join(roots.select(F.col("cls").alias("u"), F.col("root").alias("component"), "first"), "u"), "found")
    parts = found.select("root", "u", F.explode("diff").alias("part"))
    often = parts.groupBy("root", "part").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = parts.join(often, ["root", "part"]).groupBy("u").agg(F.array_sort(F.collect_list(F.struct("df", "part"))).alias("parts"))
    q = k * F.col("n_u") * (1 + 100 / percent)
    of_x = F.ceil((F.col("z") + F.greatest(F.lit(0), F.col("z") - q) - q) / 2 - 1e-9)
    of_y = F.floor((F.col("z") + k * (F.col("n_v") - F.col("n_u")) - F.col("lone")) / 2 + 1e-9) + F.when(F.col("lone") > 0, 0).otherwise(1)
    base = found.select("root", "u", "n_u", "z", "linked", "component", "first", F.when(F.col("linked"), of_y).otherwise(of_x).cast("int").alias("t"))
    # who need share nothing still has all its parts looked up; for the rest of its case see `alone`
    with_parts = base.join(shared, "u").withColumn("t", F.greatest("t", F.lit(1))).select("*", F.size("parts").alias("s")).where("s >= t")
    short = with_parts.select("root", "u", "n_u", "z", "s", "linked", "component", "first", F.posexplode(F.slice(F.col("parts.part"), 1, (F.col("s") - F.col("t") + 1).cast("int"))).alias("i", "part"))
    short = written(short, "parts")
    side = lambda df, at: df.select("root", *[c for c in ("part",) if c in df.columns], *[F.col(c).alias(f"{c}_{at}") for c in ("u", "n_u", "z", "s", "i", "linked", "component") if c in df.columns])
    # what two classes can share at most, given that a part stands at these places of theirs, rarest first
    reach = 1 + F.least("i_x", "i_y") + F.least(F.col("s_x") - F.col("i_x") - 1, F.col("s_y") - F.col("i_y") - 1)
    enough = 2 * reach >= F.col("z_x") + F.col("z_y") - k * (F.col("n_u_x") + F.col("n_u_y")) - 1e-9
    fits = (F.col("component_x") != F.col("component_y")) & (100 * F.least("n_u_x", "n_u_y") >= percent * F.greatest("n_u_x", "n_u_y"))
    loose = short.where("not linked")
    met = [(loose, short.where("first")), (loose.where("first"), short.where("not first"))]
    pair = [F.col("u_x").alias("u"), F.col("u_y").alias("v")]
    pairs = [side(x, "x").join(side(y, "y"), ["root", "part"]).where(fits & enough).select(*pair) for x, y in met]
    # classes that share no part link where their z - k n add up to 0 at most: with any of them if with the least, or the least near one
    by = (F.col("z") - k * F.col("n_u")).alias("by")
    place = F.struct(by, F.col("u").alias("v"), F.col("component").alias("of_v"))
    best = base.where("first").groupBy("root").agg(F.array(F.min(place), F.min(F.when(F.col("linked"), place))).alias("best"))
    alone = base.where("not linked").select("root", "u", "component", by).join(best, "root").select("u", "component", "by", F.explode("best").alias("best")).where("best.of_v != component and best.by + by <= 1e-9").select("u", F.col("best.v").alias("v"))
    return pairs[0].unionByName(pairs[1]).unionByName(alone).distinct()


def class_links(sets: DataFrame, percent: int = 80) -> DataFrame:
    """u, v: verified links between classes that connect the same classes as all links do."""
    least_of_kind = sets.groupBy("kind").agg(F.min(F.struct("n", "cls")).alias("low"), F.count(F.lit(1)).alias("of_kind"))
    placed = looked_up(sets.select("cls", "kind", "n", F.size("keys").alias("o")), least_of_kind, "kind")
    placed = placed.select("cls", F.col("low.cls").alias("low"), (F.col("low.cls") == F.col("cls")).alias("first"), (100 * F.col("o") >= percent * (F.col("n") + F.col("low.n") - F.col("o"))).alias("near"))
    placed = written(placed, "kinds")
    of_kind = placed.where("near and not first").select(F.col("cls").alias("u"), F.col("low").alias("v"))
    sought = written(sets.join(placed.where("first or not near").select("cls", "first"), "cls"), "sought")
    short = sought.select("cls", "first", "n", F.size("keys").alias("r"), F.posexplode(F.slice("keys", 1, (F.size("keys") - F.col("need") + 1).cast("int"))).alias("i", "key"))
    leading = F.max(F.when(F.col("first"), F.struct(F.col("r") / F.col("n"), "cls")))["cls"]
    lists = short.groupBy("key").agg(F.count(F.lit(1)).alias("len"), leading.alias("leader")).where("len > 1 and leader is not null")
    tries = short.join(lists, "key").where("cls != leader").groupBy("cls").agg(F.max(F.struct("len", "leader")).alias("best")).select(F.col("cls").alias("u"), F.col("best.leader").alias("v"))
    tries = written(tries, "tries")
    groups = components(tries)
    groups = written(groups.unionByName(groups.select(F.col("root").alias("u"), "root")).distinct(), "groups")
    votes = tries.join(groups, "u").groupBy("root", "v").agg(F.count(F.lit(1)).alias("n"))
    references = written(votes.groupBy("root").agg(F.max(F.struct("n", "v"))["v"].alias("v")), "references")
    tried = written(looked_up(groups, references, "root").where("u != v"), "tried")
    found = written(_differences(tried, sought, percent), "differences")
    first = found.where("linked").select("u", "v")
    named = sought.select("cls", "first").join(components(first).withColumnRenamed("u", "cls"), "cls", "left").select("cls", "first", F.coalesce("root", "cls").alias("root"))
    named = written(named, "named")
    inside = _inside(found, named, percent)
    # a class that leads all its lists makes no try and, if nobody's best, is in no group: it is one of its own
    short = short.join(named.select("cls", "root"), "cls").join(groups.select(F.col("u").alias("cls"), F.col("root").alias("grp")), "cls", "left").withColumn("grp", F.coalesce("grp", "cls"))
    short = written(short, "short")
    mixed = short.groupBy("key").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).where("low < high").select("key")
    held = written(short.join(mixed, "key"), "held")
    side = lambda df, at: df.select("key", *[F.col(c).alias(f"{c}_{at}") for c in ("cls", "first", "n", "r", "i", "root", "grp")])
    met = side(held.where("first"), "u").join(side(held, "v"), "key").where("root_u != root_v and if(first_v, grp_u < grp_v, grp_u != grp_v)")
    least = F.ceil(percent * (F.col("n_u") + F.col("n_v")) / (100 + percent))
    fits = (100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")) & (1 + F.least(F.col("r_u") - F.col("i_u") - 1, F.col("r_v") - F.col("i_v") - 1) + F.least("i_u", "i_v") >= least)
    across = met.where(fits).select(F.col("cls_u").alias("u"), F.col("cls_v").alias("v")).distinct()
    verified = _verified(written(inside.unionByName(across), "pairs"), sought, percent)
    return first.unionByName(of_kind).unionByName(verified)


def class_roots(signed: DataFrame, docs: DataFrame, text: str, k: int, percent: int) -> DataFrame:
    """cls, root for every class that links to another; root is the smallest class of its component."""
    shingles = signed.agg(F.sum("n_shingles")).first()[0] or 0
    n_groups = max(shuffled_to(docs.sparkSession), -(-shingles // _GROUP))
    sets = written(shared_sets(docs, n_groups, text, k, percent), "sets")
    return components(class_links(sets, percent)).withColumnRenamed("u", "cls")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: the smallest id that links reach, itself included."""
    signed = written(signatures(docs, doc_id, text, k, texts=False), "signed")
    roots = class_roots(signed, docs, text, k, percent)
    classes = signed.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("low")).join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    classes = written(classes, "classes")
    lows = classes.groupBy("root").agg(F.min("low").alias("component"))
    named = written(looked_up(classes, lows, "root").select("cls", "component"), "named")
    return looked_up(signed, named, "cls").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, one of each component: that of the smallest id (null last), of equal ids that of the first text in byte order.

    Rows with empty sets all stay. What is decided rests on contents alone, not on the order of rows, so docs may be any frame.
    """
    columns = docs.columns
    signed = written(signatures(docs, doc_id, text, k, texts=False), "signed")
    roots = class_roots(signed, docs, text, k, percent)
    by_id = signed.where("cls is not null").groupBy("cls", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    classes = by_id.groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "n")).alias("low"), F.sum("n").alias("rows"))
    classes = written(classes.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls")), "classes")
    kept = classes.groupBy("root").agg(F.min(F.struct("low.late", "low.doc_id", "cls"))["cls"].alias("least"))
    fate = looked_up(classes, kept, "root").select("cls", "rows", F.struct((F.col("least") == F.col("cls")).alias("stays"), F.col("low.doc_id").alias("id"), F.col("low.n").alias("n")).alias("fact"))
    fate = written(fate.where("not fact.stays or rows > 1"), "fate")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(slices(batches, ("_doc", text))):
            g, rows = shingle_sets(pc.struct_field(batch.column("_doc"), text), k)
            names = [x if n else None for x, n in zip(set_names(g, rows), np.diff(rows).tolist(), strict=True)]
            spread = (number << 20) + np.arange(len(names))
            yield batch.append_column("_cls", pa.array(names, pa.binary())).append_column("_spread", pa.array(spread))

    packed = whole_rows(docs)
    rows = packed.mapInArrow(trimmed(sign), T.StructType([*packed.schema.fields, T.StructField("_cls", T.BinaryType()), T.StructField("_spread", T.LongType())]))
    fate = fate.withColumnRenamed("cls", "_cls")
    rows = looked_up(rows, fate.select("_cls", "fact"), "_cls", fate.where(F.col("rows") > HOT * signed.count()).select("_cls"), F.col("_spread"))
    stays = rows.where(F.col("fact").isNull() | (F.col("fact.stays") & F.col("fact.id").eqNullSafe(F.col("_doc")[doc_id].cast("long"))))
    if fate.where("fact.stays and fact.n > 1").limit(1).count():
        repeated = stays.where("fact.n > 1").groupBy("_cls").agg(F.min_by("_doc", F.struct(F.col("_doc")[text].isNull(), F.col("_doc")[text])).alias("_doc"))
        stays = stays.where("fact is null or fact.n = 1").select("_doc").unionByName(repeated.select("_doc"))
    return stays.select(*[F.col("_doc")[c].alias(c) for c in columns])
