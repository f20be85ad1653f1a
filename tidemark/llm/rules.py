"""Quality rules at the level of hosts.

Every document gets counts and rule failures. Failures are aggregated by host; the hosts' failure rates give an
empirical beta prior (method of moments); a host's rate is shrunk towards it, so that a host with few documents is
not judged by them alone. A host whose shrunk rate exceeds `max_rate` is rejected with all its documents. A document is
also dropped where it fails a rule itself.

Words are `[^\\x20\\x09-\\x0D]+`. A null or empty text has no words and fails `short`. Documents with a null host
form no host: only their own failures count. Repeated rows are counted and judged one by one. An empty table gives an
empty result. Columns other than the three named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import looked_up, trimmed, written
from .text import NOT_SPACE, code_points, grams, mix, slices, split, sums

WINDOW = 8
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(h: np.ndarray, rows: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per row the words inside windows that the row holds twice or more."""
    g, at = grams(h, rows, window)
    row = np.searchsorted(rows, at, side="right")
    key = g ^ mix(row.astype(np.uint64))
    order = np.argsort(key)
    same = np.flatnonzero(np.diff(key[order].view(np.int64)) == 0)
    twice = at[order[np.unique(np.concatenate([same, same + 1]))]]
    depth = np.zeros(rows[-1] + 1, np.int64)
    np.add.at(depth, twice, 1)
    np.add.at(depth, twice + window, -1)
    return sums((np.cumsum(depth)[:-1] > 0).astype(np.int64), rows)


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[list[int], list[int]]:
    raw, n_lines, n_dup = data.tobytes(), [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        lines = [x for x in raw[a:b].split(b"\n") if x.strip()]
        n_lines.append(len(lines))
        n_dup.append(len(lines) - len(set(lines)))
    return n_lines, n_dup


def counts(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """Per row of docs the counts that rules are made of."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = split(batch.column("text"), NOT_SPACE, lower=False)
            n_lines, n_dup = _lines(words.data, words.offsets)
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    batch.column("host"),
                    pa.array(np.diff(words.rows)),
                    pa.array(_per_row(code_points(words.data) * NOT_SPACE[words.data], words.offsets)),
                    pa.array(_per_row(SYMBOLS[words.data], words.offsets)),
                    pa.array(n_lines, pa.int64()),
                    pa.array(n_dup, pa.int64()),
                    pa.array(repeated_words(words.hashes(), words.rows)),
                ],
                ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"],
            )

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).alias("text"))
    return chosen.mapInArrow(trimmed(count), COUNTS)


#: name: failing condition
RULES = {
    "short": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "4 * n_symbols > word_chars",
    "lines": "2 * n_dup_lines > n_lines",
}
BASE = ("short", "repeats")


def host_rates(judged: DataFrame) -> DataFrame:
    """host, n, failed, rate, prior_a, prior_b, shrunk: one row per host that is not null.

    With m and v the mean and variance of the hosts' rates, and e the variance that binomial chance alone explains,
    a + b = m (1 - m) / max(v - e, tiny) - 1, held within 1 and 10,000; a = m (a + b).
    """
    hosts = judged.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    hosts = hosts.withColumn("rate", F.col("n_failed") / F.col("n"))
    prior = hosts.agg(
        F.avg("rate").alias("m"), F.coalesce(F.var_pop("rate"), F.lit(0.0)).alias("v"), F.avg(1 / F.col("n")).alias("inv")
    ).select("m", (F.col("v") - F.col("m") * (1 - F.col("m")) * F.col("inv")).alias("extra"))
    prior = prior.select("m", F.least(F.lit(1e4), F.greatest(F.lit(1.0), F.col("m") * (1 - F.col("m")) / F.greatest("extra", F.lit(1e-9)) - 1)).alias("strength"))
    return hosts.crossJoin(F.broadcast(prior)).select(
        "host", "n", "n_failed", "rate", (F.col("m") * F.col("strength")).alias("prior_a"), ((1 - F.col("m")) * F.col("strength")).alias("prior_b"),
        ((F.col("n_failed") + F.col("m") * F.col("strength")) / (F.col("n") + F.col("strength"))).alias("shrunk"),
    )


def judge(counted: DataFrame, rules: dict[str, str] = RULES, base: tuple[str, ...] = BASE, max_rate: float = 0.5) -> DataFrame:
    """Adds failures (names of failed rules), base_failed, host_rate (shrunk; null without host) and kept.

    The counts are written once, so that texts are read once. The host table is one row per host after partial aggregation;
    the verdicts of hosts that hold much of the table go to all tasks, the others' rows are shuffled to theirs.
    """
    names = F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in rules.items()]))
    counted = written(counted, "rule-counts")
    judged = counted.withColumn("failures", names).withColumn("failed", F.size("failures") > 0).withColumn("base_failed", F.arrays_overlap("failures", F.array(*[F.lit(x) for x in base])))
    hosts = written(host_rates(judged), "hosts").select("host", F.col("shrunk").alias("host_rate"))
    met = looked_up(judged, hosts, "host").select(*judged.columns, "host_rate")
    return met.withColumn("kept", ~F.col("failed") & (F.coalesce("host_rate", F.lit(0.0)) <= max_rate))
