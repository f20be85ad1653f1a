"""The registered queries of this subpackage: thin digests of its operators over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, html, jaccard, katz, licenses, oracles, packing, rules, secrets, substrings, toxicity, trie, whitening
from .tables import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scores(table(spark, sf_dir, "documents"), held="crc32(cast(doc_id as string)) % 5 = 1")


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3_min_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(rules.counts(table(spark, sf_dir, "documents")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.findings(table(spark, sf_dir, "documents"), ["doc_id"]))


def op6_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path()))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


HELD = "crc32(cast(doc_id as string)) % 3 = 1"


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    return toxicity.fitted(toxicity.sampled(docs, table(spark, sf_dir, "labels"), HELD))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.scores(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", F.coalesce(F.expr(HELD), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.perspectives(table(spark, sf_dir, "conversations")))


def op10_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scans(table(spark, sf_dir, "documents")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(trie.rebuilt(trie.packed(table(spark, sf_dir, "conversations"))))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_fixed_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.deduplicated(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_katz_backoff": op1_katz_backoff,
        "op2_winnowing": op2_winnowing,
        "op3_min_cut": op3_min_cut,
        "op4_host_rules": op4_host_rules,
        "op5_blob_ledger": op5_blob_ledger,
        "op6_bin_slack": op6_bin_slack,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_toxicity": op8_toxicity,
        "op9_perspectives": op9_perspectives,
        "op10_license_index": op10_license_index,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_whitening": op12_whitening,
        "op13_fixed_anchors": op13_fixed_anchors,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_winnowing": oracles.WINNOWING, "op4_host_rules": oracles.HOST_RULES, "op7_jaccard_join": oracles.JACCARD, "op9_perspectives": chat.ORACLE, "op11_prefix_trie": trie.ORACLE, "op13_fixed_anchors": substrings.ORACLE}
