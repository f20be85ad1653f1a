"""Announcement text out of page HTML: blocks, boilerplate shared by pages, best block, residual text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import fingerprint, one_line
from ..sources.tables import stored
from .stats import running_counts

#: Elements whose content is never text, elements that end a block, words of messages and of menus.
HARD = "script|style|noscript|template|svg|iframe"
SOFT = "nav|footer|header|aside|form|button|menu"
BLOCK = "p|div|li|ul|ol|h[1-6]|article|section|main|table|tr|td|th|blockquote|pre|nav|footer|header|aside|form|title|body|dl|dt|dd"
MESSAGE_WORDS = ["shares", "purchase", "acquired", "sold", "primary insider", "transaction", "price", "holding", "aksjer", "kjøp", "salg", "kurs"]
MENU_WORDS = ["cookie", "log in", "menu", "search", "subscribe", "privacy", "terms", "meny", "søk", "personvern"]
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def blocks(pages: DataFrame) -> DataFrame:
    """page_id, block_no, text, soft (inside a frame element), chars, link_chars. Regular expressions and array functions in the JVM."""
    html = F.regexp_replace(F.coalesce("html", F.lit("")), rf"(?is)<({HARD})\b.*?(</\1\s*>|$)|<!--.*?(-->|$)", " ")
    html = F.regexp_replace(html, rf"(?is)<({SOFT})\b[^>]*>", "\u0001\u0002")
    html = F.regexp_replace(html, rf"(?is)</({SOFT})\s*>", "\u0001\u0003")
    html = F.regexp_replace(html, rf"(?is)</?({BLOCK})\b[^>]*>", "\u0001")
    parts = pages.select("page_id", F.posexplode(F.split(html, "\u0001")).alias("part_no", "raw"))
    plain = F.regexp_replace(F.regexp_replace("raw", r"(?is)<br\b[^>]*>", " "), r"(?s)<[^>]*>|[\u0002\u0003]", "")
    for name, char in ENTITIES.items():
        plain = F.replace(plain, F.lit(name), F.lit(char))
    links = F.aggregate(F.regexp_extract_all("raw", F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1)), F.lit(0), lambda n, x: n + F.length(F.regexp_replace(x, "<[^>]*>", "")))
    step = F.when(F.startswith("raw", F.lit("\u0002")), 1).when(F.startswith("raw", F.lit("\u0003")), -1).otherwise(0)
    read = parts.select("page_id", "part_no", step.alias("_step"), one_line(plain).alias("text"), links.alias("link_chars"))  # before the window, so that no pattern runs again for the filter
    out = read.withColumn("soft", F.sum("_step").over(W.partitionBy("page_id").orderBy("part_no")) > 0).where("text <> ''")
    return out.select("page_id", (F.row_number().over(W.partitionBy("page_id").orderBy("part_no")) - 1).alias("block_no"), "text", "soft", F.length("text").alias("chars"), "link_chars")


def measured(found: DataFrame, short: int = 25) -> DataFrame:
    """Adds link_density, short_share (of lines), message_hits and menu_hits."""
    split = F.split("text", "\n")
    hits = lambda words: sum((F.contains(F.lower("text"), F.lit(w)).cast("int") for w in words), F.lit(0))
    return found.withColumn("link_density", F.least(F.lit(1.0), F.col("link_chars") / F.col("chars"))).withColumn("short_share", F.size(F.filter(split, lambda x: F.length(x) < short)) / F.size(split)).withColumn("message_hits", hits(MESSAGE_WORDS)).withColumn("menu_hits", hits(MENU_WORDS))


def boilerplate(found: DataFrame, share: float = 0.2, least: int = 5, least_pages: int = 20) -> DataFrame:
    """fp, pages, sample: fingerprints of blocks on at least max(5, 20 %) of the pages; a page counts once. None below 20 pages."""
    n = found.agg(F.count_distinct("page_id").alias("_pages"))
    seen = found.select("page_id", fingerprint(F.col("text")).alias("fp"), "text").groupBy("page_id", "fp").agg(F.min("text").alias("text"))
    counted = seen.groupBy("fp").agg(F.count(F.lit(1)).alias("pages"), F.min("text").alias("sample")).crossJoin(F.broadcast(n))
    return counted.where((F.col("_pages") >= least_pages) & (F.col("pages") >= F.greatest(F.lit(least), F.ceil(share * F.col("_pages"))))).drop("_pages")


def page_sample(pages: DataFrame, most: int) -> DataFrame:
    """An evenly spaced sample by page id, a number; places come from counts summed in parts."""
    upto = running_counts(pages.select("page_id"), "page_id")
    n = pages.agg(F.count("page_id").alias("_n"))
    step = F.greatest(F.lit(1.0), F.col("_n") / F.lit(float(most)))
    chosen = upto.crossJoin(F.broadcast(n)).where(F.floor(F.col("_upto") / step) > F.floor((F.col("_upto") - F.col("_c")) / step)).select("page_id")
    return pages.join(chosen, "page_id", "left_semi")


def best_block(found: DataFrame, shared: DataFrame, least: int = 300, floor: int = 150) -> DataFrame:
    """page_id, text, pass_no: per page the best block that is no boilerplate. Strict pass: message words and `least` characters,
    no frame; mild pass: `floor` characters. Within 5 % of the best score the shorter block wins."""
    clean = measured(found).withColumn("fp", fingerprint(F.col("text"))).join(shared.select("fp"), "fp", "left_anti")
    pass_no = F.when((F.col("message_hits") > 0) & (F.col("chars") >= least) & ~F.col("soft") & (F.col("link_density") < 0.3), 1).when((F.col("chars") >= floor) & (F.col("link_density") < 0.5), 2)
    score = F.col("chars") * (1 - F.col("link_density")) * (1 + 0.2 * F.col("message_hits") - 0.2 * F.col("menu_hits"))
    scored = clean.withColumn("pass_no", pass_no).where("pass_no is not null").withColumn("score", score)
    first = scored.withColumn("_p", F.min("pass_no").over(W.partitionBy("page_id"))).where("pass_no = _p").withColumn("_best", F.max("score").over(W.partitionBy("page_id")))
    near = first.where("score >= 0.95 * _best")
    return near.withColumn("_n", F.row_number().over(W.partitionBy("page_id").orderBy("chars", "block_no"))).where("_n = 1").select("page_id", "text", "pass_no")


def residual(found: DataFrame, shared: DataFrame, least: int = 0, most: int | None = None) -> DataFrame:
    """page_id, text of `least` characters or more, out of a page's blocks; shared blocks serve to find the message, not to be deleted, since the
    labels of a form are the same in every message.

    1. The run of blocks of greatest weight: a block of its own weighs its length (4 at least), a shared one minus half of it. By prefix
       sums: the run ends at the first maximum of S_j - min S_i over i < j, and starts after the latest such minimum.
    2. Where that is too short: all blocks of their own and the blocks next to them.
    3. Else the whole page, if its own blocks have `least` characters together.
    """
    page = W.partitionBy("page_id").orderBy("block_no")
    marks = found.withColumn("fp", fingerprint(F.col("text"))).join(shared.select("fp", F.lit(True).alias("_shared")), "fp", "left").withColumn("_own", F.col("_shared").isNull())
    length = F.greatest(F.lit(4), F.col("chars")).cast("double")
    sums = marks.withColumn("_w", F.when(F.col("_own"), length).otherwise(-length / 2)).withColumn("_s", F.sum("_w").over(page)).withColumn("_before", F.col("_s") - F.col("_w"))
    runs = sums.withColumn("_gain", F.col("_s") - F.min("_before").over(page)).withColumn("_start", F.max(F.struct(-F.col("_before"), "block_no")).over(page)["block_no"])
    near = F.coalesce(F.lag("_own").over(page), F.lit(False)) | F.col("_own") | F.coalesce(F.lead("_own").over(page), F.lit(False))
    block = F.struct("block_no", "text", near.alias("near"), F.col("_own").alias("own"), "chars")
    best = runs.withColumn("_block", block).groupBy("page_id").agg(F.max(F.struct("_gain", -F.col("block_no"), "_start")).alias("x"), F.array_sort(F.collect_list("_block")).alias("b"))
    joined = lambda keep: F.array_join(F.transform(F.filter("b", keep), lambda b: b["text"]), "\n")
    tries = [joined(lambda b: b["block_no"].between(F.col("x._start"), -F.col("x.col2")) & (F.col("x._gain") > 0)), joined(lambda b: b["near"]), joined(lambda b: F.lit(True))]
    own = F.aggregate("b", F.lit(0), lambda n, b: n + F.when(b["own"], b["chars"]).otherwise(0))
    enough = lambda t: (F.length(t) >= least) & (t != "")
    text = F.when(enough(tries[0]), tries[0]).when(enough(tries[1]), tries[1]).when(enough(tries[2]) & (own >= least) & (own > 0), tries[2])
    return best.select("page_id", (text if most is None else F.substring(text, 1, most)).alias("text")).where("text is not null")


def attachment_text(attachments: DataFrame) -> DataFrame:
    """page_id, text: a page's attachments with a text, in order of attachment_no (null first, then by text), one line each."""
    part = F.struct("attachment_no", one_line(F.col("text")).alias("t"))
    parts = F.array_sort(F.filter(F.collect_list(part), lambda x: x["t"] != ""))  # filtered once they are read, so that no text is read twice
    return attachments.groupBy("page_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("text")).where("text <> ''")


def text_index(pages: DataFrame, attachments: DataFrame | None = None, least: int = 0) -> DataFrame:
    """page_id, text, how: best block, else residual text of `least` characters, else that of the page's attachments, else none; for every page.

    attachments: page_id, attachment_no, text, as read from what a page links to. Blocks are read once and written, as are the shared ones: of these there are few, so they go to
    the blocks, and what all pages share is in no task of its own. Only attachments of pages without a text of their own are read.
    """
    found = stored(blocks(pages), "page-blocks")
    shared = stored(boilerplate(found).select("fp"), "shared-blocks")
    legs = [("block", best_block(found, shared)), ("residual", residual(found, shared, least))]
    out = pages.select("page_id")
    for how, texts in legs:
        out = out.join(texts.select("page_id", F.col("text").alias(f"_{how}")), "page_id", "left")
    names = [how for how, _ in legs]
    if attachments is not None:
        out = stored(out, "page-texts")
        wanted = stored(out.where("_block is null and _residual is null").select("page_id").distinct(), "pages-without")
        texts = attachment_text(attachments.join(wanted, "page_id", "left_semi"))
        out = out.join(texts.withColumnRenamed("text", "_attachment"), "page_id", "left")
        names.append("attachment")
    how = F.coalesce(*(F.when(F.col(f"_{x}").isNotNull(), x) for x in names), F.lit("none"))
    return out.select("page_id", F.coalesce(*(f"_{x}" for x in names), F.lit("")).alias("text"), how.alias("how"))


def index_status(index: DataFrame) -> DataFrame:
    """pages, how many of them by each leg, unique_share, status: share of texts that are unique; below 25 % the extraction failed, below
    50 % it is partial. An index without a text has failed."""
    has = F.when(F.col("text") != "", fingerprint(F.col("text")))
    share = F.count_distinct(has) / F.nullif(F.count(has), F.lit(0))
    legs = [F.count(F.when(F.col("how") == x, 1)).alias(f"n_{x}") for x in ("block", "residual", "attachment", "none")]
    out = index.agg(F.count(F.lit(1)).alias("pages"), *legs, share.alias("unique_share"))
    return out.withColumn("status", F.when(F.col("unique_share").isNull() | (F.col("unique_share") < 0.25), "FAIL").when(F.col("unique_share") < 0.5, "PARTIAL").otherwise("OK"))


def why_no_text(found: DataFrame, pages_n: int = 3, blocks_n: int = 3) -> DataFrame:
    """The longest blocks of the first pages, with the measures that refused them."""
    m = measured(found)
    first = m.select("page_id").distinct().orderBy("page_id").limit(pages_n)
    longest = F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("chars"), "block_no"))
    return m.join(F.broadcast(first), "page_id").withColumn("place", longest).where(F.col("place") <= blocks_n)
