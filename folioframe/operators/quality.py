"""Quality of extracted text: lines, candidates, language, acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .sections import CORE_SECTIONS, heading_dictionary, match_headings


def text_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no (from 0), line: the non-empty stripped lines of every text."""
    return docs.select(key, F.posexplode(T.lines(F.col(text))).alias("line_no", "line"))


def ratio(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def line_statistics(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: lines, words, and shares of malformed, short (up to two words) and repeated lines."""
    size = F.size(T.words(F.col("line")))
    return lines.groupBy(key).agg(
        F.count(F.lit(1)).alias("line_count"),
        F.sum(size).cast("bigint").alias("word_count"),
        F.round(ratio(T.is_malformed(F.col("line"))), 3).alias("malformed_ratio"),
        F.round(ratio(size <= 2), 3).alias("short_line_ratio"),
        F.round(1 - F.count_distinct("line") / F.count(F.lit(1)), 3).alias("duplicate_ratio"),
    )


def contact_signals(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: how many of the first eight lines have an address, a number or a contact word."""
    signal = F.contains("line", F.lit("@")) | F.col("line").rlike(r"\+?\d[\d\s\-()]{8,}\d") | F.col("line").rlike(r"(?i)linkedin|github|email|phone|mobile")
    return lines.filter("line_no < 8").groupBy(key).agg(F.count_if(signal).alias("contact_signals"))


def candidate_scores(lines: DataFrame, urls: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Per document (or candidate): the weighted extraction score from lines, words, headings, links and noise."""
    size = F.size(T.words(F.col("line")))
    marked = match_headings(lines, heading_dictionary(lines.sparkSession), key)
    heads = marked.groupBy(key).agg(F.count_distinct("section").alias("headings"), F.count_distinct(F.when(F.col("section").isin(*CORE_SECTIONS), F.col("section"))).alias("core"))
    base = lines.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.sum(size).alias("w"), ratio(T.is_malformed(F.col("line"))).alias("bad"), ratio(size <= 2).alias("short"), (1 - F.count_distinct("line") / F.count(F.lit(1))).alias("dup"),
    )
    all_ = base.join(heads, key, "left").join(contact_signals(lines, key), key, "left")
    if urls is not None:
        all_ = all_.join(urls.groupBy(key).agg(F.count(F.lit(1)).alias("links")), key, "left")
    else:
        all_ = all_.withColumn("links", F.lit(0))
    cap = lambda c, top: F.least(F.coalesce(F.col(c), F.lit(0)) / float(top), F.lit(1.0))
    score = cap("n", 30) * 0.18 + cap("w", 220) * 0.22 + cap("core", 4) * 0.24 + cap("headings", 6) * 0.12 + cap("links", 2) * 0.06 + (1 - F.col("short")) * 0.08 + (1 - F.col("dup")) * 0.05 + cap("contact_signals", 3) * 0.10 - F.col("bad") * 0.20
    return all_.select(key, F.coalesce("headings", F.lit(0)).cast("bigint").alias("headings"), F.coalesce("core", F.lit(0)).cast("bigint").alias("core_sections"), F.coalesce("contact_signals", F.lit(0)).cast("bigint").alias("contact_signals"), F.round(F.round(F.greatest(score, F.lit(0.0)), 9), 3).alias("score"))


def best_candidate(candidates: DataFrame, key: str, *ranking: str) -> DataFrame:
    """The candidate of each key that is largest by the ranking columns in turn; the first by `ord` of equal ones."""
    order = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in ranking], "ord")
    return candidates.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")


def language_gate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, language (English, Non-English, Uncertain, Unknown), confidence, supported. Row by row, so it streams too."""
    body = F.array_join(T.lines(F.col(text)), " ")
    foreign = F.length(F.regexp_replace("b", "[^ऀ-ॿ؀-ۿЀ-ӿ぀-ヿ㐀-䶿一-鿿]", ""))
    x = docs.select(key, body.alias("b")).select(
        key, "b", foreign.alias("foreign"), F.length(F.regexp_replace("b", r"\P{L}", "")).alias("alpha"), F.length(F.regexp_replace("b", "[^A-Za-z]", "")).alias("latin"),
        F.slice(F.regexp_extract_all("b", F.lit("[A-Za-z][A-Za-z0-9+#./&-]*"), 0), 1, 250).alias("sample"),
    ).withColumn("hits", F.size(F.filter("sample", lambda w: F.lower(w).isin(*T.ENGLISH_WORDS)))).withColumn("n", F.size("sample"))
    share = lambda a: F.when(F.col("alpha") > 0, F.col(a) / F.col("alpha")).otherwise(0.0)
    x = x.withColumn("lr", share("latin")).withColumn("fr", share("foreign")).withColumn("lex", F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(0.0))
    sure = F.round(F.least(F.lit(1.0), F.col("lr") * 0.75 + F.least(F.col("lex") * 5.0, F.lit(0.25))), 3)
    abroad = (F.col("foreign") >= 8) & (F.col("fr") >= 0.05)
    plain, strong = (F.col("lr") >= 0.92) & ((F.col("hits") >= 4) | (F.col("n") <= 25)), F.col("lr") >= 0.97
    empty = F.col("b") == ""
    language = F.when(empty, "Unknown").when(abroad, "Non-English").when(plain | strong, "English").otherwise("Uncertain")
    confidence = F.when(empty, 0.0).when(abroad, F.round(F.greatest("fr", F.lit(0.85)), 3)).when(plain, F.greatest(sure, F.lit(0.9))).when(strong, F.greatest(sure, F.lit(0.88))).otherwise(sure)
    return x.select(key, language.alias("language"), confidence.alias("confidence"), (language == "English").alias("supported"))


def input_gate(lines: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Accepts or rejects each document of pages (key, page_count) from its lines: image-only, scanned, malformed."""
    marked = match_headings(lines, heading_dictionary(lines.sparkSession), key)
    heads = marked.groupBy(key).agg(F.count_distinct(F.when(F.col("section").isin(*CORE_SECTIONS), F.col("section"))).alias("core0"), F.max(F.col("section") == "header").alias("headed"), F.max(F.col("section").isin("experience", "education", "skills")).alias("main"))
    stats = lines.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("line") <= 2).alias("short"), F.count_if(T.is_malformed(F.col("line"))).alias("bad"))
    x = pages.join(stats, key, "left").join(heads, key, "left").na.fill(0, ["n", "short", "bad", "core0"])
    core = F.col("core0") + F.when((F.col("n") > 0) & ~F.coalesce("headed", F.lit(False)), 1).otherwise(0)
    x = x.withColumn("core", core)
    pc, n = F.col("page_count"), F.col("n")
    yes = lambda c, v: F.when(c, v).otherwise(0.0)
    scanned = F.when(pc > 0, F.round(yes(n / pc < 4, 0.55) + yes(n <= pc * 2, 0.25) + yes(F.col("short") >= F.greatest(F.lit(4), pc * 2), 0.15) + yes((n >= 12) & (F.col("core") <= 1), 0.05), 3)).otherwise(0.0)
    bad = F.when(n > 0, F.round(F.least(F.col("bad") / n + yes((n >= 18) & (F.col("core") <= 1), 0.12) + yes((n >= 18) & ~F.coalesce("main", F.lit(False)), 0.1), F.lit(1.0)), 3)).otherwise(0.0)
    signal = F.when(n > 0, F.round(F.least(F.col("core") / 4.0, F.lit(1.0)), 3)).otherwise(0.0)
    x = x.select(key, "n", pc.alias("pc"), scanned.alias("scanned"), bad.alias("malformed"), signal.alias("signal"))
    why = F.when((F.col("pc") > 0) & (F.col("n") == 0), "image_only").when(F.col("scanned") >= 0.8, "scanned").when((F.col("malformed") >= 0.55) & (F.col("n") < 20), "malformed").when((F.col("malformed") >= 0.6) & (F.col("signal") <= 0.25), "low_structure")
    return x.select(key, F.col("n").alias("line_count"), F.col("scanned").alias("scanned_likelihood"), F.col("malformed").alias("malformed_likelihood"), F.col("signal").alias("section_signal"), why.isNull().alias("accepted"), why.alias("reason"))


def corpus_tags(stats: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sorted tags by pages, words and characters a page."""
    tags = F.array_sort(F.array_compact(F.array(
        F.when(F.col("page_count") > 2, "multi_page"), F.when(F.col("page_count") == 1, "single_page"), F.when(F.col("word_count") < 150, "low_text"),
        F.when(F.col("word_count") > 900, "dense"), F.when(F.col("char_count") / F.greatest("page_count", F.lit(1)) < 200, "possible_scan"),
    )))
    return stats.select(key, F.array_join(tags, ",").alias("tags"))
