"""Page layout beyond columns: words to lines, box arithmetic, origins, and the choice between geometry readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def words_to_lines(words: DataFrame, keys: tuple[str, ...] = ("doc_id", "page"), gap: str = "gap") -> DataFrame:
    """keys, line, x0, x1, top, bottom, n_words, text: a page's words, by top and left edge, gathered into lines.

    A word joins the line before it if its top is within max(0.55 of the line's first word's height, 2.5) of the line's
    running top, and both lie on one side of the column gap (null: none). The running top weighs the newest word as the
    layout rule has it: (top * n + new) / (n + 1) with n counted after the word. One fold over a page's words. Words of
    equal top, x0 and word_no come by x1, bottom and text, both in the fold and in the line's text.
    """
    word = F.struct("top", "x0", "word_no", "x1", "bottom", "text")
    pages = words.groupBy(*keys).agg(F.array_sort(F.collect_list(word)).alias("w"), F.first(gap).alias("gap"))  # one page's words

    def opened(w: Column, line: Column) -> Column:
        return F.struct(line.cast("int").alias("line"), w["top"].alias("top"), F.greatest((w["bottom"] - w["top"]) * 0.55, F.lit(2.5)).alias("tol"), F.lit(1.0).alias("n"), ((w["x0"] + w["x1"]) / 2).alias("centre"))

    start = F.struct(F.lit(-1).alias("line"), F.lit(0.0).alias("top"), F.lit(-1.0).alias("tol"), F.lit(0.0).alias("n"), F.lit(0.0).alias("centre"))
    none = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, w: Column) -> Column:
        at, mid = acc["at"], (w["x0"] + w["x1"]) / 2
        near = F.abs(w["top"] - at["top"]) <= at["tol"]
        side = F.col("gap").isNull() | ((at["centre"] / at["n"] < F.col("gap")) == (mid < F.col("gap")))
        n = at["n"] + 1
        joined = F.struct(at["line"].alias("line"), ((at["top"] * n + w["top"]) / (n + 1)).alias("top"), at["tol"].alias("tol"), n.alias("n"), (at["centre"] + mid).alias("centre"))
        new = F.when(near & side, joined).otherwise(opened(w, at["line"] + 1))
        return F.struct(new.alias("at"), F.concat(acc["out"], F.array(new["line"])).alias("out"))

    each = pages.select(*keys, F.posexplode(F.arrays_zip(F.aggregate("w", none, step)["out"].alias("line"), F.col("w").alias("w"))).alias("nth", "z")).select(*keys, "nth", F.col("z.line").alias("line"), "z.w.*")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("x0", "nth", "text"))), lambda s: s["text"])
    return each.groupBy(*keys, "line").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.count(F.lit(1)).alias("n_words"), join_words(ordered).alias("text"))


def join_words(words: Column) -> Column:
    """Words with single spaces, none before a closing sign."""
    return F.regexp_replace(F.array_join(words, " "), r"\s+([,.:;!?])", "$1")


def box_area(b: Column) -> Column:
    return F.abs(b["x1"] - b["x0"]) * F.abs(b["y1"] - b["y0"])


def _edges(b: Column) -> list[Column]:
    return [F.least(b["x0"], b["x1"]), F.greatest(b["x0"], b["x1"]), F.least(b["y0"], b["y1"]), F.greatest(b["y0"], b["y1"])]


def box_contains(outer: Column, inner: Column) -> Column:
    (ol, or_, ot, ob), (il, ir, it, ib) = _edges(outer), _edges(inner)
    return (outer["page"] == inner["page"]) & (ol <= il) & (ot <= it) & (or_ >= ir) & (ob >= ib)


def boxes_overlap(a: Column, b: Column) -> Column:
    (al, ar, at, ab), (bl, br, bt, bb) = _edges(a), _edges(b)
    return (a["page"] == b["page"]) & ~((ar < bl) | (br < al) | (ab < bt) | (bb < at))


def box_from_top(t: Column, b: Column, origin: Column, height: Column) -> tuple[Column, Column]:
    """Top and bottom edge from the page's top, whatever the origin; where it is not told, t above b tells it."""
    name = F.upper(F.coalesce(origin, F.lit("")))
    low = F.contains(name, F.lit("BOTTOM")) | (~F.contains(name, F.lit("TOP")) & (t > b))
    one, two = F.when(low, height - t).otherwise(t), F.when(low, height - b).otherwise(b)
    return F.least(one, two), F.greatest(one, two)


#: What a reader's counts are worth, in 3,000ths each, and up to which count.
READER_POINTS = {"lines": (14, 60), "blocks": (12, 20), "sections": (144, 5), "headings": (45, 8), "urls": (60, 2), "table_skills": (45, 4)}


def reader_scores(candidates: DataFrame) -> DataFrame:
    """candidates with coverage and score: what a reader found on a document, each count up to its cap.

    Shares (of pages with lines and with two columns, of lines with a font) are added over their common denominator, in
    whole numbers, so that halves are rounded up alike everywhere.
    """
    pages, lines = F.greatest("pages", F.lit(1)), F.greatest("lines", F.lit(1))
    cover = F.when(F.col("pages") > 0, F.col("pages_with_lines")).otherwise(0)
    fonts = F.when(F.col("lines") > 0, F.col("font_lines")).otherwise(0)
    plain = F.col("source") == "pdfplumber"
    points = sum((F.least(F.col(c), F.lit(most)) * w for c, (w, most) in READER_POINTS.items()), F.lit(0))
    points = points + F.when((F.col("source") == "docling") & (F.col("table_skills") > 0), 120).otherwise(0)
    points = points + F.when(plain & (F.col("two_column_pages") > 0), 90).otherwise(0) + F.when(plain & (F.col("lines") > 0) & (fonts * 4 >= lines * 3), 60).otherwise(0)
    both = points * pages * lines + (cover * 300 + F.col("two_column_pages") * 150) * lines + fonts * 90 * pages
    score = F.floor((both * 2 + pages * lines * 3) / (pages * lines * 6)) / F.lit(1000.0)
    return candidates.withColumn("coverage", F.round(cover / pages, 3)).withColumn("score", score)


def best_reader(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, source, score: the highest by score, sections, headings, lines and blocks; of equals the first (ord)."""
    rank = F.struct("score", "sections", "headings", "lines", "blocks", -F.col("ord"))
    return scored.groupBy(key).agg(F.max_by(F.struct("source", "score"), rank).alias("b")).select(key, "b.*")


def merge_found(best: DataFrame, items: DataFrame, fold: bool, key: str = "doc_id") -> DataFrame:
    """key, values: the best reader's items in order, then what only the others (ord, pos) found; fold: in any case."""
    mine = items.join(best.select(key, F.col("source").alias("chosen")), key).withColumn("rank", F.struct((F.col("source") != F.col("chosen")).alias("other"), "ord", "pos"))
    one = mine.groupBy(key, (F.lower("value") if fold else F.col("value")).alias("v")).agg(F.min(F.struct("rank", "value")).alias("m"))
    return one.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda x: x["value"]), "; ").alias("values"))


def likely_headings(lines: DataFrame, matched: Column, key: str = "doc_id") -> DataFrame:
    """lines with likely: type 1.08 times the page's median size or more in up to six words, or capitals in up to five
    words, or a known heading (matched)."""
    t = F.trim("text")
    n = F.size(F.split(t, r"\s+"))
    median = F.median("size").over(Window.partitionBy(key, "page"))
    large = F.coalesce((F.col("size") >= median * 1.08) & (n <= 6), F.lit(False))
    capitals = (t == F.upper(t)) & (t != F.lower(t)) & (n <= 5)
    return lines.withColumn("likely", (t != "") & (large | capitals | matched))


def heading_evidence(headings: DataFrame, key: str = "doc_id") -> DataFrame:
    """headings (key, page, section, text, size, bold, median) with score: .45, .30 for size, .15 for bold, .10 for up to
    four words; null sizes count as none."""
    n = F.size(F.split(F.trim("text"), r"\s+"))
    points = 45 + F.when(F.coalesce(F.col("size") >= F.col("median") * 1.05, F.lit(False)), 30).otherwise(0) + F.when(F.col("bold"), 15).otherwise(0) + F.when(n <= 4, 10).otherwise(0)
    return headings.withColumn("score", points / 100.0)
