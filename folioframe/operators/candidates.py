"""One list from several strategies' lists: entries that mean the same are one candidate, with its support, its best
form and the place where it was first seen.

A document's rows are brought together once; the sums by strategy and by candidate and the ranks all use that order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A strategy's score counts so much beside completeness; candidates that no chosen list has stand with the
#: support of so many strategies, or with so much weight.
SCORE_SHARE, LEAST_SUPPORT, LEAST_WEIGHT = 0.4, 2, 1.6


def folded(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def text_key(c: Column) -> Column:
    """Lower case; all but a-z, 0-9 and + . # / as one space; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.lower(folded(c)), "[^a-z0-9+.#/ ]", " "), " +", " ")), F.lit(""))


def address_key(c: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(folded(c), "/+$", "")), F.lit(""))


def _filled(points: dict[str, int]) -> Column:
    """Hundredths for each column that has text."""
    return sum((F.when(F.coalesce(F.col(c), F.lit("")) != "", n).otherwise(0) for c, n in points.items()), F.lit(0))


@dataclass(frozen=True)
class Kind:
    """What makes two entries the same, the columns of an entry, its completeness in hundredths, and whether a candidate
    outside the chosen list needs support."""

    key: Column
    columns: tuple[str, ...]
    completeness: Column
    supported: bool


def education() -> Kind:
    return Kind(F.coalesce(text_key(F.col("institution")), text_key(F.col("degree"))), ("institution", "degree", "field_of_study", "start", "end_", "gpa"), _filled({"institution": 35, "degree": 25, "start": 20, "gpa": 20}), True)


def experience() -> Kind:
    bullets = F.when(F.col("bullets") > 0, 25).otherwise(0)
    return Kind(F.coalesce(text_key(F.col("company")), text_key(F.col("title"))), ("company", "title", "start", "end_", "bullets"), _filled({"company": 30, "title": 25, "start": 20}) + bullets, True)


def projects() -> Kind:
    more = F.when((F.coalesce("technology", F.lit("")) != "") | (F.coalesce("url", F.lit("")) != ""), 5).otherwise(0)
    return Kind(F.coalesce(text_key(F.col("name")), text_key(F.col("description"))), ("name", "description", "start", "technology", "url"), _filled({"name": 45, "description": 40, "start": 10}) + more, True)


def phrases() -> Kind:
    words = F.when(folded(F.col("value")) == "", 0.0).otherwise(F.least(F.size(F.split(folded(F.col("value")), " ")) * 12.5, F.lit(100.0)))
    return Kind(text_key(F.col("value")), ("value",), words, False)


def links() -> Kind:
    return Kind(address_key(F.col("url")), ("label", "url"), F.when(F.col("url").rlike(r"(?i)^https?://[^/?#]+"), 100).otherwise(30), False)


def merge_entries(rows: DataFrame, chosen: DataFrame, kind: Kind, key: str = "doc_id") -> DataFrame:
    """key, rank, support, weighted and the entry of each candidate of a document.

    rows are the strategies' entries (ord: the strategy, score: its score, pos: the place in its list), chosen has the
    strategy (ord) whose list comes first, in its own order; then come the other candidates by support and weight, the
    earliest seen, the best. A candidate is shown in its best form: completeness and a share of the strategy's score,
    the earliest of equals. A strategy counts once for a candidate. Entries without a key are left out.
    """
    entry = F.struct(*kind.columns)
    worth = F.round(kind.completeness / 100.0 + F.col("score") * SCORE_SHARE, 9)
    x = rows.select(key, "ord", "pos", "score", kind.key.alias("same"), worth.alias("worth"), entry.alias("entry")).filter("same IS NOT NULL")
    x = x.join(chosen.select(key, F.col("ord").alias("first_ord")), key, "left")
    here = F.when(F.col("ord") == F.col("first_ord"), F.col("pos"))
    seen = F.struct("ord", "pos")
    once = x.groupBy(key, "same", "ord").agg(F.first("score").alias("score"), F.min("pos").alias("pos"), F.min(here).alias("listed"), F.max(F.struct("worth", (-F.col("pos")).alias("late"), "entry")).alias("best"))
    best = F.struct(F.col("best.worth").alias("worth"), (-F.col("ord")).alias("later"), F.col("best.late").alias("late"), F.col("best.entry").alias("entry"))
    nodes = once.groupBy(key, "same").agg(F.count(F.lit(1)).alias("support"), F.round(F.sum("score"), 6).alias("weighted"), F.min(seen).alias("seen"), F.min("listed").alias("listed"), F.max(best).alias("best"))
    if kind.supported:
        nodes = nodes.filter(F.col("listed").isNotNull() | (F.col("support") >= LEAST_SUPPORT) | (F.col("weighted") >= LEAST_WEIGHT))
    order = Window.partitionBy(key).orderBy(F.col("listed").asc_nulls_last(), (F.col("support") + F.col("weighted")).desc(), "seen", "same")
    return nodes.select(key, F.row_number().over(order).alias("rank"), "support", "weighted", "best.entry.*")
