"""Several strategies' profiles of one document: field scores, consensus, candidate support, picks, ordered lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight of each field in a profile's global score.
WEIGHTS = {"personal": 2.0, "skills": 2.0, "experience": 2.0, "education": 1.5, "summary": 0.2}


def union_strategies(*profiles: DataFrame) -> DataFrame:
    """All strategies' rows with their ordinal."""
    return reduce(DataFrame.unionByName, [p.withColumn("ord", F.lit(i)) for i, p in enumerate(profiles)])


def field_scores(p: DataFrame) -> DataFrame:
    """Profiles (name, email, phone, location, skill_count, job_count, dated_jobs, degree_count, summary) with a score of
    each field between 0 and 1 and the weighted global score over the fields that have data."""
    on = lambda c, v: F.when(c, v).otherwise(0.0)
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    words = F.size(F.split(F.trim(F.coalesce("name", F.lit(""))), r"\s+"))
    scores = {
        "personal": on(has("name"), 0.3) + on(has("name") & words.between(2, 4), 0.15) + on(F.col("email").rlike("@"), 0.3) + on(has("phone"), 0.2) + on(F.contains(F.coalesce("location", F.lit("")), F.lit(",")), 0.05),
        "skills": F.least(F.col("skill_count"), F.lit(24)) / 24.0,
        "experience": F.when(F.col("job_count") > 0, 0.55 + 0.45 * F.col("dated_jobs") / F.col("job_count")).otherwise(0.0),
        "education": F.least(F.col("degree_count") / 2.0, F.lit(1.0)),
        "summary": on(has("summary"), 1.0),
    }
    out = p.select("*", *[F.round(s, 6).alias(f"{k}_score") for k, s in scores.items()])
    weight = lambda k: F.when(F.col(f"{k}_score") > 0, WEIGHTS[k]).otherwise(0.0)
    total = sum((weight(k) for k in WEIGHTS), F.lit(0.0))
    return out.withColumn("global_score", F.when(total > 0, F.round(F.round(sum((weight(k) * F.col(f"{k}_score") for k in WEIGHTS), F.lit(0.0)) / total, 9), 6)).otherwise(0.0))


def consensus(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document, each field from the strategy that scores best on it (then by global score, then first)."""
    rank = lambda k: F.struct(F.col(f"{k}_score"), F.col("global_score"), (-F.col("ord")).alias("o"))
    of = {"name": "personal", "email": "personal", "phone": "personal", "location": "personal", "skill_count": "skills", "job_count": "experience", "degree_count": "education", "summary": "summary"}
    return scored.groupBy(key).agg(*[F.max_by(c, rank(k)).alias(c) for c, k in of.items()])


def final_pick(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """The strategy with the highest global score; of equal ones the first."""
    return scored.groupBy(key).agg(F.max_by("strategy", F.struct("global_score", (-F.col("ord")).alias("o"))).alias("strategy"), F.max("global_score").alias("global_score"))


def candidate_support(values: DataFrame, key: str = "doc_id", least: int = 2, least_weight: float = 1.6) -> DataFrame:
    """values (key, field, value, strategy, score, ord) grouped by normal form: supported by enough strategies or weight.

    A strategy counts once per value, with its first score; the value shown is the best scored, the earliest of equals.
    """
    norm = F.trim(F.regexp_replace(F.lower("value"), "[^a-z0-9]+", " "))
    once = values.withColumn("norm", norm).filter("norm <> ''").groupBy(key, "field", "norm", "strategy").agg(F.min_by("score", "ord").alias("score"), F.min_by("value", "ord").alias("value"), F.min("ord").alias("ord"))
    g = once.groupBy(key, "field", "norm").agg(F.count(F.lit(1)).alias("support"), F.round(F.sum("score"), 6).alias("weighted"), F.max_by("value", F.struct("score", (-F.col("ord")).alias("o"))).alias("value"), F.min("ord").alias("first_seen"))
    kept = g.filter((F.col("support") >= least) | (F.col("weighted") >= least_weight))
    order = Window.partitionBy(key, "field").orderBy((F.col("support") + F.col("weighted")).desc(), "first_seen", "norm")
    return kept.select(key, "field", "value", "support", "weighted", F.row_number().over(order).alias("rank"))


def ordered_distinct(items: DataFrame, key: str = "doc_id", order: str = "pos", value: str = "value") -> DataFrame:
    """The first spelling of each value, case apart, in order of first appearance."""
    one = items.filter(F.trim(value) != "").groupBy(key, F.lower(F.trim(value)).alias("low")).agg(F.min(order).alias(order), F.min_by(value, order).alias(value))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(order))).drop("low")


def drop_contained(array: Column) -> Column:
    """Items of an array that no other, different item contains, case apart."""
    return F.filter(array, lambda x: ~F.exists(array, lambda y: (F.lower(x) != F.lower(y)) & F.contains(F.lower(y), F.lower(x))))


def merge_lists(first: Column, second: Column) -> Column:
    """first, then what second has besides, without repetitions, in order."""
    return F.array_distinct(F.concat(first, second))


def provenance(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, field, strategy, score, strategies_with_data: of equal scores the last strategy counts."""
    fields = F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"{k}_score").alias("score")) for k in WEIGHTS])
    x = scored.select(key, "strategy", "ord", F.explode(fields).alias("f")).select(key, "strategy", "ord", "f.*")
    return x.groupBy(key, "field").agg(F.max_by("strategy", F.struct("score", "ord")).alias("strategy"), F.max("score").alias("score"), F.count_if(F.col("score") > 0).alias("strategies_with_data"))


def agreement(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, agreement, overall: 0.7·mean + 0.3·(1 − coefficient of variation) of the strategies' global scores."""
    g = scored.groupBy(key).agg(F.avg("global_score").alias("m"), F.stddev_pop("global_score").alias("s"))
    cv = F.when(F.col("m") > 0, F.least(F.col("s") / F.col("m"), F.lit(1.0))).otherwise(1.0)
    return g.select(key, F.round(F.col("m") * 0.7 + (1 - cv) * 0.3, 4).alias("agreement"))
