"""Scoring extracted profiles against labelled ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dice, tokens


def similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with the Dice similarity of two texts' words."""
    return pairs.withColumn("similarity", F.round(dice(tokens(F.col(a)), tokens(F.col(b))), 6))


def set_f1(truth: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """precision, recall and F1 of the distinct lower-cased values per key; both empty counts as 1."""
    t = truth.select(key, F.lower(F.trim(value)).alias("v")).distinct().withColumn("t", F.lit(1))
    f = found.select(key, F.lower(F.trim(value)).alias("v")).distinct().withColumn("f", F.lit(1))
    g = t.join(f, [key, "v"], "full").groupBy(key).agg(F.sum(F.coalesce("t", F.lit(0)) * F.coalesce("f", F.lit(0))).alias("both"), F.count("t").alias("nt"), F.count("f").alias("nf"))
    share = lambda n: F.when(F.col(n) > 0, F.col("both") / F.col(n)).otherwise(0.0)
    return g.select(key, F.round(share("nf"), 6).alias("precision"), F.round(share("nt"), 6).alias("recall"), F.round(2 * F.col("both") / (F.col("nt") + F.col("nf")), 6).alias("f1"))


def keyed_score(truth: DataFrame, found: DataFrame, key: str, entry: str, value: str, order: str) -> DataFrame:
    """Mean similarity of values whose entry keys agree; of entries that repeat a key, the last found counts; a missing
    one counts 0."""
    norm = F.trim(F.regexp_replace(F.lower(entry), "[^a-z0-9]+", " "))
    last = found.withColumn("e", norm).withColumn("r", F.row_number().over(Window.partitionBy(key, "e").orderBy(F.desc(order)))).filter("r = 1").select(key, "e", F.col(value).alias("__f"))
    x = truth.withColumn("e", norm).join(last, [key, "e"], "left")
    return x.groupBy(key).agg(F.round(F.avg(F.when(F.col("__f").isNull(), 0.0).otherwise(dice(tokens(F.col(value)), tokens(F.col("__f"))))), 6).alias("score"))


def greedy_assignment(truth: DataFrame, found: DataFrame, key: str, order: str, value: str, least: float = 0.5) -> DataFrame:
    """Per key, each truth in order takes the best unused found value (first of equals) of at least `least` similarity.

    An ordered fold over the key's own lists, which a profile keeps short.
    """
    listed = lambda df, name: df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"]).alias(name))
    both = listed(truth, "t").join(listed(found, "f"), key, "left").withColumn("f", F.coalesce("f", F.array().cast("array<string>")))
    zero = F.struct(F.array().cast("array<int>").alias("used"), F.lit(0.0).alias("sum"), F.lit(0).alias("hits"))

    def step(acc, t):
        scored = F.transform(F.col("f"), lambda f, i: F.struct(F.when(F.array_contains(acc["used"], i), -1.0).otherwise(dice(tokens(t), tokens(f))).alias("s"), (-i).alias("o")))
        best = F.array_max(scored)
        take = F.coalesce(best["s"] >= least, F.lit(False))
        return F.struct(F.when(take, F.array_append(acc["used"], -best["o"])).otherwise(acc["used"]).alias("used"), (acc["sum"] + F.when(take, best["s"]).otherwise(0.0)).alias("sum"), (acc["hits"] + take.cast("int")).alias("hits"))

    out = both.withColumn("r", F.aggregate("t", zero, step))
    return out.select(key, F.col("r.hits").cast("bigint").alias("matched"), F.round(F.col("r.sum") / F.size("t"), 6).alias("score"))


def missing_both_ways(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, missing_in: what one side has and the other lacks."""
    a = left.select(key).distinct().join(right, key, "left_anti").withColumn("missing_in", F.lit("right"))
    return a.unionByName(right.select(key).distinct().join(left, key, "left_anti").withColumn("missing_in", F.lit("left")))


def failure_buckets(scores: DataFrame, bounds: dict[str, float]) -> DataFrame:
    """bucket, failures, mean: rows whose score is under its bound, by score column."""
    parts = F.array(*[F.struct(F.lit(c).alias("bucket"), F.col(c).cast("double").alias("s"), (F.col(c) < b).alias("bad")) for c, b in bounds.items()])
    return scores.select(F.explode(parts).alias("x")).groupBy("x.bucket").agg(F.count_if("x.bad").alias("failures"), F.round(F.avg("x.s"), 6).alias("mean"))


#: The least score a section may have, by section.
LEAST = {"contact": 1.0, "experience": 0.9, "education": 0.9, "projects": 0.85, "skills": 0.85}


def with_metadata(results: DataFrame, metadata: DataFrame, key: str = "stem") -> DataFrame:
    """Results (doc_id, key, section, score) with their sample's archetype (null if there is none) and whether they failed."""
    least = F.create_map(*[F.lit(x) for kv in LEAST.items() for x in kv])
    return results.join(metadata, key, "left").select("doc_id", key, "section", "archetype", (F.col("score") < least[F.col("section")]).alias("failed"))
