"""Sidebars, table skills, links, exact scores, manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables
from .fixtures import oracle, view
from .profile_queries import WIDTH, _col, _gap, _lines, _sc, _scored


def sidebar_detect(spark, sf_dir):
    return tables.sidebars(_lines(spark, sf_dir), WIDTH)


def smart_reading_order(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return tables.smart_order(lines, tables.sidebars(lines, WIDTH)).select("doc_id", "page", "line_no", F.col("place").cast("bigint").alias("place"))


def _cells(spark, sf_dir):
    x = view(spark, sf_dir, "raw_skills")
    return x.select(F.col("cand_id").alias("doc_id"), F.lit(0).alias("tbl"), (F.col("pos") % 4).alias("row"), (F.col("pos") % 3).alias("col"), F.when(F.col("pos") % 4 == 0, F.when(F.col("cand_id") % 2 == 0, "Skill").otherwise(F.col("raw"))).when(F.col("pos") % 3 == 2, "8/10").otherwise(F.concat("raw", F.lit(", SQL"))).alias("text"))


def table_skills(spark, sf_dir):
    return tables.table_skills(_cells(spark, sf_dir))


def text_table_skills(spark, sf_dir):
    x = view(spark, sf_dir, "raw_skills").withColumn("line", F.concat(F.lit("Tools: "), "raw", F.lit(" | Git (daily)")))
    return x.select("pos", F.array_join(tables.text_skills(F.col("line")), ";").alias("skills"))


def link_normalize(spark, sf_dir):
    x = view(spark, sf_dir, "links").withColumn("url", F.when(F.col("pos") % 11 == 0, "ana-silva-42").when(F.col("pos") % 13 == 0, "N/A").otherwise(F.col("url")))
    return x.select("doc_id", "pos", tables.normalize_link(F.col("label"), F.col("url")).alias("link"))


def personal_exact_score(spark, sf_dir):
    c = view(spark, sf_dir, "candidates")
    t = c.select("cand_id", F.col("name").alias("t_name"), F.col("email").alias("t_email"), F.when(F.col("cand_id") % 4 != 0, F.col("phone")).alias("t_phone"), F.upper("name").alias("f_name"), F.when(F.col("cand_id") % 3 != 0, F.col("email")).alias("f_email"), F.col("phone").alias("f_phone"))
    return t.select("cand_id", tables.exact_score(t, "name", "email", "phone").alias("score"))


def strategy_manifest(spark, sf_dir):
    return tables.manifest(_scored(spark, sf_dir))


QUERIES = {f.__name__: f for f in (sidebar_detect, smart_reading_order, table_skills, text_table_skills, link_normalize, personal_exact_score, strategy_manifest)}

_side = ", sb AS (SELECT doc_id, page, CASE WHEN w1 <= 168 AND n1 <= 0.75 * n0 THEN 1 WHEN w0 <= 168 AND n0 <= 0.75 * n1 THEN 0 END AS sidebar FROM (SELECT doc_id, page, count(*) FILTER (WHERE col = 0) AS n0, count(*) FILTER (WHERE col = 1) AS n1, avg(x1 - x0) FILTER (WHERE col = 0) AS w0, avg(x1 - x0) FILTER (WHERE col = 1) AS w1 FROM ac WHERE col >= 0 GROUP BY 1, 2))"
_heads = ", ".join(f"'{w}'" for w in tables.HEAD_WORDS)
_rating = "(?i)^(?:\\d{1,2}(?:/\\d{1,2})?|\\d{1,3}%|expert|advanced|intermediate|beginner|good|basic|[★☆*]+)$"
ORACLES = {
    "sidebar_detect": oracle("words_geom", _gap + _col + _side + " SELECT doc_id, page, CAST(sidebar AS BIGINT) AS sidebar FROM sb"),
    "smart_reading_order": oracle("words_geom", _gap + _col + _side + " SELECT doc_id, page, line_no, row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN col < 0 THEN 0 WHEN sidebar IS NULL THEN 1 + col WHEN col = sidebar THEN 2 ELSE 1 END, top, x0, line_no) AS place FROM ac LEFT JOIN sb USING (doc_id, page)"),
    "table_skills": oracle("raw_skills", f""", c AS (SELECT cand_id AS d, pos % 4 AS r, pos % 3 AS k, CASE WHEN pos % 4 = 0 THEN CASE WHEN cand_id % 2 = 0 THEN 'Skill' ELSE raw END WHEN pos % 3 = 2 THEN '8/10' ELSE raw || ', SQL' END AS t FROM raw_skills), h AS (SELECT d, avg(CASE WHEN lower(trim(t)) IN ({_heads}) THEN 1 ELSE 0 END) >= 0.5 AS hd FROM c WHERE r = 0 GROUP BY 1),
     b AS (SELECT c.* FROM c LEFT JOIN h USING (d) WHERE NOT coalesce(hd, false) OR r > 0), rt AS (SELECT d, k, avg(CASE WHEN regexp_matches(trim(t), '{_rating}') THEN 1 ELSE 0 END) >= 0.7 AS x FROM b GROUP BY 1, 2), i AS (SELECT d, trim(unnest(string_split(t, ','))) AS s FROM b JOIN rt USING (d, k) WHERE NOT x AND length(t) <= 100) SELECT DISTINCT d AS doc_id, s AS skill FROM i WHERE length(s) BETWEEN 2 AND 60 AND NOT regexp_matches(s, '{_rating}')"""),
    "text_table_skills": oracle("raw_skills", ", p AS (SELECT pos, unnest(string_split_regex('@' || raw || ' | Git', '\\s*[,|/]\\s*|\\s{2,}')) AS v, generate_subscripts(string_split_regex('@' || raw || ' | Git', '\\s*[,|/]\\s*|\\s{2,}'), 1) AS n FROM raw_skills), q AS (SELECT pos, n, trim(regexp_replace(replace(v, '@', ''), '\\s*\\([^)]*\\)$', '')) AS v FROM p) SELECT pos, string_agg(v, ';' ORDER BY n) AS skills FROM q WHERE length(v) BETWEEN 2 AND 60 GROUP BY 1"),
    "link_normalize": oracle("links", ", x AS (SELECT doc_id, pos, label, CASE WHEN pos % 11 = 0 THEN 'ana-silva-42' WHEN pos % 13 = 0 THEN 'N/A' ELSE trim(url) END AS u FROM links) SELECT doc_id, pos, CASE WHEN u IN ('', 'N/A') THEN '' WHEN starts_with(u, 'http') THEN u WHEN u IN ('ana-silva-42', 'not-a-url') AND label = 'LinkedIn' THEN 'https://www.linkedin.com/in/' || u WHEN u IN ('ana-silva-42', 'not-a-url') AND label = 'GitHub' THEN 'https://github.com/' || u WHEN u LIKE 'github.com%' THEN 'https://' || u ELSE u END AS link FROM x"),
    "personal_exact_score": oracle("candidates", "SELECT cand_id, round((1 + CASE WHEN cand_id % 3 <> 0 THEN 1 ELSE 0 END + CASE WHEN cand_id % 4 <> 0 THEN 1 ELSE 0 END) / CASE WHEN cand_id % 4 <> 0 THEN 3 ELSE 2 END, 6) AS score FROM candidates"),
    "strategy_manifest": oracle("strategies", _sc + ", g AS (SELECT doc_id, count(*) AS strategies, round(avg(global_score)::DECIMAL(18, 9), 6)::DOUBLE AS mean_score, CAST(max(global_score) AS DOUBLE) AS best_score FROM f GROUP BY 1) SELECT *, CASE WHEN best_score < 0.4 THEN 'hard' WHEN mean_score >= 0.7 THEN 'easy' ELSE 'mixed' END AS tag FROM g"),
}
