"""Headline, location, strict sections, source lines, entry groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation, locate, sections
from .fixtures import oracle, skill_sides, view
from .text_queries import _hd, _match, _norm


def headline_like(spark, sf_dir):
    return locate.headlines(view(spark, sf_dir, "resume_lines"))


def location_extract(spark, sf_dir):
    x = view(spark, sf_dir, "candidates").withColumn("line", F.when(F.col("cand_id") % 5 == 0, F.concat(F.lit("University of Pune, "), F.initcap("location"))).when(F.col("cand_id") % 5 == 1, F.lit("based in Berlin now")).otherwise(F.initcap("location")))
    return x.select("cand_id", locate.location(F.col("line")).alias("place"))


def section_split_graph(spark, sf_dir):
    lines = view(spark, sf_dir, "resume_lines").withColumn("is_bold", F.col("line_no") % 2 == 0).withColumn("size", F.lit(10.0)).withColumn("font_median", F.lit(10.0))
    marked = sections.match_headings(lines, sections.heading_dictionary(spark))
    return locate.strict_sections(marked).select("doc_id", "line_no", F.col("in_section").alias("section"))


def source_locator(spark, sf_dir):
    jobs = view(spark, sf_dir, "jobs").groupBy("cand_id").agg(F.min_by("title", "job_no").alias("title"), F.min_by("company", "job_no").alias("company"))
    values = jobs.select(F.col("cand_id").alias("doc_id"), F.lit("title").alias("field"), F.col("title").alias("value")).unionByName(jobs.select(F.col("cand_id").alias("doc_id"), F.lit("company").alias("field"), F.col("company").alias("value")))
    return locate.locate(values, view(spark, sf_dir, "resume_lines"))


def entry_groups(spark, sf_dir):
    return locate.entry_groups(view(spark, sf_dir, "resume_lines"), F.contains("line", F.lit(" at "))).select("doc_id", "line_no", "entry")


def skill_recall(spark, sf_dir):
    f = evaluation.set_f1(*skill_sides(view(spark, sf_dir, "raw_skills"), 5), "cand_id", "raw")
    return f.select("cand_id", "recall")


QUERIES = {f.__name__: f for f in (headline_like, location_extract, section_split_graph, source_locator, entry_groups, skill_recall)}

_tok = lambda c: f"list_distinct(list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda w: w <> ''))"
_cities = "|".join(locate.CITIES)
ORACLES = {
    "headline_like": oracle("resume_lines", "SELECT doc_id, arg_min(line, line_no) AS headline FROM resume_lines WHERE line_no BETWEEN 1 AND 7 AND len(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '')) BETWEEN 2 AND 12 AND NOT regexp_matches(line, '[0-9]|@|https?://|www\\.') GROUP BY 1"),
    "location_extract": oracle("candidates", f", x AS (SELECT cand_id, CASE WHEN cand_id % 5 = 0 THEN 'University of Pune, ' WHEN cand_id % 5 = 1 THEN 'based in Berlin now' ELSE array_to_string(list_transform(string_split(lower(location), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') END AS line FROM candidates) SELECT cand_id, CASE WHEN NOT regexp_matches(line, '(?i)university|college|institute|school|academy') THEN coalesce(nullif(regexp_extract(line, '\\b([A-Z][A-Za-z.]*(?: [A-Z][A-Za-z.]*){{0,2}}, ?[A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)?)\\b', 1), ''), nullif(regexp_extract(line, '\\b({_cities})\\b', 1), '')) END AS place FROM x"),
    "section_split_graph": oracle("resume_lines", f", {_hd}, {_norm}, {_match}, st AS (SELECT *, CASE WHEN line_no % 2 = 0 OR len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(line, '^[\\s•▪●\\-–—*#>]*(?:\\d{{1,2}}[.)]\\s*)?', ''), '[\\s:.\\-–—_|]+$', ''), '\\s+'), lambda w: w <> '')) <= 4 THEN section END AS own FROM ml), fl AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 'header') AS s FROM st) SELECT doc_id, line_no, s AS section FROM fl WHERE own IS NULL"),
    "source_locator": oracle("jobs resume_lines", f""", j AS (SELECT cand_id, arg_min(title, job_no) AS title, arg_min(company, job_no) AS company FROM jobs GROUP BY 1), v AS (SELECT cand_id AS doc_id, 'title' AS field, title AS value FROM j UNION ALL SELECT cand_id, 'company', company FROM j),
     x AS (SELECT doc_id, field, line_no, lower(trim(value)) AS a, lower(trim(line)) AS b FROM v JOIN resume_lines USING (doc_id)), y AS (SELECT doc_id, field, line_no, round(CASE WHEN a = b THEN 1 WHEN contains(a, b) OR contains(b, a) THEN least(length(a), length(b)) / greatest(length(a), length(b)) ELSE 2 * len(list_intersect({_tok('a')}, {_tok('b')})) / (len({_tok('a')}) + len({_tok('b')})) END, 6) AS s FROM x)
     SELECT doc_id, field, arg_max(line_no, (s, -line_no)) AS line_no, max(s) AS likeness FROM y GROUP BY 1, 2"""),
    "entry_groups": oracle("resume_lines", "SELECT doc_id, line_no, CAST(sum(CASE WHEN line_no > 1 AND contains(line, ' at ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS entry FROM resume_lines"),
    "skill_recall": oracle("raw_skills", ", t AS (SELECT DISTINCT cand_id, lower(trim(CASE WHEN pos % 3 = 0 THEN 'true ' || raw ELSE raw END)) AS v FROM raw_skills), f AS (SELECT DISTINCT cand_id, lower(trim(CASE WHEN pos % 5 = 0 THEN 'found ' || raw ELSE raw END)) AS v FROM raw_skills), g AS (SELECT coalesce(t.cand_id, f.cand_id) AS cand_id, count(t.v) AS nt, count(*) FILTER (WHERE t.v IS NOT NULL AND f.v IS NOT NULL) AS b FROM t FULL JOIN f ON t.cand_id = f.cand_id AND t.v = f.v GROUP BY 1) SELECT cand_id, CASE WHEN nt > 0 THEN round(b / nt, 6) ELSE 0 END AS recall FROM g"),
}
