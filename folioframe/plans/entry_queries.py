"""Entries of sections; ordered folds with no plain SQL are tested on small cases instead."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entries, sections
from .fixtures import oracle, view
from .text_queries import FILL


def experience_bundles(spark, sf_dir):
    lines = entries.ordered("doc_id", view(spark, sf_dir, "resume_lines"))
    return lines.select("doc_id", F.posexplode(entries.experience_bundles(F.col("lines"))).alias("entry", "e")).select("doc_id", "entry", F.size("e.headers").alias("headers"), F.size("e.bullets").alias("bullets"))


def section_summary(spark, sf_dir):
    """Summaries of all lines under summary headings; documents without such lines have no row."""
    marked = sections.match_headings(view(spark, sf_dir, "resume_lines"), sections.heading_dictionary(spark))
    return entries.ordered("doc_id", sections.fill_sections(marked).filter("in_section = 'summary'")).select("doc_id", entries.summary(F.col("lines")).alias("summary"))


def project_technologies(spark, sf_dir):
    return view(spark, sf_dir, "resume_lines").select("doc_id", "line_no", F.array_join(entries.technologies(F.col("line")), ",").alias("technologies"))


def certification_parse(spark, sf_dir):
    x = view(spark, sf_dir, "jobs").select("cand_id", "job_no", F.concat(F.lit("Certified "), "title", F.when(F.col("job_no") % 3 == 0, F.concat(F.lit(" by "), "company")).when(F.col("job_no") % 3 == 1, F.concat(F.lit(" ("), "company", F.lit(")"))).otherwise(F.lit("")), F.lit(" 2019")).alias("line"))
    return x.select("cand_id", "job_no", entries.certification(F.col("line")).alias("c")).select("cand_id", "job_no", "c.name", "c.issuer", "c.year")


def simple_list(spark, sf_dir):
    x = entries.ordered("cand_id", view(spark, sf_dir, "raw_skills"), "pos", "raw")
    return x.select("cand_id", F.posexplode(entries.simple_list(F.col("lines"))).alias("place", "item")).select("cand_id", F.col("place").cast("bigint").alias("place"), "item")


QUERIES = {f.__name__: f for f in (experience_bundles, section_summary, project_technologies, certification_parse, simple_list)}
ORACLES = {
    "section_summary": oracle("resume_lines", FILL + r", s AS (SELECT doc_id, trim(regexp_replace(string_agg(regexp_replace(line, '^\s*[•▪●►▸\-–—*]+\s*', ''), ' ' ORDER BY line_no), '\s+', ' ', 'g')) AS t FROM fl JOIN resume_lines USING (doc_id, line_no) WHERE own IS NULL AND section = 'summary' GROUP BY 1), u AS (SELECT doc_id, regexp_replace(t, '(?i)^(?:objective|summary|profile|about me)\s*[:\-–]\s*', '') AS t FROM s) SELECT doc_id, CASE WHEN length(t) >= 15 THEN t END AS summary FROM u"),
    "project_technologies": oracle("resume_lines", "SELECT doc_id, line_no, CASE WHEN contains(line, 'with python and sql') THEN 'Python,SQL' || CASE WHEN line LIKE 'Machine Learning%' THEN ',Machine Learning' ELSE '' END ELSE '' END AS technologies FROM resume_lines"),
    "certification_parse": oracle("jobs", "SELECT cand_id, job_no, 'Certified ' || title AS name, CASE WHEN job_no % 3 <= 1 THEN company END AS issuer, '2019' AS year FROM jobs"),
    "simple_list": oracle("raw_skills", ", v AS (SELECT cand_id, arg_min(raw, pos) AS item, min(pos) AS p FROM raw_skills GROUP BY cand_id, lower(raw)) SELECT cand_id, row_number() OVER (PARTITION BY cand_id ORDER BY p) - 1 AS place, item FROM v"),
}
