"""Field parsers over whole sections; their ordered folds have no plain SQL and are tested against lists instead."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entries, locate, parsers, sections
from .education_queries import GROUPS_ORACLE
from .fixtures import oracle, view


def education_groups(spark, sf_dir):
    return parsers.education_groups(view(spark, sf_dir, "education_lines"))


def experience_entries(spark, sf_dir):
    return parsers.experience_entries(view(spark, sf_dir, "resume_lines"))


def project_blocks(spark, sf_dir):
    return parsers.project_blocks(view(spark, sf_dir, "project_lines"), sections.heading_dictionary(spark))


def implied_skills(spark, sf_dir):
    known = entries.ordered("cand_id", view(spark, sf_dir, "raw_skills"), "pos", "raw").withColumnRenamed("lines", "known")
    told = entries.ordered("doc_id", view(spark, sf_dir, "resume_lines")).select(F.col("doc_id").alias("cand_id"), "lines")
    return known.join(told, "cand_id").select("cand_id", F.array_join(parsers.implied_skills(F.col("known"), F.col("lines")), ",").alias("skills"))


def _placed(spark, sf_dir):
    """Lines as a layout reader gives them: twelve to a page, in blocks of three."""
    n = F.col("line_no") - 1
    x = view(spark, sf_dir, "resume_lines").withColumn("page", F.floor(n / 12)).withColumn("block", F.floor(n % 12 / 3)).withColumn("top", (n % 12) * 60.0).withColumn("height", F.lit(792.0))
    return sections.match_headings(x, sections.heading_dictionary(spark))


def section_split_states(spark, sf_dir):
    return locate.state_sections(_placed(spark, sf_dir)).select("doc_id", "line_no", F.col("in_section").alias("section"))


def section_split_blocks(spark, sf_dir):
    return locate.block_sections(_placed(spark, sf_dir)).select("doc_id", "line_no", F.col("in_section").alias("section"))


QUERIES = {f.__name__: f for f in (education_groups, experience_entries, project_blocks, implied_skills, section_split_states, section_split_blocks)}
# a word boundary behind "java" leaves no room for "script", so the SQL needs no look-ahead
_named = ", ".join(f"CASE WHEN regexp_matches(text, '{pattern.replace('(?!script)', '')}') THEN '{name}' END" for name, pattern in parsers.BULLET_TECH.items())
_flat = "regexp_replace(lower(trim({})), '[.\\-_\\s]+', '', 'g')"
ORACLES = {
    "education_groups": GROUPS_ORACLE,
    "implied_skills": oracle("raw_skills resume_lines", f""", k AS (SELECT cand_id, list(raw ORDER BY pos) AS known FROM raw_skills GROUP BY 1), t AS (SELECT doc_id AS cand_id, lower(string_agg(line, ' ' ORDER BY line_no)) AS text FROM resume_lines GROUP BY 1),
     f AS (SELECT cand_id, known, list_transform(known, lambda s: lower(trim(s))) AS has, list_transform(known, lambda s: {_flat.format('s')}) AS short, list_filter([{_named}], lambda s: s IS NOT NULL) AS found FROM k JOIN t USING (cand_id))
     SELECT cand_id, array_to_string(list_concat(known, list_filter(found, lambda s: NOT list_contains(has, lower(s)) AND NOT list_contains(short, {_flat.format('s')}))), ',') AS skills FROM f"""),
}
