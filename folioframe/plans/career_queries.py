"""Careers, dates, grades."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, grades
from ..operators import career
from . import assess_queries  # noqa: F401  (its views)
from .fixtures import AS_OF, oracle, view
from .sql_text import ranged

_JOBS = f"""closed AS (SELECT cand_id, job_no, company, title, start_date, CASE WHEN is_current OR end_date IS NULL THEN DATE '{AS_OF}' ELSE end_date END AS end_date FROM jobs)"""


def experience_years_union(spark, sf_dir):
    return career.experience(view(spark, sf_dir, "jobs"), AS_OF)


def career_gaps(spark, sf_dir):
    return career.career_gaps(view(spark, sf_dir, "jobs"), AS_OF)


def job_overlaps(spark, sf_dir):
    return career.job_overlaps(view(spark, sf_dir, "jobs"), AS_OF)


def career_level(spark, sf_dir):
    jobs = view(spark, sf_dir, "jobs")
    return career.career_level(jobs, career.experience(jobs, AS_OF))


def current_position(spark, sf_dir):
    return career.current_position(view(spark, sf_dir, "jobs"))


def notable_orgs(spark, sf_dir):
    return career.notable_jobs(view(spark, sf_dir, "jobs")).select("cand_id", "company").distinct()


def seniority_score(spark, sf_dir):
    jobs = view(spark, sf_dir, "jobs")
    return career.seniority(career.career_level(jobs, career.experience(jobs, AS_OF)), jobs)


def timeline_issues(spark, sf_dir):
    return career.timeline_issues(view(spark, sf_dir, "jobs"), view(spark, sf_dir, "degrees"), AS_OF)


def _job_texts(spark, sf_dir):
    skills = view(spark, sf_dir, "raw_skills").withColumnRenamed("raw", "text").select("cand_id", "text")
    return skills.unionByName(view(spark, sf_dir, "jobs").select("cand_id", F.col("title").alias("text"))).groupBy("cand_id").agg(F.concat_ws(" ", F.array_sort(F.collect_set("text"))).alias("text"))


def domain_scores(spark, sf_dir):
    return career.domain_scores(_job_texts(spark, sf_dir), "cand_id").select("cand_id", "domain", "score")


def primary_domain(spark, sf_dir):
    texts = _job_texts(spark, sf_dir)
    return career.primary_domain(career.domain_scores(texts, "cand_id"), texts, "cand_id")


def notable_universities(spark, sf_dir):
    return career.notable_universities(view(spark, sf_dir, "edu_entries")).select("cand_id", "institution").distinct()


def date_range_extract(spark, sf_dir):
    return view(spark, sf_dir, "range_texts").select("doc_id", dates.date_range(F.col("raw")).alias("r")).select("doc_id", "r.form", "r.start", "r.end", "r.is_current")


def date_parse_career(spark, sf_dir):
    x = view(spark, sf_dir, "range_texts").select("doc_id", dates.date_range(F.col("raw")).alias("r"))
    return x.select("doc_id", dates.approximate_date(F.col("r.start")).alias("career_start"), dates.approximate_date(F.col("r.start"), 6).alias("timeline_start"))


def has_date(spark, sf_dir):
    return view(spark, sf_dir, "range_texts").select("doc_id", F.col("raw").rlike(f"(?i){dates.MY4}|{dates.SLASH}|{dates.MY2}|{dates.YEAR}").alias("has_date"), F.nullif(F.regexp_extract("raw", r"(?:19|20)\d{2}", 0), F.lit("")).alias("year"))


def grade_normalize(spark, sf_dir):
    return view(spark, sf_dir, "degrees").select("cand_id", grades.normalize_grade(F.col("grade")).alias("g")).select("cand_id", "g.*")


QUERIES = {f.__name__: f for f in (experience_years_union, career_gaps, job_overlaps, career_level, current_position, notable_orgs, seniority_score, timeline_issues, domain_scores, primary_domain, notable_universities, date_range_extract, date_parse_career, has_date, grade_normalize)}

_level_case = "CASE " + " ".join(f"WHEN regexp_matches(lower(title), '{p}') THEN '{n}'" for n, p in career.LEVELS) + " END"
_years = """spans AS (SELECT cand_id, start_date AS s, end_date AS e, max(end_date) OVER (PARTITION BY cand_id ORDER BY start_date, end_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM closed WHERE end_date >= start_date),
 islands AS (SELECT cand_id, s, e, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY cand_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM spans),
 years AS (SELECT cand_id, CAST(sum(d) AS BIGINT) AS days, round(CAST(sum(d) AS DOUBLE) / 365.25, 1) AS years FROM (SELECT cand_id, g, max(e) - min(s) AS d FROM islands GROUP BY cand_id, g) GROUP BY cand_id)"""
_levels = f"""levels AS (SELECT y.cand_id, y.years, coalesce(t.lvl, CASE {' '.join(f"WHEN years >= {b} THEN '{n}'" for b, n in career.YEARS)} ELSE '{career.FRESHER}' END) AS level
 FROM years y LEFT JOIN (SELECT cand_id, arg_min(lvl, job_no) AS lvl FROM (SELECT cand_id, job_no, {_level_case} AS lvl FROM jobs) WHERE lvl IS NOT NULL GROUP BY cand_id) t USING (cand_id))"""
_notable = " OR ".join(f"contains(lower(company), '{n}')" for n in career.NOTABLE)
_overlap = """SELECT a.cand_id, a.job_no AS job_a, b.job_no AS job_b, CAST(least(a.end_date, b.end_date) - greatest(a.start_date, b.start_date) AS BIGINT) AS overlap_days FROM closed a JOIN closed b ON a.cand_id = b.cand_id AND a.job_no < b.job_no
 WHERE least(a.end_date, b.end_date) - greatest(a.start_date, b.start_date) > 90"""
_texts = "texts AS (SELECT cand_id, lower(string_agg(t, ' ' ORDER BY t)) AS t FROM (SELECT DISTINCT cand_id, t FROM (SELECT cand_id, raw AS t FROM raw_skills UNION ALL SELECT cand_id, title FROM jobs)) GROUP BY cand_id)"
_domains = "doms AS (" + " UNION ALL ".join(f"SELECT cand_id, '{d}' AS domain, {i} AS o, round(({' + '.join(f'contains(t, {chr(39)}{w}{chr(39)})::INT' for w in ws)}) / {len(ws)}, 6) AS score FROM texts" for i, (d, ws) in enumerate(career.DOMAINS.items())) + ")"
_MON = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_ranges_sql = f"{ranged('range_texts', 'raw', 'x')}"
_steps = lambda v, ladder, least: "CASE " + " ".join(f"WHEN {v} >= {a} THEN {b}" for a, b in ladder) + f" ELSE {least} END"
_ten, _four = "least(greatest(v, 0), 10)", "least(greatest(v, 0), 4)"

ORACLES = {
    "experience_years_union": oracle("jobs", f", {_JOBS}, {_years} SELECT cand_id, days, years FROM years"),
    "career_gaps": oracle("jobs", f", {_JOBS}, l AS (SELECT cand_id, company, start_date - lag(end_date) OVER w AS d, lag(company) OVER w AS p FROM closed WINDOW w AS (PARTITION BY cand_id ORDER BY start_date, job_no)) SELECT cand_id, p AS after_company, company AS before_company, CAST(d AS BIGINT) AS gap_days, round(CAST(d AS DOUBLE) / 30.4, 1) AS gap_months FROM l WHERE d > 90"),
    "job_overlaps": oracle("jobs", f", {_JOBS} {_overlap}"),
    "career_level": oracle("jobs", f", {_JOBS}, {_years}, {_levels} SELECT cand_id, years, level FROM levels"),
    "current_position": oracle("jobs", "SELECT cand_id, arg_min(title, (NOT is_current, job_no)) AS title, arg_min(company, (NOT is_current, job_no)) AS company FROM jobs GROUP BY cand_id"),
    "notable_orgs": oracle("jobs", f"SELECT DISTINCT cand_id, company FROM jobs WHERE {_notable}"),
    "seniority_score": oracle("jobs", f""", {_JOBS}, {_years}, {_levels}, n AS (SELECT cand_id, bool_or(regexp_matches(lower(title), '{career.MANAGEMENT}')) AS m, count(DISTINCT CASE WHEN {_notable} THEN company END) AS k FROM jobs GROUP BY cand_id)
     SELECT cand_id, m AS has_management, CAST(k AS BIGINT) AS notable_count, level IN ('{career.FRESHER}', '{career.JUNIOR}') AND years < 1 AS is_fresher, round(least(years / 20, CAST(0.5 AS DOUBLE)) + CASE level {' '.join(f"WHEN '{n}' THEN CAST({p} AS DOUBLE)" for n, p in career.LEVEL_POINTS.items())} END + least(k * CAST(0.05 AS DOUBLE), CAST(0.15 AS DOUBLE)) + CASE WHEN m THEN CAST(0.05 AS DOUBLE) ELSE 0 END, 3) AS seniority FROM levels JOIN n USING (cand_id)"""),
    "timeline_issues": oracle("jobs degrees", f""", {_JOBS}, j AS (SELECT *, CASE WHEN is_current THEN DATE '{AS_OF}' ELSE end_date END AS e FROM jobs), edu AS (SELECT cand_id, max(end_date) AS g FROM degrees GROUP BY cand_id), o AS ({_overlap})
     SELECT cand_id, 'end_before_start' AS rule, 'ERROR' AS severity, job_no FROM j WHERE e < start_date UNION ALL SELECT cand_id, 'start_too_early', 'ERROR', job_no FROM j WHERE year(start_date) < 1950
     UNION ALL SELECT cand_id, 'start_in_future', 'ERROR', job_no FROM j WHERE year(start_date) > 2026 UNION ALL SELECT cand_id, 'end_in_future', 'ERROR', job_no FROM j WHERE NOT is_current AND year(e) > 2026
     UNION ALL SELECT cand_id, 'long_tenure', 'WARNING', job_no FROM j WHERE e >= start_date AND (e - start_date) / 365.25 > 25
     UNION ALL SELECT cand_id, 'before_graduation', 'WARNING', job_no FROM j JOIN edu USING (cand_id) WHERE e >= start_date AND start_date < g - 365 AND NOT contains(lower(title), 'intern')
     UNION ALL SELECT cand_id, 'overlap', 'INFO', job_a FROM o"""),
    "domain_scores": oracle("jobs raw_skills", f", {_texts}, {_domains} SELECT cand_id, domain, score FROM doms WHERE score > 0"),
    "primary_domain": oracle("jobs raw_skills", f", {_texts}, {_domains}, b AS (SELECT cand_id, arg_max(domain, (score, -o)) AS domain, max(score) AS score FROM doms WHERE score > 0 GROUP BY cand_id) SELECT cand_id, coalesce(domain, '{career.GENERAL}') AS domain, coalesce(score, CAST(0 AS DOUBLE)) AS score FROM texts LEFT JOIN b USING (cand_id)"),
    "notable_universities": oracle("edu_entries", "SELECT DISTINCT cand_id, institution FROM edu_entries WHERE regexp_matches(lower(institution), '\\b(" + "|".join(u for u in career.UNIVERSITIES if len(u) <= 4) + ")\\b') OR " + " OR ".join(f"contains(lower(institution), '{u}')" for u in career.UNIVERSITIES if len(u) > 4)),
    "date_range_extract": oracle("range_texts", f', {_ranges_sql} SELECT doc_id, form, start, "end", cur AS is_current FROM x'),
    "date_parse_career": oracle("range_texts", f""", {_ranges_sql} SELECT doc_id, CASE WHEN length(start) = 4 THEN CAST(start || '-01-01' AS DATE) ELSE CAST(strptime('1 ' || start, '%d %b %Y') AS DATE) END AS career_start,
     CASE WHEN length(start) = 4 THEN CAST(start || '-06-01' AS DATE) ELSE CAST(strptime('1 ' || start, '%d %b %Y') AS DATE) END AS timeline_start FROM x"""),
    "has_date": oracle("range_texts", f"SELECT doc_id, regexp_matches(raw, '(?i){_MON},?\\s+\\d{{4}}|(?:0?[1-9]|1[0-2])/\\d{{4}}|{_MON}[''’`]\\d{{2}}|\\b20\\d{{2}}\\b') AS has_date, nullif(regexp_extract(raw, '(?:19|20)[0-9][0-9]'), '') AS year FROM range_texts"),
    "grade_normalize": oracle("degrees", f""", g AS (SELECT cand_id, grade, CASE WHEN grade LIKE '%/10' THEN 'cgpa_10' WHEN grade LIKE '%/4' THEN 'gpa_4' WHEN grade LIKE '%/500' OR grade LIKE '%!%' ESCAPE '!' THEN 'percentage' WHEN grade IN ('A+', 'b-') THEN 'letter' WHEN grade IN ('First Class', 'Pass') THEN 'class'
      WHEN grade IN ('3.2', 'GPA: 3.95') THEN 'gpa_4' WHEN grade IN ('7.9', 'CGPA: 9') THEN 'cgpa_10' ELSE 'unknown' END AS scale,
      CASE grade WHEN '8.4/10' THEN CAST(8.4 AS DOUBLE) WHEN '3.6/4' THEN 3.6 WHEN '87%' THEN 87 WHEN 'A+' THEN 96 WHEN 'First Class' THEN 72.5 WHEN '7.9' THEN 7.9 WHEN '3.2' THEN 3.2 WHEN '450/500' THEN 90 WHEN 'CGPA: 9' THEN 9 WHEN 'Pass' THEN 45 WHEN 'b-' THEN 72.5 WHEN 'GPA: 3.95' THEN 3.95 END AS v FROM degrees),
      p AS (SELECT *, CASE scale WHEN 'cgpa_10' THEN round(least({_ten} * CAST(9.5 AS DOUBLE), 100), 1) WHEN 'gpa_4' THEN {_steps(_four, grades.FOUR_TO_PERCENT, 50)} WHEN 'unknown' THEN NULL ELSE v END AS pct FROM g)
      SELECT cand_id, scale, CAST(round(pct, 1) AS DOUBLE) AS percentage, CAST(CASE WHEN scale = 'gpa_4' THEN round({_four}, 2) WHEN scale <> 'unknown' THEN {_steps('pct', grades.PERCENT_TO_FOUR, 0)} END AS DOUBLE) AS gpa_4,
      CAST(CASE WHEN scale = 'cgpa_10' THEN round({_ten}, 2) WHEN scale <> 'unknown' THEN round(least(pct / 9.5, 10), 2) END AS DOUBLE) AS cgpa_10 FROM p""").replace("grade LIKE '%!%' ESCAPE '!'", "contains(grade, '%')"),
}
