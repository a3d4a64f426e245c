"""Résumé-shaped tables derived from the star schema, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-06-30"
_pick = lambda names, n: f"split_part('{'¦'.join(names)}', '¦', CAST(({n}) % {len(names)} AS INT) + 1)"

FIRST = ("Ana", "Ben", "Chloe", "Dev", "Elena", "Farid", "Grace")
LAST = ("Silva", "Okafor", "Novak", "Rao", "Lindqvist")
COMPANIES = ("Northwind Labs", "Google India", "Oracle Systems", "Contoso Ltd", "Fabrikam", "Intel Group", "Initech", "Zoho Corp", "Hooli Technologies")
TITLES = ("Software Engineer", "Senior Engineer", "Data Analyst", "Engineering Manager", "Intern", "Principal Architect", "Associate Consultant", "Developer", "Director of Data", "Machine Learning Engineer", "Backend Developer")
RAW_SKILLS = ("python 3", "React (Advanced)", "k8s", "Languages: Go", "scikit-learn", "websocket", "PostgreSQL", "C++", "docker (basic)", "apache spark", "SAP ABAP", "rest api", "team work", "Machine Learning", "aws", "postgre sql", "node.js", "ETL design", "HTML5", "pyspark", "Machine Learnings", "JavaScripts", "my postgresql")
HEADINGS = ("WORK EXPERIENCE:", "1. Education", "TechnicalSkills", "Éducation", "certifications", "activities", "Projects -", "about me", "Honors & Awards", "work experience history", "skills core")
RANGES = ("Jan 2020 – Present", "Jan-Mar 2021", "2019-21", "Jan''19 - Feb''20", "03/2020 to 05/2021", "Engineer since 2020", "from May 2019 to Present", "2020 till date", "Class of 1998", "Sept 2018 to June 2019, Pune", "Acme 2016 - 2018", "12/2021", "no date here")
GRADES = ("8.4/10", "3.6/4", "87%", "A+", "First Class", "7.9", "3.2", "450/500", "CGPA: 9", ".", "", "Pass", "b-", "GPA: 3.95", "101")
BULLETS = ("Built pipelines that cut cost by 30% across five teams and regions", "Responsible for reports", "Reduced latency from 40 ms to 12 ms for search", "worked on things", "Designed APIs used by 2 million users every single day", "• Led a team of 6", "Improved tests", "Migrated 12 services to containers without any downtime for customers", "helped", "attended meetings with the client team on Mondays and Fridays")
URLS = ("https://linkedin.com/in/ana-silva", "github.com/dev42", "", "http://bad host", "https://example.org/portfolio", "https://www.kaggle.com/x", "https://gitlab.com/me", "https://linkedin.com/in/ana-silva", "not-a-url")
EDUCATION = ("B.Tech in Computer Science", "Indian Institute of Technology", "CGPA: 8.4/10", "2016 - 2020", "Delhi Public School", "12th, CBSE 2014", "Pune", "92 %", "M.Sc Physics 2021", "University of Pune, Master of Arts", "8.1 CGPA", "Class of champions", "Aug 2012 – May 2014")
PROJECTS = ("Travel Planner - Python, React", "Chess Engine 2021 - 2022", "• Built an engine that plays 2 million games a day.", "Tech Stack: MQTT, pandas", "Live: https://chess.example.org", "• Weather Board", "Python, React, Node", "Jan 2023 - Mar 2023", "runs in a cupboard and hums all day.", "• reads github.com/ana/board every hour", "Home Lab")
LABELS = ("LinkedIn", "GitHub", "Portfolio", "LinkedIn", "Portfolio", "Kaggle", "GitHub")
MAILS = ("gmial.com", "gmail.com", "outlok.com", "example.org", "yahoo.co", "hotmail.com", "acme.io", "g-mail.com", "protonmial.com", "live.co", "liv.com", "googlmail.com", "icloud.org", "hotmale.com", "rediff.com", "mail.com", "outlook.co.uk")

VIEWS = {
    "candidates": f"""SELECT c_custkey AS cand_id, concat({_pick(FIRST, 'c_custkey')}, ' ', {_pick(LAST, 'c_custkey')}) AS name,
        lower(concat({_pick(FIRST, 'c_custkey')}, '.', CAST(c_custkey AS STRING), '@', {_pick(MAILS, 'c_custkey')})) AS email,
        CASE WHEN c_custkey % 4 = 0 THEN '12345' ELSE concat('+91 9', CAST(100000000 + c_custkey AS STRING)) END AS phone,
        CASE WHEN c_custkey % 3 = 0 THEN n_name ELSE concat(n_name, ', ', r_name) END AS location
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "jobs": f"""SELECT o_custkey AS cand_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS job_no,
        {_pick(COMPANIES, 'o_orderkey')} AS company, {_pick(TITLES, 'o_orderkey')} AS title, CAST(o_orderdate AS DATE) AS start_date,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey * 7 % 900 - 20 AS INT) END AS end_date, o_orderkey % 5 = 0 AS is_current FROM orders""",
    "degrees": f"""SELECT c_custkey AS cand_id, {_pick(GRADES, 'c_custkey')} AS grade, concat('Institute ', CAST(c_custkey % 20 AS STRING)) AS institution,
        CAST('1996-05-01' AS DATE) + CAST(c_custkey % 3000 AS INT) AS end_date FROM customer""",
    "raw_skills": f"""SELECT o_custkey AS cand_id, o_orderkey AS pos, {_pick(RAW_SKILLS, 'o_orderkey')} AS raw FROM orders""",
    "resume_lines": f"""SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS line_no,
        CASE WHEN o_orderkey % 4 = 0 THEN {_pick(HEADINGS, 'o_orderkey')} WHEN o_orderkey % 7 = 0 THEN concat('• ', {_pick(BULLETS, 'o_orderkey')})
        ELSE concat({_pick(TITLES, 'o_orderkey')}, ' at ', {_pick(COMPANIES, 'o_orderkey')}, ' 2019 - 2021 with python and sql') END AS line FROM orders""",
    "education_lines": f"""SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS line_no, {_pick(EDUCATION, 'o_orderkey')} AS line FROM orders""",
    "project_lines": f"""SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS line_no, {_pick(PROJECTS, 'o_orderkey')} AS line FROM orders""",
    "range_texts": f"""SELECT o_orderkey AS doc_id, concat('Role, ', {_pick(RANGES, 'o_orderkey')}) AS raw FROM orders""",
    "bullets": f"""SELECT o_custkey AS cand_id, o_orderkey AS bullet_no, {_pick(BULLETS, 'o_orderkey')} AS bullet FROM orders""",
    "links": f"""SELECT o_custkey AS doc_id, o_orderkey AS pos, {_pick(LABELS, 'o_orderkey')} AS label, {_pick(URLS, 'o_orderkey')} AS url FROM orders""",
    "strategies": """SELECT c_custkey AS doc_id, s AS strategy, CAST(o AS BIGINT) AS ord,
        CASE WHEN (c_custkey + o) % 4 = 0 THEN '' WHEN o = 1 THEN upper(c_name) ELSE concat('Ana ', c_mktsegment) END AS name,
        CASE WHEN (c_custkey + o) % 3 = 0 THEN '' ELSE concat('user', CAST(c_custkey AS STRING), '@example.com') END AS email,
        CASE WHEN (c_custkey + o) % 5 = 0 THEN '' ELSE '+1 555 010 0199' END AS phone,
        CASE WHEN o = 2 THEN 'Pune, India' ELSE 'Pune' END AS location, CAST((c_custkey * 3 + o * 5) % 30 AS BIGINT) AS skill_count,
        CAST((c_custkey + o) % 5 AS BIGINT) AS job_count, CAST((c_custkey + o) % 5 % 3 AS BIGINT) AS dated_jobs, CAST((c_custkey + 2 * o) % 4 AS BIGINT) AS degree_count,
        CASE WHEN (c_custkey + o) % 2 = 0 THEN 'Seasoned engineer' ELSE '' END AS summary
        FROM customer CROSS JOIN (SELECT 'text_lines' AS s, 0 AS o UNION ALL SELECT 'geometry', 1 UNION ALL SELECT 'adaptive', 2) z""",
    "words_geom": """SELECT l_suppkey AS doc_id, CAST(l_linenumber AS BIGINT) AS page, l_orderkey * 10 + l_linenumber AS word_no, CAST(l_orderkey % 60 AS BIGINT) AS line_no,
        CAST(CASE WHEN l_suppkey % 3 = 0 THEN 40 + (l_orderkey * 37) % 480 WHEN l_partkey % 2 = 0 THEN 40 + (l_orderkey * 37) % 170 ELSE 330 + (l_orderkey * 37) % 170 END AS DOUBLE) AS x0,
        CAST(CASE WHEN l_suppkey % 3 = 0 THEN 40 + (l_orderkey * 37) % 480 WHEN l_partkey % 2 = 0 THEN 40 + (l_orderkey * 37) % 170 ELSE 330 + (l_orderkey * 37) % 170 END + 20 + l_quantity AS DOUBLE) AS x1,
        CAST((l_orderkey * 13) % 760 AS DOUBLE) AS top, CAST((l_orderkey * 13) % 760 + 11 AS DOUBLE) AS bottom, CAST(8 + l_quantity % 7 AS DOUBLE) AS size,
        CASE WHEN l_returnflag = 'R' THEN 'Arial-Bold' ELSE 'Arial' END AS font FROM lineitem""",
    "truth_pairs": f"""SELECT o_orderkey AS doc_id, {_pick(TITLES, 'o_orderkey')} AS truth, {_pick(TITLES, 'o_orderkey * 3 + o_custkey')} AS found FROM orders""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name].replace("{", "{{").replace("}", "}}")
    # undated jobs are numbered last, as DuckDB sorts nulls
    sql = sql.replace("ORDER BY o_orderdate, o_orderkey", "ORDER BY o_orderdate NULLS LAST, o_orderkey NULLS LAST")
    tables = [t for t in ("customer", "nation", "region", "orders", "lineitem", "part", "supplier") if f" {t}" in sql]
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def skill_sides(x: DataFrame, every: int) -> tuple[DataFrame, DataFrame]:
    """All skills as truth and as found, where every third is known to the first alone and every so many to the second."""
    own = lambda n, side: x.withColumn("raw", F.when(F.col("pos") % n == 0, F.concat(F.lit(f"{side} "), "raw")).otherwise(F.col("raw")))
    return own(3, "true"), own(every, "found")


def oracle(names: str, sql: str) -> str:
    """sql for DuckDB after the views it names."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names.split()) + " " + sql
