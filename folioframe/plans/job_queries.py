"""Skills sections, job states from events, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sections, skill_sections as ss
from ..streaming import jobs
from .fixtures import VIEWS, _pick, oracle, view
from .sql_text import has, quoted
from .text_queries import _fuzzy_values, _hd, norm_of

SKILL_LINES = (
    "Languages: Python, Java (Advanced), C++", "Python   Java   SQL   Go", "Docker | Kubernetes • AWS", "Frameworks: React, Node.js Databases: MySQL, Redis", "Tools:", "", "Communication, Teamwork, Git", "React (2+ Years), Vue - Expert, 2021",
    "GPA: 8.5", "Hill College", "B.Tech in Physics", "Ability to lead people", "Technical Skills", "MongoDB (Certified Associate Developer)", "me@x.example, github.com/x/y", "•Linux", "Apr 2020, 2019 - present", "SCHOLASTIC / CO-SCHOLASTIC ACHIEVEMENTS",
    "AI / ML / NLP TOPICS, python", "Skills: Excel, Power BI", "12345, Rust less than 3 years", "core  competencies of the whole team and of all of its many members, Perl", "Backend: Go Backend/Tools: Kafka", "Cloud : AWS, GCP",
)
VIEWS |= {
    "skill_lines": f"SELECT o_custkey AS doc_id, o_orderkey AS line_no, {_pick(SKILL_LINES, 'o_orderkey * 5 + o_custkey')} AS line FROM orders",
}


def section_skills(spark, sf_dir):
    return ss.section_skills(view(spark, sf_dir, "skill_lines"), sections.heading_dictionary(spark), sections.fuzzy_dictionary(spark))


_JOBS = """SELECT event_id - event_id % 4 AS job_id, ts, CASE event_id % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'PROCESSING' WHEN 2 THEN CASE WHEN user_id % 3 = 0 THEN 'FAILURE' WHEN user_id % 3 = 1 THEN 'SUCCESS' ELSE 'PROCESSING' END
 ELSE CASE WHEN user_id % 5 = 0 THEN 'SUCCESS' WHEN user_id % 5 = 1 THEN 'PENDING' ELSE event_type END END AS state FROM {events}"""


def job_events(spark, sf_dir):
    return spark.sql(_JOBS, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def job_states(spark, sf_dir):
    events = job_events(spark, sf_dir)
    last = events.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
    return jobs.folded(events, last).select("job_id", "state", F.date_format("since", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("since"), "events")


QUERIES = {f.__name__: f for f in (section_skills, job_states)}

_strip = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_filled = lambda items: f"list_filter(list_transform({items}, lambda x: {_strip('x')}), lambda x: x <> '')"
# the label before which a space is a bar takes the space along here, as this engine's patterns have no look-ahead
_label = ss.EMBEDDED_LABEL.replace("(?=", "(", 1)


def _clean(item: str) -> str:
    t = f"trim(trim(regexp_replace({item}, '\\s+', ' ', 'g')), '•-–—*·◦►▸')"
    for pattern, instead in ss.CLEANED:
        t = f"regexp_replace({t}, {quoted(pattern)}, '{instead}', 'g')"
        if instead == "" and "Years" not in pattern:
            t = f"trim({t})"
    return f"trim({t})"


_none = " OR ".join(
    [f"list_contains([{', '.join(map(quoted, ss.SOFT))}], low)", "regexp_matches(skill, '^[0-9]+$')", *[f"starts_with(low, '{o}')" for o in ss.OPENINGS], *[has("skill", p) for p in ss.CONTACTS], *[has("low", p.replace("class x(?!ii)|", "class x|")) for p in ss.NO_SKILL]]
    + ["(contains(skill, '/') AND len(string_split(skill, ' ')) >= 3 AND len(list_filter(string_split(skill, ' '), lambda w: w = upper(w) AND w <> lower(w))) >= 2)"]
)
ORACLES = {
    "section_skills": oracle("skill_lines", f""", {_hd}, fz(tokens, section) AS (VALUES {_fuzzy_values()}), l0 AS (SELECT doc_id, line_no, {_strip('line')} AS line FROM skill_lines WHERE {_strip('line')} <> ''),
     l1 AS (SELECT *, {_strip(f"regexp_replace(regexp_replace(regexp_replace(line, {quoted(_label)}, ' | \\1', 'g'), {quoted(ss.LABEL_BEFORE)}, ''), {quoted(ss.LEVEL_BEFORE)}, '')")} AS t FROM l0), l2 AS (SELECT *, {_filled("string_split_regex(t, '\\t+|   +')")} AS cells FROM l1),
     l3 AS (SELECT doc_id, line_no, CASE WHEN t = '' THEN CAST([] AS VARCHAR[]) WHEN (contains(t, chr(9)) OR len(string_split_regex(t, '   +')) > 2) AND len(cells) >= 2 AND len(list_filter(cells, lambda c: length(c) > 40)) = 0 THEN cells
      WHEN regexp_matches(t, '[|{ss.SIGNS}]') THEN {_filled(f"string_split_regex(t, '[|{ss.SIGNS}]')")} WHEN contains(t, ',') THEN {_filled("string_split(t, ',')")} ELSE [t] END AS items FROM l2),
     l4 AS (SELECT doc_id, line_no, unnest(range(len(items))) AS no, unnest(items) AS item FROM l3), l5 AS (SELECT *, {_clean('item')} AS skill FROM l4), l6 AS (SELECT *, lower(skill) AS low, {norm_of('skill')} AS norm FROM l5 WHERE length(skill) BETWEEN 1 AND 60),
     l7 AS (SELECT * FROM l6 WHERE NOT ({_none}) AND NOT (len(list_filter(string_split_regex(skill, '\\s+'), lambda w: w <> '')) <= 7 AND (norm IN (SELECT hd.norm FROM hd) OR replace(norm, ' ', '') IN (SELECT hd.norm FROM hd)))
      AND array_to_string(list_sort(list_distinct(list_filter(string_split(norm, ' '), lambda w: length(w) > 2))), ' ') NOT IN (SELECT tokens FROM fz)),
     l8 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, low ORDER BY line_no, no) AS n FROM l7) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no, no) AS INT) AS rank, skill FROM l8 WHERE n = 1"""),
    "job_states": f"""WITH j AS ({_JOBS.format(events='events')}), r AS (SELECT *, list_position(['PENDING', 'PROCESSING', 'SUCCESS', 'FAILURE'], state) AS k FROM j), s AS (SELECT * FROM r WHERE k > 0),
     o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY k > 2 DESC, CASE WHEN k > 2 THEN ts END, CASE WHEN k > 2 THEN k ELSE -k END, ts) AS n, count(*) OVER (PARTITION BY job_id) AS events, (SELECT max(ts) FROM j) AS last FROM s)
     SELECT job_id, CASE WHEN k > 2 AND last - ts >= INTERVAL 1 HOUR THEN 'EXPIRED' ELSE state END AS state, strftime(CASE WHEN k > 2 AND last - ts >= INTERVAL 1 HOUR THEN ts + INTERVAL 1 HOUR ELSE ts END, '%Y-%m-%d %H:%M:%S.%f') AS since, events FROM o WHERE n = 1""",
}
