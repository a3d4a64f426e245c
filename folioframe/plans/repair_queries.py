"""Repairs across sections as queries over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reconcile as rc
from .assess_queries import _form, _tidy
from .fixtures import VIEWS, _pick, oracle, view
from .profile_queries import _sk
from .signature_sql import signed

FIRMS = ("Northwind Labs", "Contoso Ltd", "", "Initech Systems", "Hooli Technologies Pvt", "University of Pune", "B.Sc Physics", "Weather Station App", "Hill  College ,")
ROLES = ("Data Engineer", "Intern", "", "Analyst Jan 2019 - Mar 2021", "MBA, CGPA: 8.1", "Senior Developer", "built a dashboard platform")
PLACES = ("Pune", "", "Remote", "Bachelor of Arts 2014")
POINTS = (
    "• Built a pipeline; • Led a team of five; • built a pipeline", "", "• Deployed an api tool; see https://a.example", "GPA: 8.2; Diploma 2012", "Jan 2020 - Present; • Cut costs; • Wrote tests", "• Designed a website framework with python; • Integrated the bot", "first prize",
)
WORKS = ("1. Weather Station", "Chess Engine", "", "Route planner", "2) Notes app", "B.Tech University project", "Data Engineer at Contoso Ltd")
TALES = ("Built and deployed an app with python", "Bachelor of Science, CGPA 8.4, university college 2016", "", "Senior developer and intern lead 2019 - 2021", "a tool for all", "Created, designed and automated the platform; a website")
STACKS = ("Python; python; SQL", "", "React; Node.js", "GPA: 9; school", "Go")
STARTS = ("Jan 2020", "", "2019", "sept 2018")
ADDRESSES = ("https://github.com/x/y", "HTTPS://github.com/X/y/", "http://B.Tech", "https://mba", "ftp://a.example", "", "https://a.example/p?q=1", "http://localhost/x", "https://B.Tech/2019")
NAMES = ("GitHub", "Portfolio", "", "portfolio", "Web ,")
CHECKED = (
    "Machine Learning (ML)", "Natural Language Processing (NLP)", "reading", "built", "XYZ", "weirdo", "Python", "python 3", "AWS", "Chess Theory", "deep (nets)", "one two three four five", "LinkedIn", "Convolutional Neural Networks (CNNs)", "Go  (LLM)", "Docker ,",
    "F77", "Hiking Trails", "",
)
LEISURE = ("Chess theory, reading", "chess theory", "", "Hiking  trails,the hills", "Music", "an old music", "Go ,Chess")

_parts = f"{_pick(POINTS, 'o_orderkey * 5 + o_custkey')} AS points, {_pick(STARTS, 'o_orderkey')} AS start, '' AS end_"
_poor = "o_custkey % 3 = 0"
_three = "FROM orders CROSS JOIN (SELECT 0 AS o UNION ALL SELECT 1 UNION ALL SELECT 2) z"
VIEWS |= {
    "kept_jobs": f"SELECT o_custkey AS doc_id, o_orderkey AS pos, CASE WHEN {_poor} THEN 'University of Pune' ELSE {_pick(FIRMS, 'o_orderkey')} END AS company, CASE WHEN {_poor} THEN 'B.Sc, CGPA: 8' ELSE {_pick(ROLES, 'o_orderkey * 3 + o_custkey')} END AS title, {_pick(PLACES, 'o_orderkey + o_custkey')} AS location, CASE WHEN {_poor} THEN '' ELSE points END AS points, start, end_ FROM (SELECT *, {_parts} FROM orders) q",
    "read_jobs": f"SELECT o_custkey AS doc_id, CAST(o AS BIGINT) AS ord, o_orderkey AS pos, {_pick(FIRMS, 'o_orderkey + o')} AS company, {_pick(ROLES, 'o_orderkey * 3 + o_custkey + o')} AS title, {_pick(PLACES, 'o_orderkey')} AS location, {_pick(POINTS, 'o_orderkey * 5 + o_custkey')} AS points, {_pick(STARTS, 'o_orderkey + o')} AS start, '' AS end_ {_three}",
    "kept_works": f"SELECT o_custkey AS doc_id, o_orderkey AS pos, CASE WHEN o_custkey % 4 = 0 THEN '' ELSE {_pick(WORKS, 'o_orderkey')} END AS name, {_pick(TALES, 'o_orderkey * 5 + o_custkey')} AS description, {_pick(STACKS, 'o_orderkey + o_custkey')} AS stack, {_pick(STARTS, 'o_orderkey')} AS start, '' AS end_, '' AS url FROM orders",
    "read_works": f"SELECT o_custkey AS doc_id, CAST(o AS BIGINT) AS ord, o_orderkey AS pos, {_pick(WORKS, 'o_orderkey + o')} AS name, {_pick(TALES, 'o_orderkey * 5 + o_custkey')} AS description, {_pick(STACKS, 'o_orderkey + o_custkey')} AS stack, {_pick(STARTS, 'o_orderkey')} AS start, '' AS end_, '' AS url {_three}",
    "evidence": "SELECT c_custkey AS doc_id, CASE WHEN o = 0 AND c_custkey % 5 <> 1 THEN 'experience' WHEN o = 1 AND c_custkey % 2 = 0 THEN 'projects' ELSE 'skills' END AS section FROM customer CROSS JOIN (SELECT 0 AS o UNION ALL SELECT 1) z",
    "named_links": f"SELECT o_custkey AS doc_id, o_orderkey AS pos, {_pick(NAMES, 'o_orderkey + o_custkey')} AS label, {_pick(ADDRESSES, 'o_orderkey')} AS url FROM orders",
    "checked_skills": f"SELECT o_custkey AS cand_id, o_orderkey AS pos, {_pick(CHECKED, 'o_orderkey')} AS skill FROM orders",
    "findings": "SELECT o_custkey AS cand_id, CASE WHEN o_orderkey % 5 = 0 THEN concat('skills[', CAST(o_orderkey % 7 AS STRING), '].name') ELSE concat('links[', CAST(o_orderkey % 7 AS STRING), ']') END AS path FROM orders",
    "leisure": f"SELECT o_custkey AS cand_id, o_orderkey AS pos, {_pick(LEISURE, 'o_orderkey * 3 + o_custkey')} AS item FROM orders",
}

_array = lambda c: F.filter(F.split(c, "; "), lambda v: v != "")


def _jobs(spark, sf_dir, name):
    return view(spark, sf_dir, name).withColumnRenamed("end_", "end").withColumn("bullets", _array("points")).drop("points")


def _works(spark, sf_dir, name):
    return view(spark, sf_dir, name).withColumnRenamed("end_", "end").withColumn("technologies", _array("stack")).drop("stack")


def _shown(df, lists):
    return df.withColumn(lists, F.array_join(lists, "; ")).withColumnRenamed("end", "end_")


def repair_experience(spark, sf_dir):
    return _shown(rc.repair_experience(_jobs(spark, sf_dir, "kept_jobs"), view(spark, sf_dir, "evidence")), "bullets")


def repair_projects(spark, sf_dir):
    return _shown(rc.repair_projects(_works(spark, sf_dir, "kept_works"), view(spark, sf_dir, "evidence")), "technologies")


def recover_experience(spark, sf_dir):
    evidence = view(spark, sf_dir, "evidence")
    kept = rc.repair_experience(_jobs(spark, sf_dir, "kept_jobs"), evidence)
    return _shown(rc.recover(kept, _jobs(spark, sf_dir, "read_jobs"), evidence, "experience"), "bullets")


def recover_projects(spark, sf_dir):
    evidence = view(spark, sf_dir, "evidence")
    kept = rc.repair_projects(_works(spark, sf_dir, "kept_works"), evidence)
    return _shown(rc.recover(kept, _works(spark, sf_dir, "read_works"), evidence, "projects"), "technologies")


def repair_links(spark, sf_dir):
    return rc.repair_links(view(spark, sf_dir, "named_links"))


def repair_checked_skills(spark, sf_dir):
    told = view(spark, sf_dir, "leisure").withColumnRenamed("item", "text")
    return rc.repair_checked_skills(view(spark, sf_dir, "checked_skills"), view(spark, sf_dir, "findings"), told)


def repair_interests(spark, sf_dir):
    return rc.spaced_items(view(spark, sf_dir, "leisure"))


QUERIES = {f.__name__: f for f in (repair_experience, repair_projects, recover_experience, recover_projects, repair_links, repair_checked_skills, repair_interests)}

_list = lambda c: f"list_filter(string_split({c}, '; '), lambda v: v <> '')"
_once = lambda c: f"array_to_string(list_filter({c}, lambda x, i: list_position(list_transform({c}, lambda y: lower(y)), lower(x)) = i), '; ')"
_tidied = lambda c: f"list_filter(list_transform({_list(c)}, lambda v: {_tidy('v')}), lambda v: v IS NOT NULL)"
_evidence = "ev AS (SELECT doc_id, bool_or(section = 'experience') AS he, bool_or(section = 'projects') AS hp FROM evidence GROUP BY doc_id)"
_lower = lambda *cs: ", ".join(f"lower(coalesce({c}, ''))" for c in cs)
_JOB, _WORK = ("company", "title", "location", "start", "end_"), ("name", "description", "start", "end_", "url")


def _entries(source: str, jobs: bool, out: str) -> str:
    lines = f"list_concat([company, title, location], {_list('points')})" if jobs else f"list_concat([name, description], {_list('stack')})"
    return f"{out}_l AS (SELECT *, list_filter({lines}, lambda v: v <> '') AS lines FROM {source}), {signed(f'{out}_l', out)}"


def _cleaned(jobs: bool) -> str:
    tidy = ", ".join(f"{_tidy(c)} AS {c}" for c in (_JOB if jobs else _WORK)) if jobs else ", ".join(f"{_tidy(c)} AS {c}" for c in _WORK).replace(f"{_tidy('name')} AS name", f"regexp_replace({_tidy('name')}, '^[0-9]+[.)]\\s*', '') AS name")
    return f"{tidy}, {_tidied('points' if jobs else 'stack')} AS items"


def _kept(jobs: bool) -> str:
    """Tables ending in `kp`."""
    e, p, d = "experience_score", "projects_score", "education_score"
    drop = f"({d} > {e} AND {d} >= {0.55}) OR (NOT coalesce(he, false) AND {p} > {e} + CAST(0.2 AS DOUBLE))" if jobs else f"({d} >= 0.6 AND {d} > {p}) OR (coalesce(he, false) AND NOT coalesce(hp, false) AND {e} > {p} + CAST(0.15 AS DOUBLE))"
    said = "(company <> '' OR title <> '' OR len(" + _list("points") + ") > 0)" if jobs else "name <> ''"
    same = _lower("company", "title", "start") if jobs else _lower("name", "start")
    return f"""{_evidence}, {_entries('kept_jobs' if jobs else 'kept_works', jobs, 'sg')}, kc AS (SELECT sg.doc_id, pos, {_cleaned(jobs)} FROM sg LEFT JOIN ev USING (doc_id) WHERE NOT ({drop}) AND {said}),
     kp AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, {same} ORDER BY pos) AS n FROM kc) WHERE n = 1)"""


def _repaired(jobs: bool) -> str:
    views, columns, items = ("kept_jobs evidence", _JOB, "bullets") if jobs else ("kept_works evidence", _WORK, "technologies")
    return oracle(views, f", {_kept(jobs)} SELECT doc_id, pos, {', '.join(columns)}, {_once('items')} AS {items} FROM kp")


def _recovered(jobs: bool) -> str:
    views, columns, items, section = ("kept_jobs read_jobs evidence", _JOB, "bullets", "experience") if jobs else ("kept_works read_works evidence", _WORK, "technologies", "projects")
    same = _lower("company", "title", "start") if jobs else _lower("name", "start")
    return oracle(views, f""", {_kept(jobs)}, rd AS (SELECT * FROM {views.split()[1]} WHERE doc_id IN (SELECT doc_id FROM evidence WHERE section = '{section}') AND doc_id NOT IN (SELECT doc_id FROM kp)), {_entries('rd', jobs, 'rs')},
     rc AS (SELECT doc_id, ord, pos, {_cleaned(jobs)} FROM rs WHERE {section}_score >= 0.45), ro AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, {same} ORDER BY ord, pos) AS n FROM rc) WHERE n = 1)
     SELECT doc_id, pos, {', '.join(columns)}, {_once('items')} AS {items}, false AS recovered FROM kp UNION ALL SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord, pos), {', '.join(columns)}, {_once('items')}, true FROM ro""")


_edges = lambda c: f"trim(trim(regexp_replace({c}, '\\s+', ' ', 'g')), ' ,')"
_words = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
_acronym = "\\(([A-Z]{2,6})s?\\)\\s*$"
_name = f"trim(regexp_replace(t, '{_acronym}', ''))"
_initials = f"array_to_string(list_transform(regexp_extract_all({_name}, '[A-Za-z]+'), lambda w: upper(w[1:1])), '')"
ORACLES = {
    "repair_experience": _repaired(True), "repair_projects": _repaired(False), "recover_experience": _recovered(True), "recover_projects": _recovered(False),
    "repair_links": oracle("named_links", f""", t AS (SELECT doc_id, pos, coalesce({_tidy('label')}, 'Link') AS label, {_tidy('url')} AS url FROM named_links), h AS (SELECT *, lower(regexp_extract(url, '(?i)^https?://([^/?#]*)', 1)) AS host FROM t WHERE regexp_matches(url, '(?i)^https?://')),
     o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(regexp_replace(url, '/+$', '')) ORDER BY pos) AS n FROM h WHERE contains(host, '.') AND NOT (lower(label) = 'portfolio' AND list_contains({_words(rc.DEGREE_HOSTS)}, host))) SELECT doc_id, pos, label, url FROM o WHERE n = 1"""),
    "repair_interests": f"""WITH RECURSIVE t AS (SELECT cand_id, pos, {_edges('item')} AS f FROM ({VIEWS['leisure']})), u AS (SELECT cand_id, pos, CASE WHEN contains(f, ',') THEN array_to_string(list_filter(list_transform(string_split(f, ','), lambda p: trim(p)), lambda p: p <> ''), ', ') ELSE f END AS t FROM t),
     f AS (SELECT *, {_form('t')} AS n, row_number() OVER (PARTITION BY cand_id ORDER BY pos) AS k FROM u WHERE t <> ''),
     r AS (SELECT cand_id, 1 AS k, [n] AS forms, [t] AS kept FROM f WHERE k = 1 UNION ALL SELECT r.cand_id, r.k + 1, CASE WHEN len(list_filter(r.forms, lambda x: contains(x, f.n) OR contains(f.n, x))) > 0 THEN r.forms ELSE list_append(r.forms, f.n) END,
      CASE WHEN len(list_filter(r.forms, lambda x: contains(x, f.n) OR contains(f.n, x))) > 0 THEN r.kept ELSE list_append(r.kept, f.t) END FROM r JOIN f ON f.cand_id = r.cand_id AND f.k = r.k + 1) SELECT cand_id, array_to_string(arg_max(kept, k), '; ') AS items FROM r GROUP BY cand_id""",
    "repair_checked_skills": oracle("checked_skills findings leisure", f""", pl AS (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY pos) - 1 AS place FROM checked_skills), bad AS (SELECT DISTINCT cand_id, CAST(regexp_extract(path, '^skills\\[([0-9]+)\\]', 1) AS BIGINT) AS place FROM findings WHERE path LIKE 'skills[%'),
     ed AS (SELECT cand_id, pos, {_edges('skill')} AS t FROM pl WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.cand_id = pl.cand_id AND bad.place = pl.place)), raw_skills AS (SELECT cand_id, pos, CASE WHEN regexp_matches(t, '{_acronym}') AND {_name} <> '' AND {_initials} = regexp_extract(t, '{_acronym}', 1) THEN {_name} ELSE t END AS raw FROM ed WHERE t <> '')
     {_sk}, td AS (SELECT cand_id, lower(string_agg(item, ' ' ORDER BY pos)) AS told FROM leisure GROUP BY cand_id), jo AS (SELECT n.cand_id, n.pos, trim(n.canonical) AS skill, r.raw, lower(r.raw) AS low, n.category = 'Other' AS other, len(string_split(r.raw, ' ')) AS k, coalesce(contains(told, lower(r.raw)), false) AS said FROM nm n JOIN raw_skills r USING (cand_id, pos) LEFT JOIN td USING (cand_id)),
     ok AS (SELECT *, row_number() OVER (PARTITION BY cand_id, lower(skill) ORDER BY pos) AS n FROM jo WHERE NOT list_contains({_words([*rc.ACTIONS, *rc.PASTIMES, *rc.FRAGMENTS, *rc.PLATFORMS])}, low) AND NOT starts_with(low, 'machine (') AND NOT starts_with(low, 'deep (') AND NOT (other AND (regexp_matches(raw, '^[A-Z]{{2,5}}$') OR (k = 1 AND NOT regexp_matches(raw, '^[A-Z0-9+#./-]{{2,12}}$')) OR k > 4 OR said)))
     SELECT cand_id, pos, skill FROM ok WHERE n = 1"""),
}
