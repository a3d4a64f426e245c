"""Confidence of a profile's fields, checks of its entries, repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assess, entries, repairs
from .fixtures import VIEWS, _pick, oracle, view

COMPANY = ("Northwind Labs", "worked at a small firm in town", "", "Contoso Ltd.", "Initech", "x y", "of many trades and of none")
TITLE = ("Data Engineer", "", "Analyst", "led the whole group of five", "Manager.", "Intern")
START = ("Jan 2019", "2016", "", "soon", "March 2018", "2040", "1999")
END = ("Dec 2020", "2021", "later", "", "2015", "June 2017")
PLACE = ("Anna University", "2016 - 2020", "", "Hill College", "B.Tech", "Institute of Arts", "2014 – present")
LEVEL = ("B.Tech", "", "Lake School", "Computer Science", "Bachelor of Arts", "MBA", "Data Science  ,, 2", "Commerce")
STUDY = ("", "", "History", "Civil")
MARK = ("8.4/10", "", "A+")
PROJECT = ("Weather station", "", "a bot that answers all the mail.", "Route planner", "Search of notes")
STORY = ("Built a sensor with esp 32 and mqtt for five farms", "", "It uses pandas and scikit-learn", "Designed an llm tool with lang chain, retrieval augmented generation", "Streamlit page over http", "Trained models")
WEB = ("https://github.com/x/y", "", "github.com/x", "http://a.example/p", "ftp://b", "HTTPS://LinkedIn.com/in/z")
SKILL = ("Python", "python", "GPA: 8.2", "Jan 2020", "Bachelor of Arts", "3.5", "Hill College club", "Docker", "  SQL ", "", "• Go", "2014 - 2018", "Apache Spark", "University tools", "Pandas", "CGPA 9")
ITEM = ("Chess club", "and reading", "Hiking, the hills", "hiking hills", "First prize", "", "with honours", "Go", "FIRST PRIZE", "Chess", "an open source group", "Devloping games")
NAME = ("Ana Silva", "Ben", "Chloe 2 Novak", "Dev Rao Email:", "", "Elena van der Berg Lindqvist Okafor", "Farid  Rao - Phone")
HEADLINE = ("Data Engineer", "", "Pune, India", "see https://x.example", "Builder of things — fast", "mail me@x.org")
CRUSHED = ("Createapipelineusing pandas", "DevlopinganAI agent , , for 40k users", "builtWith 3ms delay,", "", "records 500k by ESP32 andReact", "using Lang Chain and Py MuPDF", "PrototypedofpowerbankBoard 2Units", "trainedOn F1 data", "BUILT IT")
HEAD_LINES = ("Ana Silva", "ana@mail.example.org", "Phone: 555", "", "Engineer of things", "www.a.example", "+1 555 010 0199", "Ana Silva", "see https://b.example")
SECTIONS = ("skills", "experience", "education", "projects", "awards", "interests", "languages")

_dates = f"{_pick(START, 'o_orderkey * 5 + 1')} AS start, {_pick(END, 'o_orderkey * 7 + o_custkey')} AS end_, o_orderkey % 6 = 0 AS is_current"
VIEWS |= {
    "exp_entries": f"SELECT o_custkey AS cand_id, o_orderkey AS pos, {_pick(COMPANY, 'o_orderkey')} AS company, {_pick(TITLE, 'o_orderkey * 3 + o_custkey')} AS title, {_dates}, o_orderkey % 4 AS bullets FROM orders",
    "edu_entries": f"SELECT o_custkey AS cand_id, o_orderkey AS pos, {_pick(PLACE, 'o_orderkey')} AS institution, {_pick(LEVEL, 'o_orderkey * 3 + o_custkey')} AS degree, {_pick(STUDY, 'o_custkey')} AS field_of_study, {_pick(MARK, 'o_orderkey + o_custkey')} AS gpa, {_dates} FROM orders",
    "proj_entries": f"SELECT o_custkey AS cand_id, o_orderkey AS pos, {_pick(PROJECT, 'o_orderkey')} AS name, {_pick(STORY, 'o_orderkey * 5 + o_custkey')} AS description, {_pick(WEB, 'o_orderkey + 2 * o_custkey')} AS url, CASE WHEN o_orderkey % 5 = 0 THEN 'Python' ELSE '' END AS technology, {_dates} FROM orders",
    "skill_items": f"SELECT o_custkey AS cand_id, o_orderkey AS pos, {_pick(SKILL, 'o_orderkey')} AS skill FROM orders",
    "list_items": f"SELECT o_custkey AS cand_id, o_orderkey AS pos, {_pick(ITEM, 'o_orderkey * 5 + o_custkey')} AS item FROM orders",
    "web_links": f"SELECT o_custkey AS cand_id, o_orderkey AS pos, {_pick(WEB, 'o_orderkey')} AS url FROM orders",
    "crushed_items": f"SELECT o_orderkey AS doc_id, {_pick(CRUSHED, 'o_orderkey')} AS raw FROM orders",
    "head_lines": f"SELECT o_custkey AS doc_id, o_orderkey AS line_no, {_pick(HEAD_LINES, 'o_orderkey * 5 + o_custkey')} AS line, CASE WHEN o_orderkey % 3 = 0 THEN 'header' WHEN o_orderkey % 3 = 1 THEN 'summary' ELSE 'skills' END AS section FROM orders",
    "profile_counts": f"SELECT c_custkey AS cand_id, {_pick(NAME, 'c_custkey')} AS name, CASE WHEN c_custkey % 2 = 0 THEN 'a@b.org' END AS email, '' AS phone, c_custkey % 3 AS links, c_custkey % 2 AS degrees, c_custkey % 4 AS jobs, c_custkey % 5 AS projects, c_custkey % 9 AS skills, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 2 END AS awards, 1 AS interests FROM customer",
    "people": f"""SELECT c_custkey AS cand_id, {_pick(NAME, 'c_custkey')} AS name, CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN 'ana@mail.example.org' WHEN c_custkey % 4 = 2 THEN 'a@b.org' ELSE 'me at x' END AS email,
        CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN '+1 555 010 0199' ELSE '555 0199' END AS phone, CASE WHEN c_custkey % 2 = 0 THEN 'Pune, India' ELSE '' END AS location, {_pick(HEADLINE, 'c_custkey')} AS headline FROM customer""",
    "shown_sections": "SELECT c_custkey AS cand_id, CASE WHEN (c_custkey + o) % 3 = 0 THEN 'other' ELSE s END AS section FROM customer CROSS JOIN (" + " UNION ALL ".join(f"SELECT '{s}' AS s, {i} AS o" for i, s in enumerate(SECTIONS)) + ") z",
}


def _views(spark, sf_dir, *names):
    return [view(spark, sf_dir, n) for n in names]


def personal_confidence(spark, sf_dir):
    return assess.personal_confidence(view(spark, sf_dir, "people"))


def link_confidence(spark, sf_dir):
    return assess.link_confidence(*_views(spark, sf_dir, "people", "web_links"))


def skill_confidence(spark, sf_dir):
    return assess.skill_confidence(*_views(spark, sf_dir, "people", "skill_items", "shown_sections"))


def experience_confidence(spark, sf_dir):
    return assess.entry_confidence(*_views(spark, sf_dir, "people", "exp_entries", "shown_sections"), "experience")


def education_confidence(spark, sf_dir):
    return assess.entry_confidence(*_views(spark, sf_dir, "people", "edu_entries", "shown_sections"), "education")


def project_confidence(spark, sf_dir):
    return assess.entry_confidence(*_views(spark, sf_dir, "people", "proj_entries", "shown_sections"), "projects")


def list_confidence(spark, sf_dir):
    parts = [assess.list_confidence(*_views(spark, sf_dir, "people", "list_items", "shown_sections"), s).withColumn("section", F.lit(s)) for s in ("awards", "interests", "languages")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def experience_checks(spark, sf_dir):
    return assess.entry_checks(view(spark, sf_dir, "exp_entries"), "experience")


def education_checks(spark, sf_dir):
    return assess.entry_checks(view(spark, sf_dir, "edu_entries"), "education")


def project_checks(spark, sf_dir):
    return assess.entry_checks(view(spark, sf_dir, "proj_entries"), "projects")


def year_overlap(spark, sf_dir):
    return assess.year_overlaps(view(spark, sf_dir, "exp_entries"))


def simple_list_checks(spark, sf_dir):
    return assess.simple_list_checks(view(spark, sf_dir, "list_items"))


def repair_skills(spark, sf_dir):
    return repairs.clean_skills(*_views(spark, sf_dir, "skill_items", "edu_entries"))


def repair_education(spark, sf_dir):
    return repairs.repair_education(view(spark, sf_dir, "edu_entries"))


def repair_list(spark, sf_dir):
    return repairs.repair_list(view(spark, sf_dir, "list_items"))


def repair_personal(spark, sf_dir):
    return repairs.repair_personal(view(spark, sf_dir, "people"))


def sentence_dedupe(spark, sf_dir):
    return repairs.distinct_sentences(view(spark, sf_dir, "list_items"))


def project_inferred(spark, sf_dir):
    skills = view(spark, sf_dir, "skill_items").filter("trim(skill) <> ''")
    return repairs.infer_technologies(view(spark, sf_dir, "proj_entries"), skills)


def crushed_text(spark, sf_dir):
    return view(spark, sf_dir, "crushed_items").select("doc_id", entries.crushed(F.col("raw")).alias("text"))


def contact_lines(spark, sf_dir):
    return entries.contact_lines(view(spark, sf_dir, "head_lines"))


def completeness_points(spark, sf_dir):
    return entries.completeness_points(view(spark, sf_dir, "profile_counts"))


QUERIES = {f.__name__: f for f in (personal_confidence, link_confidence, skill_confidence, experience_confidence, education_confidence, project_confidence, list_confidence, experience_checks, education_checks, project_checks, year_overlap, simple_list_checks, repair_skills, repair_education, repair_list, repair_personal, sentence_dedupe, project_inferred, crushed_text, contact_lines, completeness_points)}

_web = "regexp_matches(coalesce(url, ''), '^[hH][tT][tT][pP][sS]?://[^/?#]+')"
_shown = lambda s: f"sh AS (SELECT DISTINCT cand_id FROM shown_sections WHERE section = '{s}')"
_bonus = lambda n: f"CASE WHEN sh.cand_id IS NULL THEN 0 ELSE {n} END"
_has = lambda c, n: f"CASE WHEN {c} <> '' THEN {n} ELSE 0 END"


def _entry(view_: str, section: str, each: str, bonus: int) -> str:
    return oracle(f"people {view_} shown_sections", f""", {_shown(section)}, m AS (SELECT cand_id, CAST(sum(least(100, {each})) AS DOUBLE) / (count(*) * CAST(100 AS DOUBLE)) AS mean FROM {view_} GROUP BY cand_id)
     SELECT p.cand_id, CASE WHEN mean IS NULL THEN ({_bonus(10)}) / CAST(100 AS DOUBLE) ELSE round(least(mean + ({_bonus(bonus)}) / CAST(100 AS DOUBLE), CAST(1 AS DOUBLE)), 3) END AS score
     FROM people p LEFT JOIN sh USING (cand_id) LEFT JOIN m ON m.cand_id = p.cand_id""")


_year = lambda c: f"TRY_CAST(nullif(regexp_extract({c}, '(?:19|20)[0-9][0-9]'), '') AS INT)"
_range = f"""CASE WHEN start = '' AND end_ = '' THEN 'grey' WHEN start <> '' AND {_year('start')} IS NULL THEN 'grey' WHEN end_ <> '' AND NOT is_current AND {_year('end_')} IS NULL THEN 'grey'
 WHEN NOT is_current AND {_year('end_')} < {_year('start')} THEN 'invalid' WHEN {_year('start')} > 2035 THEN 'grey' ELSE 'valid' END"""
_sentence = lambda c: f"(right(trim({c}), 1) = '.' OR (left(trim({c}), 1) <> upper(left(trim({c}), 1)) AND len(string_split_regex(trim({c}), '\\s+')) > 4))"
_worded = lambda c, missing: f"CASE WHEN {c} = '' THEN '{missing}' WHEN {_sentence(c)} THEN 'grey' ELSE 'valid' END"
_there = lambda c, missing: f"CASE WHEN {c} = '' THEN '{missing}' ELSE 'valid' END"
_verbs = ", ".join(f"'{v}'" for v in assess.VERBS)
_bullet = f"CASE WHEN description <> '' AND len(string_split_regex(trim(description), '\\s+')) >= 5 AND trim(lower(string_split_regex(trim(description), '\\s+')[1]), '.,;:()') IN ({_verbs}) THEN 'valid' ELSE 'grey' END"


def _checks(view_: str, checks: dict[str, str]) -> str:
    return oracle(view_, " UNION ALL ".join(f"SELECT cand_id, pos, '{n}' AS \"check\", {sql} AS status FROM {view_}" for n, sql in checks.items()))


def _tidy(c: str) -> str:
    t = f"trim(regexp_replace(replace(replace({c}, '–', ' - '), '—', ' - '), '\\s+', ' ', 'g'), ' ,-')"
    t = f"regexp_replace(regexp_replace(regexp_replace({t}, '\\bDevloping\\b', 'Developing', 'gi'), '\\bNodejs\\b', 'Node.js', 'gi'), '\\bsept\\b', 'Sept', 'gi')"
    return f"nullif(regexp_replace(regexp_replace({t}, '\\s*,\\s*,', ', ', 'g'), '\\s+([,.:;!?])', '\\1', 'g'), '')"


_place = lambda c: f"coalesce(regexp_matches({c}, '\\b(university|college|institute|school|academy|iit|nit|iiit|bits)\\b', 'i'), false)"
_form = lambda c: f"trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9_\\s]', ' ', 'g'), '\\b(and|the|a|an)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
_known = "[" + ", ".join(f"CASE WHEN regexp_matches(txt, '{p}') THEN '{n}' END" for n, p in repairs.TECHNOLOGIES.items()) + "]"

ORACLES = {
    "personal_confidence": oracle("people", f"""SELECT cand_id, round((CASE WHEN name = '' THEN 0 WHEN regexp_matches(trim(name), '^\\S+(\\s+\\S+){{1,4}}$') AND NOT regexp_matches(name, '[0-9]') THEN 25 ELSE 10 END
     + CASE WHEN email = '' THEN 0 WHEN regexp_full_match(email, '[A-Za-z0-9][A-Za-z0-9_.+-]*@[A-Za-z0-9][A-Za-z0-9-]*\\.[A-Za-z][A-Za-z]+(\\.[A-Za-z][A-Za-z]+)?') THEN 25 ELSE 10 END
     + CASE WHEN phone = '' THEN 0 WHEN length(regexp_replace(phone, '\\D', '', 'g')) >= 10 THEN 20 ELSE 5 END + {_has('location', 15)} + {_has('headline', 15)}) / CAST(100 AS DOUBLE), 3) AS score FROM people"""),
    "link_confidence": oracle("people web_links", f"""SELECT p.cand_id, coalesce(round(least(least(l.n / CAST(3 AS DOUBLE), CAST(0.5 AS DOUBLE)) + l.a / CAST(4 AS DOUBLE) + l.b / CAST(4 AS DOUBLE), CAST(1 AS DOUBLE)), 3), CAST(0 AS DOUBLE)) AS score FROM people p LEFT JOIN
     (SELECT cand_id, count(*) FILTER ({_web}) AS n, max(CASE WHEN {_web} AND url ILIKE '%linkedin.com%' THEN 1 ELSE 0 END) AS a, max(CASE WHEN {_web} AND url ILIKE '%github.com%' THEN 1 ELSE 0 END) AS b FROM web_links GROUP BY cand_id) l USING (cand_id)"""),
    "skill_confidence": oracle("people skill_items shown_sections", f""", {_shown('skills')}, m AS (SELECT cand_id, count(*) AS n, count(*) FILTER (skill <> '' AND length(skill) <= 50 AND left(skill, 1) NOT IN ('•', '-', '–', '—', '►', '▸', '●')) AS ok FROM skill_items GROUP BY cand_id)
     SELECT p.cand_id, CASE WHEN n IS NULL THEN CAST(0 AS DOUBLE) ELSE round(least(least(n / CAST(20 AS DOUBLE), CAST(0.4 AS DOUBLE)) + ok / n * CAST(0.4 AS DOUBLE) + ({_bonus(20)}) / CAST(100 AS DOUBLE), CAST(1 AS DOUBLE)), 3) END AS score FROM people p LEFT JOIN sh USING (cand_id) LEFT JOIN m ON m.cand_id = p.cand_id"""),
    "experience_confidence": _entry("exp_entries", "experience", f"{_has('company', 25)} + {_has('title', 25)} + {_has('start', 25)} + CASE WHEN regexp_matches(start, '(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\\s+[0-9]{4}|\\b20[0-9][0-9]\\b') THEN 5 ELSE 0 END + CASE WHEN bullets > 0 THEN 20 ELSE 0 END", 10),
    "education_confidence": _entry("edu_entries", "education", f"{_has('institution', 35)} + {_has('degree', 30)} + {_has('start', 20)} + {_has('gpa', 15)}", 5),
    "project_confidence": _entry("proj_entries", "projects", f"{_has('name', 40)} + {_has('description', 35)} + {_has('start', 15)} + {_has('technology', 10)}", 0),
    "list_confidence": oracle("people list_items shown_sections", """, s AS (SELECT * FROM (VALUES ('awards'), ('interests'), ('languages')) v(section)), m AS (SELECT cand_id, count(*) FILTER (length(item) > 3) / count(*) AS share FROM list_items GROUP BY cand_id)
     SELECT p.cand_id, s.section, CASE WHEN share IS NULL THEN CAST(0 AS DOUBLE) ELSE round(least(share * CAST(0.8 AS DOUBLE) + CASE WHEN e.section IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END, CAST(1 AS DOUBLE)), 3) END AS score
     FROM people p CROSS JOIN s LEFT JOIN m USING (cand_id) LEFT JOIN shown_sections e ON e.cand_id = p.cand_id AND e.section = s.section"""),
    "experience_checks": _checks("exp_entries", {"company": _worded("company", "invalid"), "title": _worded("title", "grey"), "dates": _range}),
    "education_checks": _checks("edu_entries", {"institution": _there("institution", "invalid"), "degree": _there("degree", "grey"), "dates": _range}),
    "project_checks": _checks("proj_entries", {"name": _worded("name", "invalid"), "dates": _range, "url": f"CASE WHEN {_web} THEN 'valid' ELSE 'grey' END", "description": _bullet, "technology": _there("technology", "grey")}),
    "year_overlap": oracle("exp_entries", f""", y AS (SELECT cand_id, pos, {_year('start')} AS s, {_year('end_')} AS e FROM exp_entries WHERE NOT is_current)
     SELECT a.cand_id, a.pos AS first, b.pos AS second FROM y a JOIN y b ON a.cand_id = b.cand_id AND a.pos < b.pos WHERE a.s <= a.e AND b.s <= b.e AND greatest(a.s, b.s) <= least(a.e, b.e)"""),
    "simple_list_checks": oracle("list_items", "SELECT cand_id, pos, CASE WHEN trim(item) = '' OR row_number() OVER (PARTITION BY cand_id, lower(trim(item)) ORDER BY pos) > 1 OR NOT contains(trim(item), ' ') THEN 'grey' ELSE 'valid' END AS status FROM list_items"),
    "repair_skills": oracle("skill_items edu_entries", """, w AS (SELECT DISTINCT cand_id, x FROM (SELECT cand_id, unnest(list_concat([lower(trim(institution))], string_split(lower(trim(institution)), ' '))) AS x FROM edu_entries) WHERE length(x) > 5),
     k AS (SELECT cand_id, pos, trim(skill) AS skill FROM skill_items s WHERE trim(skill) <> '' AND NOT regexp_matches(skill, '^\\s*(gpa|cgpa|grade|marks|score)\\s*[:=]?\\s*[0-9.]+', 'i') AND NOT regexp_matches(trim(skill), '^([a-z]{3} [0-9]{4}|[0-9]{4} - ([0-9]{4}|present)|[0-9./]+)$', 'i')
      AND NOT regexp_matches(skill, 'bachelor (in|of) ', 'i') AND NOT EXISTS (SELECT 1 FROM w WHERE w.cand_id = s.cand_id AND contains(lower(trim(s.skill)), w.x)))
     SELECT cand_id, min(pos) AS pos, arg_min(skill, pos) AS skill FROM k GROUP BY cand_id, lower(skill)"""),
    "repair_education": oracle("edu_entries", f""", a AS (SELECT cand_id, pos, start, {_tidy('institution')} AS i, {_tidy('degree')} AS d, {_tidy('field_of_study')} AS f FROM edu_entries),
     b AS (SELECT *, coalesce(regexp_matches(i, '\\b(19|20)[0-9][0-9]\\b') AND regexp_matches(i, 'present|current|-', 'i'), false) AS dated FROM a),
     c AS (SELECT cand_id, pos, start, f, CASE WHEN dated AND {_place('d')} THEN d WHEN dated THEN NULL ELSE i END AS i, CASE WHEN dated AND {_place('d')} THEN NULL ELSE d END AS d FROM b),
     e AS (SELECT cand_id, pos, start, f, CASE WHEN {_place('d')} AND NOT {_place('i')} AND i IS NOT NULL THEN d ELSE i END AS i, CASE WHEN {_place('d')} AND NOT {_place('i')} AND i IS NOT NULL THEN i ELSE d END AS d FROM c),
     g AS (SELECT *, f IS NULL AND coalesce(regexp_matches(d, '\\b(computer science|engineering|data science|civil|commerce|science)\\b', 'i'), false) AS t FROM e),
     h AS (SELECT cand_id, pos, start, i AS institution, CASE WHEN t THEN NULL ELSE d END AS degree, CASE WHEN t THEN d ELSE f END AS field_of_study FROM g)
     SELECT cand_id, pos, institution, degree, field_of_study FROM (SELECT *, row_number() OVER (PARTITION BY cand_id, lower(coalesce(institution, '')), lower(coalesce(degree, '')), lower(start) ORDER BY pos) AS n FROM h WHERE institution IS NOT NULL OR degree IS NOT NULL) WHERE n = 1"""),
    "repair_personal": oracle("people", f"""SELECT cand_id, nullif(trim(regexp_replace(regexp_replace({_tidy('name')}, '\\b(email|e-?mail|phone|mobile|linkedin|github|portfolio|website|contact|address)\\s*:?\\s*$', '', 'i'), '\\s+', ' ', 'g'), ' |:-'), '') AS name,
     CASE WHEN lower({_tidy('headline')}) = lower(coalesce({_tidy('location')}, '')) OR headline LIKE '%http%://%' OR headline LIKE '%@%' THEN NULL ELSE {_tidy('headline')} END AS headline FROM people"""),
    "crushed_text": oracle("crushed_items", """, e AS (SELECT * FROM (VALUES ('Createapipelineusing pandas', 'Create a pipeline using pandas'), ('DevlopinganAI agent , , for 40k users', 'Developing an AI agent, for 40k users'), ('builtWith 3ms delay,', 'Built With 3ms delay'),
     ('records 500k by ESP32 andReact', 'Records 500k by ESP32 and React'), ('using Lang Chain and Py MuPDF', 'Using LangChain and PyMuPDF'), ('PrototypedofpowerbankBoard 2Units', 'Prototypedofpowerbank Board 2 Units'), ('trainedOn F1 data', 'Trained On F1 data'), ('BUILT IT', 'BUILT IT')) v(raw, text))
     SELECT doc_id, e.text FROM crushed_items LEFT JOIN e USING (raw)"""),
    "contact_lines": oracle("head_lines", """, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY line_no) AS k FROM head_lines), h AS (SELECT doc_id, line_no, line FROM n WHERE section = 'header'),
     s AS (SELECT doc_id, min(line_no) AS line_no, line FROM n WHERE section = 'summary' AND k <= 12 AND (contains(line, '@') OR contains(line, 'http') OR contains(line, 'www.') OR line LIKE 'Phone%' OR line LIKE '+%') GROUP BY doc_id, line)
     SELECT * FROM h UNION ALL SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = s.doc_id AND h.line = s.line)"""),
    "completeness_points": oracle("profile_counts", """SELECT cand_id, CAST(2 * ((name <> '')::INT + (email IS NOT NULL)::INT + (links > 0)::INT + (degrees > 0)::INT + (jobs > 0)::INT + (projects > 0)::INT + (skills > 4)::INT) + coalesce(awards, 0) + 1 AS INT) AS points FROM profile_counts"""),
    "project_inferred": oracle("proj_entries skill_items", f""", t AS (SELECT cand_id, pos, lower(concat_ws(' ', nullif(name, ''), nullif(description, ''))) AS txt FROM proj_entries WHERE technology = ''),
     s AS (SELECT cand_id, skill, min(pos) AS o FROM skill_items WHERE trim(skill) <> '' GROUP BY cand_id, skill),
     m AS (SELECT t.cand_id, t.pos, list(s.skill ORDER BY s.o) AS own FROM t JOIN s ON s.cand_id = t.cand_id WHERE regexp_matches(t.txt, '(^|\\W)' || regexp_escape(lower(s.skill)) || '($|\\W)') OR (length(regexp_replace(lower(s.skill), '[^a-z0-9+#]', '', 'g')) >= 4 AND contains(regexp_replace(t.txt, '[^a-z0-9+#]', '', 'g'), regexp_replace(lower(s.skill), '[^a-z0-9+#]', '', 'g'))) GROUP BY t.cand_id, t.pos),
     k AS (SELECT t.cand_id, t.pos, coalesce(own, []) AS own, list_filter({_known}, lambda x: x IS NOT NULL) AS known FROM t LEFT JOIN m USING (cand_id, pos))
     SELECT cand_id, pos, array_to_string(list_concat(own, list_filter(known, lambda x: NOT list_contains(list_transform(own, lambda y: lower(y)), lower(x))))[1:8], ', ') AS technologies FROM k"""),
}
_views_sql = VIEWS["list_items"]
ORACLES["sentence_dedupe"] = f"""WITH RECURSIVE t AS (SELECT cand_id, pos, trim(regexp_replace(trim(item), '\\s+', ' ', 'g'), ' ,') AS t FROM ({_views_sql})), f AS (SELECT *, {_form('t')} AS n, row_number() OVER (PARTITION BY cand_id ORDER BY pos) AS k FROM t WHERE t <> ''),
 r AS (SELECT cand_id, 1 AS k, [n] AS forms, [t] AS kept FROM f WHERE k = 1 UNION ALL
  SELECT r.cand_id, r.k + 1, CASE WHEN len(list_filter(r.forms, lambda x: contains(x, f.n) OR contains(f.n, x))) > 0 THEN r.forms ELSE list_append(r.forms, f.n) END,
   CASE WHEN len(list_filter(r.forms, lambda x: contains(x, f.n) OR contains(f.n, x))) > 0 THEN r.kept ELSE list_append(r.kept, f.t) END FROM r JOIN f ON f.cand_id = r.cand_id AND f.k = r.k + 1)
 SELECT cand_id, array_to_string(arg_max(kept, k), '; ') AS items FROM r GROUP BY cand_id"""
_on = "(regexp_matches(f.item, '^[a-z]') OR regexp_matches(lower(f.item), '^(and|or|with|affiliated|achieving) '))"
ORACLES["repair_list"] = f"""WITH RECURSIVE t AS (SELECT cand_id, pos, {_tidy('item')} AS item FROM ({_views_sql})), f AS (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY pos) AS k FROM t WHERE item IS NOT NULL),
 r AS (SELECT cand_id, k, [item] AS items, [pos] AS ps FROM f WHERE k = 1 UNION ALL
  SELECT r.cand_id, r.k + 1, CASE WHEN {_on} THEN list_append(r.items[1:len(r.items) - 1], concat(r.items[len(r.items)], ' ', f.item)) WHEN list_contains(list_transform(r.items, lambda x: lower(x)), lower(f.item)) THEN r.items ELSE list_append(r.items, f.item) END,
   CASE WHEN {_on} OR list_contains(list_transform(r.items, lambda x: lower(x)), lower(f.item)) THEN r.ps ELSE list_append(r.ps, f.pos) END FROM r JOIN f ON f.cand_id = r.cand_id AND f.k = r.k + 1),
 w AS (SELECT cand_id, arg_max(items, k) AS items, arg_max(ps, k) AS ps FROM r GROUP BY cand_id), u AS (SELECT cand_id, unnest(items) AS item, unnest(ps) AS pos FROM w)
 SELECT cand_id, pos, item FROM u WHERE NOT EXISTS (SELECT 1 FROM u o WHERE o.cand_id = u.cand_id AND lower(o.item) <> lower(u.item) AND contains(lower(o.item), lower(u.item)))"""
