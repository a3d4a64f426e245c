"""Labelled records of two layouts, as queries; their SQL reads JSON by functions for it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import truth
from .fixtures import VIEWS, _pick, oracle, view

RECORDS = (
    '{"file": "a.pdf", "personal_info": {"name": "Ana Silva", "email": "ana@x.example", "phone": "+1 555 010 0199", "location": "Pune", "links": [{"label": "Web", "url": "https://a.example"}]}, "education": [{"institution": "Hill College", "degree": "B.Sc", "field_of_study": null, "start": "2016", "end": "2019", "gpa": "8.1"}], "experience": [], "projects": [], "skills": ["Python", " SQL "], "certifications": []}',
    '{"file": "a.pdf", "personal_info": {"name": 7, "email": "ana at x", "phone": "12", "age": 3, "links": {"label": "Web"}}, "education": ["Lake School", ""], "experience": {"title": "Intern", "organization": "Initech"}, "projects": ["Bot"], "skills": {"tools": ["Git", "", 4], "core": "Java", "none": null}, "extra": [1, 2]}',
    '{"name": "Ben Rao", "contact": {"email": "b@x.example", "phone": null}, "technical_skills": {"b": ["Go"], "a": ["C", "R"]}, "education": {"institution": "IIT", "degree": "MBA"}, "experience": [{"title": "Analyst", "company": "", "organization": "Contoso", "start": "2019", "end": null}, "Clerk", 5], "projects": null}',
    '{"file": "", "personal_info": null, "education": [{"institution": 5}, 3], "experience": [{"company": "Hooli", "title": "Dev", "start": "2020", "end": "2021", "location": "", "bullets": ["a", 2]}, {"company": "X", "bullets": "none"}], "projects": [{"name": "Map", "description": "", "technologies": ["Go"], "url": "", "stars": 5}], "skills": [], "certifications": ["AWS", 3]}',
    "[1, 2]", "not json", '"text"', "{}", '{"skills": [1.5, true, null, "x"], "personal_info": {"links": [{"url": "a.example"}, "no", {"label": 3, "url": "Link not specified"}]}}',
    '{"file": 9, "name": "Eve", "contact": null, "technical_skills": "Perl", "projects": {"name": "Solo"}, "education": [{"degree": "PhD"}]}',
)
VIEWS["labelled"] = f"SELECT o_orderkey AS doc_id, {_pick(RECORDS, 'o_orderkey')} AS body FROM orders"


def truth_table(spark, sf_dir):
    t = truth.truth_table(view(spark, sf_dir, "labelled"))
    shown = lambda c, *fields: F.array_join(F.transform(c, lambda e: F.concat_ws("/", *[F.coalesce(e[f], F.lit("-")) for f in fields])), "; ").alias(c)
    return t.select("doc_id", "layout", "name", "email", "phone", "location", F.array_join("skills", "; ").alias("skills"), shown("education", "institution", "degree"), shown("experience", "title", "company", "start", "end"), shown("projects", "name"))


def record_issues(spark, sf_dir):
    return truth.record_issues(view(spark, sf_dir, "labelled"))


QUERIES = {f.__name__: f for f in (truth_table, record_issues)}

_str = lambda j, p: f"json_extract_string({j}, '$.{p}')"
_entries = lambda name, primary: (
    f"CASE json_type(j->'{name}') WHEN 'OBJECT' THEN [j->'{name}'] WHEN 'ARRAY' THEN list_transform(list_filter(CAST(j->'{name}' AS JSON[]), lambda x: json_type(x) = 'OBJECT' OR (json_type(x) = 'VARCHAR' AND trim(x->>'$') <> '')), lambda x: CASE WHEN json_type(x) = 'VARCHAR' THEN CAST(json_object('{primary}', trim(x->>'$')) AS JSON) ELSE x END) ELSE CAST([] AS JSON[]) END"
)
_join = lambda name, primary, *fields: f"array_to_string(list_transform({_entries(name, primary)}, lambda e: concat_ws('/', {', '.join(fields)})), '; ') AS {name}"
_or = lambda f: f"coalesce(e->>'{f}', '-')"
_flat = "(json_exists(j, '$.personal_info') OR json_exists(j, '$.skills'))"
_pickj = lambda a, b: f"CASE WHEN {_flat} THEN {_str('j', a)} ELSE {_str('j', b)} END"
_texts = lambda s: f"list_filter(list_transform(CASE json_type({s}) WHEN 'ARRAY' THEN CAST({s} AS JSON[]) ELSE [{s}] END, lambda x: trim(x->>'$')), lambda x: x IS NOT NULL AND x <> '')"
ORACLES = {
    "truth_table": oracle("labelled", f""", p AS (SELECT doc_id, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM labelled), o AS (SELECT doc_id, CASE WHEN json_type(j) = 'OBJECT' THEN j END AS j FROM p), q AS (SELECT *, CASE WHEN {_flat} THEN j->'skills' ELSE j->'technical_skills' END AS s FROM o)
     SELECT doc_id, CASE WHEN j IS NOT NULL THEN CASE WHEN {_flat} THEN 'profile' ELSE 'contact' END END AS layout, {_pickj('personal_info.name', 'name')} AS name, {_pickj('personal_info.email', 'contact.email')} AS email, {_pickj('personal_info.phone', 'contact.phone')} AS phone, {_pickj('personal_info.location', 'contact.location')} AS location,
      array_to_string(CASE json_type(s) WHEN 'ARRAY' THEN {_texts('s')} WHEN 'OBJECT' THEN flatten(list_transform(list_sort(json_keys(s)), lambda k: {_texts("json_extract(s, concat('$.', k))")})) ELSE [] END, '; ') AS skills,
      {_join('education', 'institution', _or('institution'), _or('degree'))}, {_join('experience', 'title', _or('title'), "coalesce(nullif(e->>'company', ''), e->>'organization', '-')", _or('start'), _or('end'))}, {_join('projects', 'name', _or('name'))} FROM q"""),
}
