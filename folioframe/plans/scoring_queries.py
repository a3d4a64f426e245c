"""All ten field scores of strategies with the evidence's weights, and the profile merged from them, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import consensus, scoring, sections
from . import merge_queries, repair_queries  # noqa: F401  (their views)
from .fixtures import VIEWS, _pick, oracle, view
from .merge_queries import STRATEGIES
from .resolve_queries import _headed
from .text_queries import _hd

NAMES = ("Ana Silva", "Ben", "Ana 2 Silva", "Work Experience", "ana silva of the north hill", "A | B", "", "Chloe de la Cruz", "one two three four five six seven")
MAILS, PHONES, PLACES, HEADS, SUMMARIES = ("a@b.org", "bad", "", "x.y+z@q.example.com", "a@b"), ("+1 555 010 0199", "123", "", "5550100199"), ("Pune, India", "Pune", ""), ("Dev", "Data Engineer", ""), ("", "Seasoned", "")
_three = "FROM customer CROSS JOIN (SELECT 0 AS o UNION ALL SELECT 1 UNION ALL SELECT 2) z"
VIEWS |= {
    "identities": f"SELECT c_custkey AS doc_id, CAST(o AS BIGINT) AS ord, {_pick(NAMES, 'c_custkey * 3 + o * 5')} AS name, {_pick(MAILS, 'c_custkey + o * 3')} AS email, {_pick(PHONES, 'c_custkey * 3 + o')} AS phone, {_pick(PLACES, 'c_custkey + o')} AS location, {_pick(HEADS, 'c_custkey + 2 * o')} AS headline, {_pick(SUMMARIES, 'c_custkey + o')} AS summary {_three}",
    "shown": "SELECT c_custkey AS doc_id, CASE WHEN (c_custkey + o) % 4 = 0 THEN 'other' WHEN o = 0 THEN 'experience' WHEN o = 1 THEN 'education' WHEN o = 2 THEN 'projects' WHEN o = 3 THEN 'skills' WHEN o = 4 THEN 'awards' ELSE 'interests' END AS section FROM customer CROSS JOIN (" + " UNION ALL ".join(f"SELECT {o} AS o" for o in range(6)) + ") z",
}
_kind = "CASE pos % 5 WHEN 0 THEN 'skills' WHEN 1 THEN 'awards' WHEN 2 THEN 'interests' WHEN 3 THEN 'languages' ELSE 'skills' END"


def _rows(spark, sf_dir, field):
    return consensus.union_strategies(*[view(spark, sf_dir, f"{field}_{s}") for s in STRATEGIES])


def strategy_scores(spark, sf_dir):
    items = _rows(spark, sf_dir, "phrases").withColumn("field", F.expr(_kind))
    args = [_rows(spark, sf_dir, f) for f in ("jobs", "degrees", "works")]
    return scoring.strategy_scores(view(spark, sf_dir, "identities"), _rows(spark, sf_dir, "sites"), items, *args, sections.heading_dictionary(spark), view(spark, sf_dir, "shown"))


def profile_merge(spark, sf_dir):
    return scoring.merge_profiles(view(spark, sf_dir, "identities"), strategy_scores(spark, sf_dir), sections.heading_dictionary(spark))


QUERIES = {f.__name__: f for f in (strategy_scores, profile_merge)}

_D = lambda v: f"CAST({v} AS DOUBLE)"
_all = lambda f: "(" + " UNION ALL ".join(f"SELECT {i} AS ord, * FROM {f}_{s}" for i, s in enumerate(STRATEGIES)) + ")"
_count = lambda c: f"len(list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> ''))"
_if = lambda c, n: f"CASE WHEN {c} THEN {n} ELSE 0 END"
_sentence = lambda c: f"({_count(c)} > 10 OR right({c}, 1) = '.')"
_name = lambda c: f"({_count(c)} BETWEEN 2 AND 5 AND NOT regexp_matches({c}, '[0-9]'))"
_identity = lambda c, s: f"({_count(c)} BETWEEN 2 AND 6 AND NOT regexp_matches({c}, '[0-9@|/\\\\#:+=]') AND {s} IS NULL)"
_mail, _phone = lambda c: f"regexp_matches({c}, '{scoring.EMAIL}')", lambda c: f"length(regexp_replace({c}, '[^0-9]', '', 'g')) >= 10"
_points = lambda n, s, e, p, place: f"(CASE WHEN {_name(n)} THEN 30 WHEN {_identity(n, s)} THEN 15 ELSE 0 END + {_if(_mail(e), 30)} + {_if(_phone(p), 20)} + {_if(f'contains({place}, {chr(39)},{chr(39)})', 20)}) / {_D(100)}"
_job = f"{_if('company <> ' + chr(39) * 2 + ' AND NOT ' + _sentence('company'), 30)} + {_if('title <> ' + chr(39) * 2, 25)} + {_if('start <> ' + chr(39) * 2, 20)} + {_if('bullets > 0', 25)}"
_degree = " + ".join(_if(f"{c} <> ''", n) for c, n in (("institution", 35), ("degree", 25), ("start", 20), ("gpa", 20)))
_work = f"{_if('name <> ' + chr(39) * 2 + ' AND NOT ' + _sentence('name'), 45)} + " + " + ".join(_if(c, n) for c, n in (("description <> ''", 40), ("start <> ''", 10), ("technology <> '' OR url <> ''", 5)))
_mean = lambda field, table, points: f"SELECT doc_id, ord, '{field}' AS field, sum({points}) / (count(*) * {_D(100)}) AS score FROM {_all(table)} GROUP BY doc_id, ord"
_score = lambda f: f"CASE WHEN {_unshown(f)} AND {f} IS NOT NULL THEN least({f}, {_D(0.25)}) ELSE coalesce({f}, {_D(0)}) END"
_unshown = lambda f: f"NOT list_contains(shown, '{f}')" if f in scoring.SHOWN else "false"
_weight = lambda f, w: f"CASE WHEN {_unshown(f)} THEN CASE WHEN {f} IS NOT NULL THEN {_D(w)} * {_D(0.35)} ELSE {_D(0)} END ELSE {_D(w)} END"
_views = "identities shown " + " ".join(f"{f}_{s}" for f in ("jobs", "degrees", "works", "phrases", "sites") for s in STRATEGIES)
_scored = f""", {_hd}, {_headed('identities', 'name', 'idn')}, it AS (SELECT *, {_kind} AS field FROM {_all('phrases')}),
 li AS (SELECT doc_id, ord, field, count(*) AS n, count(*) FILTER (value <> '' AND length(value) <= 40 AND NOT regexp_matches(value, '^[•–-]')) AS clean, count(*) FILTER (length(value) > 8) AS l8, count(*) FILTER (length(value) > 3) AS l3 FROM it GROUP BY ALL),
 lg AS (SELECT doc_id, ord, 'personal_info' AS field, {_points('name', 'section', 'email', 'phone', 'location')} AS score FROM idn UNION ALL SELECT doc_id, ord, 'summary', {_D(1)} FROM identities WHERE summary <> ''
  UNION ALL SELECT doc_id, ord, 'links', least(count(*) FILTER (regexp_matches(url, '(?i)^https?://[^/?#]+')) / {_D(2)}, {_D(1)}) FROM {_all('sites')} GROUP BY doc_id, ord
  UNION ALL SELECT doc_id, ord, field, least(CASE field WHEN 'skills' THEN round(least(n, 24) / {_D(24)} * (clean / {_D('n')}), 3) WHEN 'awards' THEN l8 / {_D(4)} WHEN 'interests' THEN l3 / {_D(3)} ELSE n / {_D(4)} END, {_D(1)}) FROM li
  UNION ALL {_mean('experience', 'jobs', _job)} UNION ALL {_mean('education', 'degrees', _degree)} UNION ALL {_mean('projects', 'works', _work)}),
 by_ AS (SELECT doc_id, ord, {', '.join(f"max(CASE WHEN field = '{f}' THEN score END) AS {f}" for f in scoring.WEIGHTS)} FROM lg GROUP BY doc_id, ord), sh AS (SELECT doc_id, list(section) AS shown FROM shown GROUP BY doc_id),
 jn AS (SELECT i.doc_id, i.ord, {', '.join(f'b.{f}' for f in scoring.WEIGHTS)}, coalesce(sh.shown, []) AS shown FROM identities i LEFT JOIN by_ b ON b.doc_id = i.doc_id AND b.ord = i.ord LEFT JOIN sh ON sh.doc_id = i.doc_id),
 sc AS (SELECT doc_id, ord, {', '.join(f'{_score(f)} AS {f}_score' for f in scoring.WEIGHTS)}, round(({' + '.join(f'({_score(f)}) * ({_weight(f, w)})' for f, w in scoring.WEIGHTS.items())}) / ({' + '.join(f'({_weight(f, w)})' for f, w in scoring.WEIGHTS.items())}), 9) AS global_score FROM jn)"""
_valid = {"name": f"({_name('name')} OR {_identity('name', 'section')})", "email": _mail("email"), "phone": _phone("phone"), "location": "contains(location, ',')", "headline": "length(headline) >= 4"}
_others = [f for f in scoring.WEIGHTS if f != "personal_info"]
ORACLES = {
    "strategy_scores": oracle(_views, f"{_scored} SELECT * FROM sc"),
    "profile_merge": oracle(_views, f"""{_scored}, rk AS (SELECT i.*, sc.* EXCLUDE (doc_id, ord), row_number() OVER (PARTITION BY i.doc_id ORDER BY global_score DESC, i.ord) AS rank FROM idn i JOIN sc ON sc.doc_id = i.doc_id AND sc.ord = i.ord),
     mg AS (SELECT doc_id, {', '.join(f'arg_min({c}, rank) FILTER ({ok}) AS m_{c}' for c, ok in _valid.items())}, arg_min(section, rank) FILTER ({_valid['name']} AND section IS NOT NULL) AS any_section, arg_min(coalesce(section, ''), rank) FILTER ({_valid['name']}) AS m_section, arg_max({{'name': name, 'email': email, 'phone': phone, 'location': location, 'headline': headline}}, (personal_info_score, -rank)) AS p,
      {', '.join(f'arg_max(ord, ({f}_score, -rank)) AS {f}_from' for f in _others)} FROM rk GROUP BY doc_id), en AS (SELECT *, coalesce({_points("coalesce(m_name, '')", "nullif(m_section, '')", "coalesce(m_email, '')", "coalesce(m_phone, '')", "coalesce(m_location, '')")}, 0) >= 0.25 AS ok FROM mg)
     SELECT doc_id, {', '.join(f'CASE WHEN ok THEN m_{c} ELSE p.{c} END AS {c}' for c in _valid)}, {', '.join(f'{f}_from' for f in _others)} FROM en"""),
}
