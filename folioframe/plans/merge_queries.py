"""Entries of several strategies merged to one list each, as queries over whole tables with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candidates, consensus
from .assess_queries import COMPANY, LEVEL, MARK, PLACE, PROJECT, START, STORY, STUDY, TITLE, WEB
from .fixtures import VIEWS, _pick, oracle, view

PHRASE = ("Chess club", "chess  club", "First prize", "FIRST PRIZE!", "", "Go (game)", "Hiking, the hills", "C++ / C#", "c++ / c# ", "Reading of old books in all the libraries of the town")
SITES = ("https://github.com/x/y", "HTTPS://github.com/X/y/", "github.com/x", "github.com/x/", "", "ftp://b.example/", "https://b.example")
STRATEGIES = ("lines", "layout", "blocks")

_blank = lambda c, n, m: f"CASE WHEN ({n}) % {m} = 0 THEN '' ELSE {c} END"
_shown = lambda c, k: {"lines": c, "layout": f"concat(upper({c}), ' ,')", "blocks": f"concat('  ', {c})"}[k]
for _i, _s in enumerate(STRATEGIES):
    _base = f"o_custkey AS doc_id, o_orderkey AS pos, CAST((o_custkey * 7 + {_i} * 31) % 97 AS DOUBLE) / 100 AS score"
    _n = f"o_orderkey + {_i}"
    VIEWS |= {
        f"jobs_{_s}": f"SELECT {_base}, {_blank(_shown(_pick(COMPANY, 'o_orderkey'), _s), _n, 5)} AS company, {_blank(_pick(TITLE, 'o_orderkey * 3 + o_custkey'), _n, 4)} AS title, {_pick(START, f'o_orderkey * 5 + {_i}')} AS start, '2021' AS end_, ({_n}) % 3 AS bullets FROM orders",
        f"degrees_{_s}": f"SELECT {_base}, {_blank(_shown(_pick(PLACE, 'o_orderkey'), _s), _n, 3)} AS institution, {_pick(LEVEL, 'o_orderkey * 3 + o_custkey')} AS degree, {_pick(STUDY, _n)} AS field_of_study, {_pick(START, f'o_orderkey * 5 + {_i}')} AS start, '2021' AS end_, {_pick(MARK, _n)} AS gpa FROM orders",
        f"works_{_s}": f"SELECT {_base}, {_shown(_pick(PROJECT, 'o_orderkey * 3 + o_custkey'), _s)} AS name, {_pick(STORY, f'o_orderkey * 5 + {_i}')} AS description, {_blank(_pick(START, 'o_orderkey'), _n, 3)} AS start, {_blank(chr(39) + 'Python' + chr(39), _n, 2)} AS technology, {_pick(WEB, _n)} AS url FROM orders",
        f"phrases_{_s}": f"SELECT {_base}, {_pick(PHRASE, f'o_orderkey * 3 + {_i}')} AS value FROM orders",
        f"sites_{_s}": f"SELECT {_base}, '{_s}' AS label, {_pick(SITES, f'o_orderkey * 3 + {_i}')} AS url FROM orders",
    }
FIELDS = {"jobs": candidates.experience, "degrees": candidates.education, "works": candidates.projects, "phrases": candidates.phrases, "sites": candidates.links}


def _rows(spark, sf_dir, field):
    return consensus.union_strategies(*[view(spark, sf_dir, f"{field}_{s}") for s in STRATEGIES])


def _merged(spark, sf_dir, field):
    rows = _rows(spark, sf_dir, field)
    chosen = rows.groupBy("doc_id").agg(F.max_by("ord", F.struct("score", (-F.col("ord")).alias("o"))).alias("ord"))
    return candidates.merge_entries(rows, chosen, FIELDS[field]())


def strategy_union(spark, sf_dir):
    return _rows(spark, sf_dir, "jobs").select("doc_id", F.col("ord").cast("long").alias("ord"), "pos", "company", "title", "start", "bullets")


def merged_experience(spark, sf_dir):
    return _merged(spark, sf_dir, "jobs")


def merged_education(spark, sf_dir):
    return _merged(spark, sf_dir, "degrees")


def merged_projects(spark, sf_dir):
    return _merged(spark, sf_dir, "works")


def merged_phrases(spark, sf_dir):
    return _merged(spark, sf_dir, "phrases")


def merged_links(spark, sf_dir):
    return _merged(spark, sf_dir, "sites")


QUERIES = {f.__name__: f for f in (strategy_union, merged_experience, merged_education, merged_projects, merged_phrases, merged_links)}

_text = lambda c: f"nullif(trim(regexp_replace(lower({c}), '[^a-z0-9+.#/]+', ' ', 'g')), '')"
_has = lambda c, n: f"CASE WHEN {c} <> '' THEN {n} ELSE 0 END"
_trim = lambda c: f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def _sql(field: str, columns: str, same: str, hundredths: str, supported: bool) -> str:
    union = " UNION ALL ".join(f"SELECT {i} AS ord, * FROM {field}_{s}" for i, s in enumerate(STRATEGIES))
    kept = "WHERE listed IS NOT NULL OR support >= 2 OR weighted >= 1.6" if supported else ""
    return oracle(" ".join(f"{field}_{s}" for s in STRATEGIES), f""", x AS (SELECT *, {same} AS same, round(({hundredths}) / CAST(100 AS DOUBLE) + score * CAST(0.4 AS DOUBLE), 9) AS worth FROM ({union})),
     ch AS (SELECT doc_id, ord FROM (SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS n FROM x) WHERE n = 1),
     su AS (SELECT doc_id, same, count(*) AS support, round(sum(score), 6) AS weighted FROM (SELECT DISTINCT doc_id, same, ord, score FROM x WHERE same IS NOT NULL) GROUP BY 1, 2),
     be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, same ORDER BY worth DESC, ord, pos) AS n FROM x WHERE same IS NOT NULL) WHERE n = 1),
     fi AS (SELECT * FROM (SELECT doc_id, same, ord AS o, pos AS p, row_number() OVER (PARTITION BY doc_id, same ORDER BY ord, pos) AS n FROM x WHERE same IS NOT NULL) WHERE n = 1),
     li AS (SELECT x.doc_id, same, min(pos) AS listed FROM x JOIN ch ON x.doc_id = ch.doc_id AND x.ord = ch.ord WHERE same IS NOT NULL GROUP BY 1, 2)
     SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY listed NULLS LAST, support + weighted DESC, o, p, same) AS INT) AS rank, support, weighted, {columns}
     FROM su JOIN be USING (doc_id, same) JOIN fi USING (doc_id, same) LEFT JOIN li USING (doc_id, same) {kept}""")


ORACLES = {
    "strategy_union": oracle(" ".join(f"jobs_{s}" for s in STRATEGIES), " UNION ALL ".join(f"SELECT doc_id, CAST({i} AS BIGINT) AS ord, pos, company, title, start, bullets FROM jobs_{s}" for i, s in enumerate(STRATEGIES))),
    "merged_experience": _sql("jobs", "company, title, start, end_, bullets", f"coalesce({_text('company')}, {_text('title')})", f"{_has('company', 30)} + {_has('title', 25)} + {_has('start', 20)} + CASE WHEN bullets > 0 THEN 25 ELSE 0 END", True),
    "merged_education": _sql("degrees", "institution, degree, field_of_study, start, end_, gpa", f"coalesce({_text('institution')}, {_text('degree')})", f"{_has('institution', 35)} + {_has('degree', 25)} + {_has('start', 20)} + {_has('gpa', 20)}", True),
    "merged_projects": _sql("works", "name, description, start, technology, url", f"coalesce({_text('name')}, {_text('description')})", f"{_has('name', 45)} + {_has('description', 40)} + {_has('start', 10)} + CASE WHEN technology <> '' OR url <> '' THEN 5 ELSE 0 END", True),
    "merged_phrases": _sql("phrases", "value", _text("value"), f"CASE WHEN {_trim('value')} = '' THEN 0 ELSE least(len(string_split({_trim('value')}, ' ')) * CAST(12.5 AS DOUBLE), 100) END", False),
    "merged_links": _sql("sites", "label, url", f"nullif(lower(regexp_replace({_trim('url')}, '/+$', '')), '')", "CASE WHEN regexp_matches(url, '^https?://[^/?#]+', 'i') THEN 100 ELSE 30 END", False),
}
