"""Rescued sections, adaptive sections and resolved names as queries, with their SQL."""

from __future__ import annotations

from ..functions import contacts
from ..operators import education, parsers, resolve, sections
from .fixtures import VIEWS, _pick, oracle, view
from .sql_text import has, quoted
from .text_queries import _hd, norm_of

READ = ("EDUCATION", "Skills", "Experience", "B.Tech at Hill College, a school of many things", "Python and SQL", "Northwind Labs 2019 - 2021", "Class XII, Valley School", "University of Pune", "Degree", "a line of no great matter at all", "Work History", "GPA 8.1")
HEADER = ("ANA", "silva", "Ana Silva | Engineer", "ana@x.example +1 555 010 0199", "Email: b@x.example", "Contact", "Data engineer of many things • Pune", "github.com/x/y", "Skills", "Oneil", "12 Hill Road", "Chloe van der Berg", "/phone Dev Rao", "", "Ben", "Professional Summary")
SECTIONED = ("header", "header", "skills", "header", "experience", "awards", "publications", "header", "interests", "activities", "references", "header", "courses")
LEARNT = ("Ana Silva", "B.Sc Physics 8.1 CGPA", "Hill College", "male", "ana@x.example B.Tech", "Percentage: 81%", "of many things", "", "Phone: B.E Civil", "91 %", "University of Pune", "GPA 7.2", "DOB", "MBA", "Ben Rao")
_no = "row_number() OVER (PARTITION BY o_custkey, o ORDER BY o_orderkey)"
VIEWS |= {
    "reader_lines": f"SELECT o_custkey AS doc_id, CASE WHEN o = 0 THEN 'words' ELSE 'layout' END AS source, CAST(o AS BIGINT) AS ord, CAST({_no} AS BIGINT) AS line_no, {_pick(READ, 'o_orderkey * (1 + 4 * o) + o_custkey')} AS line FROM orders CROSS JOIN (SELECT 0 AS o UNION ALL SELECT 1) z",
    "chosen_reader": "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN 'words' ELSE 'layout' END AS source FROM customer",
    "header_lines": f"SELECT o_custkey AS doc_id, o_orderkey AS line_no, {_pick(HEADER, 'o_orderkey * 3 + o_custkey')} AS line FROM orders",
    "sectioned_lines": f"SELECT o_custkey AS doc_id, o_orderkey AS line_no, CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 7 = 0 THEN 'education' WHEN {_pick(SECTIONED, 'o_orderkey')} = 'courses' AND o_custkey % 3 <> 1 THEN 'header' ELSE {_pick(SECTIONED, 'o_orderkey')} END AS section, {_pick(LEARNT, 'o_orderkey * 7 + o_custkey')} AS line FROM orders",
    "printed_lines": f"SELECT o_custkey AS doc_id, o_orderkey AS line_no, {_pick(READ, 'o_orderkey * 5 + o_custkey')} AS line, (o_orderkey + o_custkey) % 19 = 0 AS is_bold, CASE WHEN o_orderkey % 17 = 0 THEN CAST(14 AS DOUBLE) WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(10 AS DOUBLE) END AS size, CAST(10 AS DOUBLE) AS font_median FROM orders",
}


def rescued_lines(spark, sf_dir):
    return resolve.rescue(view(spark, sf_dir, "reader_lines"), view(spark, sf_dir, "chosen_reader"), sections.heading_dictionary(spark))


def section_split_adaptive(spark, sf_dir):
    return resolve.adaptive_sections(sections.match_headings(view(spark, sf_dir, "printed_lines"), sections.heading_dictionary(spark)))


def name_resolution(spark, sf_dir):
    return resolve.resolve_names(view(spark, sf_dir, "header_lines"), sections.heading_dictionary(spark))


def routed_lines(spark, sf_dir):
    return resolve.route(view(spark, sf_dir, "sectioned_lines"))


QUERIES = {f.__name__: f for f in (rescued_lines, section_split_adaptive, name_resolution, routed_lines)}


def _headed(source: str, column: str, out: str) -> str:
    return f"{out}_n AS (SELECT *, {norm_of(column)} AS norm FROM {source}), {out} AS (SELECT {out}_n.*, CASE WHEN len(string_split({out}_n.norm, ' ')) <= 7 THEN coalesce(a.section, b.section) END AS section FROM {out}_n LEFT JOIN hd a ON {out}_n.norm = a.norm LEFT JOIN hd b ON replace({out}_n.norm, ' ', '') = b.norm)"


_size = lambda c: f"len(list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> ''))"
_school = "(" + " OR ".join(f"contains(lower(line), '{w}')" for w in resolve.SCHOOL_WORDS) + ")"
_connect = ", ".join(f"'{w}'" for w in contacts.CONNECTORS)
_like = lambda t: f"(length({t}) BETWEEN 4 AND 55 AND NOT regexp_matches({t}, '[0-9@/\\\\|:;]') AND len(string_split_regex({t}, '\\s+')) BETWEEN 2 AND 4 AND len(list_filter(string_split_regex({t}, '\\s+'), lambda w: w NOT IN ({_connect}) AND NOT regexp_matches(w, '^\\p{{Lu}}[\\p{{L}}''’.-]*$'))) = 0)"


def _segment(t: str) -> str:
    t = f"trim({t})"
    for pattern, instead in resolve.SEGMENT:
        t = f"regexp_replace({t}, {quoted(pattern)}, '{instead}', 'g')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'), ' |•·:-')"


_contact = " OR ".join(has("trim(line)", resolve.SEGMENT[k][0]) for k in (1, 2, 3))
_told = " OR ".join([has("c", p) for p in (parsers.DEGREE, education.NAMED_GRADE, education.GRADE_FIRST, r"[0-9]+(?:\.[0-9]+)?\s*%$")] + [f"contains(lower(c), '{w}')" for w in parsers.INSTITUTIONS])
_field = "CASE " + " ".join(f"WHEN section = '{x}' THEN '{f}'" for f, xs in resolve.FIELDS.items() for x in xs) + " ELSE section END"
_place = "CASE " + " ".join(f"WHEN section = '{x}' THEN {i}" for xs in resolve.FIELDS.values() for i, x in enumerate(xs)) + " ELSE 0 END"
_split = lambda c: f"string_split_regex({c}, '\\s*[|•·]\\s*')"
_cap = "array_to_string(list_transform(string_split(lower(concat(one, ' ', two)), ' '), lambda w: concat(upper(w[1:1]), w[2:])), ' ')"
_target = "section = 'education'"
ORACLES = {
    "rescued_lines": oracle("reader_lines chosen_reader", f""", {_hd}, {_headed('reader_lines', 'line', 'ml')}, f AS (SELECT *, min(CASE WHEN {_target} THEN line_no END) OVER (PARTITION BY doc_id, source) AS fi FROM ml),
     g AS (SELECT *, min(CASE WHEN line_no > fi AND section <> 'education' THEN line_no END) OVER (PARTITION BY doc_id, source) AS st FROM f), b AS (SELECT * FROM g WHERE line_no >= fi AND (st IS NULL OR line_no < st)),
     q AS (SELECT doc_id, source, min(ord) AS ord, count(*) FILTER (NOT coalesce({_target}, false)) + least(coalesce(sum(CASE WHEN NOT coalesce({_target}, false) THEN {_size('line')} END), 0) / CAST(8 AS DOUBLE), 6) + count(*) FILTER (NOT coalesce({_target}, false) AND {_school}) AS quality FROM b GROUP BY doc_id, source),
     t AS (SELECT q.doc_id, arg_min(q.source, q.ord) AS source FROM q JOIN chosen_reader c USING (doc_id) LEFT JOIN q o ON o.doc_id = q.doc_id AND o.source = c.source WHERE q.source <> c.source AND q.quality > coalesce(o.quality, 0) + 2 GROUP BY q.doc_id),
     k AS (SELECT r.doc_id, r.line_no, r.line FROM reader_lines r JOIN chosen_reader c ON c.doc_id = r.doc_id AND c.source = r.source)
     SELECT doc_id, line_no, line, false AS rescued FROM k UNION ALL SELECT b.doc_id, coalesce((SELECT max(line_no) FROM k WHERE k.doc_id = b.doc_id), 0) + row_number() OVER (PARTITION BY b.doc_id ORDER BY b.line_no), b.line, true FROM b JOIN t ON t.doc_id = b.doc_id AND t.source = b.source"""),
    "section_split_adaptive": oracle("printed_lines", f""", {_hd}, {_headed('printed_lines', 'line', 'ml')}, a AS (SELECT *, CASE WHEN is_bold OR coalesce(size >= font_median * CAST(1.08 AS DOUBLE), false) THEN section END AS own FROM ml),
     b AS (SELECT * FROM (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 'header') AS s FROM a) WHERE own IS NULL),
     c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY line_no) AS n, count(*) OVER (PARTITION BY doc_id, s) AS al FROM b), d AS (SELECT *, s = 'header' AND al > 10 AS again, CASE WHEN s = 'header' AND al > 10 AND n > 6 THEN section END AS own2 FROM c),
     e AS (SELECT *, CASE WHEN again THEN coalesce(last_value(own2 IGNORE NULLS) OVER (PARTITION BY doc_id, s ORDER BY line_no ROWS UNBOUNDED PRECEDING), 'header') ELSE s END AS t FROM d)
     SELECT doc_id, t AS section, CAST(row_number() OVER (PARTITION BY doc_id, t ORDER BY again DESC, line_no) AS INT) AS pos, line FROM e WHERE own2 IS NULL"""),
    "name_resolution": oracle("header_lines", f""", {_hd}, h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM header_lines WHERE trim(line) <> ''), s AS (SELECT doc_id, k, {_segment('line')} AS clean FROM h WHERE k <= 8), {_headed('s', 'clean', 'm')},
     p AS (SELECT *, list_filter(list_transform({_split('clean')}, lambda x: {_segment('x')}), lambda x: {_like('x')})[1] AS found, clean <> '' AND {_size('clean')} <= 2 AND regexp_matches(clean, '^[A-Za-z][A-Za-z\\s.''-]*$') AS short FROM m),
     g AS (SELECT doc_id, arg_min(found, k) FILTER (section IS NULL AND found IS NOT NULL) AS segment, count(*) FILTER (short AND k <= 2) AS n, arg_min(clean, k) AS one, max(CASE WHEN k = 2 THEN clean END) AS two FROM p GROUP BY doc_id), w AS (SELECT *, {_cap} AS pair, trim({_split('one')}[1]) AS f FROM g),
     v AS (SELECT *, CASE WHEN segment IS NOT NULL THEN 'segment' WHEN n = 2 AND {_like('pair')} THEN 'pair' WHEN {_size('f')} <= 5 AND f <> '' THEN 'first' END AS how FROM w)
     SELECT doc_id, CASE how WHEN 'segment' THEN segment WHEN 'pair' THEN pair WHEN 'first' THEN f END AS name, how FROM v"""),
    "routed_lines": oracle("sectioned_lines", f""", x AS (SELECT doc_id, line_no, line, {_field} AS field, {_place} AS p FROM sectioned_lines), h AS (SELECT doc_id, line_no, {_segment('line')} AS c FROM x WHERE field = 'header' AND trim(line) <> '' AND NOT ({_contact}) AND doc_id NOT IN (SELECT doc_id FROM x WHERE field = 'education')),
     i AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM h WHERE c <> '' AND lower(c) NOT IN ('male', 'female', 'dob', 'date of birth') AND NOT ({_like('c')} AND {_size('c')} <= 4) AND ({_told})),
     u AS (SELECT doc_id, line_no, line, field, p FROM x UNION ALL SELECT doc_id, line_no, c, 'education', 0 FROM i WHERE n > 1) SELECT doc_id, field, CAST(row_number() OVER (PARTITION BY doc_id, field ORDER BY p, line_no) AS INT) AS pos, line FROM u"""),
}
