"""Education sections to records, with recursive SQL for their folds."""

from __future__ import annotations

from ..operators import education as ed
from ..operators import parsers
from .fixtures import VIEWS, _pick, view
from .sql_text import before, edges, group, has, quoted, ranged, some

GROUPED = (
    "B.Tech in Computer Science", "Indian Institute of Technology", "CGPA: 8.4/10", "2016 - 2020", "Delhi Public School", "12th, CBSE 2014", "Pune, India", "92 %", "M.Sc Physics 2021", "University of Pune, Master of Arts", "8.1 CGPA",
    "Class of champions", "Aug 2012 – May 2014", "Thesis: on birds", "Diploma - Fine Arts 7.5", "77/100", "Hill College | MBA in Finance | 2014 - 2016 | CGPA 7.9", "BCA | Lake Academy | Open Learning Centre | 81% Marks",
    "Music | Dance | Drama", "Remote", "Jan 2019 - Present", "B.E Mechanical 8.25", "| 2011 - 2013 | HSC | Valley School | Score: 88%", "Lake Academy, Associate Diploma - Design",
)
TABLE = (
    "B.Tech Indian Institute of Technology [8.4] [2020]", "HSC Delhi Public School [92%] [2016]", "Senior School", "M.Sc in Physics 2018 - 2020 CGPA: 8.1", "Hill College May 2015", "of the North", "MBA in Finance [7.2] [", "Grade: 9 2017",
)
ROWS = (
    "2016 - 2020 B.TechinComputerScience GraphicEra University 8.4/10", "Jan 2014 - Present MBA (Finance) Hill College 7.9", "2012-2014 Senior Secondary Delhi PublicSchool 92%", "2010 - 2012 nothing to see", "Mar2008 – Jun2010 Diploma in Arts, Lake Academy, 77.5%",
    "University of Pune", "2011 - 2013 Intermediate Valley School 88",
)
_no = "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)"
VIEWS |= {
    "education_groups_lines": f"SELECT o_custkey AS doc_id, CAST({_no} AS BIGINT) AS line_no, {_pick(GROUPED, 'o_orderkey * 7 + o_custkey')} AS line FROM orders",
    "education_sections": f"""SELECT o_custkey AS doc_id, CAST({_no} AS BIGINT) AS line_no, CASE o_custkey % 4 WHEN 0 THEN CASE WHEN o_orderkey % 11 = 0 OR {_no} = 1 THEN 'Degree/Certificate, Institute and Year' ELSE {_pick(TABLE, 'o_orderkey + o_custkey')} END
        WHEN 1 THEN {_pick(ROWS, 'o_orderkey + o_custkey')} ELSE {_pick(GROUPED, 'o_orderkey * 7 + o_custkey')} END AS line FROM orders""",
}


def education_tables(spark, sf_dir):
    return ed.table_rows(view(spark, sf_dir, "education_sections"))


def education_records(spark, sf_dir):
    lines = view(spark, sf_dir, "education_groups_lines")
    return ed.group_records(parsers.education_groups(lines), lines=lines)


def education_entries(spark, sf_dir):
    return ed.education_entries(view(spark, sf_dir, "education_sections"))


QUERIES = {f.__name__: f for f in (education_tables, education_records, education_entries)}

_named, _first = ed.NAMED_GRADE, ed.GRADE_FIRST
_school = lambda t: "(" + " OR ".join(f"contains(lower({t}), '{w}')" for w in parsers.SCHOOLS) + ")"
_place = lambda t: (
    f"(len(list_filter(string_split_regex(trim({t}), '\\s+'), lambda w: w <> '')) BETWEEN 1 AND 4 AND NOT {has(t, '(?i)\\b(?:' + '|'.join(parsers.ORGANISATIONS) + ')\\b')} AND (list_contains([{', '.join(map(quoted, parsers.PLACES))}], lower(trim({t})))"
    f" OR {has(f'trim({t})', '^[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)?,\\s*(?:[A-Z]{2,3}|[A-Z][a-z]+)')}))"
)
_inside = r"(?i)\bin\s+(.+)$"


def groups_sql(lines: str) -> str:
    """Tables ending in `eg` (doc_id, line_no, line, entry) of the source's lines, with the dates already read (ln)."""
    rest = "CASE WHEN strpos(line, start) > 0 THEN line[1:strpos(line, start) - 1] ELSE replace(line, right(line, 1), '') END"
    grade = f"({has('line', f'(?i)(?:{parsers.GRADE_NAMES})[:\\s]*[0-9.]+')} OR {has('line', f'(?i)[0-9.]+(?:\\s*/\\s*[0-9.]+)?%?\\s*(?:{parsers.GRADE_NAMES})')})"
    return f"""src AS (SELECT doc_id, line_no, trim(line) AS line FROM ({lines}) WHERE trim(line) <> ''), {ranged('src', 'line', 'ln')},
 fe AS (SELECT doc_id, line_no, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k, {has('line', parsers.DEGREE)} AS d, {_school('line')} AS s, {grade} AS g, coalesce(form IS NOT NULL AND trim({rest}) = '', false) AS pure,
  form IS NULL AND NOT {has('line', parsers.DEGREE)} AND NOT {grade} AND NOT {has('line', '[0-9]+(?:\\.[0-9]+)?\\s*%\\s*$')} AND {has('line', '^\\p{Lu}')} AS o FROM ln),
 nx AS (SELECT *, (g AND NOT d AND NOT s) OR pure AS stays FROM fe),
 gr AS (SELECT doc_id, k, [0] AS out, d AS cd, s AS cs, 1 AS size, o AS lo, d AS ld, s AS ls FROM nx WHERE k = 1 UNION ALL
  SELECT doc_id, k, CASE WHEN opens AND lo AND size > 1 THEN list_concat(out[1:len(out) - 1], [out[len(out)] + 1, out[len(out)] + 1]) WHEN opens AND lo THEN list_append(out, out[len(out)]) WHEN opens THEN list_append(out, out[len(out)] + 1) ELSE list_append(out, out[len(out)]) END,
   CASE WHEN opens AND lo THEN ld OR d WHEN opens THEN d ELSE cd OR d END, CASE WHEN opens AND lo THEN ls OR s WHEN opens THEN s ELSE cs OR s END, CASE WHEN opens AND lo THEN 2 WHEN opens THEN 1 ELSE size + 1 END, o, d, s
  FROM (SELECT gr.doc_id, nx.k, gr.out, gr.cd, gr.cs, gr.size, gr.lo, gr.ld, gr.ls, nx.d, nx.s, nx.o, NOT nx.stays AND CASE WHEN nx.d AND NOT nx.s THEN gr.cd WHEN nx.s AND NOT nx.d THEN gr.cs ELSE false END AS opens
   FROM gr JOIN nx ON nx.doc_id = gr.doc_id AND nx.k = gr.k + 1)),
 ou AS (SELECT doc_id, arg_max(out, k) AS out FROM gr GROUP BY doc_id), eg AS (SELECT nx.doc_id, line_no, line, CAST(out[nx.k] AS BIGINT) AS entry FROM nx JOIN ou USING (doc_id))"""


def _studied(t: str) -> tuple[str, str]:
    dash = r"\s+[–—-]\s+(.+)$"
    dashed = f"({has(t, dash)} AND {has(before(t, dash), parsers.DEGREE)})"
    return (
        f"CASE WHEN {has(t, _inside)} THEN {some(before(t, _inside))} WHEN {dashed} THEN {some(before(t, dash))} ELSE {t} END",
        f"CASE WHEN {has(t, _inside)} THEN trim(regexp_extract({t}, {quoted(_inside)}, 1)) WHEN {dashed} THEN trim(regexp_extract({t}, {quoted(dash)}, 1)) END",
    )


def records_sql(out: str = "er") -> str:
    """Tables ending in `out` (doc_id, entry and the record) from eg."""
    kept = f"SELECT * FROM eg WHERE NOT {has('line', ed.SAYS_NOTHING)}"
    in_degree, in_field = f"CASE WHEN {has('rest', _inside)} THEN {some(before('rest', _inside))} ELSE rest END", group("rest", _inside, 1)
    strip = f"CASE WHEN {has('rest', _named)} THEN {edges(f'regexp_replace(rest, {quoted(_named)}, {quoted('')}, {quoted('g')})')} WHEN {has('rest', _first)} THEN {edges(f'regexp_replace(rest, {quoted(_first)}, {quoted('')}, {quoted('g')})')} WHEN sure IS NOT NULL THEN '' ELSE rest END"
    behind = "trim(t[length(" + before("t", parsers.DEGREE) + ") + 1:], ' ,-')"
    institutions = "(" + " OR ".join(f"contains(lower(t), '{w}')" for w in parsers.INSTITUTIONS) + ")"
    wd, wf = _studied("t")
    rd, rf = _studied("behind")
    return f"""bp AS (SELECT doc_id, line_no, list_filter(list_transform(string_split(line, '|'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM eg WHERE len(string_split(line, '|')) > 2),
 bu AS (SELECT doc_id, line_no, unnest(parts) AS part, unnest(range(len(parts))) AS no FROM bp WHERE len(parts) > 2), {ranged('bu', 'part', 'bd')},
 bf AS (SELECT * EXCLUDE (rest), CASE WHEN trim(rest) = '' THEN part ELSE trim(rest) END AS rest, trim(coalesce({group('part', _named, 2)}, {group('part', _first, 1)})) AS grade,
  form IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, line_no, form IS NOT NULL ORDER BY no) = 1 AS first_date FROM bd),
 bk AS (SELECT *, CASE WHEN first_date THEN 'date' WHEN grade IS NOT NULL THEN 'grade' WHEN {has('rest', parsers.DEGREE)} THEN 'degree' WHEN {_school('rest')} THEN 'school' ELSE 'left' END AS kind FROM bf),
 bo AS (SELECT *, {in_degree} AS pd, {in_field} AS pf, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY kind = 'left', no) AS k FROM bk),
 br AS (SELECT doc_id, line_no, k, CASE WHEN kind = 'school' THEN rest END AS i, CASE WHEN kind IN ('degree') THEN pd WHEN kind = 'left' THEN rest END AS d, CASE WHEN kind = 'degree' THEN pf END AS f, CASE WHEN kind = 'grade' THEN grade END AS g, CASE WHEN kind = 'date' THEN [start, "end", CAST(cur AS VARCHAR)] END AS dr FROM bo WHERE k = 1 UNION ALL
  SELECT bo.doc_id, bo.line_no, bo.k, CASE WHEN kind = 'school' OR (kind = 'left' AND d IS NOT NULL AND NOT (f IS NULL AND contains(rest, ' '))) THEN coalesce(i, rest) ELSE i END,
   CASE WHEN kind = 'degree' AND pf IS NOT NULL THEN pd WHEN kind IN ('degree', 'left') THEN coalesce(d, rest) ELSE d END,
   CASE WHEN kind = 'degree' AND pf IS NOT NULL THEN pf WHEN kind = 'degree' AND d IS NOT NULL THEN coalesce(f, rest) WHEN kind = 'left' AND d IS NOT NULL AND f IS NULL AND contains(rest, ' ') THEN rest ELSE f END,
   CASE WHEN kind = 'grade' THEN grade ELSE g END, CASE WHEN kind = 'date' THEN [start, "end", CAST(cur AS VARCHAR)] ELSE dr END FROM br JOIN bo ON bo.doc_id = br.doc_id AND bo.line_no = br.line_no AND bo.k = br.k + 1),
 bb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY k DESC) AS n FROM br) WHERE n = 1 AND (i IS NOT NULL OR d IS NOT NULL) AND (dr IS NOT NULL OR g IS NOT NULL)),
 ke AS ({kept}), {ranged('ke', 'line', 'kd')}, kr AS (SELECT * EXCLUDE (rest), CASE WHEN trim(rest) = '' THEN line ELSE trim(rest) END AS rest FROM kd),
 ks AS (SELECT *, trim(coalesce({group('rest', _named, 2)}, {group('rest', _first, 1)}, CASE WHEN {has('rest', ed.PERCENT)} OR {has('rest', ed.OF_HUNDRED)} THEN rest END)) AS sure FROM kr),
 kb AS (SELECT *, CASE WHEN sure IS NULL AND {has('rest', parsers.DEGREE)} THEN {group('rest', ed.BARE_GRADE, 1)} END AS bare, {strip} AS t1 FROM ks),
 kt AS (SELECT *, CASE WHEN bare IS NOT NULL THEN {edges(f'regexp_replace(rest, {quoted(ed.BARE_GRADE)}, {quoted('')})')} END AS t2 FROM kb),
 lo AS (SELECT doc_id, line_no, 1 AS v, t1 AS t FROM kt UNION ALL SELECT doc_id, line_no, 2, t2 FROM kt WHERE t2 IS NOT NULL), lb AS (SELECT *, {has('t', parsers.DEGREE)} AS isd, {behind} AS behind FROM lo),
 ls AS (SELECT *, CASE WHEN isd AND {institutions} THEN {some(edges(before('t', parsers.DEGREE)))} END AS school, CASE WHEN isd THEN {wd} END AS wd, CASE WHEN isd THEN {wf} END AS wf, {rd} AS rd, {rf} AS rf, {_place('t')} AS place FROM lb),
 se AS (SELECT kt.doc_id, kt.entry, kt.line_no, kt.sure, kt.bare, kt.form, kt.start, kt."end" AS en, kt.cur, a.t AS t1, a.isd AS d1, a.school AS s1, a.wd AS wd1, a.wf AS wf1, a.rd AS rd1, a.rf AS rf1, a.place AS p1, b.t AS t2, b.isd AS d2, b.school AS s2, b.wd AS wd2, b.wf AS wf2, b.rd AS rd2, b.rf AS rf2, b.place AS p2,
   bb.i AS bi, bb.d AS bd, bb.f AS bf, bb.g AS bg, bb.dr AS bdr, bb.doc_id IS NOT NULL AS barred, row_number() OVER (PARTITION BY kt.doc_id, kt.entry ORDER BY kt.line_no) AS k
  FROM kt JOIN ls a ON a.doc_id = kt.doc_id AND a.line_no = kt.line_no AND a.v = 1 LEFT JOIN ls b ON b.doc_id = kt.doc_id AND b.line_no = kt.line_no AND b.v = 2 LEFT JOIN bb ON bb.doc_id = kt.doc_id AND bb.line_no = kt.line_no),
 re AS (SELECT doc_id, entry, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS i, CAST(NULL AS VARCHAR) AS d, CAST(NULL AS VARCHAR) AS f, CAST(NULL AS VARCHAR) AS g, CAST(NULL AS VARCHAR[]) AS dr, false AS done FROM se GROUP BY doc_id, entry UNION ALL
  SELECT doc_id, entry, k, CASE WHEN barred THEN bi WHEN t = '' THEN i WHEN i IS NULL AND s IS NOT NULL THEN s WHEN NOT isd THEN coalesce(i, t) ELSE i END,
   CASE WHEN barred THEN bd WHEN t = '' THEN d WHEN i IS NULL AND s IS NOT NULL THEN rd WHEN isd THEN wd WHEN i IS NOT NULL AND NOT p AND d IS NULL THEN t ELSE d END,
   CASE WHEN barred THEN bf WHEN t = '' OR NOT isd THEN f WHEN i IS NULL AND s IS NOT NULL THEN coalesce(rf, f) ELSE coalesce(wf, f) END, CASE WHEN barred THEN bg ELSE coalesce(sure, g, bare) END, CASE WHEN barred THEN bdr WHEN form IS NULL THEN dr ELSE coalesce(dr, [start, en, CAST(cur AS VARCHAR)]) END, barred
  FROM (SELECT re.doc_id, re.entry, se.k, re.i, re.d, re.f, re.g, re.dr, se.sure, se.bare, se.form, se.start, se.en, se.cur, se.barred, se.bi, se.bd, se.bf, se.bg, se.bdr, re.g IS NULL AND se.bare IS NOT NULL AS x2,
    CASE WHEN x2 THEN t2 ELSE t1 END AS t, CASE WHEN x2 THEN d2 ELSE d1 END AS isd, CASE WHEN x2 THEN s2 ELSE s1 END AS s, CASE WHEN x2 THEN wd2 ELSE wd1 END AS wd, CASE WHEN x2 THEN wf2 ELSE wf1 END AS wf, CASE WHEN x2 THEN rd2 ELSE rd1 END AS rd, CASE WHEN x2 THEN rf2 ELSE rf1 END AS rf, CASE WHEN x2 THEN p2 ELSE p1 END AS p
   FROM re JOIN se ON se.doc_id = re.doc_id AND se.entry = re.entry AND se.k = re.k + 1 WHERE NOT re.done)),
 {out} AS (SELECT doc_id, entry, i AS institution, d AS degree, f AS field_of_study, dr[1] AS start, dr[2] AS "end", CAST(dr[3] AS BOOLEAN) AS is_current, g AS gpa FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, entry ORDER BY k DESC) AS n FROM re) WHERE n = 1 AND (i IS NOT NULL OR d IS NOT NULL))"""


def tables_sql(lines: str) -> str:
    """Tables ending in `tr` (doc_id, line_no and the record)."""
    apart = lambda t: some(f"regexp_replace(regexp_replace(regexp_replace({t}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '\\bin\\b', ' in ', 'g'), '\\s+', ' ', 'g')")
    part = lambda p, k: f"trim(regexp_extract(line, {quoted(p)}, {k}))"
    c, within = ed.CRUSHED_ROW, r"(?i)in\s*(.+)$"
    text = f"CASE WHEN {has('rest', _named)} THEN {edges(f'regexp_replace(rest, {quoted(_named)}, {quoted('')}, {quoted('g')})')} ELSE trim(rest) END"
    return f"""ts AS (SELECT doc_id, line_no, trim(line) AS line, {has('trim(line)', ed.TABLE_HEAD)} AS head FROM ({lines}) WHERE trim(line) <> ''), th AS (SELECT *, max(head) OVER (PARTITION BY doc_id) AS headed FROM ts), tb AS (SELECT * FROM th WHERE NOT head), {ranged('tb', 'line', 'td')},
 tg AS (SELECT doc_id, headed, line_no, line, sum(CASE WHEN contains(line, '[') OR form IS NOT NULL OR NOT headed THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS r FROM td),
 tm AS (SELECT doc_id, headed, min(line_no) AS line_no, string_agg(line, ' ' ORDER BY line_no) AS line FROM tg GROUP BY doc_id, headed, r), {ranged('tm', 'line', 'tx')}, ty AS (SELECT *, {text} AS txt FROM tx),
 tz AS (SELECT *, {has('txt', parsers.DEGREE)} AS isd, CASE WHEN {has('txt', _inside)} THEN {some(before('txt', _inside))} ELSE txt END AS deg, {part(c, 3)} AS cdeg FROM ty),
 tr AS (SELECT doc_id, line_no, {part(ed.BRACKETS, 2)} AS institution, {part(ed.BRACKETS, 1)} AS degree, NULL AS field_of_study, NULL AS start, {part(ed.BRACKETS, 4)} AS "end", false AS is_current, {part(ed.BRACKETS, 3)} AS gpa FROM tz WHERE headed AND {has('line', ed.BRACKETS)}
  UNION ALL SELECT doc_id, line_no, CASE WHEN NOT isd THEN txt END, CASE WHEN isd THEN deg END, CASE WHEN isd THEN trim({group('txt', _inside, 1)}) END, start, "end", cur, trim({group('rest', _named, 2)}) FROM tz WHERE headed AND NOT {has('line', ed.BRACKETS)} AND txt <> '' AND (NOT isd OR deg IS NOT NULL)
  UNION ALL SELECT doc_id, line_no, {apart(edges(part(c, 4)))}, {apart(f"CASE WHEN {has('cdeg', within)} THEN {before('cdeg', within)} ELSE cdeg END")}, {apart(group('cdeg', within, 1))}, {part(c, 1)}, {part(c, 2)}, lower({part(c, 2)}) = 'present', {some(part(c, 5))} FROM tz WHERE NOT headed AND {has('line', c)})"""


_sections = VIEWS["education_sections"]
_record = 'institution, degree, field_of_study, start, "end", is_current, gpa'
ORACLES = {
    "education_tables": f"WITH {tables_sql(_sections)} SELECT doc_id, line_no, {_record} FROM tr",
    "education_records": f"WITH RECURSIVE {groups_sql(VIEWS['education_groups_lines'])}, {records_sql()} SELECT * FROM er",
    "education_entries": f"""WITH RECURSIVE {tables_sql(_sections)}, {groups_sql(f"SELECT * FROM ({_sections}) z WHERE doc_id NOT IN (SELECT doc_id FROM tr)")}, {records_sql()}
     SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS entry, {_record} FROM tr UNION ALL SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY entry) - 1, {_record} FROM er""",
}
#: The grouping alone, for the query of that name.
GROUPS_ORACLE = f"WITH RECURSIVE {groups_sql(VIEWS['education_lines'])} SELECT doc_id, line_no, line, entry FROM eg"
