"""Words to lines, boxes, geometry readers, heading evidence, date forms, evaluation results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import evaluation, layout, sections
from .fixtures import VIEWS, _pick, oracle, view
from .text_queries import _hd, norm_of

WORDS = ("Data", "Engineer", "at", "Northwind", ",", "SKILLS", "Python", ".", "2019", "EDUCATION", "built", "Work", ":")
LINES = ("SKILLS", "Work Experience", "built things at Northwind", "EDUCATION AND MORE OF IT ALL", "Projects", "one", "", "Ana Silva", "A VERY LONG LINE OF CAPITALS INDEED")
DATES = ("jan 2020", "September 2018", "03/2021", "2019", "Sept 2017", "", "soon", "12/1999", "MAY 2015")
URLS = ("https://a.example", "https://b.example", "HTTPS://A.example", "https://c.example/x")

VIEWS |= {
    "page_words": f"""SELECT l_suppkey AS doc_id, CAST(l_linenumber AS BIGINT) AS page, l_orderkey * 10 + l_linenumber AS word_no, CAST(40 + (l_orderkey * 37 + l_partkey) % 480 AS DOUBLE) AS x0, CAST(60 + (l_orderkey * 37 + l_partkey) % 480 AS DOUBLE) AS x1,
        CAST((l_orderkey * 13) % 190 AS DOUBLE) * 4 + CAST(l_partkey % 5 AS DOUBLE) AS top, CAST((l_orderkey * 13) % 190 AS DOUBLE) * 4 + CAST(l_partkey % 5 AS DOUBLE) + 8 + CAST(l_quantity % 5 AS DOUBLE) AS bottom,
        {_pick(WORDS, 'l_orderkey + l_partkey')} AS text, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE CAST(300 AS DOUBLE) END AS gap FROM lineitem""",
    "boxes": """SELECT l_orderkey * 10 + l_linenumber AS pair, l_partkey % 2 AS page_a, CAST(l_partkey % 97 AS DOUBLE) AS ax0, CAST((l_partkey * 7) % 89 AS DOUBLE) AS ay0, CAST((l_partkey * 3) % 101 AS DOUBLE) AS ax1, CAST((l_partkey * 5) % 83 AS DOUBLE) AS ay1,
        l_suppkey % 2 AS page_b, CAST(l_orderkey % 97 AS DOUBLE) AS bx0, CAST((l_orderkey * 7) % 89 AS DOUBLE) AS by0, CAST((l_orderkey * 3) % 101 AS DOUBLE) AS bx1, CAST((l_orderkey * 5) % 83 AS DOUBLE) AS by1,
        CASE WHEN l_partkey % 4 = 0 THEN 'CoordOrigin.BOTTOMLEFT' WHEN l_partkey % 4 = 1 THEN 'topleft' WHEN l_partkey % 4 = 2 THEN '' END AS origin FROM lineitem""",
    "readers": """SELECT o_orderkey AS doc_id, s AS source, CAST(o AS BIGINT) AS ord, (o_orderkey * 3 + o) % 5 AS pages, least((o_orderkey + o) % 5, (o_orderkey * 3 + o) % 5) AS pages_with_lines, (o_orderkey * 7 + o * 11) % 90 AS lines, least((o_orderkey * 5 + o) % 90, (o_orderkey * 7 + o * 11) % 90) AS font_lines,
        (o_orderkey + o * 3) % 25 AS blocks, (o_orderkey + o) % 7 AS sections, (o_orderkey * 2 + o) % 10 AS headings, (o_orderkey + o) % 4 AS urls, (o_orderkey + 2 * o) % 6 AS table_skills, least((o_orderkey + o) % 2, (o_orderkey * 3 + o) % 5) AS two_column_pages
        FROM orders CROSS JOIN (SELECT 'docling' AS s, 0 AS o UNION ALL SELECT 'pdfplumber', 1) z""",
    "found_urls": f"""SELECT o_orderkey AS doc_id, s AS source, CAST(o AS BIGINT) AS ord, CAST(p AS BIGINT) AS pos, {_pick(URLS, 'o_orderkey * 3 + o + p * 5')} AS value
        FROM orders CROSS JOIN (SELECT 'docling' AS s, 0 AS o, 0 AS p UNION ALL SELECT 'docling', 0, 1 UNION ALL SELECT 'pdfplumber', 1, 0 UNION ALL SELECT 'pdfplumber', 1, 1 UNION ALL SELECT 'pdfplumber', 1, 2) z""",
    "sized_lines": f"""SELECT l_suppkey AS doc_id, CAST(l_linenumber AS BIGINT) AS page, l_orderkey AS line_no, {_pick(LINES, 'l_orderkey + l_partkey')} AS text, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE CAST(8 + l_quantity % 7 AS DOUBLE) END AS size, l_returnflag = 'R' AS bold FROM lineitem""",
    "written_dates": f"SELECT o_orderkey AS doc_id, {_pick(DATES, 'o_orderkey')} AS raw, CAST(o_orderdate AS DATE) AS start_date, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 900 - 50 AS INT) END AS end_date FROM orders",
    "eval_rows": f"SELECT o_orderkey AS doc_id, concat('sample_', CAST(o_orderkey % 2000 AS STRING)) AS stem, CAST(o_orderkey * 7 % 101 AS DOUBLE) / 100 AS score, {_pick(('skills', 'education', 'experience', 'projects', 'contact'), 'o_orderkey')} AS section FROM orders",
    "eval_meta": f"SELECT concat('sample_', CAST(c_custkey AS STRING)) AS stem, {_pick(('two_column', 'plain', 'scanned'), 'c_custkey')} AS archetype FROM customer",
}


def words_to_lines(spark, sf_dir):
    return layout.words_to_lines(view(spark, sf_dir, "page_words"))


def box_relations(spark, sf_dir):
    b = view(spark, sf_dir, "boxes")
    box = lambda s: F.struct(F.col(f"page_{s}").alias("page"), *[F.col(f"{s}{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])
    x = b.select("pair", box("a").alias("a"), box("b").alias("b"))
    a, c = F.col("a"), F.col("b")
    return x.select("pair", layout.box_area(a).alias("area"), layout.box_contains(a, c).alias("holds"), layout.boxes_overlap(a, c).alias("meets"))


def box_origin(spark, sf_dir):
    top, bottom = layout.box_from_top(F.col("ay0"), F.col("ay1"), F.col("origin"), F.lit(800.0))
    return view(spark, sf_dir, "boxes").select("pair", top.alias("top"), bottom.alias("bottom"))


def reader_scores(spark, sf_dir):
    return layout.reader_scores(view(spark, sf_dir, "readers")).select("doc_id", "source", "coverage", "score")


def best_reader(spark, sf_dir):
    return layout.best_reader(layout.reader_scores(view(spark, sf_dir, "readers")))


def merge_reader_urls(spark, sf_dir):
    return layout.merge_found(best_reader(spark, sf_dir), view(spark, sf_dir, "found_urls"), fold=False)


def merge_reader_skills(spark, sf_dir):
    return layout.merge_found(best_reader(spark, sf_dir), view(spark, sf_dir, "found_urls"), fold=True)


def _headed(spark, sf_dir):
    return sections.match_headings(view(spark, sf_dir, "sized_lines").withColumn("line", F.col("text")), sections.heading_dictionary(spark))


def likely_headings(spark, sf_dir):
    return layout.likely_headings(_headed(spark, sf_dir), F.col("section").isNotNull()).select("doc_id", "page", "line_no", "text", "likely")


def heading_evidence(spark, sf_dir):
    lines = _headed(spark, sf_dir).withColumn("median", F.coalesce(F.median("size").over(Window.partitionBy("doc_id", "page")), F.lit(10.0)))
    return layout.heading_evidence(lines.filter("section IS NOT NULL")).select("doc_id", "page", "line_no", "text", "section", "score")


def date_normalize(spark, sf_dir):
    return view(spark, sf_dir, "written_dates").select("doc_id", dates.normalize_date(F.col("raw")).alias("token"))


def duration_years(spark, sf_dir):
    return view(spark, sf_dir, "written_dates").select("doc_id", dates.duration_years(F.col("start_date"), F.col("end_date")).alias("years"))


def failure_metadata(spark, sf_dir):
    return evaluation.with_metadata(view(spark, sf_dir, "eval_rows"), view(spark, sf_dir, "eval_meta"))


QUERIES = {f.__name__: f for f in (words_to_lines, box_relations, box_origin, reader_scores, best_reader, merge_reader_urls, merge_reader_skills, likely_headings, heading_evidence, date_normalize, duration_years, failure_metadata)}

_d = lambda x: f"CAST({x} AS DOUBLE)"
_cover = f"CASE WHEN pages > 0 THEN pages_with_lines / {_d('pages')} ELSE {_d(0)} END"
_fonts = f"CASE WHEN lines > 0 THEN font_lines / {_d('lines')} ELSE {_d(0)} END"
_points = " + ".join(f"least({c}, {most}) * {w}" for c, (w, most) in layout.READER_POINTS.items())
_points += " + CASE WHEN source = 'docling' AND table_skills > 0 THEN 120 ELSE 0 END + CASE WHEN source = 'pdfplumber' AND two_column_pages > 0 THEN 90 ELSE 0 END + CASE WHEN source = 'pdfplumber' AND lines > 0 AND font_lines * 4 >= lines * 3 THEN 60 ELSE 0 END"
_p, _l = "greatest(pages, 1)", "greatest(lines, 1)"
_parts = f"(({_points}) * {_p} * {_l} + (CASE WHEN pages > 0 THEN pages_with_lines ELSE 0 END * 300 + two_column_pages * 150) * {_l} + CASE WHEN lines > 0 THEN font_lines ELSE 0 END * 90 * {_p})"
_score = f"(({_parts} * 2 + {_p} * {_l} * 3) // ({_p} * {_l} * 6)) / {_d(1000)}"
_best = f", sc AS (SELECT *, {_score} AS score FROM readers), be AS (SELECT doc_id, source, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sections DESC, headings DESC, lines DESC, blocks DESC, ord) AS n FROM sc) WHERE n = 1)"
_merged = lambda v: f"""{_best}, it AS (SELECT f.doc_id, f.value, row_number() OVER (PARTITION BY f.doc_id ORDER BY f.source <> b.source, f.ord, f.pos) AS k FROM found_urls f JOIN be b USING (doc_id)),
 fi AS (SELECT doc_id, min(k) AS k, arg_min(value, k) AS value FROM it GROUP BY doc_id, {v}) SELECT doc_id, string_agg(value, '; ' ORDER BY k) AS values FROM fi GROUP BY doc_id"""  # noqa: E731
_median = "median(size) OVER (PARTITION BY doc_id, page)"
_count = "len(string_split_regex(trim(text), '\\s+'))"
_headed_sql = f", {_hd}, ht AS (SELECT *, {norm_of('text')} AS norm FROM sized_lines), hl AS (SELECT ht.*, CASE WHEN len(string_split(ht.norm, ' ')) <= 7 THEN coalesce(a.section, b.section) END AS section FROM ht LEFT JOIN hd a ON ht.norm = a.norm LEFT JOIN hd b ON replace(ht.norm, ' ', '') = b.norm)"

ORACLES = {
    "words_to_lines": f"""WITH RECURSIVE w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY top, x0, word_no) AS k FROM ({VIEWS['page_words']})),
     r AS (SELECT doc_id, page, k, CAST(0 AS INT) AS line, top AS t, greatest((bottom - top) * CAST(0.55 AS DOUBLE), 2.5) AS tol, CAST(1 AS DOUBLE) AS n, (x0 + x1) / 2 AS c FROM w WHERE k = 1
      UNION ALL SELECT doc_id, page, k, CASE WHEN j THEN line ELSE line + 1 END, CASE WHEN j THEN (t * (n + 1) + top) / (n + 2) ELSE top END, CASE WHEN j THEN tol ELSE greatest((bottom - top) * CAST(0.55 AS DOUBLE), 2.5) END, CASE WHEN j THEN n + 1 ELSE 1 END, CASE WHEN j THEN c + m ELSE m END
       FROM (SELECT w.doc_id, w.page, w.k, r.line, r.t, r.tol, r.n, r.c, w.top, w.bottom, (w.x0 + w.x1) / 2 AS m, abs(w.top - r.t) <= r.tol AND (w.gap IS NULL OR (r.c / r.n < w.gap) = ((w.x0 + w.x1) / 2 < w.gap)) AS j FROM r JOIN w ON w.doc_id = r.doc_id AND w.page = r.page AND w.k = r.k + 1))
     SELECT doc_id, page, line, min(x0) AS x0, max(x1) AS x1, min(top) AS top, max(bottom) AS bottom, count(*) AS n_words, regexp_replace(string_agg(text, ' ' ORDER BY x0, top, word_no), '\\s+([,.:;!?])', '\\1', 'g') AS text FROM w JOIN r USING (doc_id, page, k) GROUP BY doc_id, page, line""",
    "box_relations": oracle("boxes", """SELECT pair, abs((ax1 - ax0) * (ay1 - ay0)) AS area, page_a = page_b AND least(ax0, ax1) <= least(bx0, bx1) AND least(ay0, ay1) <= least(by0, by1) AND greatest(ax0, ax1) >= greatest(bx0, bx1) AND greatest(ay0, ay1) >= greatest(by0, by1) AS holds,
     page_a = page_b AND greatest(least(ax0, ax1), least(bx0, bx1)) <= least(greatest(ax0, ax1), greatest(bx0, bx1)) AND greatest(least(ay0, ay1), least(by0, by1)) <= least(greatest(ay0, ay1), greatest(by0, by1)) AS meets FROM boxes"""),
    "box_origin": oracle("boxes", """, f AS (SELECT pair, ay0, ay1, origin ILIKE '%bottom%' OR ((origin IS NULL OR origin = '') AND ay0 > ay1) AS low FROM boxes)
     SELECT pair, CASE WHEN low THEN 800 - greatest(ay0, ay1) ELSE least(ay0, ay1) END AS top, CASE WHEN low THEN 800 - least(ay0, ay1) ELSE greatest(ay0, ay1) END AS bottom FROM f"""),
    "reader_scores": oracle("readers", f"SELECT doc_id, source, round({_cover}, 3) AS coverage, {_score} AS score FROM readers"),
    "best_reader": oracle("readers", f"{_best} SELECT * FROM be"),
    "merge_reader_urls": oracle("readers found_urls", _merged("value")),
    "merge_reader_skills": oracle("readers found_urls", _merged("lower(value)")),
    "likely_headings": oracle("sized_lines", f"{_headed_sql} SELECT doc_id, page, line_no, text, trim(text) <> '' AND (coalesce(size >= {_median} * CAST(1.08 AS DOUBLE) AND {_count} <= 6, false) OR (NOT regexp_matches(text, '[a-z]') AND {_count} <= 5) OR section IS NOT NULL) AS likely FROM hl"),
    "heading_evidence": oracle("sized_lines", f"{_headed_sql}, m AS (SELECT *, coalesce({_median}, 10) AS md FROM hl) SELECT doc_id, page, line_no, text, section, (45 + CASE WHEN size >= md * CAST(1.05 AS DOUBLE) THEN 30 ELSE 0 END + CASE WHEN bold THEN 15 ELSE 0 END + CASE WHEN {_count} <= 4 THEN 10 ELSE 0 END) / CAST(100 AS DOUBLE) AS score FROM m WHERE section IS NOT NULL"),
    "date_normalize": oracle("written_dates", """SELECT doc_id, CASE WHEN regexp_matches(raw, '^[A-Za-z]{3,9} [0-9]{4}$') THEN upper(raw[1:1]) || lower(raw[2:3]) || ' ' || right(raw, 4)
     WHEN raw LIKE '__/____' THEN strftime(make_date(2000, CAST(left(raw, 2) AS INT), 1), '%b') || ' ' || right(raw, 4) ELSE raw END AS token FROM written_dates"""),
    "duration_years": oracle("written_dates", "SELECT doc_id, CASE WHEN end_date >= start_date THEN CAST(end_date - start_date AS DOUBLE) / CAST(365.25 AS DOUBLE) WHEN end_date < start_date THEN CAST(0 AS DOUBLE) END AS years FROM written_dates"),
    "failure_metadata": oracle("eval_rows eval_meta", """SELECT e.doc_id, e.stem, e.section, m.archetype, e.score < CASE e.section WHEN 'contact' THEN CAST(1 AS DOUBLE) WHEN 'experience' THEN CAST(0.9 AS DOUBLE) WHEN 'education' THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.85 AS DOUBLE) END AS failed FROM eval_rows e LEFT JOIN eval_meta m USING (stem)"""),
}
