"""Text quality, language, contacts, masking, sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contacts
from ..functions.text import ENGLISH_WORDS
from ..operators import quality, sections, signatures
from .fixtures import oracle, view
from .signature_sql import COUNTS, signed


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def line_quality_stats(spark, sf_dir):
    return quality.line_statistics(quality.text_lines(_docs(spark, sf_dir)))


def language_gate(spark, sf_dir):
    return quality.language_gate(_docs(spark, sf_dir))


def candidate_score(spark, sf_dir):
    return quality.candidate_scores(view(spark, sf_dir, "resume_lines").withColumn("line_no", F.col("line_no") - 1))


def select_candidate(spark, sf_dir):
    scored = quality.candidate_scores(view(spark, sf_dir, "resume_lines").withColumn("line_no", F.col("line_no") - 1))
    both = scored.withColumn("ord", F.lit(0)).withColumn("source", F.lit("reader")).unionByName(scored.withColumn("score", F.round(F.round(F.col("score") * F.when(F.col("doc_id") % 2 == 0, 1.1).otherwise(0.9), 9), 3)).withColumn("ord", F.lit(1)).withColumn("source", F.lit("layout")))
    return quality.best_candidate(both, "doc_id", "score", "core_sections", "headings", "contact_signals").select("doc_id", "source", "score")


def input_quality_gate(spark, sf_dir):
    lines = view(spark, sf_dir, "resume_lines")
    pages = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % 3).alias("page_count"))
    return quality.input_gate(lines, pages)


def corpus_tags(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return quality.corpus_tags(docs.select("doc_id", (F.col("doc_id") % 4 + 1).alias("page_count"), F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("word_count"), F.length("text").alias("char_count")))


def truth_status(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").dropDuplicates(["doc_id"])
    return _docs(spark, sf_dir).join(labels, "doc_id", "left").select("doc_id", F.when(F.col("quality").isNull(), "missing").when(F.col("quality") == 0, "template_only").otherwise("labeled").alias("status"))


def email_extract(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", contacts.email(F.col("text")).alias("email")).filter("email IS NOT NULL")


def phone_extract(spark, sf_dir):
    return view(spark, sf_dir, "candidates").select("cand_id", contacts.phone(F.concat_ws(" ", "email", "phone")).alias("phone"))


def name_like(spark, sf_dir):
    x = view(spark, sf_dir, "candidates").withColumn("name", F.when(F.col("cand_id") % 5 == 0, F.lower("name")).when(F.col("cand_id") % 7 == 0, F.concat("name", F.lit(" 3"))).otherwise(F.col("name")))
    return x.select("cand_id", contacts.looks_like_name(F.col("name")).alias("is_name"))


def _masked(how):
    def query(spark, sf_dir):
        c = view(spark, sf_dir, "candidates")
        return c.select("cand_id", contacts.mask_name(F.col("name"), how).alias("name"), contacts.mask_email(F.col("email"), how).alias("email"), contacts.mask_phone(F.col("phone"), how).alias("phone"))

    return query


def url_links(spark, sf_dir):
    x = view(spark, sf_dir, "links").filter("url <> ''")
    return x.select("doc_id", "pos", contacts.link_label(F.col("url")).alias("label"))


def page_hosts(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", F.lower(F.regexp_extract("url", "^https?://([^/?#]+)", 1)).alias("host")).groupBy("host").agg(F.count(F.lit(1)).alias("pages"))


def heading_exact(spark, sf_dir):
    return sections.match_headings(view(spark, sf_dir, "resume_lines"), sections.heading_dictionary(spark)).filter("section IS NOT NULL").select("doc_id", "line_no", "section")


def heading_fuzzy(spark, sf_dir):
    return sections.match_fuzzy(view(spark, sf_dir, "resume_lines"), sections.fuzzy_dictionary(spark)).filter("fuzzy_section IS NOT NULL").select("doc_id", "line_no", F.col("fuzzy_section").alias("section"))


def section_forward_fill(spark, sf_dir):
    marked = sections.match_headings(view(spark, sf_dir, "resume_lines"), sections.heading_dictionary(spark))
    return sections.fill_sections(marked).select("doc_id", "line_no", F.col("in_section").alias("section"))


def section_sizes(spark, sf_dir):
    return section_forward_fill(spark, sf_dir).groupBy("section").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("doc_id").alias("documents"))


def block_features(spark, sf_dir):
    return signatures.block_features(view(spark, sf_dir, "resume_lines"))


def section_signature(spark, sf_dir):
    return signatures.section_scores(block_features(spark, sf_dir)).select("doc_id", *[f"{k}_score" for k in signatures.KINDS], "best_section", "best_score")


QUERIES = {f.__name__: f for f in (line_quality_stats, language_gate, candidate_score, select_candidate, input_quality_gate, corpus_tags, truth_status, email_extract, phone_extract, name_like, url_links, page_hosts, heading_exact, heading_fuzzy, section_forward_fill, section_sizes, block_features, section_signature)}
QUERIES |= {f"pii_mask_{h}": _masked(h) for h in ("mask", "redact", "pseudonym", "partial")}

_LINES = r"ln AS (SELECT doc_id, trim(regexp_replace(u, '^\s+|\s+$', '', 'g')) AS line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS u FROM documents)), l AS (SELECT doc_id, line, len(list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> '')) AS nw FROM ln WHERE line <> '')"
_BAD = r"((length(line) >= 30 AND NOT contains(line, ' ')) OR (regexp_matches(line, '\p{L}') AND length(regexp_replace(line, '[\p{L}\p{N}\s.,:/&()\-+%#@]', '', 'g')) / length(line) > 0.12))"
_words = ", ".join(f"'{w}'" for w in ENGLISH_WORDS)
_flat = sections.listed_headings()
_compact = {h.replace(" ", ""): s for h, s in _flat.items()} | _flat
_hd = "hd(norm, section) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _compact.items()) + ")"
norm_of = lambda c: rf"trim(regexp_replace(strip_accents(lower(regexp_replace(regexp_replace({c}, '^[\s•▪●\-–—*#>]*(?:\d{{1,2}}[.)]\s*)?', ''), '[\s:.\-–—_|]+$', ''))), '[^a-z0-9_&+]+', ' ', 'g'))"
_norm = f"nl AS (SELECT *, {norm_of('line')} AS norm FROM resume_lines)"
_match = """ml AS (SELECT nl.doc_id, nl.line_no, nl.line, CASE WHEN len(string_split(nl.norm, ' ')) <= 7 THEN coalesce(a.section, b.section) END AS section FROM nl LEFT JOIN hd a ON nl.norm = a.norm LEFT JOIN hd b ON replace(nl.norm, ' ', '') = b.norm)"""
_core = ", ".join(f"'{c}'" for c in sections.CORE_SECTIONS)
_cand = f""", {_hd}, {_norm}, {_match}, st AS (SELECT doc_id, count(*) AS n, sum(len(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> ''))) AS w, count(DISTINCT section) AS h, count(DISTINCT CASE WHEN section IN ({_core}) THEN section END) AS core,
 avg(CAST({_BAD} AS INT)) AS bad, avg(CASE WHEN len(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '')) <= 2 THEN 1 ELSE 0 END) AS sh, 1 - count(DISTINCT line) / count(*) AS dup,
 count(*) FILTER (WHERE line_no <= 8 AND (contains(line, '@') OR regexp_matches(line, '\\+?\\d[\\d\\s\\-()]{{8,}}\\d') OR regexp_matches(line, '(?i)linkedin|github|email|phone|mobile'))) AS cs FROM ml GROUP BY doc_id),
 sc AS (SELECT doc_id, h, core, cs, round(greatest(least(n / 30, 1) * CAST(0.18 AS DOUBLE) + least(w / 220, 1) * CAST(0.22 AS DOUBLE) + least(core / 4, 1) * CAST(0.24 AS DOUBLE) + least(h / 6, 1) * CAST(0.12 AS DOUBLE) + (1 - sh) * CAST(0.08 AS DOUBLE) + (1 - dup) * CAST(0.05 AS DOUBLE) + least(cs / 3, 1) * CAST(0.10 AS DOUBLE) - bad * CAST(0.20 AS DOUBLE), 0)::DECIMAL(18, 9), 3)::DOUBLE AS score FROM st)"""


def _fuzzy_values():
    from itertools import combinations

    best = {}
    for rank, (h, s) in enumerate(_flat.items()):
        parts = sorted({t for t in h.split() if len(t) > 2})
        for k in range(1, min(4, len(parts)) + 1):
            if k / len(parts) >= 0.75:
                for sub in combinations(parts, k):
                    best.setdefault(" ".join(sub), []).append((-k / len(parts), rank, s))
    return ", ".join(f"('{k}', '{min(v)[2]}')" for k, v in best.items())


_blocks = f"bl AS (SELECT doc_id, list(line ORDER BY line_no) AS lines FROM resume_lines GROUP BY doc_id), {signed('bl', 'sg')}"
_D = lambda v: f"CAST({v} AS DOUBLE)"
_lang = f"""x AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda u: trim(u)), lambda u: u <> ''), ' ') AS b FROM documents),
 y AS (SELECT doc_id, b, length(regexp_replace(b, '[^\\x{{0900}}-\\x{{097F}}\\x{{0600}}-\\x{{06FF}}\\x{{0400}}-\\x{{04FF}}\\x{{3040}}-\\x{{30FF}}\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}]', '', 'g')) AS f, length(regexp_replace(b, '\\P{{L}}', '', 'g')) AS a, length(regexp_replace(b, '[^A-Za-z]', '', 'g')) AS l, list_slice(regexp_extract_all(b, '[A-Za-z][A-Za-z0-9+#./&-]*'), 1, 250) AS w FROM x),
 z AS (SELECT *, CASE WHEN a > 0 THEN l / a ELSE 0 END AS lr, CASE WHEN a > 0 THEN f / a ELSE 0 END AS fr, len(list_filter(w, lambda q: lower(q) IN ({_words}))) AS h, len(w) AS n FROM y),
 v AS (SELECT *, round(least(1, lr * {_D(.75)} + least(CASE WHEN n > 0 THEN h / n * 5 ELSE 0 END, {_D(.25)})), 3) AS c, b = '' AS e, f >= 8 AND fr >= 0.05 AS o, lr >= 0.92 AND (h >= 4 OR n <= 25) AS p, lr >= 0.97 AS q FROM z)
 SELECT doc_id, CASE WHEN e THEN 'Unknown' WHEN o THEN 'Non-English' WHEN p OR q THEN 'English' ELSE 'Uncertain' END AS language, CAST(CASE WHEN e THEN 0 WHEN o THEN round(greatest(fr, {_D(.85)}), 3) WHEN p THEN greatest(c, {_D(.9)}) WHEN q THEN greatest(c, {_D(.88)}) ELSE c END AS DOUBLE) AS confidence, (NOT e AND NOT o AND (p OR q)) AS supported FROM v"""
_gate = f""", {_hd}, {_norm}, {_match}, pg AS (SELECT c_custkey AS doc_id, c_custkey % 3 AS pc FROM customer), st AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE length(line) <= 2) AS sh, count(*) FILTER (WHERE {_BAD}) AS bd, count(DISTINCT CASE WHEN section IN ({_core}) THEN section END) AS c0, coalesce(bool_or(section = 'header'), false) AS hd_, coalesce(bool_or(section IN ('experience','education','skills')), false) AS mn FROM ml GROUP BY doc_id),
 j AS (SELECT pg.doc_id, pc, coalesce(n, 0) AS n, coalesce(sh, 0) AS sh, coalesce(bd, 0) AS bd, coalesce(c0, 0) + CASE WHEN coalesce(n, 0) > 0 AND NOT coalesce(hd_, false) THEN 1 ELSE 0 END AS core, coalesce(mn, false) AS mn FROM pg LEFT JOIN st USING (doc_id)),
 k AS (SELECT *, CASE WHEN pc > 0 THEN round(CASE WHEN n / pc < 4 THEN {_D(.55)} ELSE 0 END + CASE WHEN n <= pc * 2 THEN {_D(.25)} ELSE 0 END + CASE WHEN sh >= greatest(4, pc * 2) THEN {_D(.15)} ELSE 0 END + CASE WHEN n >= 12 AND core <= 1 THEN {_D(.05)} ELSE 0 END, 3) ELSE 0 END AS sl,
 CASE WHEN n > 0 THEN round(least(bd / n + CASE WHEN n >= 18 AND core <= 1 THEN {_D(.12)} ELSE 0 END + CASE WHEN n >= 18 AND NOT mn THEN {_D(.1)} ELSE 0 END, 1), 3) ELSE 0 END AS m, CASE WHEN n > 0 THEN round(least(core / 4, 1), 3) ELSE 0 END AS g FROM j),
 r AS (SELECT *, CASE WHEN pc > 0 AND n = 0 THEN 'image_only' WHEN sl >= 0.8 THEN 'scanned' WHEN m >= 0.55 AND n < 20 THEN 'malformed' WHEN m >= 0.6 AND g <= 0.25 THEN 'low_structure' END AS y FROM k)
 SELECT doc_id, n AS line_count, CAST(sl AS DOUBLE) AS scanned_likelihood, CAST(m AS DOUBLE) AS malformed_likelihood, CAST(g AS DOUBLE) AS section_signal, y IS NULL AS accepted, y AS reason FROM r"""
_masks = {
    "mask": ("array_to_string(list_transform(string_split(name, ' '), lambda w: left(w, 1) || '***'), ' ')", "left(email, 1) || '***@' || split_part(email, '@', 2)", "'******' || right(d, 4)"),
    "redact": ("'[NAME REDACTED]'", "'[EMAIL REDACTED]'", "'[PHONE REDACTED]'"),
    "pseudonym": ("'Candidate ' || upper(left(md5(name), 6))", "'user_' || left(md5(email), 6) || '@example.com'", "'+00 00000 00000'"),
    "partial": ("split_part(name, ' ', 1) || ' ' || left(split_part(name, ' ', 2), 1) || '.'", "left(u, 2) || repeat('*', greatest(length(u) - 2, 0)) || '@' || split_part(email, '@', 2)", "left(d, 2) || repeat('*', greatest(length(d) - 4, 0)) || right(d, 2)"),
}
_label = "CASE " + " ".join(f"WHEN contains(lower(url), '{d}') THEN '{n}'" for d, n in contacts.DOMAINS) + " ELSE 'Portfolio' END"
FILL = f", {_hd}, {_norm}, {_match}, fl AS (SELECT doc_id, line_no, own, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 'header') AS section FROM (SELECT *, CASE WHEN regexp_matches(line, '^\\s*[•▪●\\-–—*]\\s') THEN NULL ELSE section END AS own FROM ml))"
ORACLES = {
    "line_quality_stats": f"WITH {_LINES} SELECT doc_id, count(*) AS line_count, CAST(sum(nw) AS BIGINT) AS word_count, round(avg(CAST({_BAD} AS INT)), 3) AS malformed_ratio, round(avg(CASE WHEN nw <= 2 THEN 1 ELSE 0 END), 3) AS short_line_ratio, round(1 - count(DISTINCT line) / count(*), 3) AS duplicate_ratio FROM l GROUP BY doc_id",
    "language_gate": "WITH " + _lang,
    "candidate_score": oracle("resume_lines", _cand + " SELECT doc_id, h AS headings, core AS core_sections, cs AS contact_signals, score FROM sc"),
    "select_candidate": oracle("resume_lines", _cand + ", two AS (SELECT *, 0 AS o, 'reader' AS source FROM sc UNION ALL SELECT doc_id, h, core, cs, round((score * CASE WHEN doc_id % 2 = 0 THEN CAST(1.1 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END)::DECIMAL(18, 9), 3)::DOUBLE, 1, 'layout' FROM sc) SELECT doc_id, arg_max(source, (score, -o)) AS source, max(score) AS score FROM two GROUP BY doc_id"),
    "input_quality_gate": oracle("resume_lines", _gate),
    "corpus_tags": r"WITH x AS (SELECT doc_id, doc_id % 4 + 1 AS p, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS w, length(text) AS c FROM documents) SELECT doc_id, concat_ws(',', CASE WHEN w > 900 THEN 'dense' END, CASE WHEN w < 150 THEN 'low_text' END, CASE WHEN p > 2 THEN 'multi_page' END, CASE WHEN c / p < 200 THEN 'possible_scan' END, CASE WHEN p = 1 THEN 'single_page' END) AS tags FROM x",
    "truth_status": "SELECT d.doc_id, CASE WHEN quality IS NULL THEN 'missing' WHEN quality = 0 THEN 'template_only' ELSE 'labeled' END AS status FROM documents d LEFT JOIN (SELECT doc_id, any_value(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)",
    "email_extract": f"SELECT doc_id, lower(regexp_extract(text, '{contacts.EMAIL}')) AS email FROM documents WHERE regexp_matches(text, '{contacts.EMAIL}')",
    "phone_extract": oracle("candidates", "SELECT cand_id, CASE WHEN length(regexp_replace(phone, '[^0-9]', '', 'g')) >= 10 THEN phone END AS phone FROM candidates"),
    "name_like": oracle("candidates", "SELECT cand_id, NOT (cand_id % 5 = 0 OR cand_id % 7 = 0) AS is_name FROM candidates"),
    "url_links": oracle("links", f"SELECT doc_id, pos, {_label} AS label FROM links WHERE url <> ''"),
    "page_hosts": "SELECT lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, count(*) AS pages FROM pages GROUP BY 1",
    "heading_exact": oracle("resume_lines", f", {_hd}, {_norm}, {_match} SELECT doc_id, line_no, section FROM ml WHERE section IS NOT NULL"),
    "heading_fuzzy": oracle("resume_lines", f", {_norm}, fz(tokens, section) AS (VALUES {_fuzzy_values()}), tk AS (SELECT doc_id, line_no, list_sort(list_distinct(list_filter(string_split(norm, ' '), lambda w: length(w) > 2))) AS t FROM nl) SELECT doc_id, line_no, section FROM tk JOIN fz ON array_to_string(t, ' ') = tokens WHERE len(t) BETWEEN 1 AND 4"),
    "section_forward_fill": oracle("resume_lines", FILL + " SELECT doc_id, line_no, section FROM fl WHERE own IS NULL"),
    "section_sizes": oracle("resume_lines", FILL + " SELECT section, count(*) AS lines, count(DISTINCT doc_id) AS documents FROM fl WHERE own IS NULL GROUP BY section"),
    "block_features": oracle("resume_lines", f", {_blocks} SELECT doc_id, {', '.join(COUNTS)} FROM sg"),
    "section_signature": oracle("resume_lines", f", {_blocks} SELECT doc_id, {', '.join(f'{k}_score' for k in signatures.KINDS)}, best_section, best_score FROM sg"),
}
ORACLES |= {f"pii_mask_{h}": oracle("candidates", f", c AS (SELECT *, regexp_replace(phone, '[^0-9]', '', 'g') AS d, split_part(email, '@', 1) AS u FROM candidates) SELECT cand_id, {n} AS name, {e} AS email, {p} AS phone FROM c") for h, (n, e, p) in _masks.items()}
