"""Skills, consensus, validation, evaluation, geometry."""

from __future__ import annotations

from difflib import get_close_matches

from pyspark.sql import functions as F

from ..operators import career, consensus, evaluation, geometry, skills, validation
from .fixtures import AS_OF, MAILS, oracle, skill_sides, view

WIDTH, HEIGHT = 600.0, 800.0


def _normal(spark, sf_dir):
    return skills.normalize_skills(view(spark, sf_dir, "raw_skills"))


def skill_normalize(spark, sf_dir):
    return _normal(spark, sf_dir).select("cand_id", "pos", "canonical", "category", "weight", "known", "level")


def skill_list(spark, sf_dir):
    return skills.skill_list(_normal(spark, sf_dir)).select("cand_id", "canonical", F.col("rank").cast("bigint").alias("rank"))


def skills_by_category(spark, sf_dir):
    return skills.skills_by_category(skills.skill_list(_normal(spark, sf_dir)))


def tech_stack_score(spark, sf_dir):
    return skills.stack_score(skills.skill_list(_normal(spark, sf_dir)))


def skill_semantic(spark, sf_dir):
    keys = view(spark, sf_dir, "raw_skills").select(skills.skill_key(skills.bare(F.col("raw"))).alias("key")).distinct()
    d = skills.dictionary(spark)
    return skills.semantic_matches(keys.join(d.select("key"), "key", "left_anti").filter("key <> ''"), d).select("key", "canonical")


def _scored(spark, sf_dir):
    return consensus.field_scores(view(spark, sf_dir, "strategies"))


def strategy_field_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", "strategy", "personal_score", "skills_score", "experience_score", "education_score", "summary_score", "global_score")


def consensus_merge(spark, sf_dir):
    return consensus.consensus(_scored(spark, sf_dir))


def final_pick(spark, sf_dir):
    return consensus.final_pick(_scored(spark, sf_dir))


def provenance_best(spark, sf_dir):
    return consensus.provenance(_scored(spark, sf_dir))


def strategy_agreement(spark, sf_dir):
    return consensus.agreement(_scored(spark, sf_dir))


def candidate_support(spark, sf_dir):
    s = _scored(spark, sf_dir)
    values = s.select("doc_id", F.lit("name").alias("field"), F.col("name").alias("value"), "strategy", F.col("personal_score").alias("score"), "ord").unionByName(s.select("doc_id", F.lit("location").alias("field"), F.col("location").alias("value"), "strategy", F.col("global_score").alias("score"), "ord"))
    return consensus.candidate_support(values).select("doc_id", "field", "value", "support", "weighted", F.col("rank").cast("bigint").alias("rank"))


def ordered_dedupe(spark, sf_dir):
    return consensus.ordered_distinct(view(spark, sf_dir, "raw_skills").select(F.col("cand_id").alias("doc_id"), "pos", F.when(F.col("pos") % 2 == 0, F.upper("raw")).otherwise(F.col("raw")).alias("value"))).select("doc_id", "value", F.col("rank").cast("bigint").alias("rank"))


def substring_subsumption(spark, sf_dir):
    x = view(spark, sf_dir, "raw_skills").groupBy("cand_id").agg(F.array_sort(F.collect_set(F.lower("raw"))).alias("a"))
    return x.select("cand_id", F.array_join(consensus.drop_contained(F.col("a")), "|").alias("kept"))


def bullet_quality(spark, sf_dir):
    return validation.bullet_report(view(spark, sf_dir, "bullets")).select("cand_id", "bullet_no", "has_action_verb", "has_metric", "has_number", "is_weak", "word_count", "score")


def bullet_ranking(spark, sf_dir):
    return validation.ranked_bullets(validation.bullet_report(view(spark, sf_dir, "bullets")), "cand_id", "bullet_no")


def quality_report(spark, sf_dir):
    c = view(spark, sf_dir, "candidates")
    bullets = validation.bullet_report(view(spark, sf_dir, "bullets")).groupBy("cand_id").agg(F.round(F.avg("score") * 100, 1).alias("bullet_score"))
    jobs = view(spark, sf_dir, "jobs").groupBy("cand_id").agg(F.count(F.lit(1)).alias("n"))
    k = F.col("cand_id")
    flags = {"has_name": k % 9 != 0, "has_email": F.col("email").isNotNull(), "has_phone": k % 4 != 0, "has_skills": k % 6 != 0, "has_experience": F.col("n").isNotNull(), "dated": k % 2 == 0, "has_education": k % 5 != 0, "two_column": k % 3 == 0, "has_linkedin": k % 7 == 0, "has_summary": k % 8 == 0, "has_location": F.col("location") != "", "has_headline": k % 10 == 0, "has_links": k % 7 == 0, "has_projects": k % 11 == 0}
    x = c.join(bullets, "cand_id", "left").join(jobs, "cand_id", "left").select("cand_id", F.coalesce("bullet_score", F.lit(0.0)).alias("bullet_score"), *[v.alias(n) for n, v in flags.items()])
    return validation.quality_report(x).select("cand_id", "quality_ats", "completeness", "overall", "ats_grade", "overall_grade")


def link_validation(spark, sf_dir):
    return validation.link_checks(view(spark, sf_dir, "links")).select("doc_id", "pos", "status")


def mail_domain_typo(spark, sf_dir):
    return validation.mail_suggestion(view(spark, sf_dir, "candidates")).select("cand_id", "suggested_domain")


def date_range_checks(spark, sf_dir):
    return validation.date_checks(view(spark, sf_dir, "jobs")).select("cand_id", "job_no", "status")


def skill_checks(spark, sf_dir):
    return validation.skill_checks(view(spark, sf_dir, "raw_skills")).select("cand_id", "pos", "status")


def personal_checks(spark, sf_dir):
    return validation.personal_checks(view(spark, sf_dir, "candidates")).select("cand_id", "name_check", "email_check", "phone_check", "location_check")


def validation_ats(spark, sf_dir):
    bucket = lambda good: F.when(F.col("status") == "valid", "valid").when(F.col("status").isin(*good), "grey").otherwise("invalid")
    people = personal_checks(spark, sf_dir)
    parts = [(people, "cand_id", "personal", F.col(c)) for c in ("name_check", "email_check", "phone_check", "location_check")]
    parts += [(skill_checks(spark, sf_dir), "cand_id", "skills", bucket(["noisy", "duplicate"])), (date_range_checks(spark, sf_dir), "cand_id", "experience", bucket(["missing", "far_future"])), (link_validation(spark, sf_dir), "doc_id", "links", bucket(["mismatch", "duplicate"]))]
    return validation.validation_score(validation.union_checks(*parts))


def confidence_overall(spark, sf_dir):
    x = _scored(spark, sf_dir).groupBy("doc_id").agg(F.round(F.avg("global_score"), 6).alias("field_conf"), F.round(F.avg("personal_score"), 6).alias("completeness")).join(consensus.agreement(_scored(spark, sf_dir)), "doc_id")
    return validation.confidence(x).select("doc_id", "overall", "grade")


def dice_similarity(spark, sf_dir):
    return evaluation.similarity(view(spark, sf_dir, "truth_pairs"), "truth", "found").select("doc_id", "similarity")


def skill_f1(spark, sf_dir):
    return evaluation.set_f1(*skill_sides(view(spark, sf_dir, "raw_skills"), 4), "cand_id", "raw")


def structured_entry_score(spark, sf_dir):
    j = view(spark, sf_dir, "jobs")
    return evaluation.keyed_score(j, j.withColumn("company", F.when(F.col("job_no") % 3 == 0, F.concat("company", F.lit(" Holdings"))).otherwise(F.col("company"))).withColumn("title", F.when(F.col("job_no") % 2 == 0, F.concat(F.lit("Senior "), "title")).otherwise(F.col("title"))), "cand_id", "company", "title", "job_no")


def greedy_assignment(spark, sf_dir):
    j = view(spark, sf_dir, "jobs")
    return evaluation.greedy_assignment(j, j.withColumn("title", F.when(F.col("job_no") % 2 == 0, F.concat_ws(" ", "title", F.lit("team"))).otherwise("volunteer")), "cand_id", "job_no", "title")


def truth_pack_check(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select((F.col("doc_id") + 5).alias("doc_id"))
    return evaluation.missing_both_ways(d, labels, "doc_id")


def failure_buckets(spark, sf_dir):
    return evaluation.failure_buckets(_scored(spark, sf_dir), {"personal_score": 0.75, "skills_score": 0.6, "experience_score": 0.9, "education_score": 0.9})


def _lines(spark, sf_dir):
    w = view(spark, sf_dir, "words_geom")
    lines = w.groupBy("doc_id", "page", "line_no").agg(F.min("x0").alias("x0"), F.min_by("x1", F.struct("x0", "word_no")).alias("x1"), F.min("top").alias("top"), F.min("bottom").alias("bottom"))
    return geometry.assign_column(lines, geometry.column_gap(w, WIDTH, HEIGHT), WIDTH)


def column_gap(spark, sf_dir):
    return geometry.column_gap(view(spark, sf_dir, "words_geom"), WIDTH, HEIGHT)


def assign_column(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "page", "line_no", F.col("column").cast("bigint").alias("column_no"))


def reading_order(spark, sf_dir):
    return geometry.reading_order(_lines(spark, sf_dir), HEIGHT).select("doc_id", "page", "line_no", F.col("place").cast("bigint").alias("place"))


def line_blocks(spark, sf_dir):
    return geometry.line_blocks(geometry.reading_order(_lines(spark, sf_dir), HEIGHT)).select("doc_id", "page", "line_no", "block")


def bold_lines(spark, sf_dir):
    return geometry.bold_lines(view(spark, sf_dir, "words_geom"))


def font_median(spark, sf_dir):
    return geometry.font_median(view(spark, sf_dir, "words_geom"))


def layout_report(spark, sf_dir):
    w = view(spark, sf_dir, "words_geom")
    pages = w.groupBy("doc_id", "page").agg(F.count_distinct("line_no").alias("lines"), F.count_if(F.col("size") >= 14).alias("headings")).join(geometry.column_gap(w, WIDTH, HEIGHT), ["doc_id", "page"], "left")
    return geometry.layout_report(pages.withColumn("two_column", F.col("gap").isNotNull()))


QUERIES = {f.__name__: f for f in (
    skill_normalize, skill_list, skills_by_category, tech_stack_score, skill_semantic, strategy_field_scores, consensus_merge, final_pick, provenance_best, strategy_agreement, candidate_support, ordered_dedupe,
    substring_subsumption, bullet_quality, bullet_ranking, quality_report, link_validation, mail_domain_typo, date_range_checks, skill_checks, personal_checks, validation_ats, confidence_overall, dice_similarity, skill_f1,
    structured_entry_score, greedy_assignment, truth_pack_check, failure_buckets, column_gap, assign_column, reading_order, line_blocks, bold_lines, font_median, layout_report,
)}

_D = lambda v: f"CAST({v} AS DOUBLE)"
_last = {}
for _n, _c, _w, _ks in skills.SKILLS:
    for _k in _ks:
        _last[_k] = (_n, _c, _w)
_dict = "dict(key, canonical, category, weight, o) AS (VALUES " + ", ".join(f"('{k}', '{n}', '{c}', {_D(w)}, {i})" for i, (k, (n, c, w)) in enumerate(_last.items())) + ")"
_lv = "|".join(w for _, w in skills.LEVELS)
_guess = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(key, '{p}')" for p in ps) + f" THEN '{n}'" for n, ps in skills.GUESSES) + " ELSE 'Other' END"
_level = "CASE " + " ".join(f"WHEN regexp_matches(lower(regexp_extract(raw, '\\(([^)]*)\\)', 1)), '\\b(?:{w})\\b') THEN '{n}'" for n, w in skills.LEVELS) + " " + " ".join(f"WHEN regexp_matches(lower(raw), '\\b(?:{w})\\b') THEN '{n}'" for n, w in skills.LEVELS) + " END"
_sk = f""", {_dict}, b AS (SELECT cand_id, pos, raw, trim(regexp_replace(regexp_replace(regexp_replace(raw, '^[A-Za-z &/]+:\\s*', ''), '\\([^)]*\\)', '', 'g'), '(?i)\\b(?:{_lv})\\b', '', 'g')) AS bare, {_level} AS level FROM raw_skills),
 k AS (SELECT *, trim(regexp_replace(regexp_replace(lower(bare), '[^\\w\\s+#./]', '', 'g'), '\\s+', ' ', 'g')) AS key FROM b),
 sem AS (SELECT u.key, arg_min(d.canonical, d.o) AS canonical, arg_min(d.category, d.o) AS category, arg_min(d.weight, d.o) AS weight FROM (SELECT DISTINCT key FROM k WHERE key <> '' AND key NOT IN (SELECT key FROM dict)) u JOIN dict d ON (contains(u.key, d.key) OR contains(d.key, u.key)) AND abs(length(u.key) - length(d.key)) <= 5 AND 2 * least(length(u.key), length(d.key)) / (length(u.key) + length(d.key)) >= 0.85 GROUP BY u.key),
 nm AS (SELECT k.cand_id, k.pos, coalesce(d.canonical, s.canonical, CASE WHEN length(bare) <= 8 AND bare = upper(bare) THEN bare ELSE array_to_string(list_transform(string_split(bare, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') END) AS canonical, coalesce(d.category, s.category, (SELECT {_guess.replace('key', 'k.key')})) AS category, coalesce(d.weight, s.weight, {_D(.6)}) AS weight, (d.canonical IS NOT NULL OR s.canonical IS NOT NULL) AS known, level FROM k LEFT JOIN dict d ON k.key = d.key LEFT JOIN sem s ON k.key = s.key),
 sl AS (SELECT cand_id, lower(canonical) AS low, arg_min(canonical, pos) AS canonical, arg_min(category, pos) AS category, arg_min(weight, pos) AS weight, arg_min(known, pos) AS known FROM nm GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY weight DESC, low) AS rank FROM sl)"""
_sc = f""", q AS (SELECT *, round(CASE WHEN name <> '' THEN {_D(.3)} ELSE 0 END + CASE WHEN name <> '' AND len(regexp_split_to_array(trim(name), '\\s+')) BETWEEN 2 AND 4 THEN {_D(.15)} ELSE 0 END + CASE WHEN contains(email, '@') THEN {_D(.3)} ELSE 0 END + CASE WHEN phone <> '' THEN {_D(.2)} ELSE 0 END + CASE WHEN contains(location, ',') THEN {_D(.05)} ELSE 0 END, 6) AS personal_score,
 round(least(skill_count, 24) / 24, 6) AS skills_score, round(CASE WHEN job_count > 0 THEN {_D(.55)} + {_D(.45)} * dated_jobs / job_count ELSE 0 END, 6) AS experience_score, round(least(degree_count / 2, 1), 6) AS education_score, CASE WHEN summary <> '' THEN {_D(1)} ELSE 0 END AS summary_score FROM strategies),
 p AS (SELECT *, CASE WHEN personal_score > 0 THEN 2 ELSE 0 END AS w1, CASE WHEN skills_score > 0 THEN 2 ELSE 0 END AS w2, CASE WHEN experience_score > 0 THEN 2 ELSE 0 END AS w3, CASE WHEN education_score > 0 THEN {_D(1.5)} ELSE 0 END AS w4, CASE WHEN summary_score > 0 THEN {_D(.2)} ELSE 0 END AS w5 FROM q),
 f AS (SELECT *, CASE WHEN w1 + w2 + w3 + w4 + w5 > 0 THEN round(((w1 * personal_score + w2 * skills_score + w3 * experience_score + w4 * education_score + w5 * summary_score) / (w1 + w2 + w3 + w4 + w5))::DECIMAL(18, 9), 6)::DOUBLE ELSE 0 END AS global_score FROM p)"""
_by = lambda c, k: f"arg_max({c}, ({k}_score, global_score, -ord)) AS {c}"
_verbs = ", ".join(f"'{v}'" for v in validation.ACTION_VERBS)
_bul = f""", t AS (SELECT *, regexp_replace(trim(bullet), '^[•\\-–—►▸●▶✓✔* ]+', '') AS t FROM bullets), u AS (SELECT *, list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '') AS ws, {" OR ".join(f"regexp_matches(t, '{m}')" for m in validation.METRICS)} AS has_metric, regexp_matches(t, '[0-9]') AS has_number, {" OR ".join(f"starts_with(lower(t), '{w}')" for w in validation.WEAK_OPENINGS)} AS is_weak FROM t),
 bl AS (SELECT cand_id, bullet_no, coalesce(lower(ws[1]) IN ({_verbs}), false) AS has_action_verb, has_metric, has_number, is_weak, CAST(len(ws) AS BIGINT) AS word_count FROM u),
 bs AS (SELECT *, round(greatest(0, least(1, CASE WHEN has_action_verb THEN {_D(.35)} ELSE 0 END + CASE WHEN has_metric THEN {_D(.35)} WHEN has_number THEN {_D(.15)} ELSE 0 END + CASE WHEN word_count BETWEEN 8 AND 30 THEN {_D(.2)} WHEN word_count BETWEEN 6 AND 7 THEN {_D(.1)} ELSE 0 END - CASE WHEN is_weak THEN {_D(.2)} ELSE 0 END)), 3) AS score FROM bl)"""
_links = """lk AS (SELECT *, trim(url) AS u, lower(regexp_extract(trim(url), '^(?:https?://)?(?:www\\.)?([^/?#:\\s]+)', 1)) AS h, row_number() OVER (PARTITION BY doc_id, lower(trim(url)) ORDER BY pos) AS n FROM links),
 lc AS (SELECT doc_id, pos, CASE WHEN u = '' THEN 'empty' WHEN NOT regexp_matches(h, '^[a-z0-9-]+(\\.[a-z0-9-]+)+$') THEN 'malformed' WHEN n > 1 THEN 'duplicate' WHEN (label = 'LinkedIn' AND NOT contains(h, 'linkedin.com')) OR (label = 'GitHub' AND NOT contains(h, 'github.com')) OR (label = 'Kaggle' AND NOT contains(h, 'kaggle.com')) THEN 'mismatch' ELSE 'valid' END AS status FROM lk)"""
_dc = "dc AS (SELECT cand_id, job_no, CASE WHEN start_date IS NULL AND end_date IS NULL THEN 'missing' WHEN NOT is_current AND end_date < start_date THEN 'reversed' WHEN year(start_date) > 2035 OR year(end_date) > 2035 THEN 'far_future' ELSE 'valid' END AS status FROM jobs)"
_skc = r"kc AS (SELECT cand_id, pos, CASE WHEN trim(raw) = '' THEN 'empty' WHEN row_number() OVER (PARTITION BY cand_id, lower(trim(raw)) ORDER BY pos) > 1 THEN 'duplicate' WHEN length(trim(raw)) > 45 OR regexp_matches(trim(raw), '[.!?]$|^\d+$') OR len(string_split(raw, ',')) > 2 OR regexp_matches(trim(raw), '(?i)^(?:awarded|won|worked|responsible)\b') THEN 'noisy' ELSE 'valid' END AS status FROM raw_skills)"
_pc = """pc AS (SELECT cand_id, CASE WHEN regexp_matches(name, '[0-9]') THEN 'invalid' WHEN contains(name, ' ') THEN 'valid' ELSE 'grey' END AS name_check, CASE WHEN regexp_full_match(email, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') THEN 'valid' WHEN contains(email, '@') THEN 'grey' ELSE 'invalid' END AS email_check,
 CASE WHEN length(regexp_replace(phone, '[^0-9]', '', 'g')) BETWEEN 10 AND 15 THEN 'valid' WHEN length(regexp_replace(phone, '[^0-9]', '', 'g')) BETWEEN 7 AND 9 THEN 'grey' ELSE 'invalid' END AS phone_check, CASE WHEN contains(trim(location), ' ') THEN 'valid' WHEN location <> '' THEN 'grey' ELSE 'invalid' END AS location_check FROM candidates)"""
_grade = lambda c: f"CASE WHEN {c} >= 85 THEN 'A' WHEN {c} >= 70 THEN 'B' WHEN {c} >= 55 THEN 'C' WHEN {c} >= 40 THEN 'D' ELSE 'F' END"
_tok = lambda c: f"list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda w: w <> '')"
_dice = lambda a, b: f"2 * len(list_intersect(list_distinct({a}), list_distinct({b}))) / (len(list_distinct({a})) + len(list_distinct({b})))"
_gap = """, bd AS (SELECT doc_id, page, (x0 + x1) / 2 AS c FROM words_geom WHERE top >= 96 AND top <= 736), bn AS (SELECT DISTINCT doc_id, page, CAST(floor(c / 8) AS INT) AS bin FROM bd WHERE floor(c / 8) BETWEEN 21 AND 54),
 en AS (SELECT * FROM bn UNION ALL SELECT DISTINCT doc_id, page, 20 FROM bd UNION ALL SELECT DISTINCT doc_id, page, 55 FROM bd), rn AS (SELECT *, lead(bin) OVER (PARTITION BY doc_id, page ORDER BY bin) - bin - 1 AS z FROM en), bt AS (SELECT doc_id, page, arg_max(bin, (z, -bin)) AS bin, max(z) AS z FROM rn WHERE z > 0 GROUP BY 1, 2),
 gp AS (SELECT doc_id, page, CAST((bin + 1) * 8 + z * 4 AS DOUBLE) AS gap FROM bt WHERE z * 8 >= 18), gg AS (SELECT doc_id, page, gap FROM (SELECT doc_id, page, gap, count(*) FILTER (WHERE c < gap) AS l, count(*) AS n FROM bd JOIN gp USING (doc_id, page) GROUP BY 1, 2, 3) WHERE n >= 8 AND l >= 3 AND n - l >= 3 AND l / n BETWEEN 0.15 AND 0.85)"""
_col = """, li AS (SELECT doc_id, page, line_no, min(x0) AS x0, arg_min(x1, (x0, word_no)) AS x1, min(top) AS top, min(bottom) AS bottom FROM words_geom GROUP BY 1, 2, 3), ac AS (SELECT li.*, CASE WHEN gap IS NULL OR x1 - x0 > 288 THEN -1 WHEN (x0 + x1) / 2 < gap THEN 0 ELSE 1 END AS col FROM li LEFT JOIN gg USING (doc_id, page)),
 ro AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN top <= 112 THEN 0 WHEN col = 1 THEN 2 ELSE 1 END, top, x0, line_no) AS place FROM ac)"""
ORACLES = {
    "skill_normalize": oracle("raw_skills", _sk + " SELECT cand_id, pos, canonical, category, weight, known, level FROM nm"),
    "skill_list": oracle("raw_skills", _sk + " SELECT cand_id, canonical, rank FROM rk"),
    "skills_by_category": oracle("raw_skills", _sk + ", r5 AS (SELECT *, row_number() OVER (PARTITION BY cand_id, category ORDER BY rank) AS r FROM rk) SELECT cand_id, category, string_agg(canonical, ', ' ORDER BY r) AS skills FROM r5 WHERE r <= 5 GROUP BY 1, 2"),
    "tech_stack_score": oracle("raw_skills", _sk + f" SELECT cand_id, round(least(1, avg(weight) * {_D(.6)} + least(count(DISTINCT category) / 5, 1) * {_D(.4)})::DECIMAL(18, 9), 3)::DOUBLE AS score FROM rk WHERE known OR weight > 0.6 GROUP BY 1"),
    "skill_semantic": oracle("raw_skills", _sk + " SELECT key, canonical FROM sem"),
    "strategy_field_scores": oracle("strategies", _sc + " SELECT doc_id, strategy, personal_score, skills_score, experience_score, education_score, CAST(summary_score AS DOUBLE) AS summary_score, CAST(global_score AS DOUBLE) AS global_score FROM f"),
    "consensus_merge": oracle("strategies", _sc + " SELECT doc_id, " + ", ".join([_by("name", "personal"), _by("email", "personal"), _by("phone", "personal"), _by("location", "personal"), _by("skill_count", "skills"), _by("job_count", "experience"), _by("degree_count", "education"), _by("summary", "summary")]) + " FROM f GROUP BY doc_id"),
    "final_pick": oracle("strategies", _sc + " SELECT doc_id, arg_max(strategy, (global_score, -ord)) AS strategy, CAST(max(global_score) AS DOUBLE) AS global_score FROM f GROUP BY 1"),
    "provenance_best": oracle("strategies", _sc + ", lg AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS field, strategy, ord, {k}_score AS s FROM f" for k in consensus.WEIGHTS) + ") SELECT doc_id, field, arg_max(strategy, (s, ord)) AS strategy, CAST(max(s) AS DOUBLE) AS score, count(*) FILTER (WHERE s > 0) AS strategies_with_data FROM lg GROUP BY 1, 2"),
    "strategy_agreement": oracle("strategies", _sc + f" SELECT doc_id, round(avg(global_score) * {_D(.7)} + (1 - CASE WHEN avg(global_score) > 0 THEN least(stddev_pop(global_score) / avg(global_score), 1) ELSE 1 END) * {_D(.3)}, 4) AS agreement FROM f GROUP BY 1"),
    "candidate_support": oracle("strategies", _sc + """, vs AS (SELECT doc_id, 'name' AS field, name AS value, personal_score AS s, ord FROM f UNION ALL SELECT doc_id, 'location', location, global_score, ord FROM f), nv AS (SELECT *, trim(regexp_replace(lower(value), '[^a-z0-9]+', ' ', 'g')) AS norm FROM vs),
     gr AS (SELECT doc_id, field, norm, count(*) AS support, round(sum(s), 6) AS weighted, arg_max(value, (s, -ord)) AS value, min(ord) AS fs FROM nv WHERE norm <> '' GROUP BY 1, 2, 3) SELECT doc_id, field, value, support, weighted, row_number() OVER (PARTITION BY doc_id, field ORDER BY support + weighted DESC, fs, norm) AS rank FROM gr WHERE support >= 2 OR weighted >= 1.6"""),
    "ordered_dedupe": oracle("raw_skills", ", v AS (SELECT cand_id, pos, CASE WHEN pos % 2 = 0 THEN upper(raw) ELSE raw END AS value FROM raw_skills), o AS (SELECT cand_id, arg_min(value, pos) AS value, min(pos) AS p FROM v GROUP BY cand_id, lower(trim(value))) SELECT cand_id AS doc_id, value, row_number() OVER (PARTITION BY cand_id ORDER BY p) AS rank FROM o"),
    "substring_subsumption": oracle("raw_skills", ", d AS (SELECT DISTINCT cand_id, lower(raw) AS v FROM raw_skills) SELECT cand_id, string_agg(v, '|' ORDER BY v) AS kept FROM d WHERE NOT EXISTS (SELECT 1 FROM d e WHERE e.cand_id = d.cand_id AND e.v <> d.v AND contains(e.v, d.v)) GROUP BY 1"),
    "bullet_quality": oracle("bullets", _bul + " SELECT cand_id, bullet_no, has_action_verb, has_metric, has_number, is_weak, word_count, CAST(score AS DOUBLE) AS score FROM bs"),
    "bullet_ranking": oracle("bullets", _bul + ", r AS (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY score DESC, bullet_no) AS a, row_number() OVER (PARTITION BY cand_id, score < 0.4 ORDER BY score DESC, bullet_no) AS b FROM bs) SELECT cand_id, bullet_no, CAST(score AS DOUBLE) AS score, CASE WHEN score < 0.4 THEN 'weak' ELSE 'top' END AS kind FROM r WHERE (a <= 3 AND score >= 0.6) OR (score < 0.4 AND b <= 3)"),
    "quality_report": oracle("candidates bullets jobs", _bul + f""", bc AS (SELECT cand_id, round(avg(score) * 100, 1) AS s FROM bs GROUP BY 1), jc AS (SELECT DISTINCT cand_id FROM jobs), z AS (SELECT c.cand_id AS k, coalesce(bc.s, 0) AS s, jc.cand_id IS NOT NULL AS j FROM candidates c LEFT JOIN bc USING (cand_id) LEFT JOIN jc ON jc.cand_id = c.cand_id),
     y AS (SELECT *, (k % 9 <> 0)::INT AS n, (k % 4 <> 0)::INT AS p, (k % 6 <> 0)::INT AS sk, (k % 5 <> 0)::INT AS e, (k % 7 = 0)::INT AS l, (k % 8 = 0)::INT AS su FROM z),
     x AS (SELECT *, CAST(greatest(0, least(100, 15 * n + 15 + 10 * p + 15 * sk + CASE WHEN j THEN CASE WHEN k % 2 = 0 THEN 15 ELSE 8 END ELSE 0 END + 10 * e - CASE WHEN k % 3 = 0 THEN 10 ELSE 0 END + 10 * l + 10 * su)) AS DOUBLE) AS a, round((10 * n + 10 + 8 * p + 5 + 5 * (k % 10 = 0)::INT + 7 * l + 8 * su + 12 * sk + 15 * j::INT + 12 * e + 8 * (k % 11 = 0)::INT) * 100 / 100, 1) AS c FROM y),
     w AS (SELECT *, round(CAST(a * CAST(0.35 AS DOUBLE) + c * CAST(0.35 AS DOUBLE) + s * CAST(0.30 AS DOUBLE) AS DECIMAL(18, 9)), 1)::DOUBLE AS o FROM x) SELECT k AS cand_id, a AS quality_ats, CAST(c AS DOUBLE) AS completeness, o AS overall, {_grade('a')} AS ats_grade, {_grade('o')} AS overall_grade FROM w"""),
    "link_validation": oracle("links", f", {_links} SELECT doc_id, pos, status FROM lc"),
    # the textbook ratio of the standard library, over the domains that the view draws from
    "mail_domain_typo": oracle("candidates", ", n(host, near) AS (VALUES " + ", ".join(f"('{m}', '{(get_close_matches(m, validation.MAIL_DOMAINS, 1, 0.82) or [''])[0]}')" for m in MAILS) + f") SELECT cand_id, CASE WHEN host NOT IN ({', '.join(repr(d) for d in validation.MAIL_DOMAINS)}) THEN nullif(near, '') END AS suggested_domain FROM candidates JOIN n ON split_part(email, '@', 2) = host"),
    "date_range_checks": oracle("jobs", f", {_dc} SELECT * FROM dc"),
    "skill_checks": oracle("raw_skills", f", {_skc} SELECT * FROM kc"),
    "personal_checks": oracle("candidates", f", {_pc} SELECT * FROM pc"),
    "validation_ats": oracle("candidates raw_skills jobs links", f""", {_pc}, {_skc}, {_dc}, {_links}, ch AS (SELECT cand_id AS d, 'personal' AS s, 20 AS w, unnest([name_check, email_check, phone_check, location_check]) AS b FROM pc UNION ALL SELECT cand_id, 'skills', 20, CASE status WHEN 'valid' THEN 'valid' WHEN 'noisy' THEN 'grey' WHEN 'duplicate' THEN 'grey' ELSE 'invalid' END FROM kc
     UNION ALL SELECT cand_id, 'experience', 25, CASE status WHEN 'valid' THEN 'valid' WHEN 'missing' THEN 'grey' WHEN 'far_future' THEN 'grey' ELSE 'invalid' END FROM dc UNION ALL SELECT doc_id, 'links', 15, CASE status WHEN 'valid' THEN 'valid' WHEN 'mismatch' THEN 'grey' WHEN 'duplicate' THEN 'grey' ELSE 'invalid' END FROM lc),
     g AS (SELECT d, s, w, count(*) FILTER (WHERE b = 'valid') AS v, count(*) FILTER (WHERE b = 'grey') AS h, count(*) AS n FROM ch GROUP BY 1, 2, 3), t AS (SELECT d, CAST(sum(CAST(round_even((v + {_D(.5)} * h) / n * w, 0) AS BIGINT)) AS BIGINT) AS a, CAST(sum(v) AS BIGINT) AS v, CAST(sum(h) AS BIGINT) AS h, CAST(sum(n - v - h) AS BIGINT) AS i FROM g GROUP BY 1)
     SELECT d AS doc_id, a AS validation_ats, v AS valid, h AS grey, i AS invalid, {_grade('a')} AS grade FROM t"""),
    "confidence_overall": oracle("strategies", _sc + f""", a AS (SELECT doc_id, round(avg(global_score), 6) AS fc, round(avg(personal_score), 6) AS cp, round(avg(global_score) * {_D(.7)} + (1 - CASE WHEN avg(global_score) > 0 THEN least(stddev_pop(global_score) / avg(global_score), 1) ELSE 1 END) * {_D(.3)}, 4) AS ag FROM f GROUP BY 1),
     o AS (SELECT doc_id, round(fc * {_D(.6)} + ag * {_D(.25)} + cp * {_D(.15)}, 4) AS overall FROM a) SELECT doc_id, overall, CASE WHEN overall >= 0.85 THEN 'A' WHEN overall >= 0.7 THEN 'B' WHEN overall >= 0.5 THEN 'C' WHEN overall >= 0.3 THEN 'D' ELSE 'F' END AS grade FROM o"""),
    "dice_similarity": oracle("truth_pairs", f"SELECT doc_id, round({_dice(_tok('truth'), _tok('found'))}, 6) AS similarity FROM truth_pairs"),
    "skill_f1": oracle("raw_skills", ", t AS (SELECT DISTINCT cand_id, lower(trim(CASE WHEN pos % 3 = 0 THEN 'true ' || raw ELSE raw END)) AS v FROM raw_skills), f AS (SELECT DISTINCT cand_id, lower(trim(CASE WHEN pos % 4 = 0 THEN 'found ' || raw ELSE raw END)) AS v FROM raw_skills), g AS (SELECT coalesce(t.cand_id, f.cand_id) AS cand_id, count(t.v) AS nt, count(f.v) AS nf, count(*) FILTER (WHERE t.v IS NOT NULL AND f.v IS NOT NULL) AS b FROM t FULL JOIN f ON t.cand_id = f.cand_id AND t.v = f.v GROUP BY 1) SELECT cand_id, CASE WHEN nf > 0 THEN round(b / nf, 6) ELSE 0 END AS precision, CASE WHEN nt > 0 THEN round(b / nt, 6) ELSE 0 END AS recall, round(2 * b / (nt + nf), 6) AS f1 FROM g"),
    "structured_entry_score": oracle("jobs", f", f AS (SELECT cand_id, CASE WHEN job_no % 3 = 0 THEN company || ' Holdings' ELSE company END AS company, arg_max(CASE WHEN job_no % 2 = 0 THEN 'Senior ' || title ELSE title END, job_no) AS g FROM jobs GROUP BY 1, 2) SELECT cand_id, round(avg(CASE WHEN g IS NULL THEN 0 ELSE {_dice(_tok('title'), _tok('g'))} END), 6) AS score FROM jobs LEFT JOIN f USING (cand_id, company) GROUP BY 1"),
    "truth_pack_check": "WITH l AS (SELECT DISTINCT doc_id + 5 AS doc_id FROM labels) SELECT doc_id, 'right' AS missing_in FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM l) UNION ALL SELECT doc_id, 'left' FROM l WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "failure_buckets": oracle("strategies", _sc + " " + " UNION ALL ".join(f"SELECT '{c}' AS bucket, count(*) FILTER (WHERE {c} < {b}) AS failures, round(avg({c}), 6) AS mean FROM f" for c, b in (("personal_score", 0.75), ("skills_score", 0.6), ("experience_score", 0.9), ("education_score", 0.9)))),
    "column_gap": oracle("words_geom", _gap + " SELECT doc_id, page, gap FROM gg"),
    "assign_column": oracle("words_geom", _gap + _col + " SELECT doc_id, page, line_no, CAST(col AS BIGINT) AS column_no FROM ac"),
    "reading_order": oracle("words_geom", _gap + _col + " SELECT doc_id, page, line_no, place FROM ro"),
    "line_blocks": oracle("words_geom", _gap + _col + ", nw AS (SELECT *, CASE WHEN lag(col) OVER w <> col OR top - lag(bottom) OVER w > greatest(lag(bottom - top) OVER w * 1.6, 5) THEN 1 ELSE 0 END AS z FROM ro WINDOW w AS (PARTITION BY doc_id, page ORDER BY place)) SELECT doc_id, page, line_no, CAST(sum(z) OVER (PARTITION BY doc_id, page ORDER BY place ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM nw"),
    "bold_lines": oracle("words_geom", "SELECT doc_id, page, line_no, 2 * count(*) FILTER (WHERE font = 'Arial-Bold') > count(*) AS is_bold FROM words_geom GROUP BY 1, 2, 3"),
    "font_median": oracle("words_geom", "SELECT doc_id, median(size) AS font_median FROM words_geom GROUP BY 1"),
    "layout_report": oracle("words_geom", _gap + f", pg AS (SELECT doc_id, page, count(DISTINCT line_no) AS n, count(*) FILTER (WHERE size >= 14) AS h FROM words_geom GROUP BY 1, 2), lr AS (SELECT doc_id, count(*) AS p, count(gap) AS t, sum(h) AS h, sum(n) AS n FROM pg LEFT JOIN gg USING (doc_id, page) GROUP BY 1) SELECT doc_id, CASE WHEN t = 0 THEN 'single_column' WHEN t = p THEN 'two_column' ELSE 'mixed' END AS layout, round(h / greatest(n, 1), 4) AS heading_density, round(least({_D(.72)} + CASE WHEN t = 0 THEN {_D(.18)} ELSE 0 END - CASE WHEN t > 0 THEN {_D(.08)} ELSE 0 END + CASE WHEN h >= 3 THEN {_D(.06)} ELSE 0 END, 1), 4) AS order_confidence FROM lr"),
}
