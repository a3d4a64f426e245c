"""The thin queries op1 to op13 and the pipeline, over whole tables with production parameters; SQL where it can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, exact_dedup, fill_middle, fingerprints, html_text, language, packing, pii, quality, setjoin, spelling, token_files
from .common import table

BYTE_VOCABULARY, WORD_VOCABULARY = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(n) AS text_sha256
FROM t WINDOW w AS (PARTITION BY n)
"""


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_language(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_report(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(table(spark, sf_dir, "documents")).select("doc_id", "n_entities", "text")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_in_middle_report(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256(concat('42:', CAST(doc_id AS VARCHAR))) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
c AS (SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST(concat('0x', h[1:8]) AS BIGINT) % (len(u) + 1) AS a, CAST(concat('0x', h[9:16]) AS BIGINT) % (len(u) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST(concat('0x', h[17:24]) AS BIGINT) % 100 >= 50 THEN 'plain'
    WHEN CAST(concat('0x', h[25:32]) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
s AS (SELECT doc_id, text, n, form, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS x FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', p, '<S>', x, '<M>', m) ELSE concat('<S>', x, '<P>', p, '<M>', m) END) AS output_sha256, sha256(text) AS restored_sha256
FROM s
"""


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest")


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM d, ks, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
hits AS (SELECT dw.r, dw.i, dw.k, bw.item FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, i, k FROM hits) z, LATERAL (SELECT unnest(range(i, i + k)) AS p) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) z GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(table(spark, sf_dir, "documents"))


#: CRC-32 by bytes over a table that the query makes itself; pairs by one letter left out of, or hidden in, either word.
OP13_SQL = r"""
WITH RECURSIVE tb AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, d: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
r0 AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
r1 AS (SELECT d, run, count(*) AS c, hex(encode(concat(d, ':', run))) AS x FROM r0 WHERE length(run) >= 6 GROUP BY d, run),
r2 AS (SELECT run, c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(CAST(length(x) / 2 AS BIGINT)), lambda i: CAST(concat('0x', x[2 * i + 1:2 * i + 2]) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM r1, tb),
r3 AS (SELECT CASE WHEN h % 199 = 0 THEN concat(left(run, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, c FROM r2),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM r3 WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w), k AS (SELECT word, n, concat(left(word, i - 1), '*', substr(word, i + 1)) AS hidden, concat(left(word, i - 1), substr(word, i + 1)) AS cut FROM p),
d AS (SELECT DISTINCT k.word AS a, w.word AS b FROM k JOIN w ON w.word = k.cut), e AS (SELECT a, b FROM d UNION ALL SELECT b, a FROM d UNION ALL SELECT x.word, y.word FROM k x JOIN k y ON x.hidden = y.hidden AND x.word <> y.word),
g AS (SELECT a AS word, count(*) AS n_near, max(w.n) AS best_n FROM e JOIN w ON w.word = b GROUP BY a), b AS (SELECT a AS word, min(b) AS best FROM e JOIN w ON w.word = b JOIN g ON g.word = a AND w.n = g.best_n GROUP BY a),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * w.n THEN best END AS form, CASE WHEN best_n >= 5 * w.n THEN best_n END AS form_n FROM w LEFT JOIN g USING (word) LEFT JOIN b USING (word)),
c AS (SELECT word, word AS far, 0 AS k FROM f UNION ALL SELECT c.word, f.form, k + 1 FROM c JOIN f ON f.word = c.far WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(far, k) AS root FROM c GROUP BY word) z USING (word)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_bpe, op3_best_fit_packing, op4_exact_dedup, op5_language, op6_token_files, op7_ngram_jaccard, op8_quality, op9_pii, op10_html_text, op11_fill_in_middle, op12_decontamination, op13_spelling_variants, pipeline)}
ORACLES = {"op4_exact_dedup": OP4_SQL, "op11_fill_in_middle": OP11_SQL, "op12_decontamination": OP12_SQL, "op13_spelling_variants": OP13_SQL}
