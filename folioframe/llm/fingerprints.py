"""Canonical exact fingerprints of documents, with DataFrame functions only.

A text's canonical form is Unicode-normalised (NFKC), case-folded and has its white space folded; its digest is four
64-bit xxhash values of that form. Where rows share a digest, their canonical bytes are compared by grouping on them;
a digest that covers different texts (which nobody has seen) is extended, so that equal fingerprints mean equal forms.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable
from .exact_dedup import MAX_BROADCAST_IDS

WIDTH = 4
#: Ranges of document ids in which neighbours are found: RANGE_ROWS rows each, up to MAX_RANGES of them, whose boundaries
#: stand in the plan. In larger tables each is cut again, into ranges of CUT_ROWS rows, whose boundaries are a table.
RANGE_ROWS, MAX_RANGES, CUT_ROWS = 2000, 4096, 32000


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again (folding can undo it), white space runs to one space, ends trimmed."""

    def java(cls: str, method: str, arg: Column) -> Column:
        return F.call_function("reflect", F.lit(cls), F.lit(method), arg, F.lit(True))

    form = java("com.ibm.icu.text.Normalizer", "compose", F.coalesce(text, F.lit("")))
    form = java("com.ibm.icu.text.Normalizer", "compose", java("com.ibm.icu.lang.UCharacter", "foldCase", form))
    return F.trim(F.regexp_replace(form, r"(?U)[\s\p{Z}]+", " "))


def digest(form: Column) -> Column:
    """64 hexadecimal digits: WIDTH xxhash64 values under different seeds."""
    return F.concat(*[F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), form))), 16, "0") for seed in range(WIDTH)])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of every row; null counts as empty, and other columns are ignored."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = durable(rows.withColumn("form", canonical(F.col("text"))).select("doc_id", digest(F.col("form")).alias("fp"), F.sha2("form", 256).alias("alt")))
    again = made.groupBy("fp").count().filter("count > 1").select("fp")
    mixed = _mixed(_texts_of(rows, made.join(again, "fp").select("doc_id")).select(canonical(F.col("text")).alias("form")).select(digest(F.col("form")).alias("fp"), "form"))
    return _extend(made, mixed, ("fp", "alt")).select("doc_id", F.col("fp").alias("fingerprint"))


def _texts_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows with these ids: by broadcast while the ids are few (MAX_BROADCAST_IDS longs), else by a shuffle."""
    ids = ids.select(F.col("doc_id")).distinct()
    return rows.join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids, "doc_id", "left_semi")


def _mixed(forms: DataFrame) -> DataFrame:
    """Digests (fp) under which different canonical bytes stand; equal ones meet map-side, so hot groups stay small."""
    return forms.groupBy("fp", "form").agg(F.count(F.lit(1)).alias("n")).groupBy("fp").count().filter("count > 1").select("fp")


def _extend(made: DataFrame, mixed: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """made, where digests in mixed are extended by the SHA-256 of the canonical form."""
    mixed = durable(mixed)
    n = mixed.count()
    if not n:
        return made
    for fp, alt in pairs:
        marks = mixed.select(F.col("fp").alias(fp), F.lit(True).alias("__mixed"))
        made = made.join(F.broadcast(marks) if n <= MAX_BROADCAST_IDS // 10 else marks, fp, "left")
        made = made.withColumn(fp, F.when(F.col("__mixed"), F.concat(fp, F.lit("-"), alt)).otherwise(F.col(fp))).drop("__mixed")
    return made


def _search(bounds: Column, size: int) -> Column:
    """How many of the first values of bounds (ascending, of length size, a power of 2 less 1 or more) are not above doc_id."""
    steps = F.array(*[F.lit(size >> k) for k in range(1, size.bit_length())])
    return F.coalesce(F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= F.col("doc_id"), at + step).otherwise(at)), F.lit(0))


def _placed(rows: DataFrame) -> DataFrame:
    """rows with the number of their id range in __range (long), ascending with the ids. A range holds about RANGE_ROWS
    rows, in tables of over MAX_RANGES such ranges about CUT_ROWS, at any size of the table."""
    n = rows.count()
    parts = min(MAX_RANGES, max(1, -(-n // RANGE_ROWS)))
    cuts = sorted(set(rows.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (8 * parts)))) if parts > 1 and n else []
    size = 1 << max(1, len(cuts) + 1).bit_length()
    bounds = F.split(F.lit(",".join([*(str(int(c)) for c in cuts), *[str(2**63 - 1)] * (size - len(cuts))])), ",").cast("array<long>")
    coarse = _search(bounds, size).cast("long")
    again = -(-n // (parts * CUT_ROWS))
    if again < 2:
        return rows.withColumn("__range", coarse)
    room = 1 << again.bit_length()
    shares = F.array(*[F.lit(i / again) for i in range(1, again)])
    fine = rows.select(coarse.alias("__range"), "doc_id").groupBy("__range").agg(F.percentile_approx("doc_id", shares, 8 * again).alias("cuts"))
    fine = durable(fine.select("__range", F.concat("cuts", F.array_repeat(F.lit(2**63 - 1), room - again + 1)).alias("__cuts")))
    # a row for each coarse range, with n / CUT_ROWS boundaries altogether
    fine = F.broadcast(fine) if parts * room <= MAX_BROADCAST_IDS else fine
    return rows.withColumn("__range", coarse).join(fine, "__range", "left").withColumn("__range", F.col("__range") * room + _search(F.col("__cuts"), room)).drop("__cuts")


def with_next(rows: DataFrame, *carry: str) -> DataFrame:
    """rows (doc_id, text, ...) with next_<c> of each carried column: its value in the row that follows in ascending
    doc_id, and in the first row after the last. Rows that repeat an id follow each other by a hash of their text;
    null ids come first. One shuffle of the rows by id range; a range's first row is also dealt to the range before."""
    placed = _placed(rows)
    firsts = placed.groupBy("__range").agg(F.min("doc_id").alias("__first"), F.max(F.col("doc_id").isNull()).alias("__null"))
    firsts = durable(firsts.select("__range", F.when(~F.col("__null"), F.col("__first")).alias("__first")))  # a row per range
    ranges, last = firsts.agg(F.count(F.lit(1)), F.max("__range")).first()
    before = F.coalesce(F.lag("__range").over(Window.orderBy("__range")), F.lit(last))
    table = firsts.withColumn("__before", before)
    dealt = placed.join(F.broadcast(table) if ranges <= MAX_BROADCAST_IDS else table, "__range")
    here = F.struct(F.col("__range").alias("range"), F.lit(False).alias("halo"))
    there = F.struct(F.col("__before").alias("range"), F.lit(True).alias("halo"))
    first = F.col("__first").eqNullSafe(F.col("doc_id"))
    dealt = dealt.withColumn("__at", F.explode(F.when(first, F.array(here, there)).otherwise(F.array(here)))).withColumn("__tie", F.xxhash64("text")).drop("__range", "__first", "__before")
    order = Window.partitionBy(F.col("__at.range")).orderBy(F.col("__at.halo"), F.col("doc_id").asc_nulls_first(), "__tie")
    led = dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carry])
    return led.filter(~F.col("__at.halo")).select(*rows.columns, *[f"next_{c}" for c in carry])


def edited(text: Column, following: Column) -> Column:
    """text with its last quarter (rounded down, in code points) replaced by the first as many of the following one."""
    n = F.length(text)
    k = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(following, F.lit(1), k))


def fingerprint_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, one row per document.

    The fingerprint is exact, so likeness is 1 where fingerprints are equal and 0 elsewhere. An empty table gives no
    rows; a lone document is its own successor.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = rows.withColumn("form", canonical(F.col("text"))).select("doc_id", "text", digest(F.col("form")).alias("fp"), F.sha2("form", 256).alias("alt"))
    led = with_next(own, "doc_id", "text", "fp", "alt").withColumn("edit", edited(F.col("text"), F.col("next_text")))
    led = led.withColumn("edit_form", canonical(F.col("edit")))
    made = durable(led.select("doc_id", "next_doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edit", 256).alias("edited_sha256"), "fp", "alt", "next_fp", "next_alt", digest(F.col("edit_form")).alias("edit_fp"), F.sha2("edit_form", 256).alias("edit_alt")))
    again = durable(made.select(F.explode(F.array("fp", "edit_fp")).alias("fp")).groupBy("fp").count().filter("count > 1").select("fp"))
    own_again = made.join(again, "fp", "left_semi").select("doc_id")
    edit_again = made.join(again.withColumnRenamed("fp", "edit_fp"), "edit_fp", "left_semi").filter("edit_fp <> fp")
    needed = reduce(DataFrame.union, [own_again, edit_again.select("doc_id"), edit_again.select("next_doc_id")])
    texts = _texts_of(rows, needed)
    pairs = edit_again.select("doc_id", "next_doc_id").join(texts, "doc_id").join(texts.select(F.col("doc_id").alias("next_doc_id"), F.col("text").alias("next_text")), "next_doc_id")
    forms = texts.select("text").union(pairs.select(edited(F.col("text"), F.col("next_text")))).select(canonical(F.col("text")).alias("form"))
    made = _extend(made, _mixed(forms.select(digest(F.col("form")).alias("fp"), "form")), ("fp", "alt"), ("next_fp", "next_alt"), ("edit_fp", "edit_alt"))
    like = lambda c: F.col("fp").eqNullSafe(F.col(c)).cast("double")
    return made.select("doc_id", "n_chars", "edited_sha256", F.col("fp").alias("fingerprint"), F.col("edit_fp").alias("edited_fingerprint"), like("edit_fp").alias("near_edited"), like("next_fp").alias("near_next"))
