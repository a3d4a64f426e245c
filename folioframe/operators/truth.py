"""Labelled records of two layouts, as JSON of any shape, to one flat table; and what is wrong with each, by path.

A record is parsed once to a VARIANT. Its layout is told by its keys, lists and objects are read by what they are, and
nothing but built-in functions looks inside, so records may differ from row to row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The keys of a record, of its person and of its entries; those of an entry that are lists of strings.
TOP = ("file", "personal_info", "education", "experience", "projects", "skills", "certifications")
PERSON = ("name", "email", "phone", "location", "links")
ENTRIES = {
    "education": ("institution", "degree", "field_of_study", "start", "end", "gpa"), "experience": ("company", "title", "start", "end", "location", "bullets"), "projects": ("name", "description", "technologies", "url"),
}
LISTS = {"bullets", "technologies"}
#: Forms of addresses and numbers, words that stand for a missing address.
EMAIL = r"^[A-Za-z0-9][A-Za-z0-9_.+\-]*@[A-Za-z0-9][A-Za-z0-9\-]*(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}$"
PHONE = r"\+?\d[\d\s\-()]{8,}\d"
NO_LINK = r"(?i)link not specified|not provided|not available"

_at = lambda v, path, kind="variant": F.try_variant_get(v, path, kind)
_text = lambda v, path="$": F.when(kind_of(_at(v, path)) == "string", _at(v, path, "string"))
_items = lambda v: F.coalesce(_at(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def kind_of(v: Column) -> Column:
    """missing, null, object, list, string, or other."""
    name = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), "missing").when(F.is_variant_null(v), "null").when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "list").when(name == "STRING", "string").otherwise("other")
    )


def parsed(records: DataFrame, column: str = "body") -> DataFrame:
    """records with v, the VARIANT of the text; null where it is no JSON."""
    return records.withColumn("v", F.try_parse_json(column))


def _scalars(v: Column) -> Column:
    """The texts of a list's items, or of a value by itself; empty ones go."""
    one = lambda x: F.trim(F.try_variant_get(x, "$", "string"))
    texts = F.when(kind_of(v) == "list", F.transform(_items(v), one)).otherwise(F.array(one(v)))
    return F.filter(texts, lambda t: t.isNotNull() & (t != ""))


def skill_texts(v: Column) -> Column:
    """Skills as a list, or as lists by category (in order of the categories' names)."""
    values = F.map_values(_at(v, "$", "map<string,variant>"))
    kind = kind_of(v)
    return F.when(kind == "list", _scalars(v)).when(kind == "object", F.flatten(F.transform(values, _scalars))).otherwise(F.array().cast("array<string>"))


def entries(v: Column, primary: str) -> Column:
    """Objects as they are, whether alone or in a list; a text in a list is an object of its primary field alone."""
    named = lambda x: F.to_variant_object(F.named_struct(F.lit(primary), F.trim(F.try_variant_get(x, "$", "string"))))
    kept = F.filter(_items(v), lambda x: (kind_of(x) == "object") | (kind_of(x) == "string") & (F.trim(F.try_variant_get(x, "$", "string")) != ""))
    listed = F.transform(kept, lambda x: F.when(kind_of(x) == "string", named(x)).otherwise(x))
    kind = kind_of(v)
    return F.when(kind == "object", F.array(v)).when(kind == "list", listed).otherwise(F.array().cast("array<variant>"))


def truth_table(records: DataFrame, key: str = "doc_id", column: str = "body") -> DataFrame:
    """key, layout, name, email, phone, location, skills, education, experience, projects: one row a record, entries as
    arrays of structs. Records that are no JSON object have the layout null and nothing else."""
    v = F.col("v")
    flat = _at(v, "$.personal_info").isNotNull() | _at(v, "$.skills").isNotNull()
    is_object = kind_of(v) == "object"
    pick = lambda a, b: F.when(flat, _at(v, a, "string")).otherwise(_at(v, b, "string"))
    skills = F.when(flat, _at(v, "$.skills")).otherwise(_at(v, "$.technical_skills"))
    said = lambda x, name: F.try_variant_get(x, f"$.{name}", "string")
    education = F.transform(entries(_at(v, "$.education"), "institution"), lambda x: F.struct(*[said(x, n).alias(n) for n in ("institution", "degree")]))
    company = lambda x: F.coalesce(F.nullif(said(x, "company"), F.lit("")), said(x, "organization"))
    experience = F.transform(entries(_at(v, "$.experience"), "title"), lambda x: F.struct(said(x, "title").alias("title"), company(x).alias("company"), said(x, "start").alias("start"), said(x, "end").alias("end")))
    projects = F.transform(entries(_at(v, "$.projects"), "name"), lambda x: F.struct(said(x, "name").alias("name")))
    return parsed(records, column).select(
        key, F.when(is_object, F.when(flat, "profile").otherwise("contact")).alias("layout"), pick("$.personal_info.name", "$.name").alias("name"), pick("$.personal_info.email", "$.contact.email").alias("email"),
        pick("$.personal_info.phone", "$.contact.phone").alias("phone"), pick("$.personal_info.location", "$.contact.location").alias("location"), skill_texts(skills).alias("skills"), education.alias("education"),
        experience.alias("experience"), projects.alias("projects"),
    )


def _finding(level: str, path: Column | str, issue: str, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(level).alias("level"), (F.lit(path) if isinstance(path, str) else path).alias("path"), F.lit(issue).alias("issue")))


def _unknown(v: Column, base: Column, known: tuple[str, ...]) -> Column:
    """A warning for each key of an object that is not known."""
    extra = F.array_except(F.map_keys(_at(v, "$", "map<string,variant>")), F.array(*map(F.lit, known)))
    return F.when(kind_of(v) == "object", F.transform(extra, lambda k: _finding("warning", F.concat(base, F.lit("."), k), "unknown", F.lit(True))))


def _entry_findings(v: Column, name: str) -> Column:
    """Findings of a list of entries: each by its place."""

    def one(x: Column, i: Column) -> Column:
        base = F.concat(F.lit(f"$.{name}["), i.cast("string"), F.lit("]"))
        found = [F.array(_finding("error", base, "no object", kind_of(x) != "object"))]
        for field in ENTRIES[name]:
            value, path = F.try_variant_get(x, f"$.{field}", "variant"), F.concat(base, F.lit(f".{field}"))
            kind, is_object = kind_of(value), kind_of(x) == "object"
            wrong = kind != "list" if field in LISTS else ~kind.isin("string", "null")
            found.append(F.array(_finding("error", path, "missing", is_object & (kind == "missing")), _finding("error", path, "no list" if field in LISTS else "no string", is_object & (kind != "missing") & wrong)))
            if field in LISTS:
                found.append(_string_items(value, path))
        found.append(_unknown(x, base, ENTRIES[name]))
        return F.flatten(F.array_compact(F.array(*found)))

    return F.flatten(F.transform(_items(v), one))


def _string_items(v: Column, path: Column) -> Column:
    return F.transform(_items(v), lambda y, j: _finding("error", F.concat(path, F.lit("["), j.cast("string"), F.lit("]")), "no string", kind_of(y) != "string"))


def record_issues(records: DataFrame, key: str = "doc_id", column: str = "body") -> DataFrame:
    """key, level, path, issue: a row for every finding of a record. Of records that name one file, all but the first (by
    key) repeat it."""
    v = F.col("v")
    at = lambda name: _at(v, f"$.{name}")
    person = at("personal_info")
    is_person = kind_of(person) == "object"
    said = lambda name: F.trim(_text(person, f"$.{name}"))
    links = _at(person, "$.links")

    def link(x: Column, i: Column) -> Column:
        base = F.concat(F.lit("$.personal_info.links["), i.cast("string"), F.lit("]"))
        found = [_finding("error", base, "no object", kind_of(x) != "object")]
        for field in ("label", "url"):
            kind = kind_of(F.try_variant_get(x, f"$.{field}", "variant"))
            path = F.concat(base, F.lit(f".{field}"))
            found += [_finding("error", path, "missing", (kind_of(x) == "object") & (kind == "missing")), _finding("error", path, "no string", (kind_of(x) == "object") & ~kind.isin("string", "missing"))]
        url = F.trim(F.try_variant_get(x, "$.url", "string"))
        odd = (kind_of(F.try_variant_get(x, "$.url", "variant")) == "string") & (url != "") & ~url.rlike("^(?:https?://|www\\.)") & ~url.rlike(NO_LINK)
        return F.array(*found, _finding("warning", F.concat(base, F.lit(".url")), "odd address", odd))

    file = F.trim(_text(v, "$.file"))
    plain = [
        *[_finding("error", f"$.{k}", "missing", at(k).isNull()) for k in TOP], _finding("error", "$.file", "empty", F.coalesce(file, F.lit("")) == ""),
        _finding("error", "$.personal_info", "no object", ~is_person), *[_finding("error", f"$.personal_info.{k}", "no string", is_person & ~kind_of(_at(person, f"$.{k}")).isin("string", "null", "missing")) for k in PERSON[:4]],
        _finding("warning", "$.personal_info.email", "odd address", (said("email") != "") & ~said("email").rlike(EMAIL)), _finding("warning", "$.personal_info.phone", "odd number", (said("phone") != "") & ~said("phone").rlike(PHONE)),
        _finding("error", "$.personal_info.links", "no list", is_person & ~kind_of(links).isin("list", "null", "missing")), *[_finding("error", f"$.{k}", "no list", kind_of(at(k)) != "list") for k in (*ENTRIES, "skills", "certifications")],
    ]
    found = F.array(
        F.array(*plain), _unknown(v, F.lit("$"), TOP), _unknown(person, F.lit("$.personal_info"), PERSON), F.flatten(F.transform(_items(links), link)), *[_entry_findings(at(k), k) for k in ENTRIES],
        *[_string_items(at(k), F.lit(f"$.{k}")) for k in ("skills", "certifications")],
    )
    is_object = kind_of(v) == "object"
    root = F.array(F.array(_finding("error", "$", "no object", ~F.coalesce(is_object, F.lit(False)))))
    x = parsed(records, column).select(key, file.alias("file"), F.when(is_object, found).otherwise(root).alias("found"))
    rows = x.select(key, F.explode(F.flatten(F.array_compact("found"))).alias("f")).filter("f IS NOT NULL").select(key, "f.*")
    first = x.filter("file <> ''").groupBy("file").agg(F.min(key).alias("first"))
    again = x.join(first, "file").filter(F.col(key) > F.col("first")).select(key, F.lit("error").alias("level"), F.lit("$.file").alias("path"), F.lit("repeated").alias("issue"))
    return rows.unionByName(again)
