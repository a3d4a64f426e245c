"""Education sections to records: a table where there is one, rows of run-together text, or groups of lines.

Lines are read in plain columns first (dates, grades, degrees, institutions); only then does a fold over a document's own
lines fill its records. One shuffle brings a document's lines together; grouping, tables and records all reuse it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import date_range
from .parsers import DATED, DEGREE, GRADE_NAMES, INSTITUTIONS, SCHOOLS, _holds, education_groups, is_place

#: A table's head, a row in brackets, a row of run-together text, lines that say nothing of the record.
TABLE_HEAD = r"(?i)^(?:degree(?:/certificate)?|qualification|programme|course)\b.*\b(?:institute|institution|university|board|college|school)\b"
BRACKETS = r"^(.+?)\s+(.+?)\s+\[([^\]]+)\]\s+\[([^\]]+)\]$"
_SHORT_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
CRUSHED_ROW = (
    rf"(?i)^({_SHORT_MONTH}\s*\d{{4}}|\d{{4}})\s*[-–]\s*({_SHORT_MONTH}\s*\d{{4}}|\d{{4}}|Present)\s+"
    r"((?:B\.?Tech|M\.?Tech|B\.?Sc|M\.?Sc|B\.?E|M\.?E|B\.?Com|M\.?Com|MBA|BCA|MCA|Bachelor|Master|Ph\.?D|Secondary|Senior\s*Secondary|High\s*School|Diploma|Intermediate|12th|10th|SSC|HSC|CBSE|ICSE)[\w\s./()-]*)\s+"
    r"([A-Z][^0-9]{4,80}?)\s+([0-9]+(?:\.[0-9]+)?(?:\s*/\s*[0-9]+(?:\.[0-9]+)?)?%?)"
)
SAYS_NOTHING = r"(?i)^(?:Thesis|Dissertation|Research|Topic|Project|Specialization|Minor|Focus|Concentration|Advisor|Supervisor|Committee|Note|Award|Honours?|Cum\s+Laude)\s*[:\-–]"
#: The five forms of a grade: after its name, before its name, percent, of 100, bare at the end of a degree.
NAMED_GRADE = rf"(?i)({GRADE_NAMES})[:\s]*([0-9.]+(?:\s*/\s*[0-9.]+)?%?)"
GRADE_FIRST = rf"(?i)([0-9.]+(?:\s*/\s*[0-9.]+)?%?)\s*({GRADE_NAMES})"
PERCENT, OF_HUNDRED = r"^[0-9]+(?:\.[0-9]+)?\s*%\s*$", r"^[0-9]+(?:\.[0-9]+)?\s*/\s*100\s*$"
BARE_GRADE = r"\b([0-9]\.[0-9]{1,2}|10(?:\.0)?)\s*$"
RECORD = ("institution", "degree", "field_of_study", "start", "end", "is_current", "gpa")
_RECORD_TYPE = "struct<institution:string,degree:string,field_of_study:string,start:string,end:string,is_current:boolean,gpa:string>"

_edges = lambda c: F.regexp_replace(c, "^[ ,-]+|[ ,-]+$", "")
_some = lambda c: F.nullif(F.trim(c), F.lit(""))
_group = lambda c, p, k: F.when(c.rlike(p), F.regexp_extract(c, p, k))


def _record(**fields: Column) -> Column:
    null = {n: F.lit(None).cast("boolean" if n == "is_current" else "string") for n in RECORD}
    return F.struct(*[(fields.get(n, null[n])).alias(n) for n in RECORD])


def _studied(text: Column) -> Column:
    """struct(degree, field): "degree in field"; all of it is the degree otherwise."""
    inside = r"(?i)\bin\s+(.+)$"
    return F.when(text.rlike(inside), F.struct(_some(F.split(text, inside, 2)[0]).alias("degree"), F.trim(F.regexp_extract(text, inside, 1)).alias("field"))).otherwise(F.struct(text.alias("degree"), F.lit(None).cast("string").alias("field")))


def table_rows(lines: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """key, order and the record of each row of an education table.

    In a document with a table's head, a line without a bracket and without a date continues the row before it; a row is
    "degree institution [grade] [end]", or a date range with a grade, a degree "in" a field, or else an institution. In
    a document without a head, a row of run-together text (dates, degree, institution, grade) is one by itself.
    """
    line = F.trim("line")
    x = lines.select(key, order, line.alias("line")).filter("line <> ''").withColumn("is_head", F.col("line").rlike(TABLE_HEAD))
    doc = Window.partitionBy(key)
    x = x.withColumn("headed", F.max("is_head").over(doc)).filter("NOT is_head").withColumn("dated", F.col("line").rlike(DATED))
    opens = F.contains("line", F.lit("[")) | F.col("dated") | ~F.col("headed")
    x = x.withColumn("row", F.sum(F.when(opens, 1).otherwise(0)).over(doc.orderBy(order)))
    # lines before the first that opens a row are one row
    rows = x.groupBy(key, "headed", "row").agg(F.min(order).alias(order), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "line"))), lambda s: s["line"]), " ").alias("line"))
    rows = rows.withColumn("dr", date_range(F.col("line")))
    row, rest = F.col("line"), F.col("dr.remaining")
    brackets = _record(degree=F.trim(F.regexp_extract(row, BRACKETS, 1)), institution=F.trim(F.regexp_extract(row, BRACKETS, 2)), gpa=F.trim(F.regexp_extract(row, BRACKETS, 3)), end=F.trim(F.regexp_extract(row, BRACKETS, 4)), is_current=F.lit(False))
    text = F.when(rest.rlike(NAMED_GRADE), _edges(F.regexp_replace(rest, NAMED_GRADE, ""))).otherwise(F.trim(rest))
    has = text.rlike(DEGREE)
    dated = F.col("dr.form").isNotNull()
    inline = _record(
        institution=F.when(~has, text), degree=F.when(has, _studied(text)["degree"]), field_of_study=F.when(has, _studied(text)["field"]), gpa=F.trim(_group(rest, NAMED_GRADE, 2)),
        start=F.when(dated, F.col("dr.start")), end=F.when(dated, F.col("dr.end")), is_current=F.when(dated, F.col("dr.is_current")),
    )
    apart = lambda c: _some(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "(?<=[a-z])(?=[A-Z])", " "), r"\bin\b", " in "), r"\s+", " "))
    degree, end = F.trim(F.regexp_extract(row, CRUSHED_ROW, 3)), F.trim(F.regexp_extract(row, CRUSHED_ROW, 2))
    within = r"(?i)in\s*(.+)$"
    crushed = _record(
        institution=apart(_edges(F.trim(F.regexp_extract(row, CRUSHED_ROW, 4)))), degree=apart(F.when(degree.rlike(within), F.split(degree, within, 2)[0]).otherwise(degree)), field_of_study=apart(_group(degree, within, 1)),
        start=F.trim(F.regexp_extract(row, CRUSHED_ROW, 1)), end=end, is_current=F.lower(end) == "present", gpa=_some(F.regexp_extract(row, CRUSHED_ROW, 5)),
    )
    got = F.when(F.col("headed") & row.rlike(BRACKETS), brackets).when(F.col("headed") & (text != "") & (~has | _studied(text)["degree"].isNotNull()), inline).when(~F.col("headed") & row.rlike(CRUSHED_ROW), crushed)
    # as a generated row, so that the filter is not moved down with a copy of the whole record
    return rows.select(key, order, F.explode(F.array(got)).alias("r")).filter("r IS NOT NULL").select(key, order, "r.*")


def _barred(cells: Column) -> Column:
    """The record of a line of three or more parts between bars; null if it has neither name nor degree, or no date and no
    grade. Parts fill the first empty place they fit: dates, grades, degrees, institutions; what is left fills the rest."""
    text = "string"
    null = F.lit(None).cast(text)
    zero = F.struct(*[null.alias(n) for n in ("institution", "degree", "field", "gpa")], F.lit(None).cast("struct<start:string,end:string,is_current:boolean>").alias("dr"), F.array().cast("array<string>").alias("left"))

    def put(a: Column, **new: Column) -> Column:
        return F.struct(*[(new.get(n, a[n])).alias(n) for n in ("institution", "degree", "field", "gpa", "dr", "left")])

    def step(a: Column, c: Column) -> Column:
        dated = c["dr"]["form"].isNotNull() & a["dr"].isNull()
        found = F.struct(c["dr"]["start"].alias("start"), c["dr"]["end"].alias("end"), c["dr"]["is_current"].alias("is_current"))
        with_field = put(a, degree=c["degree"], field=c["field"])
        plain = F.when(a["degree"].isNull(), put(a, degree=c["rest"])).when(a["field"].isNull(), put(a, field=c["rest"])).otherwise(a)
        return (
            F.when(dated, put(a, dr=found)).when(c["grade"].isNotNull(), put(a, gpa=c["grade"]))
            .when(c["is_degree"], F.when(c["field"].isNotNull(), with_field).otherwise(plain))
            .when(c["is_school"], F.when(a["institution"].isNull(), put(a, institution=c["rest"])).otherwise(a))
            .otherwise(put(a, left=F.array_append(a["left"], c["rest"])))
        )

    def fill(a: Column, item: Column) -> Column:
        studied = a["field"].isNull() & a["degree"].isNotNull() & (F.size(F.split(F.trim(item), r"\s+")) >= 2)
        return F.when(studied, put(a, field=item)).when(a["degree"].isNull(), put(a, degree=item)).when(a["institution"].isNull(), put(a, institution=item)).otherwise(a)

    got = F.aggregate(cells, zero, step, lambda a: F.aggregate(a["left"], a, fill))
    whole = F.transform(F.array(got), lambda a: F.when(
        (a["institution"].isNotNull() | a["degree"].isNotNull()) & (a["dr"].isNotNull() | a["gpa"].isNotNull()),
        _record(institution=a["institution"], degree=a["degree"], field_of_study=a["field"], start=a["dr"]["start"], end=a["dr"]["end"], is_current=a["dr"]["is_current"], gpa=a["gpa"]),
    ))
    return F.get(whole, F.lit(0))


def _said(text: Column) -> Column:
    """What a line says once its date and grade are out: is it blank, a degree, an institution before a degree, a place."""
    dash = r"\s+[–—-]\s+(.+)$"
    before = F.split(text, DEGREE, 2)[0]
    behind = F.substring(text, F.length(before) + F.lit(1), F.length(text))

    def studied(t: Column) -> Column:
        inside, head = r"(?i)\bin\s+(.+)$", F.split(t, dash, 2)[0]
        return (
            F.when(t.rlike(inside), _studied(t)).when(t.rlike(dash) & head.rlike(DEGREE), F.struct(_some(head).alias("degree"), F.trim(F.regexp_extract(t, dash, 1)).alias("field")))
            .otherwise(F.struct(t.alias("degree"), F.lit(None).cast("string").alias("field")))
        )

    is_degree = text.rlike(DEGREE)
    school = F.when(is_degree & _holds(text, INSTITUTIONS), _some(_edges(before)))
    return F.struct(
        text.alias("text"), (F.length(text) == 0).alias("blank"), is_degree.alias("is_degree"), F.when(is_degree, studied(text)).alias("whole"), school.alias("school"),
        F.when(school.isNotNull(), studied(_edges(behind))).alias("rest"), is_place(text).alias("is_place"),
    )


def barred_records(lines: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """key, order, barred: the records of lines of three or more parts between bars."""
    x = lines.select(key, order, F.filter(F.transform(F.split("line", r"\|"), lambda p: F.trim(p)), lambda p: p != "").alias("parts"), F.size(F.split("line", r"\|")).alias("bars"))
    x = x.filter((F.col("bars") > 2) & (F.size("parts") > 2)).select(key, order, F.posexplode("parts").alias("no", "part")).withColumn("dr", date_range(F.col("part")))
    rest = F.when(F.trim("dr.remaining") != "", F.trim("dr.remaining")).otherwise(F.col("part"))
    grade = F.trim(F.coalesce(_group(F.col("part"), NAMED_GRADE, 2), _group(F.col("part"), GRADE_FIRST, 1)))
    is_degree, studied = rest.rlike(DEGREE), _studied(rest)
    cell = F.struct(
        "no", "dr", grade.alias("grade"), rest.alias("rest"), is_degree.alias("is_degree"), F.when(is_degree & studied["field"].isNotNull(), studied["degree"]).alias("degree"),
        F.when(is_degree, studied["field"]).alias("field"), _holds(rest, SCHOOLS).alias("is_school"),
    )
    return x.groupBy(key, order).agg(F.array_sort(F.collect_list(cell)).alias("cells")).select(key, order, _barred(F.col("cells")).alias("barred"))


def group_records(groups: DataFrame, key: str = "doc_id", order: str = "line_no", lines: DataFrame | None = None) -> DataFrame:
    """key, entry and the record of each group (entry) of education lines: a line fills what the record still lacks.

    Of a line, the first date range, the grade (in one of five forms) and then the rest are read: an institution before
    a degree, a degree with its field behind "in" or a dash, a place (nothing), or else the institution, then the degree.
    A bare number ends a degree's line as its grade only while there is none. A line of three or more parts between bars
    that is a record by itself is the group's record. Groups without an institution and a degree have none. With the
    lines that the groups come from, lines between bars are read from them, and the groups are made once.
    """
    bars = groups if lines is None else lines.select(key, order, F.trim("line").alias("line"))
    x = groups.filter(~F.col("line").rlike(SAYS_NOTHING)).join(barred_records(bars, key, order), [key, order], "left").withColumn("dr", date_range(F.col("line")))
    rest = F.when(F.trim("dr.remaining") != "", F.trim("dr.remaining")).otherwise(F.col("line"))
    x = x.withColumn("rest", rest)
    rest = F.col("rest")
    named, first = _group(rest, NAMED_GRADE, 2), _group(rest, GRADE_FIRST, 1)
    sure = F.trim(F.coalesce(named, first, F.when(rest.rlike(PERCENT) | rest.rlike(OF_HUNDRED), rest)))
    x = x.withColumn("sure", sure).withColumn("bare", F.when(F.col("sure").isNull() & rest.rlike(DEGREE), _group(rest, BARE_GRADE, 1)))
    without = F.when(named.isNotNull(), _edges(F.regexp_replace(rest, NAMED_GRADE, ""))).when(first.isNotNull(), _edges(F.regexp_replace(rest, GRADE_FIRST, ""))).when(F.col("sure").isNotNull(), "").otherwise(rest)
    x = x.withColumn("without", without).withColumn("shorter", F.when(F.col("bare").isNotNull(), _edges(F.regexp_replace(rest, BARE_GRADE, ""))))
    found = F.when(F.col("dr.form").isNotNull(), F.struct(F.col("dr.start").alias("start"), F.col("dr.end").alias("end"), F.col("dr.is_current").alias("is_current")))
    said = F.struct(F.col(order).alias("o"), "barred", found.alias("dr"), "sure", "bare", _said(F.col("without")).alias("said"), F.when(F.col("shorter").isNotNull(), _said(F.col("shorter"))).alias("shorter"))
    per = x.select(key, "entry", said.alias("x")).groupBy(key, "entry").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    null = F.lit(None).cast("string")
    zero = F.struct(*[null.alias(n) for n in ("institution", "degree", "field", "gpa")], F.lit(None).cast("struct<start:string,end:string,is_current:boolean>").alias("dr"), F.lit(None).cast(_RECORD_TYPE).alias("barred"))

    def step(a: Column, x: Column) -> Column:
        s = F.when(a["gpa"].isNull() & x["bare"].isNotNull(), x["shorter"]).otherwise(x["said"])
        led = a["institution"].isNull() & s["school"].isNotNull()
        placed = a["institution"].isNotNull() & s["is_place"]
        words = ~s["blank"] & ~s["is_degree"]
        names = words & a["institution"].isNull()
        degree = F.when(s["blank"], a["degree"]).when(led, s["rest"]["degree"]).when(s["is_degree"], s["whole"]["degree"]).when(words & ~names & ~placed & a["degree"].isNull(), s["text"]).otherwise(a["degree"])
        field = F.when(s["blank"] | ~s["is_degree"], a["field"]).when(led, F.coalesce(s["rest"]["field"], a["field"])).otherwise(F.coalesce(s["whole"]["field"], a["field"]))
        return F.struct(
            F.when(led & ~s["blank"], s["school"]).when(names, s["text"]).otherwise(a["institution"]).alias("institution"), degree.alias("degree"), field.alias("field"),
            F.coalesce(x["sure"], a["gpa"], x["bare"]).alias("gpa"), F.coalesce(a["dr"], x["dr"]).alias("dr"), F.coalesce(a["barred"], x["barred"]).alias("barred"),
        )

    done = F.aggregate("xs", zero, step, lambda a: F.coalesce(a["barred"], _record(institution=a["institution"], degree=a["degree"], field_of_study=a["field"], start=a["dr"]["start"], end=a["dr"]["end"], is_current=a["dr"]["is_current"], gpa=a["gpa"])))
    return per.select(key, "entry", F.explode(F.array(done)).alias("r")).select(key, "entry", "r.*").filter("institution IS NOT NULL OR degree IS NOT NULL")


def education_entries(lines: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """key, entry (from 0) and the record of each entry of an education section: table rows where there are any, else the
    records of its groups of lines."""
    rows = table_rows(lines, key, order)
    tables = rows.withColumn("entry", F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long") - 1).select(key, "entry", *RECORD)
    others = group_records(education_groups(lines.join(rows.select(key).distinct(), key, "left_anti"), key, order), key, order, lines)
    numbered = F.row_number().over(Window.partitionBy(key).orderBy("entry")).cast("long") - 1
    return tables.unionByName(others.withColumn("entry", numbered).select(key, "entry", *RECORD))
