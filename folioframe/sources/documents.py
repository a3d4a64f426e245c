"""Readers of documents, labelled sets and dictionaries."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_BYTES, MAX_BYTES = 100, 50 * 1024 * 1024
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PROFILE = (
    "file STRING, personal_info STRUCT<name: STRING, email: STRING, phone: STRING, location: STRING>, "
    "education ARRAY<STRUCT<institution: STRING, degree: STRING, gpa: STRING>>, experience ARRAY<STRUCT<company: STRING, title: STRING, bullets: ARRAY<STRING>>>, "
    "projects ARRAY<STRUCT<name: STRING, description: STRING>>, skills ARRAY<STRING>, certifications ARRAY<STRING>"
)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, content of every file under path, with reject_reason: wrong suffix, too small, too large, or null."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return df.select("path", "length", "content", reject_reason(F.col("path"), F.col("length")).alias("reject_reason"))


def reject_reason(path: Column, length: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(~suffix.isin("pdf", "docx"), "suffix").when(length < MIN_BYTES, "too_small").when(length > MAX_BYTES, "too_large")


def parse_docx(content: bytes) -> tuple[list[str], list[str]]:
    """Non-empty paragraphs (tables' too) in order, and distinct web links."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
        rels = z.read("word/_rels/document.xml.rels") if "word/_rels/document.xml.rels" in z.namelist() else b"<r/>"
    targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(rels)}
    lines = []
    for p in root.iter(f"{_W}p"):
        parts = []
        for e in p.iter():
            if e.tag == f"{_W}t":
                parts.append(e.text or "")
            elif e.tag in (f"{_W}tab", f"{_W}br", f"{_W}cr"):
                parts.append(" ")
        if line := " ".join("".join(parts).split()):
            lines.append(line)
    urls = [targets.get(h.get(f"{_R}id"), "") for h in root.iter(f"{_W}hyperlink")]
    return lines, list(dict.fromkeys(u for u in urls if u and u.startswith(("http://", "https://"))))


def read_docx(found: DataFrame) -> DataFrame:
    """path, lines, urls, error of files (path, content): a file that cannot be read is a row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows.append((path, *parse_docx(bytes(content)), None))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows.append((path, [], [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "lines", "urls", "error"])

    return found.select("path", "content").mapInPandas(run, "path string, lines array<string>, urls array<string>, error string")


def labelled_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(PROFILE).json(path)


def schema_issues(profiles: DataFrame) -> DataFrame:
    """file, issue: missing fields, files that repeat, odd addresses; one row a finding."""
    checks = {
        "missing_file": F.coalesce("file", F.lit("")) == "", "missing_personal_info": F.col("personal_info").isNull(), "missing_skills": F.col("skills").isNull(),
        "missing_experience": F.col("experience").isNull(), "missing_education": F.col("education").isNull(), "missing_projects": F.col("projects").isNull(),
        "odd_email": (F.col("personal_info.email") != "") & ~F.col("personal_info.email").rlike(r"^[^@\s]+@[^@\s]+\.[a-z]{2,}$"),
    }
    found = F.array_compact(F.array(*[F.when(c, n) for n, c in checks.items()]))
    twice = profiles.filter("file IS NOT NULL").groupBy("file").count().filter("count > 1").select("file", F.lit("repeated_file").alias("issue"))
    return profiles.select("file", F.explode(found).alias("issue")).unionByName(twice)


def write_envelopes(profiles: DataFrame, path: str, key: str = "doc_id") -> None:
    """One JSON document a line, nulls kept, with the key beside it."""
    body = F.to_json(F.struct(*[c for c in profiles.columns if c != key]), {"ignoreNullFields": "false"})
    profiles.select(key, body.alias("profile")).write.mode("overwrite").option("ignoreNullFields", False).json(path)
