import importlib
import io
import json
import subprocess
import sys
import zipfile
from pathlib import Path

from pyspark.sql import functions as F

from folioframe.operators import entries
from folioframe.sources import documents
from folioframe.streaming import gate

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def docx(paragraphs, link=None):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    if link:
        body += '<w:p><w:hyperlink r:id="r1"><w:r><w:t>Site</w:t></w:r></w:hyperlink></w:p>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}" xmlns:r="{R}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="{link or ""}"/></Relationships>')
    return out.getvalue()


def test_docx(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx(["Jordan  Sample", "", "Skills"], "https://example.org/x"))
    (tmp_path / "b.docx").write_bytes(b"not a zip file, but long enough to pass the size check " * 3)
    (tmp_path / "c.txt").write_bytes(b"x" * 200)
    (tmp_path / "d.docx").write_bytes(b"tiny")
    found = documents.files(spark, str(tmp_path))
    assert {Path(r["path"]).name: r["reject_reason"] for r in found.collect()} == {"a.docx": None, "b.docx": None, "c.txt": "suffix", "d.docx": "too_small"}
    got = {Path(r["path"]).name: r for r in documents.read_docx(found.filter("reject_reason IS NULL")).collect()}
    assert (got["a.docx"]["lines"], got["a.docx"]["urls"], got["a.docx"]["error"]) == (["Jordan Sample", "Skills", "Site"], ["https://example.org/x"], None)
    assert got["b.docx"]["lines"] == [] and "BadZipFile" in got["b.docx"]["error"]


def test_labelled_set_and_envelopes(spark, tmp_path):
    rows = [{"file": "a", "personal_info": {"name": "X", "email": "bad"}, "education": [], "experience": [], "projects": [], "skills": ["SQL"]}, {"file": "a", "personal_info": {"name": "Y"}, "education": []}]
    (tmp_path / "set.json").write_text(json.dumps(rows))
    df = documents.labelled_set(spark, str(tmp_path / "set.json"))
    issues = sorted(r["issue"] for r in documents.schema_issues(df).collect())
    assert issues == ["missing_experience", "missing_projects", "missing_skills", "odd_email", "repeated_file"]
    documents.write_envelopes(df.select(F.col("file").alias("doc_id"), "skills"), str(tmp_path / "out"))
    assert '"skills":null' in json.loads(sorted((tmp_path / "out").glob("part-*"))[0].read_text().splitlines()[1])["profile"]


def test_stream_gives_the_batch_result(spark, tmp_path):
    lines = [{"doc_id": 1, "text": "the work of an engineer in the university", "ts": "2024-01-01T00:00:00"}, {"doc_id": 2, "text": "резюме инженера", "ts": "2024-01-01T00:01:00"}, {"doc_id": 2, "text": "резюме инженера", "ts": "2024-01-01T00:02:00"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text("\n".join(map(json.dumps, lines)))
    stream = gate.document_stream(spark, str(tmp_path / "in"))
    gate.run_once(gate.gated(gate.once(stream)), "gated", str(tmp_path / "ck"))
    assert {(r["doc_id"], r["language"]) for r in spark.table("gated").collect()} == {(1, "English"), (2, "Non-English")}
    gate.run_once(gate.accepted_per_window(stream), "windows", str(tmp_path / "ck2"), "complete")
    assert [r["documents"] for r in spark.table("windows").collect()] == [3]


def test_experience_bundles(spark):
    lines = ["Engineer | Acme | Jan 2020 – Present", "Pune", "• Built a thing", "that works", "• Cut cost", "Analyst at Initech", "• Reported"]
    got = spark.createDataFrame([(lines,)], "l array<string>").select(entries.experience_bundles(F.col("l")).alias("e")).first()["e"]
    assert [(e["headers"], e["bullets"]) for e in got] == [(["Engineer | Acme | Jan 2020 – Present", "Pune"], ["Built a thing that works", "Cut cost"]), (["Analyst at Initech"], ["Reported"])]


def test_entries(spark):
    df = spark.createDataFrame([("AWS Architect (Amazon) 2021", "builtPipelines with sparkAnd kafka,redis")], "c string, x string")
    r = df.select(entries.certification(F.col("c")).alias("c"), entries.crushed(F.col("x")).alias("x"), entries.technologies(F.lit("Used C++, node.js and Spark")).alias("t")).first()
    assert (r["c"]["name"], r["c"]["issuer"], r["c"]["year"]) == ("AWS Architect", "Amazon", "2021")
    assert r["x"] == "Built Pipelines with spark And kafka,redis"
    assert r["t"] == ["Node.js", "C++", "Apache Spark"]  # projects' own come first


def test_entry_imports_without_the_training_data_part():
    code = "import sys; sys.modules['folioframe.llm'] = None\nimport __spark_entry__ as e\nprint(len(e.queries()), len(e.oracle_sql()))"
    root = Path(__file__).resolve().parent.parent
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 60 and int(out[1]) > 60


def test_every_oracle_has_its_query():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
