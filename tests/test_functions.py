import collections

from pyspark.sql import functions as F

from folioframe.functions import contacts, dates, grades, text
from folioframe.operators import consensus, entries, evaluation, sections, skills
from folioframe.plans import entry_queries, profile_queries
from folioframe.plans.fixtures import HEADINGS, view

SF = "/root/testdata/sf0.001"


def column(spark, values, expr, name="v"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, {name} string")
    return [r["o"] for r in df.select("i", expr(F.col(name)).alias("o")).orderBy("i").collect()]


def test_date_ranges(spark):
    got = column(spark, ["Jan 2020 – Present", "Jan-Mar 2021", "2019-21", "Jan'19 - Feb'20", "03/2020 to 05/2021", "since 2020", "2020 till date", "Class of 1998", "", None], dates.date_range)
    short = [(r["start"], r["end"], r["is_current"]) if r else None for r in got]
    assert short[:7] == [("Jan 2020", None, True), ("Jan 2021", "Mar 2021", False), ("2019", "2021", False), ("Jan 2019", "Feb 2020", False), ("Mar 2020", "May 2021", False), ("2020", None, True), ("2020", None, True)]
    assert short[7] == (None, None, None) and got[7]["remaining"] == "Class of 1998"


def test_approximate_dates(spark):
    got = column(spark, ["Jan 2020", "Foo 2020", "3/2020", "13/2020", "2019", "x", None], dates.approximate_date)
    assert [str(d) if d else None for d in got] == ["2020-01-01", "2020-01-01", "2020-03-01", None, "2019-01-01", None, None]


def test_grades(spark):
    got = column(spark, ["8.4/10", "3.6/4", "87%", "A+", "First Class", "450/500", ".", "", None, "CGPA: 9"], grades.normalize_grade)
    assert [(r["scale"], r["percentage"]) for r in got] == [("cgpa_10", 79.8), ("gpa_4", 88.5), ("percentage", 87.0), ("letter", 96.0), ("class", 72.5), ("percentage", 90.0), ("unknown", None), ("unknown", None), ("unknown", None), ("cgpa_10", 85.5)]


def test_contacts(spark):
    assert column(spark, ["x A.B@C.Org y", "none", None], contacts.email) == ["a.b@c.org", None, None]
    assert column(spark, ["9876543210", "call +1 (555) 010-0199", "12345"], contacts.phone) == ["+91 98765 43210", "+1 (555) 010-0199", None]
    assert column(spark, ["Ana de Silva", "ana silva", "Ana", "Ana Silva 3"], contacts.looks_like_name) == [True, False, False, False]


def test_text(spark):
    assert column(spark, ["a  b (cid:3) , c", None], text.clean_text) == ["a b, c", None]
    assert column(spark, ["x" * 30, "ok text", "$$$$ a"], text.is_malformed) == [True, False, True]


def test_headings(spark):
    lines = spark.createDataFrame([(1, 0, "Name"), (1, 1, "WORK EXPERIENCE:"), (1, 2, "did things"), (1, 3, "1. Éducation"), (1, 4, "• skills"), (2, 0, "TechnicalSkills")], "doc_id long, line_no int, line string")
    marked = sections.match_headings(lines, sections.heading_dictionary(spark))
    assert {(r["doc_id"], r["line_no"]): r["section"] for r in marked.collect() if r["section"]} == {(1, 1): "experience", (1, 3): "education", (1, 4): "skills", (2, 0): "skills"}
    filled = {(r["doc_id"], r["line_no"]): r["in_section"] for r in sections.fill_sections(marked).collect()}
    assert filled == {(1, 0): "header", (1, 2): "experience", (1, 4): "education"}


def test_skills(spark):
    raw = spark.createDataFrame([(1, 0, "Python 3"), (1, 1, "React (Advanced)"), (1, 2, "websocket"), (1, 3, "Languages: Go"), (1, 4, "weird thing")], "cand_id long, pos long, raw string")
    got = {r["raw"]: (r["canonical"], r["level"], r["known"]) for r in skills.normalize_skills(raw).collect()}
    assert got == {"Python 3": ("Python", None, True), "React (Advanced)": ("React", "Expert", True), "websocket": ("WebSocket", None, True), "Languages: Go": ("Go", None, True), "weird thing": ("Weird Thing", None, False)}


def test_greedy_assignment_takes_each_found_value_once(spark):
    t = spark.createDataFrame([(1, 0, "data engineer"), (1, 1, "data engineer lead")], "k long, o int, v string")
    f = spark.createDataFrame([(1, 0, "data engineer lead"), (1, 1, "cook")], "k long, o int, v string")
    r = evaluation.greedy_assignment(t, f, "k", "o", "v").first()
    assert r["matched"] == 1 and abs(r["score"] - 0.4) < 1e-6


def test_drop_contained(spark):
    df = spark.createDataFrame([(["Spark", "Apache Spark", "SQL"],)], "a array<string>")
    assert df.select(consensus.drop_contained(F.col("a")).alias("o")).first()["o"] == ["Apache Spark", "SQL"]


def test_greedy_assignment_reads_all_jobs(spark):
    titles = collections.defaultdict(list)
    for r in view(spark, SF, "jobs").orderBy("cand_id", "job_no").collect():
        titles[r["cand_id"]].append(r["title"])
    want = {}
    for k, own in titles.items():
        left, score = {i: {*x.lower().split(), "team"} if i % 2 else {"volunteer"} for i, x in enumerate(own)}, []
        for words in (set(x.lower().split()) for x in own):
            like = {i: 2 * len(words & f) / (len(words) + len(f)) for i, f in left.items()}
            best = min(like, key=lambda i: (-like[i], i), default=None)
            if best is not None and like[best] >= 0.5:
                score.append(like[best])
                del left[best]
        want[k] = (len(score), round(sum(score) / len(own), 6))
    assert max(map(len, titles.values())) > 8
    assert {r["cand_id"]: (r["matched"], r["score"]) for r in profile_queries.greedy_assignment(spark, SF).collect()} == want


def test_section_summary_reads_the_whole_section(spark):
    got = {r["doc_id"]: r["summary"] for r in entry_queries.section_summary(spark, SF).collect()}
    want, inside = collections.defaultdict(list), {}
    for r in view(spark, SF, "resume_lines").orderBy("doc_id", "line_no").collect():
        if r["line"] in HEADINGS[:9]:  # the last two are no headings as they stand
            inside[r["doc_id"]] = r["line"] == "about me"
        elif inside.get(r["doc_id"]):
            want[r["doc_id"]].append(r["line"].removeprefix("• "))
    assert got == {k: " ".join(v) if len(" ".join(v)) >= 15 else None for k, v in want.items()} and max(map(len, want.values())) > 2


def test_technologies_are_all_named(spark):
    ten = "Python, Java, React, Node, PostgreSQL, Kafka, Docker, AWS, Git, Machine Learning"
    values = [ten, "LLM and rag-pipelines on ESP 32 over MQTT with pandas", "R and C", "C++, C#, R&D, c, r", "pythonic .js", None, *entries.PROJECT_TECHNOLOGIES]
    got = column(spark, values, entries.technologies)
    assert got[0] == ["Python", "React", "Node.js", "Java", "PostgreSQL", "AWS", "Docker", "Kafka", "Git", "Machine Learning"]
    assert got[1] == ["Large Language Models", "RAG (Retrieval-Augmented Generation)", "Pandas", "ESP32", "MQTT"]
    assert got[2:6] == [["C", "R"], ["C++", "C#"], [], []]
    assert all(name in found for name, found in zip(entries.PROJECT_TECHNOLOGIES, got[6:], strict=True))
