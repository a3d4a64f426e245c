"""Field parsers on literal sections, and their folds against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from folioframe.functions.dates import date_range
from folioframe.operators import locate, parsers, sections
from folioframe.plans import parser_queries
from folioframe.plans.fixtures import view

SF = "/root/testdata/sf0.001"


def lines(spark, *docs):
    return spark.createDataFrame([(d, n, x) for d, ls in enumerate(docs) for n, x in enumerate(ls)], "doc_id long, line_no long, line string")


def test_predicates(spark):
    titles = ["Data Engineer", "Part-Time Tutor", "engineer of things that work well", "Built the data lake for us.", "Northwind", "Chemistry", ""]
    places = ["Pune", "new delhi", "Austin, TX", "Pune, India", "Pune Systems", "Somewhere", "Remote", "a b c d e", ""]
    got = spark.createDataFrame([(t,) for t in titles], "t string").select(parsers.is_title(F.col("t"))).collect()
    assert [r[0] for r in got] == [True, True, False, False, False, False, False]
    got = spark.createDataFrame([(t,) for t in places], "t string").select(parsers.is_place(F.col("t"))).collect()
    assert [r[0] for r in got] == [True, True, True, True, False, False, True, False, False]
    degrees = ["B.Tech in CS", "Master  of   Science", "12th, CBSE", "University of Pune", "MBAs"]
    got = spark.createDataFrame([(t,) for t in degrees], "t string").select(F.col("t").rlike(parsers.DEGREE)).collect()
    assert [r[0] for r in got] == [True, True, True, False, False]


def test_education_groups(spark):
    x = lines(
        spark,
        ["B.Tech in CS", "IIT Delhi", "CGPA: 8.4/10", "2016 - 2020", "Delhi Public School", "12th, CBSE"],
        ["Stanford University", "M.Sc Physics", "Anytown Centre", "B.Sc Physics", " ", "University of Pune"],
        ["M.Sc Physics", "B.Sc Physics 2014", "91 %", "HSC"],
        ["", None],
        [],
    )
    got = {}
    for r in parsers.education_groups(x).orderBy("line_no").collect():
        got.setdefault(r["doc_id"], []).append(r["entry"])
    assert got == {0: [0, 0, 0, 0, 1, 1], 1: [0, 0, 1, 1, 1], 2: [0, 1, 1, 2]}
    assert parsers.education_groups(x.limit(0)).count() == 0


def grouped(rows):
    """Entry numbers of (degree, school, stays, orphan) rows, with lists of lines as groups."""
    groups, current = [], []
    for i, (degree, school, stays, _) in enumerate(rows):
        clash = 0 if degree and not school else 1 if school and not degree else None
        if current and not stays and clash is not None and any(rows[j][clash] for j in current):
            back = [current.pop()] if rows[current[-1]][3] else []
            groups.append(current)
            current = [*back, i]
        else:
            current.append(i)
    groups = [g for g in [*groups, current] if g]
    return {i: n for n, g in enumerate(groups) for i in g}


def test_education_groups_as_lists_do(spark):
    x = view(spark, SF, "education_lines").cache()
    d = date_range(F.trim("line"))
    facts = x.select("doc_id", "line_no", F.trim("line").alias("l"), d["form"].alias("form"), d["start"].alias("start")).orderBy("doc_id", "line_no").collect()
    docs = {}
    for r in facts:
        line, low = r["l"], r["l"].lower()
        degree, school = bool(re.search(parsers.DEGREE, line)), any(w in low for w in parsers.SCHOOLS)
        grade = bool(re.search(rf"(?i)(?:{parsers.GRADE_NAMES})[:\s]*[0-9.]+|[0-9.]+(?:\s*/\s*[0-9.]+)?%?\s*(?:{parsers.GRADE_NAMES})", line))
        pure = bool(r["form"]) and not line.replace(line[line.find(r["start"]) :], "").strip()
        orphan = not r["form"] and not degree and not grade and not re.search(r"[0-9]+(?:\.[0-9]+)?\s*%$", line) and line[:1].isupper()
        docs.setdefault(r["doc_id"], []).append((r["line_no"], (degree, school, grade and not degree and not school or pure, orphan)))
    want = {(k, no): n for k, rows in docs.items() for (no, _), n in zip(rows, grouped([f for _, f in rows]).values(), strict=True)}
    got = {(r["doc_id"], r["line_no"]): r["entry"] for r in parser_queries.education_groups(spark, SF).collect()}
    assert got == want and max(want.values()) > 2


def test_experience_entries(spark):
    x = lines(
        spark,
        ["Data Engineer | Northwind | Pune Jan 2020 – Present", "• Built pipelines", "• Ran them"],
        ["Analyst at Fabrikam 2018 - 2019", "• Reports", "Contoso Ltd 2016 - 2017", "Software Engineer", "Berlin", "• Code"],
        ["Hooli, Bengaluru 2019 - 2021", "Backend Developer", "• x"],
        ["Contoso, Inc 2019 - 2021", "Senior Manager", "• x"],
        ["Intern Jan 2020 – Mar 2020", "• x"],
    )
    got = [tuple(r) for r in parsers.experience_entries(x).orderBy("doc_id", "entry").collect()]
    assert got == [
        (0, 0, "Northwind", "Data Engineer", "Pune", "Jan 2020", None, True, 2),
        (1, 0, "Fabrikam", "Analyst", None, "2018", "2019", False, 1),
        (1, 1, "Contoso Ltd", "Software Engineer", "Berlin", "2016", "2017", False, 1),
        (2, 0, "Hooli", "Backend Developer", "Bengaluru", "2019", "2021", False, 1),
        (3, 0, "Contoso, Inc", "Senior Manager", None, "2019", "2021", False, 1),
        (4, 0, None, "Intern", None, "Jan 2020", "Mar 2020", False, 1),
    ]


def test_project_blocks(spark):
    x = lines(
        spark,
        ["Travel Planner | Python, React", "Jan 2023 - Mar 2023", "• Built a planner with streamlit, see github.com/ana/travel.", "Tech Stack: MQTT, pandas", "Chess Engine 2021 - 2022", "• an engine that plays on phones and on boards.", "Live: https://chess.example.org"],
        ["Python, React, Node", "• Weather Board", "• shows the weather on an esp 32", "• lower text before"],
        ["• lower case text opens nothing", "2019 - 2021", "tools: x", "Home Lab", "runs in a cupboard and hums all day, which the cat enjoys."],
        ["", "  "],
    )
    got = {(r["doc_id"], r["entry"]): r.asDict() for r in parsers.project_blocks(x, sections.heading_dictionary(spark)).collect()}
    assert {k: v["name"] for k, v in got.items()} == {(0, 1): "Travel Planner", (0, 2): "Chess Engine", (1, 1): "Weather Board", (2, 1): "Home Lab"}
    a, b = got[0, 1], got[0, 2]
    assert (a["url"], a["start"], a["end"], a["description"]) == ("https://github.com/ana/travel", "Jan 2023", "Mar 2023", "Built a planner with streamlit, see github.com/ana/travel.")
    assert a["technologies"] == "Python,React,MQTT,Pandas,Streamlit"
    assert (b["url"], b["start"], b["end"], b["description"]) == ("https://chess.example.org", "2021", "2022", "An engine that plays on phones and on boards.")
    assert got[1, 1]["technologies"].startswith("Python,React,Node.js") and "ESP32" in got[1, 1]["technologies"]
    assert got[2, 1]["description"] == "Runs in a cupboard and hums all day, which the cat enjoys."


@pytest.mark.parametrize("known,bullets,want", [
    (["node js", "SQL"], ["Used Node.js, Golang and Power BI"], ["node js", "SQL", "JavaScript", "Go", "Power BI"]),  # "js" stands alone after the dot
    ([], ["javascript and c++ code", None], ["JavaScript"]),
    (["React"], [], ["React"]),
])
def test_implied_skills(spark, known, bullets, want):
    df = spark.createDataFrame([(known, bullets)], "k array<string>, b array<string>")
    assert df.select(parsers.implied_skills(F.col("k"), F.col("b")).alias("s")).first()["s"] == want


def best(spark, groups):
    """Section and score of each group of lines, by the signature operator, which has its own SQL."""
    rows = [(k, n, x) for k, ls in enumerate(groups) for n, x in enumerate(ls)]
    made = locate.signatures(spark.createDataFrame(rows, "k long, line_no long, line string"), "k").collect() if rows else []
    return {r["k"]: (r["best_section"], r["best_score"] or 0.0) for r in made}


def test_section_split_by_states(spark):
    x = [r.asDict() for r in parser_queries._placed(spark, SF).orderBy("doc_id", "line_no").collect()]
    alone = best(spark, [[r["line"]] for r in x])
    now, first, held = {}, {}, {}
    for k, r in enumerate(x):
        d = r["doc_id"]
        zone = r["page"] == 0 and r["top"] <= 0.18 * r["height"]
        if r["section"]:
            now[d] = r["section"]
        elif d not in now and not zone and alone[k][1] >= 0.55:
            now[d] = alone[k][0]
        else:
            held.setdefault((d, now.get(d, "header")), []).append((r["line_no"], r["line"]))
    small = [k for k, ls in held.items() if len(ls) < 4 and k[1] != "header"]
    again = best(spark, [[line for _, line in held[k]] for k in small])
    first = {k: again[i][0] for i, k in enumerate(small) if again[i][1] >= 0.52}
    want = {(k[0], n): first.get(k, k[1]) for k, ls in held.items() for n, _ in ls}
    got = {(r["doc_id"], r["line_no"]): r["section"] for r in parser_queries.section_split_states(spark, SF).collect()}
    assert got == want and len(set(want.values())) > 3


def test_section_split_by_blocks(spark):
    blocks = {}
    for r in parser_queries._placed(spark, SF).orderBy("doc_id", "line_no").collect():
        blocks.setdefault((r["doc_id"], r["page"], r["block"]), []).append(r)
    scores = best(spark, [[r["line"] for r in ls] for ls in blocks.values()])
    now, seen, want = {}, set(), {}
    for k, ((d, page, block), ls) in enumerate(blocks.items()):
        section, score = scores[k]
        if ls[0]["section"]:
            now[d] = ls[0]["section"]
            seen.add(d)
            ls, out = ls[1:], now[d]
        elif d not in seen and page == 0 and block <= 2 and ls[0]["top"] <= 0.18 * ls[0]["height"]:
            out = "header"
        else:
            if section and score >= (0.48 if now.get(d, "header") == "header" else 0.6):
                now[d] = section
            out = now.get(d, "header")
        want |= {(d, r["line_no"]): out for r in ls}
    got = {(r["doc_id"], r["line_no"]): r["section"] for r in parser_queries.section_split_blocks(spark, SF).collect()}
    assert got == want and len(set(want.values())) > 3


def test_parser_queries_run(spark):
    for name, query in parser_queries.QUERIES.items():
        assert query(spark, SF).count() > 0, name
