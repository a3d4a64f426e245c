"""Labelled records of odd shapes against plain Python, and over the whole table of the query."""

import json
import re

from folioframe.operators import truth
from folioframe.plans import truth_queries
from folioframe.plans.fixtures import view

SF = "/root/testdata/sf0.001"


def kind(x):
    return "null" if x is None else "object" if isinstance(x, dict) else "list" if isinstance(x, list) else "string" if isinstance(x, str) else "other"


def scalar(x):
    return x if isinstance(x, str) else None if x is None else json.dumps(x, separators=(",", ":"))


def flat(body):
    try:
        r = json.loads(body)
    except (TypeError, ValueError):
        r = None
    if not isinstance(r, dict):
        return None, None, None, None, None, [], [], [], []
    profile = "personal_info" in r or "skills" in r
    person = (r.get("personal_info") if profile else r | {"x": 0}) or {}
    contact = person if profile else (r.get("contact") or {})
    skills = r.get("skills" if profile else "technical_skills")
    groups = skills if isinstance(skills, list) else [y for _, x in sorted(skills.items()) for y in (x if isinstance(x, list) else [x])] if isinstance(skills, dict) else []

    def entries(name, primary):
        v = r.get(name)
        v = [v] if isinstance(v, dict) else v if isinstance(v, list) else []
        return [x if isinstance(x, dict) else {primary: x.strip()} for x in v if isinstance(x, dict) or isinstance(x, str) and x.strip()]

    return (
        "profile" if profile else "contact", scalar(person.get("name")), *[scalar(contact.get(k)) for k in ("email", "phone", "location")], [s for x in groups if x is not None and (s := scalar(x).strip())],
        [(scalar(e.get("institution")), scalar(e.get("degree"))) for e in entries("education", "institution")],
        [(scalar(e.get("title")), scalar(e.get("company") or e.get("organization")), scalar(e.get("start")), scalar(e.get("end"))) for e in entries("experience", "title")], [(scalar(e.get("name")),) for e in entries("projects", "name")],
    )


def issues(body):
    try:
        r = json.loads(body)
    except (TypeError, ValueError):
        r = None
    if not isinstance(r, dict):
        return [("error", "$", "no object")]
    out = [("error", f"$.{k}", "missing") for k in truth.TOP if k not in r] + [("warning", f"$.{k}", "unknown") for k in r if k not in truth.TOP]
    if not (isinstance(r.get("file"), str) and r["file"].strip()):
        out.append(("error", "$.file", "empty"))
    p = r.get("personal_info")
    if not isinstance(p, dict):
        out.append(("error", "$.personal_info", "no object"))
    else:
        out += [("warning", f"$.personal_info.{k}", "unknown") for k in p if k not in truth.PERSON]
        out += [("error", f"$.personal_info.{k}", "no string") for k in truth.PERSON[:4] if kind(p.get(k)) not in ("string", "null")]
        for k, pattern, name in (("email", truth.EMAIL, "odd address"), ("phone", truth.PHONE, "odd number")):
            if isinstance(p.get(k), str) and p[k].strip() and not re.search(pattern, p[k].strip()):
                out.append(("warning", f"$.personal_info.{k}", name))
        links = p.get("links")
        if kind(links) not in ("list", "null"):
            out.append(("error", "$.personal_info.links", "no list"))
        for i, x in enumerate(links if isinstance(links, list) else []):
            at = f"$.personal_info.links[{i}]"
            if not isinstance(x, dict):
                out.append(("error", at, "no object"))
                continue
            out += [("error", f"{at}.{k}", "missing" if k not in x else "no string") for k in ("label", "url") if k not in x or not isinstance(x[k], str)]
            u = x.get("url")
            if isinstance(u, str) and u.strip() and not re.match(r"https?://|www\.", u.strip()) and not re.search(truth.NO_LINK, u):
                out.append(("warning", f"{at}.url", "odd address"))
    for name, keys in truth.ENTRIES.items():
        v = r.get(name)
        if not isinstance(v, list):
            out.append(("error", f"$.{name}", "no list"))
            continue
        for i, x in enumerate(v):
            at = f"$.{name}[{i}]"
            if not isinstance(x, dict):
                out.append(("error", at, "no object"))
                continue
            for k in keys:
                if k not in x:
                    out.append(("error", f"{at}.{k}", "missing"))
                elif k in truth.LISTS:
                    out += [("error", f"{at}.{k}", "no list")] if not isinstance(x[k], list) else [("error", f"{at}.{k}[{j}]", "no string") for j, y in enumerate(x[k]) if not isinstance(y, str)]
                elif kind(x[k]) not in ("string", "null"):
                    out.append(("error", f"{at}.{k}", "no string"))
            out += [("warning", f"{at}.{k}", "unknown") for k in x if k not in keys]
    for k in ("skills", "certifications"):
        out += [("error", f"$.{k}", "no list")] if not isinstance(r.get(k), list) else [("error", f"$.{k}[{j}]", "no string") for j, y in enumerate(r[k]) if not isinstance(y, str)]
    return out


def test_truth_table(spark):
    rows = [tuple(r) for r in view(spark, SF, "labelled").select("doc_id", "body").collect()]
    got = truth.truth_table(spark.createDataFrame([*rows, (-1, None)], "doc_id long, body string")).collect()
    have = {r["doc_id"]: (*r[1:6], list(r["skills"]), *[[tuple(e) for e in r[c]] for c in ("education", "experience", "projects")]) for r in got}
    assert have == {i: flat(b) for i, b in [*rows, (-1, None)]}
    assert {v[0] for v in have.values()} == {"profile", "contact", None}


def test_record_issues(spark):
    rows = [tuple(r) for r in view(spark, SF, "labelled").select("doc_id", "body").collect()]
    got = sorted((r["doc_id"], r["level"], r["path"], r["issue"]) for r in truth_queries.record_issues(spark, SF).collect())
    want = [(i, *x) for i, b in rows for x in issues(b)]
    named = {}
    for i, b in sorted(rows):
        try:
            f = json.loads(b).get("file")
        except (ValueError, AttributeError):
            continue
        if isinstance(f, str) and f.strip():
            if f.strip() in named:
                want.append((i, "error", "$.file", "repeated"))
            named.setdefault(f.strip(), i)
    assert got == sorted(want) and len({x[2] for x in got}) > 25
    assert truth.record_issues(view(spark, SF, "labelled").limit(0)).collect() == []
