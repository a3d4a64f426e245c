"""Education groups, experience entries, project blocks and skills that bullets imply: ordered folds over a document's own
lines, whose features are columns computed before the fold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import RANGES, date_range
from ..functions.text import words
from . import entries, sections

#: Degree terms and their other names.
DEGREES = (
    "Bachelor, Master, Doctor, Doctorate, Associate, Diploma, BSc, MSc, BTech, MTech, BCA, MCA, BBA, MBA, B.E, M.E, B.Eng, M.Eng, High School, Secondary, Intermediate, 10th, 12th, SSC, HSC, CBSE, ICSE, ISC, CISCE, "
    "bachelor degree, bachelors, bachelor's degree, bachelor of arts, bachelor of science, bachelor of engineering, bachelor of technology, bachelor of commerce, bachelor of education, bachelor of business administration, "
    "bachelor of computer applications, b.a, b.sc, b.s, b.tech, master degree, masters, master's degree, master of science, master of engineering, master of technology, master of arts, master of commerce, "
    "master of business administration, master of computer applications, m.a, m.sc, m.s, m.tech, mphil, doctoral, doctor of philosophy, phd, ph.d, associate degree, post graduate diploma, pg diploma, advanced diploma, senior secondary, higher secondary"
).split(", ")
#: Parts of words that mark an institution in education lines, and in experience lines.
SCHOOLS = "university college institute school iit nit bits academy polytechnic campus".split()
INSTITUTIONS = ("university", "institute", "college", "school", "academy", "iit", "nit", "bits", "iisc", "iim", "nift", "iiit", "polytechnic", "faculty", "department", "of technology", "of science", "of engineering", "of management", "of arts")
#: Names of grades, words of job titles, endings of organisations and of companies.
GRADE_NAMES = "CGPA|GPA|Percentage|Score|Marks|Grade|Points|CPI|SGPA|DGPA"
TITLE_WORDS = (
    "intern internship engineer developer analyst manager senior junior associate lead architect consultant specialist coordinator director officer head executive researcher scientist professor assistant teaching part-time full-time "
    "contract freelance trainee apprentice fellow staff sde mle sre tpm tl em ic devops frontend backend fullstack full-stack mobile ios android ml ai data product design qa test automation cloud security network system software "
    "principal distinguished vice president cto ceo coo vp avp gm dgm"
).split()
ORGANISATIONS = "technologies solutions systems services labs ltd limited inc corp corporation company enterprises group global international pvt private consulting ventures software tech digital research analytics networks studios works".split()
ENDINGS = "Inc Ltd LLC LLP Corp Co Pvt Private Limited Group Holdings Partners Associates Solutions Services Technologies Consulting Ventures International Global".split()
#: Places that stand alone.
PLACES = (
    "india, usa, uk, us, bangalore, bengaluru, mumbai, delhi, new delhi, hyderabad, pune, chennai, kolkata, noida, gurgaon, gurugram, remote, london, singapore, dubai, united states, united kingdom, canada, australia, germany, france, "
    "netherlands, japan, china, bhopal, indore, jaipur, lucknow, ahmedabad, surat, vadodara, nagpur, patna, ranchi, bhubaneswar, kochi, thiruvananthapuram, coimbatore, visakhapatnam, vizag, chandigarh, dehradun, amritsar, jalandhar, "
    "mangalore, mangaluru, mysore, mysuru, thane, ghaziabad, meerut, agra, varanasi, allahabad, prayagraj, jodhpur, udaipur, kota, ajmer, vellore, madurai, trichy, salem, erode, tirunelveli, tiruchirappalli, vijayawada, guntur, warangal, "
    "karimnagar, belgaum, hubli, dharwad, bellary, shimoga, tumkur, udupi, manipal, calicut, kozhikode, thrissur, palakkad, kollam, navi mumbai, nashik, aurangabad, kolhapur, solapur, amravati, raipur, bilaspur, bhilai, guwahati, shillong, "
    "imphal, aizawl, agartala, itanagar, kohima, jammu, srinagar, leh, shimla, dharamsala, rishikesh, haridwar, nainital, mussoorie, durg, korba, jagdalpur, new york, san francisco, seattle, austin, boston, chicago, los angeles, berlin, "
    "toronto, sydney, amsterdam, zurich, paris, hong kong"
).split(", ")
#: Technologies that a bullet can name, with their patterns.
BULLET_TECH = {
    "Python": r"\bpython\b", "Java": r"\bjava\b(?!script)", "JavaScript": r"\bjavascript\b|\bjs\b", "TypeScript": r"\btypescript\b|\bts\b", "C++": r"\bc\+\+\b", "C#": r"\bc#\b", "Go": r"\bgolang\b|\bgo\b", "Rust": r"\brust\b",
    "React": r"\breact(?:\.js|js)?\b", "Node.js": r"\bnode(?:\.js|js)\b", "Angular": r"\bangular\b", "Vue": r"\bvue(?:\.js|js)?\b", "Django": r"\bdjango\b", "Flask": r"\bflask\b", "FastAPI": r"\bfastapi\b", "Spring": r"\bspring(?:\s+boot)?\b",
    "TensorFlow": r"\btensorflow\b", "PyTorch": r"\bpytorch\b", "Pandas": r"\bpandas\b", "NumPy": r"\bnumpy\b", "scikit-learn": r"\bscikit[-\s]learn\b", "Docker": r"\bdocker\b", "Kubernetes": r"\bkubernetes\b|\bk8s\b", "AWS": r"\baws\b",
    "GCP": r"\bgcp\b", "Azure": r"\bazure\b", "MySQL": r"\bmysql\b", "PostgreSQL": r"\bpostgresql\b|\bpostgres\b", "MongoDB": r"\bmongodb\b", "Redis": r"\bredis\b", "Git": r"\bgit\b", "Linux": r"\blinux\b", "Streamlit": r"\bstreamlit\b",
    "LangChain": r"\blangchain\b", "NLP": r"\bnlp\b", "LLM": r"\bllm\b", "OpenCV": r"\bopencv\b", "Tailwind": r"\btailwind\b", "Bootstrap": r"\bbootstrap\b", "GraphQL": r"\bgraphql\b", "REST": r"\brest\s*api\b", "Firebase": r"\bfirebase\b",
    "Figma": r"\bfigma\b", "Tableau": r"\btableau\b", "Power BI": r"\bpower\s*bi\b", "Excel": r"\bexcel\b", "MATLAB": r"\bmatlab\b", "Scala": r"\bscala\b", "Kotlin": r"\bkotlin\b", "Swift": r"\bswift\b", "PHP": r"\bphp\b", "Ruby": r"\bruby(?:\s+on\s+rails)?\b",
}
#: Signs of a bullet, openings of technology and of link lines, addresses in project texts.
SIGNS = "•►▸●▶✓✔·◦"
BULLET = rf"^[{SIGNS}\-–—*]\s+"
TECH_LINE = r"(?i)^(?:tech(?:nologies)?|tech\s+stack|built with|tools|frameworks|using|developed with)[:\s]+"
LIVE_LINE = r"(?i)^(?:live|demo|github|repo|link|source|hosted at)[:\s]+"
ADDRESS = r"(?i)(https?://\S+|(?:github|gitlab|bitbucket)\.com/\S+)"
DATED = "(?i)" + "|".join(pattern for _, pattern in RANGES)

_quoted = lambda terms: "|".join("".join(c if c.isalnum() or c in " '" else rf"\{c}" for c in t) for t in sorted(terms, key=lambda t: (-len(t), t)))
DEGREE = rf"(?i)\b(?:{_quoted(DEGREES)})\b".replace(" ", r"\s+")


def is_title(text: Column) -> Column:
    """A job title: has one of the title words, and is no long sentence (a small first letter or a full stop)."""
    t = F.trim(text)
    sentence = (F.size(words(t)) > 4) & (t.rlike(r"^\p{Ll}") | t.endswith("."))
    return ~sentence & F.lower(t).rlike(rf"\b(?:{_quoted(TITLE_WORDS)})\b")


def is_place(text: Column) -> Column:
    """Up to four words without an organisation's ending: a known place, or "City, State"."""
    t = F.trim(text)
    pair = t.rlike(r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?,\s*(?:[A-Z]{2,3}|[A-Z][a-z]+)")
    return F.size(words(t)).between(1, 4) & ~t.rlike(rf"(?i)\b(?:{'|'.join(ORGANISATIONS)})\b") & (F.lower(t).isin(*PLACES) | pair)


def _holds(text: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(p)) for p in parts])


def education_groups(lines: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """key, order, line, entry (from 0) of the education lines that are not blank.

    A degree opens an entry where the present one has a degree, an institution where it has an institution; lines of a
    grade or a date alone never do. The line before an opening one goes with it if it is capitalised and has no date,
    degree or grade.
    """
    line = F.trim("line")
    dr = date_range(line)
    rows = lines.select(key, order, line.alias("line")).filter("line <> ''").withColumn("dr", dr)
    at = F.call_function("locate", F.col("dr.start"), F.col("line"))
    rest = F.when(at > 0, F.substring(F.col("line"), F.lit(1), at - 1)).otherwise(F.replace("line", F.right("line", F.lit(1)), F.lit("")))
    named = rf"(?i)(?:{GRADE_NAMES})[:\s]*[0-9.]+|[0-9.]+(?:\s*/\s*[0-9.]+)?%?\s*(?:{GRADE_NAMES})"
    degree, school, grade = F.col("line").rlike(DEGREE), _holds(F.col("line"), SCHOOLS), F.col("line").rlike(named)
    stays = grade & ~degree & ~school | F.coalesce(F.col("dr.form").isNotNull() & (F.trim(rest) == ""), F.lit(False))
    orphan = F.col("dr.form").isNull() & ~degree & ~grade & ~F.col("line").rlike(r"[0-9]+(?:\.[0-9]+)?\s*%\s*$") & F.col("line").rlike(r"^\p{Lu}")
    x = rows.select(key, F.struct(order, "line", degree.alias("degree"), school.alias("school"), stays.alias("stays"), orphan.alias("orphan")).alias("x"))
    x = x.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    no = F.lit(False)
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("size"), no.alias("degree"), no.alias("school"), no.alias("orphan"), no.alias("was_school"), F.array().cast("array<int>").alias("out"))

    def step(a, x):
        opens = (a["size"] > 0) & ~x["stays"] & F.when(x["degree"] & ~x["school"], a["degree"]).when(x["school"] & ~x["degree"], a["school"]).otherwise(False)
        moved = opens & a["orphan"]
        # a moved line that was its entry's only one takes the entry along
        n = F.when(opens & ~(moved & (a["size"] == 1)), a["n"] + 1).otherwise(a["n"])
        out = F.when(moved, F.array_append(F.slice(a["out"], F.lit(1), F.size(a["out"]) - 1), n)).otherwise(a["out"])
        return F.struct(
            n.alias("n"), F.when(moved, 2).when(opens, 1).otherwise(a["size"] + 1).alias("size"), F.when(opens, x["degree"]).otherwise(a["degree"] | x["degree"]).alias("degree"),
            F.when(moved, a["was_school"] | x["school"]).when(opens, x["school"]).otherwise(a["school"] | x["school"]).alias("school"), x["orphan"].alias("orphan"), x["school"].alias("was_school"), F.array_append(out, n).alias("out"),
        )

    done = x.select(key, F.explode(F.arrays_zip("xs", F.aggregate("xs", zero, step, lambda a: a["out"]).alias("entry"))).alias("z"))
    return done.select(key, F.col(f"z.xs.{order}").alias(order), F.col("z.xs.line").alias("line"), F.col("z.entry").cast("long").alias("entry"))


def experience_entries(lines: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """key, entry, company, title, location, start, end, is_current, bullets (their number): one row per bundle with
    headers. Dates leave the headers first; then "a | b", "title at company", or which of two headers is a title."""
    bundles = entries.ordered(key, lines, order).select(key, F.posexplode(entries.experience_bundles(F.col("lines"))).alias("entry", "e"))
    heads = bundles.filter("size(e.headers) > 0").select(key, "entry", F.size("e.bullets").cast("long").alias("bullets"), F.posexplode("e.headers").alias("no", "head"))
    heads = heads.withColumn("dr", date_range(F.col("head"))).withColumn("rest", F.trim("dr.remaining"))
    # the keys lie together already, so this needs no shuffle of its own
    got = heads.groupBy(key, "entry").agg(
        F.first("bullets").alias("bullets"), F.transform(F.array_sort(F.collect_list(F.when(F.col("rest") != "", F.struct("no", "rest")))), lambda x: x["rest"]).alias("h"),
        F.min_by("dr", F.when(F.col("dr.form").isNotNull(), F.col("no"))).alias("dr"),
    )
    first, second, third = (F.get("h", F.lit(i)) for i in range(3))
    parts = F.filter(F.split(first, r"\s*\|\s*"), lambda p: (F.trim(p) != "") & ~p.rlike(DATED))
    names, places = F.filter(parts, lambda p: ~is_place(p)), F.filter(parts, is_place)
    a, b = F.get(names, F.lit(0)), F.get(names, F.lit(1))
    none = F.lit(None).cast("string")
    pair = lambda company, title, place=none: F.struct(F.trim(company).alias("company"), F.trim(title).alias("title"), F.trim(place).alias("place"))
    last_place = F.when(F.size(places) > 0, F.element_at(places, -1))
    bars = F.when(F.size(F.filter(F.split(first, r"\|"), lambda p: F.trim(p) != "")) < 2, pair(none, none)).when(is_title(a), pair(b, a, last_place)).otherwise(pair(a, b, last_place))
    said = r"(?i)^(.+?)\s+at\s+(.+)$"
    at = F.when(first.rlike(said), pair(F.regexp_extract(first, said, 2), F.regexp_extract(first, said, 1))).otherwise(pair(none, none))
    alone = F.when(is_title(first), pair(none, first)).otherwise(pair(first, none))
    two = F.when(is_title(first) & ~is_title(second), pair(second, first)).otherwise(pair(first, second))
    got = got.withColumn("p", F.when(F.contains(first, F.lit("|")), bars).when(F.lower(first).contains(" at "), at).when(second.isNull(), alone).otherwise(two))
    second_place = F.when(F.contains(first, F.lit("|")) & is_place(second), second)
    place = F.coalesce("p.place", second_place, F.when(is_place(third), third))
    got = got.withColumn("place", place)
    before, after = F.trim(F.substring_index("p.company", ",", 1)), F.trim(F.regexp_replace("p.company", r"^[^,]*,", ""))
    located = F.col("place").isNull() & F.contains("p.company", F.lit(",")) & (F.length(after) <= 35) & ~after.rlike(rf"(?i)^(?:{'|'.join(ENDINGS)})\.?$") & is_place(after) & ~_holds(before, INSTITUTIONS)
    return got.select(
        key, F.col("entry").cast("long").alias("entry"), F.when(located, before).otherwise(F.col("p.company")).alias("company"), "p.title", F.when(located, after).otherwise(F.col("place")).alias("location"),
        F.col("dr.start").alias("start"), F.col("dr.end").alias("end"), F.col("dr.is_current").alias("is_current"), "bullets",
    ).filter("company IS NOT NULL OR title IS NOT NULL OR bullets > 0")


def inline_items(text: Column) -> Column:
    """Items between bullet signs, else between commas and slashes."""
    parts = F.when(text.rlike(f"[{SIGNS}]"), F.split(text, f"[{SIGNS}]")).otherwise(F.split(text, "[,/]"))
    return F.transform(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""), lambda p: F.regexp_replace(p, r"^[•\-*]+|[•\-*]+$", ""))


def address(text: Column) -> Column:
    """The first web address of a project text, with a scheme; or null."""
    found = F.regexp_replace(F.nullif(F.regexp_extract(text, ADDRESS, 1), F.lit("")), r"[).,;]+$", "")
    return F.when(found.startswith("http"), found).otherwise(F.concat(F.lit("https://"), found))


def _short(items: Column, most: int = 3) -> Column:
    return F.size(F.filter(items, lambda i: F.size(words(i)).between(1, most)))


def project_header(text: Column) -> Column:
    """struct(name, url, items) of a header "name | technologies | address"; name is null without a letter."""
    parts = F.filter(F.transform(F.split(text, r"\s*\|\s*"), lambda p: F.trim(p)), lambda p: p != "")
    bare = F.filter(F.transform(parts, lambda p: F.when(p.rlike(ADDRESS), F.regexp_replace(F.regexp_replace(p, ADDRESS, ""), "^[ ,:-]+|[ ,:-]+$", "")).otherwise(p)), lambda p: p != "")
    listed = lambda p: (F.size(inline_items(p)) >= 2) & F.forall(inline_items(p), lambda i: F.size(words(i)) <= 3)
    name = F.coalesce(F.get(F.filter(bare, lambda p: ~listed(p)), F.lit(0)), F.get(parts, F.lit(0)))
    name = F.trim(F.regexp_replace(name, r"\s*[–—·|]\s*$", ""))
    ok = ~text.rlike(TECH_LINE) & name.rlike("[A-Za-z]")
    return F.struct(F.when(ok, name).alias("name"), F.when(~text.rlike(TECH_LINE), address(text)).alias("url"), F.when(~text.rlike(TECH_LINE), F.flatten(F.transform(F.filter(bare, listed), inline_items))).otherwise(F.array().cast("array<string>")).alias("items"))


def project_lines(lines: DataFrame, dictionary: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """key, order, entry (from 1), role, core: what each line of a projects section is to which project.

    Roles: header, techs (of the project whose name the next bullet gives), tech, link, date and text. Lines before any
    project that open none, blank ones, and dates alone are left out.
    """
    text = F.trim("line")
    core = F.when(text.rlike(BULLET), F.trim(F.regexp_replace(text, BULLET, ""))).otherwise(text)
    marked = sections.match_headings(lines.select(key, order, text.alias("text"), core.alias("line")), dictionary, key).withColumn("dr", date_range(F.col("line")))
    rest, dated = F.trim("dr.remaining"), F.col("dr.form").isNotNull()
    items = inline_items(rest)
    list_like = (F.size(items) >= 2) & (_short(items) >= F.greatest(F.lit(2), F.size(items) - 1))
    tech = rest.rlike(TECH_LINE) | list_like
    plain = F.size(words(rest)).between(1, 9) & ~rest.endswith(".") & ~rest.rlike(r"^\p{Ll}") & ~rest.rlike(r"^(?:[A-Za-z0-9+#.-]+(?:,\s*|/))+[A-Za-z0-9+#.-]+$")
    head = F.col("section").isNull() & ~tech & F.when(dated, rest.rlike("[A-Za-z]")).otherwise(plain)
    bullet = F.col("text").rlike(BULLET)
    x = marked.select(
        key, F.struct(
            order, "line", bullet.alias("bullet"), F.col("section").isNotNull().alias("heading"), F.coalesce(head, F.lit(False)).alias("head"), tech.alias("tech"), F.col("text").rlike(TECH_LINE).alias("tech_line"),
            F.col("text").rlike(LIVE_LINE).alias("live"), dated.alias("dated"), (dated & (rest == "")).alias("only_date"), project_header(F.when(rest == "", F.col("line")).otherwise(rest))["name"].isNotNull().alias("named"),
            F.coalesce(F.lead(bullet).over(Window.partitionBy(key).orderBy(order)), F.lit(False)).alias("bullet_next"),
        ).alias("x"), F.col("text").alias("t"),
    )
    x = x.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("t") != "", F.col("x")))).alias("xs"))
    kind = "array<struct<entry:int,role:string>>"
    no = F.lit(False)
    zero = F.struct(F.lit(0).alias("n"), no.alias("open"), no.alias("fresh"), no.alias("dated"), no.alias("wait"), F.array().cast(kind).alias("out"))

    def step(a, x):
        inner = a["open"] & ~x["heading"] & ~(x["head"] & ~x["bullet"])
        late = a["fresh"] & x["only_date"] & ~a["dated"] & ~x["bullet"]
        starts = ~x["only_date"] & ~x["tech"] & x["named"] & (~x["bullet"] | x["head"])
        waits = ~x["bullet"] & ~x["only_date"] & x["tech"] & x["bullet_next"]
        role = (
            F.when(a["wait"], "header").when(late, "date").when(inner & x["bullet"], "text").when(inner & x["tech_line"], "tech").when(inner & x["live"], "link").when(inner, "text")
            .when(x["bullet"] & ~x["head"], F.when(a["n"] > 0, "text")).when(starts, "header").when(waits, "techs")
        )
        opened = ~a["wait"] & ~inner & ~late & starts
        wait = ~a["wait"] & ~inner & ~late & ~starts & waits
        n = a["n"] + (opened | wait).cast("int")
        opens = a["wait"] | opened
        return F.struct(
            n.alias("n"), (opens | inner | late).alias("open"), opens.alias("fresh"), F.when(opened | wait, x["dated"]).otherwise(a["dated"]).alias("dated"), wait.alias("wait"),
            F.array_append(a["out"], F.struct(n.alias("entry"), role.alias("role"))).alias("out"),
        )

    done = x.select(key, F.explode(F.arrays_zip("xs", F.aggregate("xs", zero, step, lambda a: a["out"]).alias("o"))).alias("z"))
    return done.select(key, F.col(f"z.xs.{order}").alias(order), F.col("z.o.entry").cast("long").alias("entry"), F.col("z.o.role").alias("role"), F.col("z.xs.line").alias("core")).filter("role IS NOT NULL")


def once(items: Column) -> Column:
    """Items in order, each once, case apart."""
    return F.aggregate(items, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x)))


def project_blocks(lines: DataFrame, dictionary: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """key, entry, name, description, technologies, url, start, end: the projects of a projects section, named ones only."""
    x = project_lines(lines, dictionary, key, order).withColumn("dr", date_range(F.col("core")))
    waited = F.max(F.col("role") == "techs").over(Window.partitionBy(key, "entry"))
    x = x.withColumn("waited", waited).withColumn("body", F.when(F.col("waited") | (F.trim("dr.remaining") == ""), F.col("core")).otherwise(F.trim("dr.remaining")))
    x = x.withColumn("h", F.when(F.col("role") == "header", project_header(F.col("body"))))
    said = F.regexp_replace("core", TECH_LINE, "")
    techs = F.when(F.col("role").isin("techs", "tech"), inline_items(said)).when(F.col("role") == "header", F.col("h.items"))
    # technologies above the name stand first, then the header's, then those of later lines
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(techs.isNotNull(), F.struct(F.col(order), techs.alias("t"))))), lambda s: s["t"]))
    ranged = F.col("dr.form").isNotNull() & (F.col("role").isin("date", "techs") | (F.col("role") == "header") & ~F.col("waited"))
    g = x.groupBy(key, "entry").agg(
        F.max("h.name").alias("name"), F.max("h.url").alias("url"), F.min_by(address(F.regexp_replace("core", LIVE_LINE, "")), F.when(F.col("role") == "link", F.col(order))).alias("live"),
        F.min_by("dr", F.when(ranged, F.col(order))).alias("dr"), listed.alias("listed"),
        entries.crushed(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "text", F.struct(order, "core")))), lambda s: s["core"]), " ")).alias("description"),
    )
    g = g.filter("name IS NOT NULL")
    known = F.transform("listed", lambda t: F.coalesce(F.get(entries.project_names(t), F.lit(0)), F.trim(t)))
    found = entries.project_names(F.concat_ws(" ", "name", "description"))
    return g.select(key, "entry", "name", "description", F.array_join(once(F.filter(F.concat(known, found), lambda t: t != "")), ",").alias("technologies"), F.coalesce("url", "live", address(F.col("description"))).alias("url"), F.col("dr.start").alias("start"), F.col("dr.end").alias("end"))


def implied_skills(known: Column, bullets: Column) -> Column:
    """known skills (array), then the technologies that bullets (array) name and known has neither by name nor without
    its dots, dashes and spaces."""
    squeezed = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[.\-_\s]+", "")
    text = F.lower(F.array_join(bullets, " "))
    found = F.array_compact(F.array(*[F.when(text.rlike(pattern), name) for name, pattern in BULLET_TECH.items()]))
    has = F.transform(known, lambda k: F.lower(F.trim(k)))
    short = F.transform(known, squeezed)
    return F.concat(known, F.filter(found, lambda f: ~F.array_contains(has, F.lower(f)) & ~F.array_contains(short, squeezed(f))))
