"""Section headings: dictionary, exact and fuzzy matches, splitting of lines into sections."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

CORE_SECTIONS = ("header", "summary", "skills", "experience", "education", "projects")
_listed = lambda s: tuple(w.strip() for w in s.split("; "))
#: The headings of each section; of a heading that two sections list, the later section counts.
HEADINGS = {
    "summary": _listed(
        "summary; professional summary; executive summary; career summary; about me; about; profile; professional profile; career profile; career objective; objective; professional objective; career goal; "
        "goals; overview; professional overview; background; personal statement; statement of purpose; bio; biography; introduction; intro; highlights; career highlights; key highlights; professional background; who am i; "
        "about myself; cover summary; resume summary; self summary; professional bio; career overview; value proposition; professional introduction; candidate profile; executive profile; professional snapshot"
    ),
    "skills": _listed(
        "skills; technical skills; core skills; key skills; professional skills; skill set; skillset; skill summary; areas of expertise; expertise; competencies; core competencies; technical competencies; technical expertise; technologies; "
        "technology; tech stack; tools; tools & technologies; tools and technologies; programming languages; languages & tools; languages and tools; software; software skills; software proficiency; hard skills; soft skills; "
        "technical knowledge; knowledge; proficiencies; proficiency; abilities; technical abilities; frameworks; frameworks & libraries; platforms; development skills; programming skills; coding skills; it skills; computer skills; "
        "skills & technologies; skills and technologies; skills & tools; skills and tools; relevant skills; additional skills; key technical skills; areas of knowledge; technical proficiency; software tools; technical tools; "
        "digital skills; data skills; skills summary; skill highlights; core technical skills; languages, frameworks & tools; tech skills; engineering skills; skills & expertise; skills and expertise; capabilities; "
        "technical capabilities; core capabilities; key capabilities; specializations; specialisation; technical specialization; domain expertise; domain skills; technical strengths; core strengths; strengths; "
        "technologies used; technologies known; tech expertise; language and tools; languages & frameworks; languages and frameworks; tools & frameworks; libraries and frameworks; cloud & devops; devops skills; data science skills; "
        "development tools; my skills; what i know; what i do; technical background; technical knowledge base; programming knowledge; software development skills; languages & technologies; technologies & tools; "
        "technical tools & frameworks; programming languages & tools; languages, tools & technologies; area of expertise; areas of technical expertise; technical area of expertise; key technical competencies; industry skills; "
        "professional competencies; skill matrix; technical skill matrix; relevant technical skills; computer proficiency; technical toolkit; skills inventory; technology stack; technicalskills"
    ),
    "experience": _listed(
        "experience; work experience; professional experience; employment; employment history; work history; career history; professional history; professional background; relevant experience; industry experience; technical experience; "
        "internship; internships; internship experience; research experience; teaching experience; positions; positions held; job experience; professional activities; work; professional work; career experience; job history; "
        "relevant work experience; experience & employment; professional work experience; industry work experience; applied experience; engineering experience; software experience; it experience; development experience; "
        "organizational experience; work & internship experience; work and internship; training & experience; training and experience; practical experience; work profile; professional work profile; employment profile; "
        "industry exposure; work engagements"
    ),
    "education": _listed(
        "education; educational background; educational qualifications; academic background; academic qualifications; academic history; qualifications; degrees; degree; schooling; training; training & education; education & training; "
        "academic credentials; credentials; academic profile; educational history; educational details; academic details; studies; study; academic record; educational record; university; universities; college; colleges; "
        "schools; school; academic education; formal education; academic achievements; academic experience; scholastic details; scholastic background; academic qualifications and achievements; qualification; certification; "
        "certifications; education profile; academicdetails"
    ),
    "projects": _listed(
        "projects; personal projects; academic projects; project work; project experience; notable projects; side projects; open source projects; key projects; technical projects; relevant projects; project portfolio; portfolio; "
        "engineering projects; research projects; selected projects; featured projects; capstone projects; major projects; mini projects; application projects; live projects; significant projects; project highlights; "
        "project details; software projects; projects & portfolio; project; product builds; build log; selected build work; course projects; courseprojects"
    ),
    "certifications": _listed(
        "certifications; certification; certified; licenses; license; licences; credentials; professional certifications; technical certifications; accreditations; accreditation; badges; online courses; mooc; moocs; "
        "courses & certifications; certificates; certificate; professional certificates; industry certifications; certifications & licenses; certifications and licenses; digital certificates; continuing education; "
        "professional development courses"
    ),
    "awards": _listed(
        "awards; honors; honours; achievements; achievement; competitions & achievements; competitions and achievements; competitions; competitive achievements; accomplishments; accomplishment; recognition; recognitions; "
        "awards & honors; honors & awards; awards and honors; prizes; distinctions; merits; accolades; scholarships; scholarship; fellowships; fellowship; grants; grant; academic awards; professional awards; industry awards; "
        "notable achievements; key achievements; achievements & awards; awards & achievements; achievements and awards; honors and awards; awards and achievements; recognitions & achievements; honor roll; dean's list; merit awards; "
        "milestones; recognition highlights"
    ),
    "interests": _listed(
        "interests; hobbies; hobbies & interests; interests & hobbies; personal interests; activities; extracurricular; extracurricular activities; outside interests; leisure; recreational activities; passions; other interests; "
        "personal activities; hobby; leisure activities; co-curricular activities; co curricular; cocurricular; personal hobbies; outside of work; fun facts; extra-curricular activities; extracurricular & hobbies; "
        "sports & hobbies; other activities; hobbies and interests; beyond work; personal pursuits"
    ),
    "languages": _listed("languages; language skills; language proficiency; spoken languages; foreign languages; linguistic skills; human languages; language knowledge; communication languages; multilingual; natural languages; language"),
    "publications": _listed(
        "publications; research publications; papers; journal papers; conference papers; articles; research articles; research papers; books; authored works; research work; research; papers published; published works; "
        "peer reviewed papers; scientific publications; academic publications"
    ),
    "volunteer": _listed(
        "volunteer; volunteering; volunteer experience; volunteer work; community service; social work; non-profit; nonprofit; outreach; community involvement; service; civic involvement; community activities; volunteer activities; "
        "social service; community engagement; social engagement"
    ),
    "references": _listed("references; reference; referees; referee; professional references; character references; available upon request; references available"),
    "courses": _listed("courses; coursework; relevant courses; relevant coursework; online courses; training courses; academic courses; key courses; selected coursework; notable coursework; course highlights; completed courses"),
    "activities": _listed(
        "activities; campus activities; student activities; club activities; leadership activities; organizational activities; social activities; professional activities; academic activities; positions of responsibility; "
        "clubs & organizations; clubs and organizations; student organizations; clubs; organization; organizations; memberships; membership; affiliations; affiliation; professional memberships; professional associations; "
        "associations; association"
    ),
    "header": _listed("contact; contact information; contact details; personal; personal details; personal information; general information; profile details; candidate details"),
}


def _folded(heading: str) -> str:
    return " ".join("".join(c if c.isalnum() or c in "_&+" else " " for c in heading.lower()).split())


def listed_headings() -> dict[str, str]:
    """Section by heading, in comparison form."""
    return {_folded(h): s for s, hs in HEADINGS.items() for h in hs}


def fold(c: Column) -> Column:
    """A heading's comparison form: no accents, lower case, letters, digits and _ & + in single-spaced words."""
    plain = F.translate(F.lower(c), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9_&+]+", " "))


def clean_heading(c: Column) -> Column:
    """Without numbering, bullets and closing punctuation."""
    return T.strip(F.regexp_replace(F.regexp_replace(c, r"^[\s•▪●\-–—*#>]*(?:\d{1,2}[.)]\s*)?", ""), r"[\s:.\-–—_|]+$", ""))


def heading_dictionary(spark: SparkSession) -> DataFrame:
    """norm, section: one row per heading (the last section that lists it counts), and one for its form without spaces."""
    last = listed_headings()
    compact = {h.replace(" ", ""): s for h, s in last.items()}
    rows = list((compact | last).items())
    return spark.createDataFrame(rows, "norm string, section string")


def match_headings(lines: DataFrame, dictionary: DataFrame, key: str = "doc_id") -> DataFrame:
    """lines with section: what the line is the heading of (up to seven words; as it is, else without spaces), or null."""
    cleaned = clean_heading(F.col("line"))
    norm = F.when(F.size(T.words(cleaned)) <= 7, fold(cleaned))
    d = F.broadcast(dictionary)  # a few hundred fixed rows
    x = lines.withColumn("__n", norm).join(d.select(F.col("norm").alias("__n"), F.col("section").alias("__s1")), "__n", "left")
    x = x.withColumn("__c", F.replace(F.col("__n"), F.lit(" "), F.lit(""))).join(d.select(F.col("norm").alias("__c"), F.col("section").alias("__s2")), "__c", "left")
    return x.withColumn("section", F.coalesce("__s1", "__s2")).drop("__n", "__c", "__s1", "__s2")


def fuzzy_dictionary(spark: SparkSession) -> DataFrame:
    """tokens (sorted, joined), section, score: every token subset that matches a heading by three quarters."""
    best: dict[str, tuple[float, int, str]] = {}
    last = listed_headings()
    for rank, (h, s) in enumerate(last.items()):
        parts = sorted({t for t in h.split() if len(t) > 2})
        for k in range(1, min(4, len(parts)) + 1):
            score = k / len(parts)
            if score >= 0.75:
                for sub in combinations(parts, k):
                    name = " ".join(sub)
                    if name not in best or (score, -rank) > best[name][:2]:
                        best[name] = (score, -rank, s)
    return spark.createDataFrame([(n, s, float(x)) for n, (x, _, s) in best.items()], "tokens string, section string, score double")


def match_fuzzy(lines: DataFrame, dictionary: DataFrame) -> DataFrame:
    """lines with fuzzy_section and fuzzy_score, from the line's distinct words of three letters or more."""
    toks = F.array_sort(F.array_distinct(F.filter(F.split(fold(clean_heading(F.col("line"))), " "), lambda w: F.length(w) > 2)))
    keyed = lines.withColumn("__t", F.when(F.size(toks).between(1, 4), F.array_join(toks, " ")))
    d = F.broadcast(dictionary).select(F.col("tokens").alias("__t"), F.col("section").alias("fuzzy_section"), F.col("score").alias("fuzzy_score"))
    return keyed.join(d, "__t", "left").drop("__t")


def fill_sections(marked: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """Lines that are no heading, with the section of the last heading before them ("header" before the first)."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    bullet = F.col("line").rlike(r"^\s*[•▪●\-–—*]\s")
    own = F.when(~bullet, F.col("section"))
    return marked.withColumn("__own", own).withColumn("in_section", F.coalesce(F.last("__own", ignorenulls=True).over(before), F.lit("header"))).filter(F.col("__own").isNull()).drop("__own")
