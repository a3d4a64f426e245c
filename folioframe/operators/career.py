"""Careers: time worked, gaps, overlaps, level, domain, seniority, consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Title patterns in order of precedence.
LEVELS = (
    ("Executive / Director (15+ yrs)", r"\b(cto|ceo|vp|vice\s+president|chief|director|head\s+of)\b"),
    ("Principal / Staff (10–15 yrs)", r"\b(principal|staff|distinguished|fellow|architect)\b"),
    ("Senior (6–10 yrs)", r"\b(senior|sr\.?|lead|manager|tech\s+lead|team\s+lead)\b"),
    ("Mid-level (3–6 yrs)", r"\b(mid|ii|2|associate)\b"),
    ("Junior (1–3 yrs)", r"\b(junior|jr\.?|i\b|entry\s+level|entry-level)\b"),
    ("Fresher (0–1 yrs)", r"\b(intern|trainee|apprentice|graduate\s+trainee|fresher)\b"),
)
#: Levels by years worked, and what a level adds to seniority.
YEARS = ((15, "Executive / Director (15+ yrs)"), (10, "Principal / Staff (10–15 yrs)"), (6, "Senior (6–10 yrs)"), (3, "Mid-level (3–6 yrs)"), (1, "Junior (1–3 yrs)"))
FRESHER, JUNIOR = "Fresher (0–1 yrs)", "Junior (1–3 yrs)"
LEVEL_POINTS = {"Fresher (0–1 yrs)": 0.0, "Junior (1–3 yrs)": 0.05, "Mid-level (3–6 yrs)": 0.1, "Senior (6–10 yrs)": 0.2, "Principal / Staff (10–15 yrs)": 0.25, "Executive / Director (15+ yrs)": 0.3}
#: Keywords by domain, in order of precedence.
DOMAINS = {
    "ML / AI / Data Science": ("machine learning", "deep learning", "neural", "nlp", "tensorflow", "pytorch", "scikit", "pandas", "numpy", "data science", "ai", "llm", "gpt", "bert", "computer vision", "opencv", "kaggle", "model training", "hugging face", "langchain", "rag", "generative ai"),
    "Data Engineering / Analytics": ("spark", "hadoop", "kafka", "airflow", "dbt", "data warehouse", "etl", "data pipeline", "bigquery", "snowflake", "hive", "flink", "data engineer", "data analyst", "tableau", "power bi", "looker", "databricks"),
    "DevOps / Cloud / Infrastructure": ("kubernetes", "k8s", "docker", "terraform", "ansible", "jenkins", "ci/cd", "cloud", "aws", "gcp", "azure", "devops", "infrastructure", "sre", "prometheus", "grafana", "helm", "argocd", "platform engineer"),
    "Frontend": ("react", "angular", "vue", "next.js", "svelte", "frontend", "ui developer", "html", "css", "sass", "tailwind", "redux", "d3.js", "three.js", "figma", "ux", "web developer", "ui/ux"),
    "Mobile Development": ("android", "ios", "react native", "flutter", "swift", "kotlin", "mobile developer", "xcode", "expo", "jetpack", "swiftui"),
    "Backend / Full-stack": ("backend", "api", "rest", "grpc", "microservices", "django", "flask", "fastapi", "spring", "node.js", "express", "database", "server", "java", "golang", "postgresql", "redis", "kafka", "graphql"),
    "Security / Networking": ("security", "cybersecurity", "penetration", "pentest", "soc", "firewall", "encryption", "oauth", "siem", "network security", "cve"),
    "Embedded / Systems": ("embedded", "firmware", "rtos", "arduino", "raspberry pi", "fpga", "c++", "assembly", "microcontroller", "iot", "hardware"),
}
#: The domain of those in whose texts no keyword is found.
GENERAL = "General Software"
#: Employers and universities that count as notable; names of universities of up to four letters are words.
NOTABLE = (
    "google", "microsoft", "apple", "amazon", "meta", "netflix", "linkedin", "twitter", "x corp", "uber", "airbnb", "stripe", "palantir", "openai", "anthropic", "deepmind", "salesforce", "adobe", "nvidia", "intel", "amd",
    "oracle", "sap", "ibm", "cisco", "vmware", "atlassian", "shopify", "spotify", "bytedance", "tiktok", "pinterest", "snap", "zoom", "slack", "figma", "notion", "airtable", "databricks", "snowflake", "flipkart", "ola", "swiggy",
    "zomato", "paytm", "phonepe", "razorpay", "freshworks", "zoho", "infosys", "tcs", "wipro", "hcl", "cognizant", "accenture", "deloitte", "mckinsey", "goldman sachs", "jpmorgan", "morgan stanley", "bloomberg", "citadel",
    "two sigma", "jane street", "samsung", "lg", "sony", "toyota", "tesla", "spacex",
)
UNIVERSITIES = (
    "iit", "iim", "nit", "bits pilani", "iiit", "indian institute of technology", "indian institute of management", "national institute of technology", "mit", "massachusetts institute of technology", "stanford", "harvard",
    "caltech", "carnegie mellon", "cmu", "berkeley", "uc berkeley", "oxford", "cambridge", "eth zurich", "imperial college", "nyu", "columbia", "yale", "princeton", "cornell", "georgia tech", "university of michigan",
    "university of toronto", "national university of singapore", "nus", "nanyang", "ntu", "delhi university", "du", "mumbai university", "vit", "srm", "anna university", "jadavpur", "osmania", "hyderabad central",
)
#: Words of leading others.
MANAGEMENT = r"\b(manag|led|lead|mentor|coach|team of|direct report|hire|recruit|grow|build team|head of|vp|director|chief|officer|president)\b"


def closed_jobs(jobs: DataFrame, as_of: str) -> DataFrame:
    """Jobs with a start, open or current ones ending at as_of."""
    day = F.lit(as_of).cast("date")
    return jobs.filter("start_date IS NOT NULL").withColumn("end_date", F.when(F.col("is_current") | F.col("end_date").isNull(), day).otherwise(F.col("end_date")))


def experience(jobs: DataFrame, as_of: str, key: str = "cand_id") -> DataFrame:
    """key, days, years: the union of a candidate's jobs, in one pass over jobs sorted within the key."""
    order = Window.partitionBy(key).orderBy("start_date", "end_date")
    seen = F.max("end_date").over(order.rowsBetween(Window.unboundedPreceding, -1))
    x = closed_jobs(jobs, as_of).filter("end_date >= start_date").withColumn("seen", seen)
    # what each job adds beyond the latest end before it
    days = F.greatest(F.lit(0), F.datediff("end_date", F.when(F.col("seen") >= F.col("start_date"), F.col("seen")).otherwise(F.col("start_date"))))
    return x.groupBy(key).agg(F.sum(days).cast("bigint").alias("days")).withColumn("years", F.round(F.col("days").cast("double") / F.lit(365.25).cast("double"), 1))


def career_gaps(jobs: DataFrame, as_of: str, key: str = "cand_id", least_days: int = 90) -> DataFrame:
    """Gaps of more than least_days between a job's start and the end of the job before it by start."""
    order = Window.partitionBy(key).orderBy("start_date", "job_no")
    x = closed_jobs(jobs, as_of).select(key, "company", "start_date", F.lag("end_date").over(order).alias("prev_end"), F.lag("company").over(order).alias("after_company"))
    gap = F.datediff("start_date", "prev_end")
    return x.filter(gap > least_days).select(key, "after_company", F.col("company").alias("before_company"), gap.cast("bigint").alias("gap_days"), F.round(gap.cast("double") / F.lit(30.4).cast("double"), 1).alias("gap_months"))


def job_overlaps(jobs: DataFrame, as_of: str, key: str = "cand_id", months: int = 3) -> DataFrame:
    """Pairs of a candidate's jobs that share more than `months` months of 30 days."""
    x = closed_jobs(jobs, as_of).select(key, "job_no", "start_date", "end_date")
    a, b = x.alias("a"), x.alias("b")
    days = F.datediff(F.least("a.end_date", "b.end_date"), F.greatest("a.start_date", "b.start_date"))
    pairs = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.job_no") < F.col("b.job_no")) & (F.col("a.start_date") < F.col("b.end_date")) & (F.col("b.start_date") < F.col("a.end_date")))
    return pairs.filter(days > 30 * months).select(F.col(f"a.{key}").alias(key), F.col("a.job_no").alias("job_a"), F.col("b.job_no").alias("job_b"), days.cast("bigint").alias("overlap_days"))


def title_level(title: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(LEVELS):
        out = F.when(F.lower(title).rlike(pattern), name).otherwise(out)
    return out


def career_level(jobs: DataFrame, years: DataFrame, key: str = "cand_id") -> DataFrame:
    """key, level, years: of the first title that tells one, else by years worked."""
    named = jobs.withColumn("lvl", title_level(F.col("title"))).filter("lvl IS NOT NULL").groupBy(key).agg(F.min_by("lvl", "job_no").alias("lvl"))
    by_years = F.lit(FRESHER)
    for bound, name in reversed(YEARS):
        by_years = F.when(F.col("years") >= bound, name).otherwise(by_years)
    return years.join(named, key, "left").select(key, "years", F.coalesce("lvl", by_years).alias("level"))


def domain_scores(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, domain, score: the share of each domain's keywords that the lower-cased text contains; shares over 0."""
    low = texts.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    share = [F.struct(F.lit(d).alias("domain"), F.lit(i).alias("ord"), F.round(sum((F.contains("t", F.lit(w)).cast("int") for w in ws), F.lit(0)) / len(ws), 6).alias("score")) for i, (d, ws) in enumerate(DOMAINS.items())]
    return low.select(key, F.explode(F.array(*share)).alias("x")).select(key, "x.*").filter("score > 0")


def primary_domain(scores: DataFrame, people: DataFrame, key: str) -> DataFrame:
    """key, domain, score of all people: the domain of the largest share, the first of equals; GENERAL without any."""
    best = scores.groupBy(key).agg(F.max_by("domain", F.struct("score", (-F.col("ord")).alias("o"))).alias("domain"), F.max("score").alias("score"))
    return people.select(key).distinct().join(best, key, "left").select(key, F.coalesce("domain", F.lit(GENERAL)).alias("domain"), F.coalesce("score", F.lit(0.0)).alias("score"))


def notable_jobs(jobs: DataFrame) -> DataFrame:
    low = F.lower(F.coalesce("company", F.lit("")))
    hit = F.lit(False)
    for name in NOTABLE:
        hit = hit | F.contains(low, F.lit(name))
    return jobs.filter(hit)


def notable_universities(degrees: DataFrame) -> DataFrame:
    """degrees of notable institutions; short names count as whole words only."""
    low = F.lower(F.coalesce("institution", F.lit("")))
    words = "|".join(u for u in UNIVERSITIES if len(u) <= 4)
    hit = low.rlike(rf"\b(?:{words})\b")
    for name in UNIVERSITIES:
        if len(name) > 4:
            hit |= F.contains(low, F.lit(name))
    return degrees.filter(hit)


def current_position(jobs: DataFrame, key: str = "cand_id") -> DataFrame:
    """The first current job of each candidate, else the first job; a null is_current is not current."""
    first = F.struct((~F.coalesce("is_current", F.lit(False))).alias("old"), F.col("job_no"))
    return jobs.groupBy(key).agg(F.min_by("title", first).alias("title"), F.min_by("company", first).alias("company"))


def seniority(levels: DataFrame, jobs: DataFrame, key: str = "cand_id") -> DataFrame:
    """key, has_management, notable_count, is_fresher (of the two lowest levels, with less than a year), seniority (0 to 1)."""
    led = jobs.groupBy(key).agg(F.coalesce(F.max(F.lower(F.col("title")).rlike(MANAGEMENT)), F.lit(False)).alias("has_management"))
    known = notable_jobs(jobs).groupBy(key).agg(F.count_distinct("company").alias("notable_count"))
    points = F.create_map(*[F.lit(x) for kv in LEVEL_POINTS.items() for x in kv])
    x = levels.join(led, key, "left").join(known, key, "left").na.fill(0, ["notable_count"]).na.fill(False, ["has_management"])
    half, few = F.lit(0.5).cast("double"), F.lit(0.15).cast("double")
    score = F.least(F.col("years") / 20, half) + points[F.col("level")] + F.least(F.col("notable_count") * 0.05, few) + F.when(F.col("has_management"), 0.05).otherwise(0.0)
    return x.select(key, "has_management", F.col("notable_count").cast("bigint").alias("notable_count"), (F.col("level").isin(FRESHER, JUNIOR) & (F.col("years") < 1)).alias("is_fresher"), F.round(score, 3).alias("seniority"))


def timeline_issues(jobs: DataFrame, degrees: DataFrame, as_of: str, key: str = "cand_id") -> DataFrame:
    """key, rule, severity, job_no: what is wrong or odd about dates, one row a finding."""
    last_year = F.year(F.lit(as_of).cast("date")) + 2
    x = jobs.withColumn("end", F.when(F.col("is_current"), F.lit(as_of).cast("date")).otherwise(F.col("end_date")))
    tenure = F.datediff("end", "start_date") / F.lit(365.25).cast("double")
    rules = F.array_compact(F.array(
        F.when(F.year("start_date") < 1950, F.struct(F.lit("start_too_early").alias("rule"), F.lit("ERROR").alias("severity"))),
        F.when(F.year("start_date") > last_year, F.struct(F.lit("start_in_future").alias("rule"), F.lit("ERROR").alias("severity"))),
        F.when(~F.col("is_current") & (F.year("end") > last_year), F.struct(F.lit("end_in_future").alias("rule"), F.lit("ERROR").alias("severity"))),
        F.when(F.col("end") < F.col("start_date"), F.struct(F.lit("end_before_start").alias("rule"), F.lit("ERROR").alias("severity"))),
        F.when((F.col("end") >= F.col("start_date")) & (tenure > 25), F.struct(F.lit("long_tenure").alias("rule"), F.lit("WARNING").alias("severity"))),
    ))
    own = x.select(key, "job_no", F.explode(rules).alias("r")).select(key, "r.rule", "r.severity", "job_no")
    latest = degrees.groupBy(key).agg(F.max("end_date").alias("edu_end"))
    ended = x.filter("end >= start_date")
    early = ended.join(latest, key).filter((F.col("start_date") < F.date_sub("edu_end", 365)) & ~F.contains(F.lower("title"), F.lit("intern"))).select(key, F.lit("before_graduation").alias("rule"), F.lit("WARNING").alias("severity"), "job_no")
    both = job_overlaps(jobs, as_of, key).select(key, F.lit("overlap").alias("rule"), F.lit("INFO").alias("severity"), F.col("job_a").alias("job_no"))
    return own.unionByName(early).unionByName(both)
