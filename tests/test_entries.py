"""Technologies of a text: the scan for known words loses none of them."""

import re

from pyspark.sql import functions as F

from folioframe.operators import entries
from folioframe.operators.skills import SKILLS


def patterns():
    """Names in order, each with one pattern a key; those of one letter look at the text as it is."""
    out = {name: [(re.compile(rf"(?<!\w){re.escape(k.lower())}(?!\w)", re.A), True) for k in (name, *keys)] for name, keys in entries.PROJECT_TECHNOLOGIES.items()}
    for name, _, _, keys in SKILLS:
        own = [(re.compile(rf"(?<![\w.&+#'’-]){k.upper()}(?![\w&+#'’-])" if len(k) == 1 else rf"(?<![\w.]){re.escape(k)}(?!\w)", re.A), len(k) > 1) for k in keys]
        out[name] = out.get(name, []) + own
    return out


PATTERNS = patterns()


def named(text):
    """All names by trying every key at every place."""
    low = text.lower()
    return [name for name, tried in PATTERNS.items() if any(p.search(low if lower else text) for p, lower in tried)]


def test_technologies_as_by_trying_every_key(spark):
    keys = [k for name, own in entries.PROJECT_TECHNOLOGIES.items() for k in (name, *own)] + [k for s in SKILLS for k in s[3]]
    forms = ("{}", "x {}, y", "({})", "a.{}.b", "z{}", "{}z", "{}_", "{}+", "K{}İ")
    texts = [f.format(k) for k in dict.fromkeys(keys) for f in forms] + [k.upper() for k in keys] + [f"{a} {b}" for a, b in zip(keys, keys[7:], strict=False)]
    texts += ["", "C, R and C++", "R&D in C# and c", "nothing that is known"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", entries.technologies(F.col("t")).alias("n")).collect()
    assert len(got) == len(texts)
    assert [(r["t"], r["n"]) for r in got if r["n"] != named(r["t"])] == []
    assert spark.range(1).select(entries.technologies(F.lit(None).cast("string"))).first()[0] == []


def test_names_are_looked_for_only_where_a_word_of_theirs_is(spark):
    plan = spark.range(1).select(entries.technologies(F.concat(F.lit("Go "), F.col("id").cast("string"))).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan and "filter(" in plan
