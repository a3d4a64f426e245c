"""Matching-block likeness against the standard library; job states on streams with restarts, late and repeated events."""

import collections
import difflib
import random

import pytest
from pyspark.sql import functions as F

from folioframe.operators import likeness
from folioframe.plans import job_queries
from folioframe.streaming import jobs

SF = "/root/testdata/sf0.001"


def textbook(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_ratio_is_the_textbook_one():
    rng = random.Random(1)
    for _ in range(4000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert likeness.ratio(a, b) == textbook(a, b), (a, b)


def test_nearest_equals_brute_force(spark):
    rng = random.Random(2)
    known = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(60)})
    values = [None, "", *known[:5]]
    for _ in range(400):
        w = list(rng.choice(known))
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "x"])
        values.append("".join(w))
    got = likeness.nearest(spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame([(k,) for k in known], "name string")).collect()
    want = {}
    for v in set(values) - {None} - set(known):
        best = max(((textbook(k, v), k) for k in known), default=(0, ""))
        if best[0] >= 0.82:
            want[v] = (best[1], best[0])
    assert {r["value"]: (r["nearest"], r["likeness"]) for r in got} == want and len(want) > 60


def life(events):
    """State, its time and the number of events of each job, by plain rules over sorted events."""
    of = collections.defaultdict(list)
    for job, state, ts in events:
        if state in jobs.STATES[:4] and job is not None and ts is not None:
            of[job].append((ts, jobs.STATES.index(state)))
    out = {}
    for job, seen in of.items():
        ends = sorted(x for x in seen if x[1] >= 2)
        top = max(r for _, r in seen)
        ts, rank = ends[0] if ends else (min(t for t, r in seen if r == top), top)
        out[job] = (jobs.STATES[rank], ts, len(seen))
    return out


def test_folded_states(spark):
    events = job_queries.job_events(spark, SF)
    rows = [(r["job_id"], r["state"], r["ts"]) for r in events.collect()]
    got = {r["job_id"]: (r["state"], r["since"], r["events"]) for r in jobs.folded(events).collect()}
    assert got == life(rows)
    assert jobs.folded(events.limit(0)).collect() == []


@pytest.fixture
def rocks(spark):
    key, value = jobs.PROVIDER
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    yield spark
    spark.conf.set(key, before)


def test_states_on_a_stream_with_a_restart(rocks, tmp_path):
    """Events come shuffled, some of them twice, in two runs of one query; then time goes on and results expire."""
    spark, folder, mark = rocks, tmp_path / "in", str(tmp_path / "mark")
    # all within a day, so that shuffled events are late but within the delay
    start = F.timestamp_seconds(F.lit(1_700_000_000))
    events = job_queries.job_events(spark, SF).limit(400).withColumn("ts", F.timestamp_micros(F.unix_micros(start) + F.col("job_id") * 1_000_000 + F.pmod(F.xxhash64("ts"), F.lit(60)) * 1_000_000)).cache()
    rows = [(r["job_id"], r["state"], r["ts"]) for r in events.collect()]
    random.Random(3).shuffle(rows)
    schema = "job_id long, state string, ts timestamp"

    def drop(part, name):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(folder / name))

    def run():
        seen = []

        def keep(df, n):
            seen.extend((n, *map(tuple, [r])) for r in df.collect())

        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
        q = jobs.job_states(stream, "1 day").writeStream.foreachBatch(keep).option("checkpointLocation", mark).outputMode("update").trigger(availableNow=True).start()
        q.awaitTermination()
        return {r[0]: r[1:] for _, r in sorted(seen, key=lambda x: x[0])}

    drop(rows[:150], "a")
    drop(rows[100:250], "b")
    first = run()
    drop(rows[250:], "c")
    second = run()
    want = life(rows[:150] + rows[100:])
    assert {k: v for k, v in (first | second).items()} == want
    assert {v[0] for v in want.values()} >= {"PROCESSING", "SUCCESS", "FAILURE"}
    late = max(r[2] for r in rows)
    drop([(10**9, "PENDING", late.replace(year=late.year + 1))], "d")
    third = run()
    expired = {k for k, v in third.items() if v[0] == "EXPIRED"}
    assert expired == {k for k, v in want.items() if v[0] in ("SUCCESS", "FAILURE")}
    assert all((third[k][1] - want[k][1]).total_seconds() == jobs.EXPIRY for k in expired)
