"""Years of jobs that share their dates; levels where jobs have none."""

from datetime import date

import duckdb
import pytest

from folioframe.operators import career
from folioframe.plans import career_queries
from folioframe.plans.fixtures import AS_OF, VIEWS

JOBS = [(1, 1, date(2010, 1, 1), None, True), (1, 2, date(2010, 1, 1), None, True), (2, 1, date(2010, 1, 1), date(2010, 1, 11), False), (2, 2, date(2010, 3, 1), date(2010, 3, 31), False), (2, 3, date(2010, 3, 1), date(2010, 3, 31), False)]


@pytest.mark.parametrize("jobs", [JOBS, JOBS[::-1]])
def test_jobs_of_equal_dates_count_once(spark, jobs):
    df = spark.createDataFrame(jobs, "cand_id long, job_no long, start_date date, end_date date, is_current boolean")
    got = {r["cand_id"]: r["days"] for r in career.experience(df, "2010-01-31").collect()}
    assert got == {1: 30, 2: 40}


def test_undated_jobs_name_a_level_last(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE orders AS SELECT * FROM (VALUES (1, 7, NULL), (5, 7, TIMESTAMP '2000-01-01'), (12, 8, NULL), (11, 8, TIMESTAMP '2000-01-01')) t(o_orderkey, o_custkey, o_orderdate)")
    con.execute(f"COPY (SELECT o_orderkey::BIGINT AS o_orderkey, o_custkey::BIGINT AS o_custkey, o_orderdate FROM orders) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    got = {r["cand_id"]: r["level"] for r in career_queries.career_level(spark, str(tmp_path)).collect()}
    assert got == {7: "Principal / Staff (10–15 yrs)", 8: "Senior (6–10 yrs)"}
    assert got == {k: level for k, _, level in con.execute(career_queries.ORACLES["career_level"]).fetchall()}


def test_repeated_orders_add_no_days(spark, tmp_path):
    """Every job six times, ties that the SQL leaves open: the days are those of the merged intervals."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT o_orderkey + i * 900 AS o_orderkey, o_custkey, o_orderdate FROM '/root/testdata/sf0.001/orders.parquet', range(6) t(i)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    want = {}
    jobs = con.execute(f"WITH jobs AS ({VIEWS['jobs']}) SELECT cand_id, start_date, CASE WHEN is_current OR end_date IS NULL THEN DATE '{AS_OF}' ELSE end_date END AS e FROM jobs WHERE e >= start_date ORDER BY ALL").fetchall()
    for k, s, e in jobs:
        days, seen = want.get(k, (0, s))
        want[k] = (days + max(0, (e - max(s, seen)).days), max(e, seen))
    got = {r["cand_id"]: r["days"] for r in career_queries.experience_years_union(spark, str(tmp_path)).collect()}
    assert got == {k: days for k, (days, _) in want.items()}
