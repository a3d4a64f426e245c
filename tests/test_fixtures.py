"""The derived tables hold what they are meant to hold, and every query gives rows."""

import re

import duckdb
import pytest

from __spark_entry__ import PLANS
from folioframe.plans.fixtures import VIEWS

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PICK = re.compile(r"split_part\('((?:[^']|'')*)', '¦', CAST\(\([^']*?\) % \d+ AS INT\) \+ 1\) AS (\w+)")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(VIEWS))
def test_columns_hold_their_value_lists(duck, name):
    assert duck.execute(f"SELECT count(*) FROM ({VIEWS[name]})").fetchone()[0] > 0
    for listed, column in PICK.findall(VIEWS[name]):
        got = {r[0] for r in duck.execute(f"SELECT DISTINCT {column} FROM ({VIEWS[name]})").fetchall()}
        assert got == set(listed.replace("''", "'").split("¦")), column


@pytest.mark.parametrize("name", sorted(n for m in PLANS for n in m.ORACLES))
def test_sql_gives_rows(duck, name):
    sql = next(m.ORACLES[name] for m in PLANS if name in m.ORACLES)
    assert duck.execute(f"SELECT count(*) FROM ({sql})").fetchone()[0] > 2
