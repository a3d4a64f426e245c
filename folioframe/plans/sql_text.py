"""SQL for DuckDB that reads dates and parts of lines, shared by the oracles of the parsers."""

from __future__ import annotations

import re

from ..functions.dates import MONTH, MONTHS, PRESENT, RANGES

quoted = lambda s: "'" + s.replace("'", "''") + "'"


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {quoted(pattern)})"


def group(text: str, pattern: str, k: int) -> str:
    return f"CASE WHEN {has(text, pattern)} THEN regexp_extract({text}, {quoted(pattern)}, {k}) END"


def before(text: str, pattern: str) -> str:
    """What stands before the first match, or all of the text."""
    return f"string_split(regexp_replace({text}, {quoted(pattern)}, chr(1)), chr(1))[1]"


def edges(text: str, signs: str = " ,-") -> str:
    return f"trim({text}, '{signs}')"


def some(text: str) -> str:
    return f"nullif(trim({text}), '')"


def normal_date(t: str) -> str:
    t = f"regexp_replace(trim({t}), '[.,]+$', '')"
    long, short, slash = rf"(?i)^({MONTH}),?\s+(\d{{4}})", rf"(?i)^({MONTH})['’`](\d{{2}})", r"^(0?[1-9]|1[0-2])/(\d{4})"
    name = lambda p: f"concat(upper(regexp_extract({t}, {quoted(p)}, 1)[1:1]), lower(regexp_extract({t}, {quoted(p)}, 1)[2:3]))"
    months = "[" + ", ".join(quoted(m) for m in MONTHS) + "]"
    yy = f"regexp_extract({t}, {quoted(short)}, 2)"
    return (
        f"CASE WHEN {has(t, long)} THEN concat({name(long)}, ' ', regexp_extract({t}, {quoted(long)}, 2)) WHEN {has(t, short)} THEN concat({name(short)}, CASE WHEN TRY_CAST({yy} AS INT) <= 35 THEN ' 20' ELSE ' 19' END, {yy})"
        f" WHEN {has(t, slash)} THEN concat(({months})[TRY_CAST(regexp_extract({t}, {quoted(slash)}, 1) AS INT)], ' ', regexp_extract({t}, {quoted(slash)}, 2)) ELSE {t} END"
    )


def ranged(source: str, text: str, out: str, p: str = "") -> str:
    """Three tables, the last named `out`: source with {p}form, {p}start, {p}end, {p}cur, {p}rest of the first date range in text."""
    by_form = lambda f: f"CASE {p}form " + " ".join(f"WHEN '{n}' THEN {f(f'(?i){x}')}" for n, x in RANGES) + " END"
    groups = lambda k: by_form(lambda x: f"regexp_extract({text}, {quoted(x)}, {k})" if k <= re.compile(x).groups else "''")
    form = "CASE " + " ".join(f"WHEN {has(text, f'(?i){x}')} THEN '{n}'" for n, x in RANGES) + " END"
    around = by_form(lambda x: f"regexp_replace({text}, {quoted(x)}, chr(1))")
    alone, months = f"starts_with({p}form, 'one_')", f"{p}form = 'months'"
    dated = lambda g: normal_date(f"CASE WHEN {months} THEN concat({p}{g}, ' ', {p}g3) ELSE {p}{g} END")
    cur = f"CASE WHEN {p}form IN ('till', 'since') THEN true WHEN {months} OR {alone} THEN false ELSE {has(f'{p}g2', f'(?i)^{PRESENT}')} END"
    half = lambda i: f"coalesce(string_split({p}around, chr(1))[{i}], '')"
    joined = f"concat(regexp_replace(trim({half(1)}), '[,-]+$', ''), ' ', regexp_replace(trim({half(2)}), '^[,-]+', ''))"
    return f"""{out}_f AS (SELECT *, {form} AS {p}form FROM {source}), {out}_g AS (SELECT *, {groups(1)} AS {p}g1, {groups(2)} AS {p}g2, {groups(3)} AS {p}g3, {around} AS {p}around FROM {out}_f),
 {out} AS (SELECT *, CASE WHEN {p}form IS NOT NULL THEN {dated('g1')} END AS {p}start, CASE WHEN {p}form IS NOT NULL THEN {cur} END AS {p}cur,
  CASE WHEN {p}form IS NOT NULL AND NOT {alone} AND NOT ({cur}) THEN CASE WHEN {p}form = 'short_year' THEN concat(regexp_extract({p}g1, '20[0-9]{{2}}')[1:2], {p}g2) ELSE {dated('g2')} END END AS {p}end,
  CASE WHEN {p}form IS NULL THEN trim({text}) ELSE regexp_replace(trim(regexp_replace({joined}, '\\s+', ' ', 'g')), '[,-]+$', '') END AS {p}rest FROM {out}_g)"""
