"""SQL for DuckDB of a block's counts and scores, from a table with the block's lines as a list."""

from __future__ import annotations

from ..operators.signatures import FORMS, KEYWORDS, KINDS, phrase
from .sql_text import quoted

_D = lambda v: f"CAST({v} AS DOUBLE)"
_on = lambda c, v: f"CASE WHEN {c} THEN {v} ELSE {_D(0)} END"
_part = lambda c, w, by, top: f"{_D(w)} + least({c} / {_D(by)}, {_D(top)})"
_quiet = "bullets = 0 AND ranges = 0"
_TERMS = {
    "skills": (_on("tech >= 2", _part("tech", 0.4, 20, 0.4)), _on(f"{_quiet} AND tech >= 3", _D(0.15)), _on("avg_len < 80 AND bullets = 0 AND tech >= 2", _D(0.1))),
    "experience": (_on("ranges >= 1", _D(0.3)), _on("role >= 1", _part("role", 0.2, 5, 0.2)), _on("org >= 1", _D(0.15)), _on("bullets >= 2", _D(0.2)), _on("ranges >= 1 AND bullets >= 1", _D(0.15))),
    "education": (_on("degrees >= 1", _D(0.5)), _on("grades >= 1", _D(0.2)), _on("school >= 2", _part("school", 0.2, 8, 0.2)), _on("degrees >= 1 AND dates >= 1", _D(0.1))),
    "projects": (_on("project >= 2", _part("project", 0.3, 8, 0.3)), _on("tech >= 1 AND bullets >= 1 AND ranges = 0", _D(0.2)), _on("urls >= 1 AND bullets >= 1", _D(0.15))),
    "awards": (_on("award >= 1", _part("award", 0.3, 5, 0.3)), _on("bullets >= 1 AND award >= 1", _D(0.15))),
    "summary": (_on(_quiet, f"CASE WHEN avg_len > 80 THEN {_D(0.55)} WHEN avg_len > 55 THEN {_D(0.45)} WHEN avg_len > 40 THEN {_D(0.3)} WHEN long_lines >= 1 THEN {_D(0.2)} ELSE {_D(0)} END"), _on(f"line_count <= 4 AND avg_len > 50 AND {_quiet}", _D(0.15))),
    "interests": (_on("avg_len < 40 AND bullets >= 1 AND ranges = 0", _D(0.2)), _on("bullets >= 2 AND tech = 0 AND ranges = 0", _D(0.1))),
}


def signed(source: str, out: str) -> str:
    """Tables ending in `out`: source (with a list `lines`) with counts, scores, best_section and best_score."""
    some = lambda f: f"CAST(len(list_filter(lines, lambda v: {f})) AS INT)"
    size = "len(list_filter(string_split_regex(trim(v), '\\s+'), lambda w: w <> ''))"
    counts = {n: some(f"regexp_matches(trim(v), {quoted(p)})") for n, p in FORMS.items()}
    for kind, words in KEYWORDS.items():
        plain = ", ".join(quoted(w) for w in words if w.isalnum())
        counts[kind] = f"CAST(len(list_intersect(words, [{plain}]))" + "".join(f" + CAST(regexp_matches(txt, {quoted(phrase(w))}) AS INT)" for w in words if not w.isalnum()) + " AS INT)"
    counts |= {
        "line_count": "CAST(len(lines) AS INT)", "avg_len": f"CASE WHEN len(lines) > 0 THEN list_sum(list_transform(lines, lambda v: length(trim(v)))) / {_D('len(lines)')} ELSE {_D(0)} END",
        "short_lines": some(f"{size} <= 4"), "long_lines": some(f"{size} > 20"), "has_contact": f"len(list_filter(lines, lambda v: regexp_matches(v, {quoted(FORMS['emails'])}) OR regexp_matches(v, {quoted(FORMS['phones'])}))) > 0",
    }
    scores = ", ".join(f"CASE WHEN line_count > 0 THEN least({' + '.join(ts)}, {_D(1)}) ELSE {_D(0)} END AS {k}_score" for k, ts in _TERMS.items())
    best = "list_max([" + ", ".join(f"({k}_score, {-i}, '{k}')" for i, k in enumerate(KINDS)) + "])"
    return f"""{out}_w AS (SELECT *, lower(array_to_string(lines, ' ')) AS txt, list_distinct(string_split_regex(lower(array_to_string(lines, ' ')), '\\W+')) AS words FROM {source}),
 {out}_c AS (SELECT *, {', '.join(f'{f} AS {n}' for n, f in counts.items())} FROM {out}_w), {out}_s AS (SELECT *, {scores} FROM {out}_c), {out} AS (SELECT *, CASE WHEN {best}[1] >= 0.25 THEN {best}[3] END AS best_section, {best}[1] AS best_score FROM {out}_s)"""


COUNTS = ("line_count", "avg_len", "short_lines", "long_lines", "has_contact", *FORMS, *KEYWORDS)
