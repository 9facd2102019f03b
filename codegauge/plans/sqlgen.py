"""Small generators of DuckDB SQL text for the oracle (the twin of each Spark query).

They restate the same fixed rule tables in SQL: Python-compatible strip, substring counts,
per-language CASE expressions. Nothing here runs on Spark.
"""

from __future__ import annotations

from codegauge.functions import rules as R

WS = (r"[\t\n\x0B\x0C\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
      r"\x{202F}\x{205F}\x{3000}]")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def lstrip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+', '')"


def cnt(x: str, sub: str) -> str:
    return f"((length({x}) - length(replace({x}, {q(sub)}, ''))) // {len(sub)})"


def cnt_any(x: str, subs) -> str:
    return "(" + " + ".join(cnt(x, s) for s in subs) + ")" if subs else "0"


def contains_any(x: str, subs) -> str:
    return "(" + " OR ".join(f"strpos({x}, {q(s)}) > 0" for s in subs) + ")"


def ends_any(x: str, subs) -> str:
    return "(" + " OR ".join(f"suffix({x}, {q(s)})" for s in subs) + ")"


def by_lang(table: dict, fn, default: str = "0", lang: str = "lang") -> str:
    parts = " ".join(f"WHEN {q(k)} THEN {fn(v)}" for k, v in table.items())
    return f"(CASE {lang} {parts} ELSE {default} END)"


def in_list(x: str, items) -> str:
    return f"{x} IN (" + ", ".join(q(i) for i in items) + ")"


def map_case(x: str, table: dict, default: str = "NULL") -> str:
    parts = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items())
    return f"(CASE {x} {parts} ELSE {default} END)"


def eslint_category(x: str) -> str:
    parts = " ".join(f"WHEN {in_list(x, rs)} THEN {q(c)}" for c, rs in R.ESLINT_RULE_CATEGORIES.items())
    return f"(CASE {parts} ELSE 'general' END)"


def bandit_severity(sev: str, conf: str) -> str:
    return (f"(CASE WHEN {sev} = 'HIGH' AND {conf} = 'HIGH' THEN 'error' "
            f"WHEN {sev} = 'MEDIUM' OR {conf} = 'HIGH' THEN 'warning' ELSE 'info' END)")


def pyflakes_severity(m: str) -> str:
    return (f"(CASE WHEN strpos({m}, 'undefined name') > 0 OR strpos({m}, 'imported but unused') > 0 "
            f"THEN 'warning' WHEN strpos({m}, 'redefined') > 0 THEN 'info' ELSE 'warning' END)")


def pyflakes_category(m: str) -> str:
    return (f"(CASE WHEN strpos({m}, 'imported but unused') > 0 OR strpos({m}, 'undefined name') > 0 "
            f"THEN 'style' ELSE 'general' END)")


def pyflakes_suggestion(m: str) -> str:
    parts = " ".join(f"WHEN strpos({m}, {q(f)}) > 0 THEN {q(t)}" for f, t in R.PYFLAKES_SUGGESTIONS)
    return f"(CASE {parts} ELSE NULL END)"


def sql_filled(sentence: str, value: str | None = None) -> str:
    """SQL text of a report sentence, with ``value`` (SQL text) in the place of ``{}``."""
    if value is None:
        return q(sentence)
    before, after = sentence.split("{}")
    return f"{q(before)} || CAST({value} AS STRING) || {q(after)}"
