"""DuckDB SQL fragments mirroring the native column expressions of
``sparktab.functions`` (used only by oracle queries)."""

from __future__ import annotations

import re

from sparktab.functions import dates as D

_MONTHS = "['ene','feb','mar','abr','may','jun','jul','ago','sep','oct','nov','dic']"
_FALLBACK = ["%d/%m/%Y", "%d-%m-%Y", "%d.%m.%Y", "%Y-%m-%d", "%Y/%m/%d", "%d %b %Y"]


def parse_generic(s: str) -> str:
    fmts = ", ".join(f"CAST(try_strptime(trim({s}), '{f}') AS DATE)" for f in _FALLBACK)
    return f"coalesce({fmts})"


def _mk(y: str, m: str, d: str) -> str:
    return f"CAST(try_strptime(({y}) || '-' || CAST({m} AS VARCHAR) || '-' || ({d}), '%Y-%m-%d') AS DATE)"


def parse_strict(s: str) -> str:
    p = f"string_split_regex(trim({s}), '\\s+')"
    mon = f"nullif(list_position({_MONTHS}, regexp_replace(lower({p}[2]), '\\.+$', '')), 0)"
    day = f"CASE WHEN regexp_full_match({p}[1], '[0-9]+') THEN {p}[1] END"
    yr = f"CASE WHEN regexp_full_match({p}[3], '[0-9]+') THEN {p}[3] END"
    return f"CASE WHEN len({p}) = 3 THEN {_mk(yr, mon, day)} END"


def parse_lenient(s: str) -> str:
    p = f"string_split_regex(trim(replace({s}, '.', '')), '\\s+')"
    mon = f"nullif(list_position({_MONTHS}, lower(substr({p}[2], 1, 3))), 0)"
    day = f"CASE WHEN regexp_full_match({p}[1], '[0-9]+') THEN {p}[1] END"
    yr = f"CASE WHEN regexp_full_match({p}[3], '[0-9]+') THEN {p}[3] END"
    primary = f"CASE WHEN len({p}) >= 3 AND {mon} IS NOT NULL THEN {_mk(yr, mon, day)} END"
    return f"coalesce({primary}, CASE WHEN {mon} IS NULL OR len({p}) < 3 THEN {parse_generic(s)} END)"


_STRPTIME = {"yyyy": "%Y", "MMM": "%b", "M": "%m", "d": "%d", "H": "%H", "mm": "%M", "ss": "%S", "'T'": "T"}


def signature_format(s: str) -> str:
    """DuckDB text of ``dates.signature_format``."""
    sig = f"regexp_replace(regexp_replace(trim({s}), '[0-9]', '9', 'g'), '\\p{{L}}+', 'a', 'g')"
    whens = []
    for pattern, fmt in D.SIGNATURE_FORMATS.items():
        duck = re.sub(r"yyyy|MMM|mm|ss|'T'|M|d|H", lambda m: _STRPTIME[m.group()], fmt)
        text = fmt.replace("'", "''")
        whens.append(f"WHEN regexp_full_match({sig}, '{pattern}') THEN CASE WHEN try_strptime(trim({s}), '{duck}') IS NOT NULL THEN '{text}' END")
    local = f"CASE WHEN regexp_full_match({sig}, '{D.LOCALISED_SIGNATURE}') AND {parse_strict(s)} IS NOT NULL THEN '{D.LOCALISED}' END"
    return f"coalesce(CASE {' '.join(whens)} END, {local})"


def profile_sql(src: str, cols: list[tuple[str, str]]) -> str:
    """Long-form profile over ``src`` for (column, spark dtype) pairs."""
    parts = []
    for i, (c, t) in enumerate(cols):
        parts.append(
            f"SELECT '{c}' AS column_name, '{t}' AS dtype, CAST({i} AS BIGINT) AS position, count(*) AS n_rows, "
            f"count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*) * 100, 4) AS missing_pct, "
            f"count(DISTINCT {c}) AS n_unique, round(count(DISTINCT {c}) / count(*), 4) AS unique_ratio FROM {src}")
    return "\nUNION ALL ".join(parts)
