"""SQL text helpers as column expressions (SQL-02..07, 10, 11, 16).

They act on a column of query or message texts, so an audit of a whole query
log runs as one projection; the single text of an interactive query goes
through a one-row frame."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lstrip(q: Column) -> Column:
    return F.regexp_replace(q, r"^\s+", "")


def strip_ws(q: Column) -> Column:
    return F.regexp_replace(q, r"^\s+|\s+$", "")


def is_select(q: Column, allow_with: bool = False) -> Column:
    """SQL-02: text starts with SELECT (after leading blanks, any case).
    ``allow_with`` also accepts a CTE (the reference refuses it)."""
    u = F.upper(_lstrip(q))
    ok = u.startswith("SELECT")
    return (ok | u.startswith("WITH")) if allow_with else ok


def has_limit(q: Column, word: bool = False) -> Column:
    """SQL-03 test: the reference looks for the substring 'limit' (so a column
    `credit_limit` counts); ``word=True`` asks for the keyword."""
    return F.lower(q).rlike(r"\blimit\b") if word else F.lower(q).contains("limit")


def add_limit(q: Column, n: int = 100, word: bool = False) -> Column:
    """SQL-03: append ' LIMIT n' when the text has no limit."""
    return F.when(has_limit(q, word), q).otherwise(F.concat(q, F.lit(f" LIMIT {n}")))


def strip_fences_explain(q: Column) -> Column:
    """SQL-04: drop code fences, strip, then drop a leading EXPLAIN."""
    s = strip_ws(F.replace(F.replace(q, F.lit("```sql"), F.lit("")), F.lit("```"), F.lit("")))
    return F.when(F.upper(s).startswith("EXPLAIN"), strip_ws(F.substring(s, 8, 1 << 30))).otherwise(s)


def lint_active(q: Column) -> Column:
    """SQL-05: `active = 1/0` -> `active = true/false` (any case)."""
    s = F.regexp_replace(q, r"(?i)\bactive\s*=\s*1\b", "active = true")
    return F.regexp_replace(s, r"(?i)\bactive\s*=\s*0\b", "active = false")


def lint_union_all(q: Column) -> Column:
    """SQL-06: every UNION not already followed by ALL becomes UNION ALL
    (changes results: duplicates stay)."""
    return F.regexp_replace(q, r"(?i)\bUNION\b(?!\s+ALL)", "UNION ALL")


def flags_not_in_null(q: Column) -> Column:
    """SQL-07: `NOT IN ( ... NULL ... )` on one line (no DOTALL)."""
    return q.rlike(r"(?i)NOT\s+IN\s*\(.*NULL.*\)")


def sql_block(text: Column) -> Column:
    """SQL-10: the first fenced sql block of a message, stripped; null when none."""
    pat = r"(?s)```sql\n(.*?)\n```"
    return F.when(text.rlike(pat), strip_ws(F.regexp_extract(text, pat, 1)))


def error_flag(text: Column) -> Column:
    """SQL-16: the text holds 'error' in any case (diagnostic only: data that
    contains the word also hits)."""
    return F.lower(text).contains("error")


_DT = r"datetime\.datetime\((\d+),\s*(\d+),\s*(\d+)(?:,\s*(\d+),\s*(\d+)(?:,\s*(\d+))?)?\)"


def normalise_literals(text: Column) -> Column:
    """SQL-11: `datetime.datetime(y, m, d[, H, M[, S]])` -> `'yyyy-mm-ddTHH:MM:SS'`
    and `Decimal('x')` -> `'x'` in printed result rows.  Pieces between the
    matches come from ``split`` and the matches from ``regexp_extract_all``;
    both are zipped back, so any number of literals per text is handled."""
    pieces = F.split(text, _DT, -1)
    matches = F.regexp_extract_all(text, F.lit(_DT), 0)

    def iso(m):
        def g(i, default=None):
            v = F.regexp_extract(m, _DT, i)
            return F.lpad(F.when(v == "", F.lit(default)).otherwise(v) if default else v, 2, "0")
        return F.concat(F.lit("'"), F.regexp_extract(m, _DT, 1), F.lit("-"), g(2), F.lit("-"), g(3), F.lit("T"),
                        g(4, "0"), F.lit(":"), g(5, "0"), F.lit(":"), g(6, "0"), F.lit("'"))
    isos = F.concat(F.transform(matches, iso), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(pieces, isos, lambda a, b: F.concat(a, b)), "")
    return F.regexp_replace(joined, r"Decimal\('([^']+)'\)", "'$1'")
