"""Localised date parsing and formatting as native column expressions
(CLN-01, CLN-02, CLN-03).  No Python UDF: month lookup is a literal map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# fixed values (must equal the reference's)
# month tokens of the lenient parser (first three letters, dots removed)
MONTHS_ES = ["ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic"]
# month abbreviations of the formatter (September is "sept.")
MONTHS_ES_OUT = ["ene.", "feb.", "mar.", "abr.", "may.", "jun.", "jul.", "ago.", "sept.", "oct.", "nov.", "dic."]
# ---------------------------------------------------------------------------

# day-first formats tried by the generic fallback parse
FALLBACK_FORMATS = ["d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-MM-dd", "yyyy/MM/dd", "d MMM yyyy"]

# date parts and times of a value's signature (digits as 9, letter runs as a) and their formats
_DATE_SHAPES = {"9{1,2}/9{1,2}/9{4}": "d/M/yyyy", "9{1,2}-9{1,2}-9{4}": "d-M-yyyy", r"9{1,2}\.9{1,2}\.9{4}": "d.M.yyyy",
                "9{4}-9{1,2}-9{1,2}": "yyyy-M-d", "9{4}/9{1,2}/9{1,2}": "yyyy/M/d", "9{1,2} a 9{4}": "d MMM yyyy"}
_TIME_SHAPES = {"": "", " 9{1,2}:99": " H:mm", " 9{1,2}:99:99": " H:mm:ss", "a9{1,2}:99:99": "'T'H:mm:ss"}
#: signature pattern -> format, date-time texts included; day first, as in ``parse_generic``
SIGNATURE_FORMATS = {d + t: df + tf for d, df in _DATE_SHAPES.items() for t, tf in _TIME_SHAPES.items()}
LOCALISED_SIGNATURE = r"9{1,2} +a\.* +9{4}"
LOCALISED = "localised"


def signature(s: Column) -> Column:
    """Shape of a text: every digit as 9, every run of letters as one a."""
    return F.regexp_replace(F.regexp_replace(F.trim(s), "[0-9]", "9"), r"\p{L}+", "a")


#: no date text is longer
MAX_DATE_CHARS = 40


def signature_format(s: Column, sig: Column) -> Column:
    """The format that ``sig``, the signature of ``s``, names, if ``s`` parses
    by it, else null.  Each value is parsed by its own format alone; a
    localised text (`15 nov. 2023`) that isn't an English one gives
    ``localised``.  ``sig`` is a column of its own, so that it is made once."""
    t = F.trim(s)
    by_format = None
    for pattern, fmt in SIGNATURE_FORMATS.items():
        hit = F.when(F.try_to_timestamp(t, F.lit(fmt)).isNotNull(), F.lit(fmt))
        test = sig.rlike(f"^{pattern}$")
        by_format = F.when(test, hit) if by_format is None else by_format.when(test, hit)
    local = F.when(sig.rlike(f"^{LOCALISED_SIGNATURE}$") & parse_localised(s, strict=True).isNotNull(), F.lit(LOCALISED))
    return F.coalesce(by_format, local)


def _month_map() -> Column:
    return F.create_map(*[x for i, m in enumerate(MONTHS_ES) for x in (F.lit(m), F.lit(i + 1))])


def _make_date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year.cast("string"), month.cast("string"), day.cast("string")),
                         "y-M-d")


def parse_generic(s: Column) -> Column:
    """Day-first generic parse; failures become null."""
    s = F.trim(s)
    return F.coalesce(*[F.try_to_date(s, f) for f in FALLBACK_FORMATS])


def parse_localised(s: Column, strict: bool = False) -> Column:
    """`15 nov. 2023` -> DATE.

    lenient (CLN-01): dots removed, month = first three letters, else a generic
    day-first parse.  strict (CLN-02): exactly three tokens, month token with
    trailing dots removed must equal a key, so `sept.` fails."""
    if strict:
        parts = F.split(F.trim(s), r"\s+")
        ok = F.size(parts) == 3
        mon = F.regexp_replace(F.lower(parts.getItem(1)), r"\.+$", "")
        m = F.try_element_at(_month_map(), mon)
        day = F.when(parts.getItem(0).rlike(r"^\d+$"), parts.getItem(0))
        year = F.when(parts.getItem(2).rlike(r"^\d+$"), parts.getItem(2))
        return F.when(ok, _make_date(year, m, day))
    clean = F.trim(F.regexp_replace(s, r"\.", ""))
    parts = F.split(clean, r"\s+")
    mon = F.lower(F.substring(parts.getItem(1), 1, 3))
    m = F.try_element_at(_month_map(), mon)
    day = F.when(parts.getItem(0).rlike(r"^\d+$"), parts.getItem(0))
    year = F.when(parts.getItem(2).rlike(r"^\d+$"), parts.getItem(2))
    primary = F.when((F.size(parts) >= 3) & m.isNotNull(), _make_date(year, m, day))
    return F.coalesce(primary, F.when(m.isNull() | (F.size(parts) < 3), parse_generic(s)))


def format_localised(d: Column) -> Column:
    """DATE -> `8 ago. 2025` (CLN-03)."""
    names = F.array(*[F.lit(m) for m in MONTHS_ES_OUT])
    return F.concat(F.dayofmonth(d).cast("string"), F.lit(" "), F.element_at(names, F.month(d)),
                    F.lit(" "), F.year(d).cast("string"))


_NTZ_EPOCH = "1970-01-01 00:00:00"


def ntz_to_instant(ts: Column) -> Column:
    """TIMESTAMP_NTZ wall time -> TIMESTAMP instant whose UTC reading is that
    wall time (independent of the session time zone; for event-time windows
    and watermarks, which need TIMESTAMP)."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit(_NTZ_EPOCH).cast("timestamp_ntz"), ts))


def instant_to_ntz(ts: Column) -> Column:
    """Inverse of ``ntz_to_instant``."""
    return F.lit(_NTZ_EPOCH).cast("timestamp_ntz") + F.make_dt_interval(
        secs=(F.unix_micros(ts) / 1_000_000).cast("decimal(18,6)"))
