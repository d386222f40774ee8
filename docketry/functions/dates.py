"""Date strings: standard form, field kinds, true incident dates.

The standard form is a ``YYYY-MM-DD`` string which is never checked against
the calendar; ``calendar_date`` gives a real DATE (NULL when there is none).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from . import regex as R
from .text import contains_any, let, strip


def is_date_field(field: str) -> bool:
    return any(indicator in field for indicator in V.DATE_FIELD_INDICATORS)


def month_to_number(name: Column) -> Column:
    """Month number of an English month name; unknown names give 1."""
    entries = ", ".join(f"'{m.lower()}', {i}" for i, m in enumerate(V.MONTHS, 1))
    return F.coalesce(F.try_element_at(F.expr(f"map({entries})"), F.lower(name)), F.lit(1))


def _iso(year: Column, month: Column, day: Column) -> Column:
    two = lambda c: F.lpad(c, 2, "0")
    return F.concat_ws("-", year, two(month), two(day))


#: Ends the parts of a date whose month is a number already.
_NUMBERED = "#"


def date_parts(value: Column) -> Column:
    """Year, month and day of the first date in ``value``, parted by blanks; NULL when there is none.

    The numeric shapes are searched only where their separator occurs. The text that holds a date is replaced by its
    groups at once, so it is searched twice and not once per group.
    """

    def parts(pattern, order):
        return F.regexp_replace(value, "(?s:\\A.*?)" + R.to_java(pattern) + "(?s:.*)", order)

    def numeric(pattern, separator):
        return F.contains(value, F.lit(separator)) & R.matches(value, pattern), parts(pattern, "$3 $1 $2 " + _NUMBERED)

    return (
        F.when(*numeric(V.NUMERIC_DATE, "/"))
        .when(R.matches(value, V.MONTH_NAME_DATE), parts(V.MONTH_NAME_DATE, "$3 $1 $2"))
        .when(*numeric(V.DASHED_DATE, "-"))
    )


def from_parts(parts: Column) -> Column:
    """Standard form of what ``date_parts`` found."""
    part = lambda k: F.substring_index(F.substring_index(parts, " ", k), " ", -1)
    month = F.when(F.endswith(parts, F.lit(_NUMBERED)), part(2)).otherwise(month_to_number(part(2)).cast("string"))
    return F.when(parts.isNotNull(), _iso(F.substring_index(parts, " ", 1), month, part(3)))


def parse_date(value: Column) -> Column:
    """Standard form of the first date in ``value``; NULL when there is none."""
    return let(date_parts(value), from_parts)


def calendar_date(standard: Column) -> Column:
    return F.to_date(F.try_to_timestamp(standard, F.lit("yyyy-MM-dd")))


def is_padded_numeric(value: Column) -> Column:
    """Plain zero-padded ``MM/DD/YYYY``, the usual shape of a filing date."""
    return F.rlike(strip(value), F.lit(R.CASE_SENSITIVE + V.PADDED_NUMERIC_DATE))


def split_multi(value: Column) -> Column:
    """The date parts of a multi-date summary, context kept."""
    return F.split(value, r"\Q" + V.MULTI_DATE_SEPARATOR + r"\E", -1)


def without_context(part: Column) -> Column:
    """``'May 1, 2020 (fell)'`` to ``'May 1, 2020'``."""
    return strip(F.substring_index(part, " (", 1))


def standardize_multiple(value: Column) -> Column:
    """Every part of a multi-date summary in standard form, unparseable ones dropped."""
    dates = F.transform(F.transform(split_multi(value), lambda p: date_parts(without_context(p))), from_parts)
    joined = F.array_join(F.filter(dates, lambda d: d.isNotNull()), V.MULTI_DATE_SEPARATOR)
    usable = value.isNotNull() & (value != "") & (value != V.NOT_AVAILABLE)
    return F.when(usable, joined).otherwise(F.lit(""))


def incident_kind(field: str) -> str:
    """How a field tells whether its date is an incident's: ``filing``, ``incident``, ``ambiguous`` or ``plain``."""
    if any(x in field for x in V.FILING_FIELD_INDICATORS):
        return "filing"
    if any(x in field for x in V.INCIDENT_FIELD_INDICATORS):
        return "incident"
    return "ambiguous" if field in V.AMBIGUOUS_FIELDS else "plain"


def is_true_incident(field: Column, value: Column, kind: Column | None = None, low: Column | None = None) -> Column:
    """Ordered rules on the value. ``kind`` is the ``incident_kind`` of the field, ``low`` the value in lower case, if known."""
    low = F.lower(value) if low is None else low
    filing = contains_any(field, V.FILING_FIELD_INDICATORS) if kind is None else kind == "filing"
    incident = contains_any(field, V.INCIDENT_FIELD_INDICATORS) if kind is None else kind == "incident"
    ambiguous = field.isin(*V.AMBIGUOUS_FIELDS) if kind is None else kind == "ambiguous"
    return (
        F.when(filing, contains_any(low, V.FILING_FIELD_CONTEXT))
        .when(incident, F.lit(True))
        .when(contains_any(low, V.INCIDENT_CONTEXT), F.lit(True))
        .when(ambiguous & ~contains_any(low, V.AMBIGUOUS_CONTEXT), F.lit(False))
        .when(is_padded_numeric(value), F.lit(False))
        .otherwise(F.lit(True))
    )
