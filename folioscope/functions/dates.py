"""Date recognition in document text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions import lexicon as lx
from folioscope.functions.patterns import all_groups, first_group, java, let, strip

_MONTHS = {name: f"{i:02d}" for i, name in enumerate(lx.ENGLISH_MONTHS, 1)} | {
    # the only French month whose name survives the cut to three letters
    "mai": "05"
}
_FULL_FRENCH = {name: f"{i:02d}" for i, name in enumerate(lx.FRENCH_MONTHS, 1)}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def normalize_date(date: Column, full_french_months: bool = False) -> Column:
    """``D/M/Y``, ``D Month Y``, ``Month D, Y`` or ``Y/M/D`` as ISO text; null otherwise.

    Month names count by their first three letters, so most French names are not
    recognised unless ``full_french_months`` is set. There is no calendar check.
    """

    def month_number(name: Column) -> Column:
        by_cut = _lookup(_MONTHS, F.substring(F.lower(name), 1, 3))
        return F.coalesce(by_cut, _lookup(_FULL_FRENCH, F.lower(name))) if full_french_months else by_cut

    def iso(year: Column, month: Column, day: Column) -> Column:
        return F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))

    def with_month_name(d: Column, pattern: str, day: int, month: int) -> Column:
        number = month_number(first_group(d, pattern, month))
        return F.when(
            number.isNotNull(), iso(first_group(d, pattern, 3), number, first_group(d, pattern, day))
        )

    def read(d: Column) -> Column:
        parts = F.split(d, "[./-]")
        part = lambda i: F.get(parts, F.lit(i))
        three = F.size(parts) == 3
        year = F.when(F.length(part(2)) == 2, F.concat(F.lit("20"), part(2))).otherwise(part(2))
        name = rf"([{lx.MONTH_LETTERS}]+)"
        return F.coalesce(
            F.when(
                d.rlike(java(r"^\d{1,2}[./-]\d{1,2}[./-]\d{2,4}")) & three,
                iso(year, part(1), part(0)),
            ),
            with_month_name(d, rf"^(\d{{1,2}})\s+{name}\s+(\d{{4}})", 1, 2),
            with_month_name(d, rf"^{name}\s+(\d{{1,2}}),?\s+(\d{{4}})", 2, 1),
            F.when(
                d.rlike(java(r"^\d{4}[./-]\d{1,2}[./-]\d{1,2}")) & three,
                iso(part(0), part(1), part(2)),
            ),
        )

    return let(date, read)


def _first_normal(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[normalize_date(first_group(text, p)) for p in patterns])


def extract_dates(text: Column) -> tuple[Column, Column]:
    """(document date, due date): first pattern whose match normalises."""
    return (
        _first_normal(text, lx.DOCUMENT_DATE_PATTERNS),
        _first_normal(text, lx.DUE_DATE_PATTERNS),
    )


def find_money_date(text: Column) -> Column:
    """First stated day-first or ISO date that exists in the calendar, else null.

    The day-first patterns also look inside ISO dates (``2024-05-15`` holds ``24-05-15``),
    which is kept.
    """

    def real_date(found: Column) -> Column:
        parts = F.split(strip(found), "[/-]")
        part = lambda i: F.get(parts, F.lit(i))
        year = F.when(F.length(part(2)) == 2, F.concat(F.lit("20"), part(2))).otherwise(part(2))
        day_first = F.concat_ws("-", F.lpad(year, 4, "0"), part(1), part(0))
        spelled = F.when(found.rlike(r"^[0-9]{1,2}[/-]"), day_first).otherwise(found)
        return F.try_to_date(spelled, "yyyy-M-d")

    def first_real(pattern: str) -> Column:
        found = all_groups(text, pattern.replace(r"\d", "[0-9]"))
        return F.get(F.filter(F.transform(found, real_date), lambda d: d.isNotNull()), F.lit(0))

    return F.coalesce(*[first_real(p) for p in lx.MONEY_DATE_PATTERNS])


def extract_date(text: Column, as_of: Column) -> Column:
    """:func:`find_money_date`, falling back to ``as_of`` (the clock is never read)."""
    return F.coalesce(find_money_date(text), as_of)


def parse_date_formats(date: Column, as_of: Column) -> Column:
    """``Y-m-d``, ``d/m/Y``, ``m/d/Y``, ``d-m-Y`` in that order, else ``as_of``."""
    formats = [
        (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "yyyy-M-d"),
        (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "d/M/yyyy"),
        (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/yyyy"),
        (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "d-M-yyyy"),
    ]
    return F.coalesce(
        *[F.when(date.rlike(shape), F.try_to_date(date, fmt)) for shape, fmt in formats], as_of
    )
