"""Money in document text: amount, currency, category, description, confidence."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions import lexicon as lx
from folioscope.functions.dates import find_money_date
from folioscope.functions.patterns import (
    WORD,
    all_groups,
    contains_any,
    first_group,
    has_any,
    let,
    may_have,
    replace_all,
    strip,
)
from folioscope.functions.text import title_case

_ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"


def to_number(text: Column) -> Column:
    """Double from digits with thousands commas; null if it is none."""
    return F.translate(text, _ARABIC_DIGITS + ",", "0123456789").try_cast("double")


def extract_amount(text: Column, strict_total: bool = False) -> Column:
    """First positive amount by pattern order, else null.

    Amounts labelled as totals win over looser ones. "total" needs no word edge, so a
    subtotal counts unless ``strict_total`` is set.
    """

    def read(low: Column) -> Column:
        def first_positive(pattern: str) -> Column:
            possible = may_have(low, pattern)
            for mark in "$€£":
                if mark in re.sub(r"\[[^]]*\]|.\?", "", pattern):  # neither in a class nor optional
                    possible = possible & low.contains(mark)
            if strict_total and pattern.startswith("total"):
                pattern = r"\b" + pattern
            bare = F.transform(
                all_groups(low, pattern), lambda m: to_number(replace_all(m, r"[€$£\s]", ""))
            )
            return F.when(possible, F.get(F.filter(bare, lambda v: v > 0), F.lit(0)))

        return F.coalesce(*[first_positive(p) for p in lx.TOTAL_PATTERNS + lx.LOOSE_AMOUNT_PATTERNS])

    return let(F.lower(text), read)


def identify_currency(text: Column, strict_currency: bool = False) -> Column:
    """First of EUR, USD, TND, GBP with a mark in the text; EUR without any.

    Marks count inside words ("fournisseur" holds "eur") unless ``strict_currency``.
    """

    def marked(low: Column, marks: list[str]) -> Column:
        if not strict_currency:
            return contains_any(low, marks)
        apart = [rf"(?:^|[^{WORD}]){m}(?:$|[^{WORD}])" if m.isalpha() else re.escape(m) for m in marks]
        return has_any(low, apart, False)

    def read(low: Column) -> Column:
        return F.coalesce(
            *[F.when(marked(low, marks), F.lit(code)) for code, marks in lx.CURRENCY_MARKS.items()],
            F.lit("EUR"),
        )

    return let(F.lower(text), read)


def amount_currency(amount: Column, text: Column) -> Column:
    """Currency of a found amount; documents without an amount are booked as USD."""
    return F.when(amount.isNotNull(), identify_currency(text)).otherwise(F.lit("USD"))


def categorize(document_type: Column) -> tuple[Column, Column]:
    """(category, subcategory) of a document type."""
    table = F.create_map(
        *[
            x
            for name, pair in lx.TYPE_CATEGORIES.items()
            for x in (F.lit(name), F.array(F.lit(pair[0]), F.lit(pair[1])))
        ]
    )
    found = F.try_element_at(table, document_type)
    return tuple(
        F.coalesce(F.get(found, F.lit(i)), F.lit(default))
        for i, default in enumerate(lx.DEFAULT_CATEGORY)
    )


def describe(text: Column, document_type: Column) -> Column:
    """Text after a description label (100 characters), else type and first line (50)."""
    labelled = let(
        F.struct(text.alias("text"), F.lower(text).alias("low")),
        lambda t: F.coalesce(*[F.when(may_have(t["low"], p), strip(first_group(t["text"], p))) for p in lx.DESCRIPTION_PATTERNS]),
    )
    first_line = strip(F.substring_index(strip(text), "\n", 1))
    title = title_case(document_type)
    fallback = F.when(
        first_line != "", F.concat(title, F.lit(": "), F.substring(first_line, 1, 50), F.lit("..."))
    ).otherwise(F.concat(title, F.lit(" transaction")))
    return F.coalesce(F.substring(labelled, 1, 100), fallback)


def extraction_confidence(
    amount: Column, currency: Column, date: Column, document_type: Column, as_of: Column
) -> Column:
    """Points for amount, currency, date and known type.

    A stated date equal to today counts half; an unstated one stands for the present moment,
    never midnight, and counts in full.
    """
    points = (
        F.when(amount > 0, 0.4).otherwise(0.0)
        + F.when(currency != "EUR", 0.2).otherwise(0.1)
        + F.when(date == as_of, 0.1).otherwise(0.2)
        + F.when(document_type != lx.UNKNOWN_TYPE, 0.2).otherwise(0.0)
    )
    return F.least(points, F.lit(1.0))


def transaction(text: Column, document_type: Column, document_id: Column, as_of: Column) -> Column:
    """One typed transaction per document; a null text gives a zero row of confidence 0."""

    def build(t: Column) -> Column:
        # amount and date are searched once and shared by the fields that need them
        def from_found(found: Column) -> Column:
            amount, stated = found["amount"], found["date"]
            currency = amount_currency(amount, t)
            category, subcategory = categorize(document_type)
            known_amount = F.coalesce(amount, F.lit(0.0))
            return F.struct(
                document_type.alias("document_type"),
                known_amount.alias("amount"),
                currency.alias("currency"),
                F.coalesce(stated, as_of).alias("date"),
                describe(t, document_type).alias("description"),
                category.alias("category"),
                subcategory.alias("subcategory"),
                document_id.alias("document_id"),
                extraction_confidence(known_amount, currency, stated, document_type, as_of).alias(
                    "confidence"
                ),
            )

        return let(
            F.struct(extract_amount(t).alias("amount"), find_money_date(t).alias("date")), from_found
        )

    failed = F.struct(
        document_type.alias("document_type"),
        F.lit(0.0).alias("amount"),
        F.lit("EUR").alias("currency"),
        F.lit(None).cast("date").alias("date"),
        F.lit("Error in analysis").alias("description"),
        F.lit("unknown").alias("category"),
        F.lit("unknown").alias("subcategory"),
        document_id.alias("document_id"),
        F.lit(0.0).alias("confidence"),
    )
    return F.when(text.isNull(), failed).otherwise(let(text, build))


def largest_amount(text: Column, info: Column, bare_comma_voids: bool = True) -> Column:
    """Largest number over 10 in info and text, converted by the currency info names.

    A comma standing alone makes the whole search fail; ``bare_comma_voids=False`` skips it.
    """

    def read(found: Column) -> Column:
        largest = F.array_max(F.filter(F.transform(found, to_number), lambda v: v > 10))
        if not bare_comma_voids:
            return largest
        return F.when(~F.exists(found, lambda m: to_number(m).isNull()), largest)

    both = F.concat(F.coalesce(info, F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))
    named = F.upper(F.coalesce(info, F.lit("")))
    factor = (
        F.when(named.contains("EUR"), lx.TND_RATES["EUR"])
        .when(named.contains("USD") | named.contains("DOLLAR"), lx.TND_RATES["USD"])
        .otherwise(1.0)
    )
    return let(all_groups(both, r"([\d,]+\.?\d*)"), read) * factor
