"""Typed fields out of document text: parties, numbers, sentences, excerpts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions import lexicon as lx
from folioscope.functions.patterns import (
    all_groups,
    contains_any,
    count_contained,
    first_group,
    let,
    strip,
)
from folioscope.functions.text import clean_for_excerpt, truncate_at_word

EXCERPT_LENGTH = 300


def extract_client(text: Column) -> tuple[Column, Column]:
    """(client name, address of up to four lines below it)."""
    name = F.coalesce(*[strip(first_group(text, p)) for p in lx.CLIENT_PATTERNS])
    return name, strip(first_group(text, lx.ADDRESS_PATTERN))


def extract_fields_by_type(text: Column, document_type: Column) -> dict[str, Column]:
    """Field name to column; a field is null for the types that do not carry it."""
    by_name: dict[str, list[Column]] = {}
    for kind, fields in lx.TYPE_FIELDS.items():
        for name, patterns in fields.items():
            found = F.coalesce(*[first_group(text, p) for p in patterns])
            value = strip(found) if name in lx.STRIPPED_FIELDS else found
            by_name.setdefault(name, []).append(F.when(document_type == kind, value))
    return {name: F.coalesce(*options) for name, options in by_name.items()}


def analyze_invoice(clean: Column) -> dict[str, Column]:
    """Number, amount, term count and invoice flags from cleaned text."""
    number = F.coalesce(
        *[first_group(clean, p) for p in lx.INVOICE_NUMBER_PATTERNS],
        F.when(F.lower(clean).contains("facture"), first_group(clean, lx.WORD_AFTER_FACTURE)),
    )
    terms = count_contained(F.lower(clean), lx.INVOICE_TERMS)
    definite = contains_any(F.lower(clean), lx.INVOICE_INDICATORS["keyword"])
    return {
        "invoice_number": number,
        "amount": F.coalesce(*[first_group(clean, p) for p in lx.INVOICE_AMOUNT_PATTERNS]),
        "invoice_term_count": terms,
        "is_definitely_invoice": definite,
        "is_invoice": definite | (terms >= 2),
    }


def extract_key_info(text: Column) -> dict[str, Column]:
    """All amounts, dates and document numbers, pattern by pattern."""
    return {
        "amounts": F.concat(*[all_groups(text, p) for p in lx.KEY_AMOUNT_PATTERNS]),
        "dates": F.concat(*[all_groups(text, p, 0) for p in lx.KEY_DATE_PATTERNS]),
        "invoice_numbers": F.concat(*[all_groups(text, p) for p in lx.KEY_NUMBER_PATTERNS]),
    }


def sentences(clean: Column, min_length: int = 10) -> Column:
    parts = F.transform(F.split(clean, "[.!?]+"), strip)
    return F.filter(parts, lambda s: F.length(s) >= min_length)


def sentence_score(sentence: Column) -> Column:
    """Weight of a sentence: money, party and date words, digits, capital, length."""

    def score(s: Column) -> Column:
        def words(low: Column) -> Column:
            return (
                count_contained(low, lx.FINANCIAL_WORDS) * 3.0
                + count_contained(low, lx.COMPANY_WORDS) * 2.0
                + count_contained(low, lx.DATE_WORDS) * 1.0
            )

        length = F.length(s)
        return (
            let(F.lower(s), words)
            + F.when(s.rlike(r"\p{Nd}"), 1.5).otherwise(0.0)
            + F.when(s.rlike("^[A-Z][a-z]"), 0.5).otherwise(0.0)
            + F.when(length < 20, -1.0).when(length > 200, -0.5).otherwise(0.5)
        )

    return score(sentence)


def smart_excerpt(text: Column, max_length: int = EXCERPT_LENGTH) -> Column:
    """Short texts whole; else the best sentences that fit together, best first.

    Later, shorter sentences may still fit after a longer one did not. If even the best one
    is too long it is truncated; without any sentence the text itself is.
    """

    def pack(clean: Column) -> Column:
        ranked = F.array_sort(
            F.transform(
                sentences(clean),
                lambda s, i: F.struct((-sentence_score(s)).alias("rank"), i.alias("at"), s.alias("s")),
            )
        )

        def choose(best: Column) -> Column:
            top = F.get(best, F.lit(0))["s"]
            start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))

            def add(acc: Column, x: Column) -> Column:
                cost = F.length(x["s"]) + 2
                grown = F.struct(
                    F.concat(
                        acc["out"], F.when(acc["used"] > 0, F.lit(" ")).otherwise(""), x["s"], F.lit(".")
                    ).alias("out"),
                    (acc["used"] + cost).alias("used"),
                )
                return F.when(acc["used"] + cost <= max_length, grown).otherwise(acc)

            return (
                F.when(F.size(best) == 0, truncate_at_word(clean, max_length))
                .when(
                    F.length(top) + 2 > max_length,
                    F.concat(truncate_at_word(top, max_length - 3), F.lit("...")),
                )
                .otherwise(F.aggregate(best, start, add, lambda acc: acc["out"]))
            )

        return F.when(F.length(clean) <= max_length, clean).otherwise(let(ranked, choose))

    return F.when(
        F.length(F.coalesce(text, F.lit(""))) <= max_length, text
    ).otherwise(let(clean_for_excerpt(text), pack))
