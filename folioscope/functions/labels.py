"""Label mapping as ordered ``when`` chains built from constant tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions import lexicon as lx
from folioscope.functions.patterns import contains_any, let, strip


def first_hit(text: Column, table: list[tuple[str, list[str]]]) -> Column:
    """Name of the first row of ``table`` one of whose words occurs in ``text``."""
    chain = reduce(
        lambda acc, row: acc.when(contains_any(text, row[1]), F.lit(row[0])),
        table[1:],
        F.when(contains_any(text, table[0][1]), F.lit(table[0][0])),
    )
    return chain


def map_label_standard(label: Column) -> Column:
    """Exact name, else first listed name inside the label, else the label made safe."""
    exact = F.create_map(*[F.lit(x) for pair in lx.STANDARD_LABELS.items() for x in pair])
    inside = [(to, [word]) for word, to in lx.STANDARD_LABELS.items()]

    def mapped(low: Column) -> Column:
        return F.coalesce(
            F.try_element_at(exact, low),
            first_hit(low, inside),
            F.regexp_replace(low, "[^a-z0-9_]", "_"),
        )

    return F.when(F.coalesce(label, F.lit("")) == "", F.lit("document")).otherwise(
        let(strip(F.lower(label)), mapped)
    )


def _grouped(label: Column, table: list[tuple[str, list[str]]]) -> Column:
    return let(
        F.lower(label), lambda low: F.coalesce(first_hit(low, table), F.replace(low, F.lit(" "), F.lit("_")))
    )


def map_label_commercial(label: Column) -> Column:
    return _grouped(label, lx.COMMERCIAL_LABEL_WORDS)


def map_label_company(label: Column) -> Column:
    return _grouped(label, lx.COMPANY_LABEL_WORDS)


def infer_label(
    label: Column | None = None,
    category: Column | None = None,
    document_type: Column | None = None,
    file_name: Column | None = None,
    text: Column | None = None,
) -> Column:
    """Stated label, else category, else type, else wording of file name, else of text."""
    stated = [
        strip(F.lower(F.nullif(c, F.lit(""))))
        for c in (label, category, document_type)
        if c is not None
    ]
    guessed = []
    if file_name is not None:
        guessed.append(let(F.lower(file_name), lambda n: first_hit(n, lx.FILE_NAME_LABEL_WORDS)))
    if text is not None:
        guessed.append(let(F.lower(text), lambda t: first_hit(t, lx.TEXT_LABEL_WORDS)))
    return F.coalesce(*stated, *guessed, F.lit("document"))


def label_problem(label: Column) -> Column:
    """What is wrong with a label's spelling; null if nothing."""
    return (
        F.when(
            label.contains(" ") & label.contains("_"),
            F.concat(F.lit("Mixed separators: '"), label, F.lit("'")),
        )
        .when(label != F.lower(label), F.concat(F.lit("Not lowercase: '"), label, F.lit("'")))
        .when(
            label.rlike(r"[^a-z0-9_\s]"), F.concat(F.lit("Special characters: '"), label, F.lit("'"))
        )
    )
