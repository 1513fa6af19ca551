"""Stored model responses and broken report JSON turned into typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions import lexicon as lx
from folioscope.functions.patterns import let


RESPONSE_FIELDS = {
    "document_type": "string", "amount": "double", "currency": "string", "date": "string",
    "description": "string", "category": "string", "subcategory": "string", "confidence": "double",
}


def outer_object(response: Column) -> Column:
    """From the first opening to the last closing brace."""
    return F.nullif(F.regexp_extract(response, r"(?s)(\{.*\})", 1), F.lit(""))


def repair_json(text: Column) -> Column:
    """Thousands commas, missing blanks, trailing commas and single quotes put right.

    The commas of a number go in one pass: a match begins at a value or where the last one ended.
    """
    steps = [
        (r"(?:(:\s*\d{1,3})|\G(?!^)),(\d{3})(?!\d)", "$1$2"),
        (r'(\d+),"([a-zA-Z_])', '$1, "$2'),
        (r",\s*([}\]])", "$1"),
    ]
    for pattern, replacement in steps:
        text = F.regexp_replace(text, pattern, replacement)
    return F.replace(text, F.lit("'"), F.lit('"'))


def repair_json_response(response: Column, as_of: Column) -> Column:
    """Typed struct from a response: parsed as is, repaired, commas dropped, else by regex."""

    def parsed(body: Column) -> Column:
        return F.coalesce(
            F.try_parse_json(body),
            F.try_parse_json(repair_json(body)),
            F.try_parse_json(F.regexp_replace(body, r"(\d+),(\d+)", "$1$2")),
        )

    def stated(name: str, kind: str) -> Column:
        """What a field is in a response that cannot be parsed."""
        if name == "date":
            return F.date_format(as_of, "yyyy-MM-dd")
        default = F.lit(lx.RESPONSE_DEFAULTS[name])
        if name not in lx.RESPONSE_PATTERNS:
            return default
        found = F.nullif(F.regexp_extract(response, lx.RESPONSE_PATTERNS[name], 1), F.lit(""))
        return F.coalesce(found.try_cast(kind), default)

    def typed(doc: Column) -> Column:
        def field(name: str, kind: str) -> Column:
            read = F.try_variant_get(doc, f"$.{name}", kind)
            return F.when(doc.isNotNull(), read).otherwise(stated(name, kind)).alias(name)

        return F.struct(*[field(name, kind) for name, kind in RESPONSE_FIELDS.items()], doc.isNotNull().alias("parsed"))

    return let(let(outer_object(response), parsed), typed)


def _number(text: Column, name: str, shape: str) -> Column:
    found = F.regexp_extract(text, rf'"{name}":\s*({shape})', 1)
    return F.replace(found, F.lit(","), F.lit("")).try_cast("double")


def regex_report_fields(response: Column, notes: int = lx.REPORT_NOTES_KEPT) -> dict[str, Column]:
    """Amounts, ratios, the first ``notes`` notes of each kind and transactions from report JSON that cannot be parsed."""
    fields = {n: F.coalesce(_number(response, n, lx.REPORT_AMOUNT_SHAPE), F.lit(0.0)) for n in lx.REPORT_AMOUNTS}
    fields |= {n: _number(response, n, lx.REPORT_RATIO_SHAPE) for n in lx.REPORT_RATIOS}
    for name in lx.REPORT_NOTES:
        block = F.regexp_extract(response, rf'(?s)"{name}":\s*\[(.*?)\]', 1)
        fields[name] = F.slice(F.regexp_extract_all(block, F.lit('"([^"]+)"'), F.lit(1)), 1, notes)
    shape = lx.REPORT_TRANSACTION_SHAPE
    fields["details_transactions"] = F.transform(
        F.arrays_zip(
            F.regexp_extract_all(response, F.lit(shape), F.lit(1)).alias("montant"),
            F.regexp_extract_all(response, F.lit(shape), F.lit(2)).alias("libelle"),
        ),
        lambda t, i: F.struct(
            F.concat(F.lit("doc"), i + 1).alias("document_id"),
            F.lit("transaction").alias("type"),
            F.replace(t["montant"], F.lit(","), F.lit("")).cast("double").alias("montant"),
            F.lit(lx.REPORT_TRANSACTION_ACCOUNT).alias("compte_comptable"),
            t["libelle"].alias("libelle"),
        ),
    )
    return fields


def stated_turnover(response: Column) -> Column:
    """Turnover named in broken report JSON, 0 without one."""
    return F.coalesce(_number(response, "chiffre_affaires", lx.REPORT_AMOUNT_SHAPE), F.lit(0.0))
