"""Text cleaning and normalising. Rule order is part of each function's meaning."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions import lexicon as lx
from folioscope.functions.patterns import (
    BLANK,
    collapse_blanks,
    has_any,
    java,
    let,
    replace_all,
    strip,
)

MIN_CLEAN_LENGTH = 30
MIN_DOCUMENT_LENGTH = 50
MAX_DOCUMENT_LENGTH = 100_000
EMBEDDING_LENGTH = 3_072
REPORT_LENGTH = 3_000

_UNPRINTABLE = r"[^\x20-\x7E\n\r\t]"
_CAPITAL_RUN = r"(?<![\w])[A-Z]{10,}(?![\w])"
_COORDINATES = r"\d+,\d+,\d+,\d+"
_KEPT_MARKS = r"""[^\w\s.,!?\-:;()\[\]{}"'/@#$%&*+=]"""


def _replace_in_order(col: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, step: replace_all(c, *step), steps, col)


def clean_text_basic(text: Column) -> Column:
    """Printable ASCII only, without capital runs, box coordinates and padding tokens."""
    return collapse_blanks(
        _replace_in_order(
            F.coalesce(text, F.lit("")),
            [
                (_UNPRINTABLE, " "),
                (_CAPITAL_RUN, " "),
                (_COORDINATES, " "),
                (r"\[PAD\]|\[unused\d+\]", " "),
            ],
        )
    )


def clean_training_text(text: Column) -> Column:
    """As :func:`clean_text_basic`, plus model tokens, odd marks and dot or dash runs."""
    return collapse_blanks(
        _replace_in_order(
            F.coalesce(text, F.lit("")),
            [
                (_UNPRINTABLE, " "),
                (_CAPITAL_RUN, " "),
                (r"\s{2,}", " "),
                (_COORDINATES, " "),
                (r"\[PAD\]|\[unused\d+\]|\[CLS\]|\[SEP\]", " "),
                (_KEPT_MARKS, " "),
                (r"\.{3,}", " "),
                (r"-{3,}", " "),
            ],
        )
    )


def clean_punctuation(text: Column) -> Column:
    """Odd marks out, long dot and dash runs cut to three, one blank after punctuation."""
    return collapse_blanks(
        _replace_in_order(
            collapse_blanks(F.coalesce(text, F.lit(""))),
            [
                (_KEPT_MARKS, " "),
                (r"\.{3,}", "..."),
                (r"-{3,}", "---"),
                (r"\s*([.,:;!?])\s*", "$1 "),
            ],
        )
    )


def clean_text_multilingual(text: Column, max_length: int | None = None) -> Column:
    """Lower-cased words only; Arabic runs are set apart from their neighbours.

    Whole texts unless ``max_length`` (``MAX_DOCUMENT_LENGTH`` is the usual cut) is asked for.
    """
    low = F.translate(F.lower(F.coalesce(text, F.lit(""))), "‏‎", "  ")
    apart = [
        (r"([\x{600}-\x{6FF}])([^\x{600}-\x{6FF}\s])", "$1 $2"),
        (r"([^\x{600}-\x{6FF}\s])([\x{600}-\x{6FF}])", "$1 $2"),
    ]
    spaced = let(low, lambda t: F.when(t.rlike(r"[\x{600}-\x{6FF}]"), _replace_in_order(t, apart)).otherwise(t))
    # blanks are no words either, so odd marks and runs of blanks go in one step
    clean = F.trim(replace_all(spaced, r"[^\w\x{600}-\x{6FF}]+", " "))
    return clean if max_length is None else F.substring(clean, 1, max_length)


def is_too_short(clean: Column, min_length: int = MIN_DOCUMENT_LENGTH) -> Column:
    return F.length(clean) < min_length


def clean_for_excerpt(text: Column) -> Column:
    """Words, basic punctuation and currency signs; four or more repeats become two."""
    return strip(
        _replace_in_order(
            F.coalesce(text, F.lit("")),
            [
                (r"\s+", " "),
                (r"[^\w\s.,;:!?\-€$£¥₹()/]", ""),
                (r"(.)\1{3,}", "$1$1"),
            ],
        )
    )


def json_receipt_to_text(text: Column, max_items: int | None = None) -> Column:
    """Readable lines from a receipt stored as a JSON object; null where that fails.

    Text totals get the ``RM`` prefix if they lack it. Scalar fields beyond the known ones
    follow as ``Name: value``. All items are listed unless ``max_items`` is given. Results of 20 characters or less count as failed.
    """
    fields = F.when(
        text.rlike(rf"^[{BLANK}]*\{{"), F.from_json(strip(text), "map<string,variant>")
    )

    def render(doc: Column) -> Column:
        def as_text(value: Column) -> Column:
            return F.try_variant_get(value, "$", "string")

        def truthy(value: Column) -> Column:
            return ~F.coalesce(as_text(value), F.lit("")).isin("", "0", "0.0", "false")

        def line(key: str, title: str) -> Column:
            value = F.try_element_at(doc, F.lit(key))
            return F.when(truthy(value), F.concat(F.lit(f"{title}: "), as_text(value)))

        total = F.try_element_at(doc, F.lit("total"))
        total_text = as_text(total)
        bare_text_total = (F.schema_of_variant(total) == "STRING") & ~total_text.startswith("RM")
        total_line = F.when(
            truthy(total),
            F.concat(F.lit("Total: "), F.when(bare_text_total, F.lit("RM")).otherwise(""), total_text),
        )
        items = F.try_variant_get(F.try_element_at(doc, F.lit("items")), "$", "array<variant>")

        def item_line(item: Column) -> Column:
            part = lambda key: F.try_variant_get(item, f"$.{key}", "string")
            body = F.concat_ws(
                " | ",
                part("name"),
                F.concat(F.lit("Qty: "), part("quantity")),
                F.concat(F.lit("Price: "), part("price")),
            )
            return F.when(body != "", F.concat(F.lit("- "), body))

        item_lines = F.when(
            items.isNotNull(),
            F.concat(
                F.array(F.lit("Items:")),
                F.filter(
                    F.transform(items if max_items is None else F.slice(items, 1, max_items), item_line),
                    lambda x: x.isNotNull(),
                ),
            ),
        ).otherwise(F.array().cast("array<string>"))

        def is_extra(entry: Column) -> Column:
            scalar = ~F.schema_of_variant(entry["value"]).rlike("^(ARRAY|OBJECT|VOID)")
            known = entry["key"].isin("company", "date", "address", "total", "items")
            return ~known & scalar & truthy(entry["value"])

        extra_lines = F.transform(
            F.filter(F.map_entries(doc), is_extra),
            lambda e: F.concat(title_case(e["key"]), F.lit(": "), as_text(e["value"])),
        )
        head = F.array_compact(
            F.array(
                line("company", "Company"), line("date", "Date"), line("address", "Address"),
                total_line,
            )
        )
        return F.array_join(F.concat(head, item_lines, extra_lines), "\n")

    readable = let(fields, lambda doc: F.when(doc.isNotNull(), render(doc)))
    return let(readable, lambda r: F.when(F.length(r) > 20, r))


def title_case(name: Column) -> Column:
    """``purchase_order`` to ``Purchase_Order``: initcap alone only sees blanks."""
    return F.array_join(F.transform(F.split(name, "_"), F.initcap), "_")


def apply_cleaned(text: Column, cleaned: Column) -> Column:
    return F.coalesce(cleaned, text)


def unwrap_json_text(text: Column) -> Column:
    """The ``text`` field if the value is a JSON object holding one, else the value itself."""
    looks_wrapped = strip(text).startswith("{") & strip(text).endswith("}") & text.contains('"text"')
    return F.coalesce(
        F.when(looks_wrapped, F.try_variant_get(F.try_parse_json(text), "$.text", "string")), text
    )


def accent_stripper():
    """Arrow UDF: compatibility-decompose, drop combining marks, lower-case, strip.

    Spark has no Unicode normalisation expression. The worker imports only the standard
    library, so the function can be shipped without this package.
    """

    @F.pandas_udf("string")
    def strip_marks(texts: pd.Series) -> pd.Series:
        import unicodedata

        def one(text):
            if text is None:
                return None
            if not text.isascii():
                text = "".join(
                    c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)
                )
            return text.lower().strip()

        return texts.map(one)

    return strip_marks


def strip_accents(text: Column) -> Column:
    """Lower-cased, stripped text without accents; only texts beyond ASCII are handed to Python."""
    beyond = text.rlike(r"[^\x00-\x7F]")
    return F.when(beyond, accent_stripper()(F.when(beyond, text))).otherwise(strip(F.lower(text)))


def tokenize_filter(text: Column) -> Column:
    """Word tokens without stopwords; the listed keywords always stay."""
    tokens = F.regexp_extract_all(text, F.lit(java(r"\w+", False)), F.lit(0))
    dropped = sorted((set(lx.STOPWORDS) - set(lx.KEPT_KEYWORDS)) | {"_"})
    return F.filter(tokens, lambda t: ~t.isin(*dropped))


def boost_keywords(text: Column) -> Column:
    """Cleaned text with its keywords repeated so that they weigh more.

    Each keyword found is appended twice (keywords in sorted order, later ones also see what
    earlier ones added). Purchase-order wording then appends its words five times and folds
    invoice runs; otherwise invoice wording appends the invoice words five times.
    """

    def repeated(words: list[str]) -> Column:
        return F.lit("".join(f" {w}" * 5 for w in words))

    def boost(clean: Column) -> Column:
        invoice_like = has_any(clean, lx.BOOST_INVOICE_PATTERNS, False)
        keywords = F.array(*[F.lit(k) for k in sorted(lx.KEPT_KEYWORDS)])
        grown = F.aggregate(
            keywords,
            clean,
            lambda acc, k: F.when(
                F.contains(F.concat(F.lit(" "), acc), F.concat(F.lit(" "), k, F.lit(" "))),
                F.concat(acc, F.lit(" "), k, F.lit(" "), k),
            ).otherwise(acc),
        )

        def finish(body: Column) -> Column:
            order_like = has_any(body, lx.BOOST_ORDER_PATTERNS, False)
            folded = F.regexp_replace(
                F.regexp_replace(
                    F.concat(body, repeated(lx.BOOST_ORDER_WORDS)), "(invoice ){3,}", "invoice "
                ),
                "(facture ){3,}",
                "facture ",
            )
            both = F.replace(
                F.replace(folded, F.lit("invoice invoice invoice"), F.lit("invoice")),
                F.lit("facture facture facture"),
                F.lit("facture"),
            )
            return (
                F.when(order_like & invoice_like, both)
                .when(order_like, folded)
                .when(invoice_like, F.concat(body, repeated(lx.BOOST_INVOICE_WORDS)))
                .otherwise(body)
            )

        return let(grown, finish)

    return let(clean_text_multilingual(text), boost)


def truncate_for_embedding(text: Column, max_length: int | None = EMBEDDING_LENGTH) -> Column:
    stripped = strip(F.coalesce(text, F.lit("")))
    return stripped if max_length is None else F.substring(stripped, 1, max_length)


def truncate_at_word(text: Column, max_length: int) -> Column:
    """Cut at the last blank if that keeps over 80% of the limit, else hard; add ``...``."""
    cut = F.substring(text, 1, max_length)
    blank_from_end = F.locate(" ", F.reverse(cut))
    last_blank = F.when(blank_from_end > 0, max_length - blank_from_end).otherwise(-1)
    shortened = let(
        last_blank,
        lambda at: F.when(
            at > max_length * 0.8, F.concat(F.substr(text, F.lit(1), at), F.lit("..."))
        ).otherwise(F.concat(F.substring(text, 1, max_length - 3), F.lit("..."))),
    )
    return F.when(F.length(text) <= max_length, text).otherwise(shortened)


def has_report_text(text: Column) -> Column:
    return F.length(strip(text)) > 10


def prepare_report_text(text: Column, max_length: int = REPORT_LENGTH) -> Column:
    return F.substring(text, 1, max_length)
