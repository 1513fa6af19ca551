"""Business documents, transactions and stored responses derived from orders and customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import amounts, rules, text
from folioscope.functions.lexicon import FRENCH_MONTHS
from folioscope.operators.joins import spread
from folioscope.sources.templates import COMMERCIAL_KINDS, render_documents

AS_OF = "2001-08-02"


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(cents: Column) -> Column:
    return F.concat(
        F.floor(cents / 100).cast("string"),
        F.lit("."),
        F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0"),
    )


def order_fields() -> dict[str, Column]:
    """Template placeholders from columns of ``orders`` joined with ``customer``."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    tax = F.floor(cents * 20 / 120).cast("long")
    thousands = F.floor(cents / 100000)
    symbols = F.array(*[F.lit(s) for s in ("$", "€", "£", "TND")])
    months = F.array(*[F.lit(m) for m in FRENCH_MONTHS])
    return {
        "key": key.cast("string"),
        "date": F.date_format(day, "dd/MM/yyyy"),
        "due_date": F.date_format(F.date_add(day, 30), "dd/MM/yyyy"),
        "iso_date": F.date_format(day, "yyyy-MM-dd"),
        "long_date": F.date_format(day, "d MMMM yyyy"),
        "due_long": F.date_format(F.date_add(day, 30), "d MMMM yyyy"),
        "french_date": F.concat_ws(
            " ", F.day(day).cast("string"), F.get(months, F.month(day) - 1), F.year(day).cast("string")
        ),
        "customer": F.col("c_name"),
        "segment": F.col("c_mktsegment"),
        "address": F.concat((F.col("c_nationkey") + 1).cast("string"), F.lit(" Rue "), F.col("c_mktsegment")),
        "country": F.concat(F.lit("Zone "), F.col("c_nationkey").cast("string")),
        "symbol": F.get(symbols, F.pmod(key, F.lit(4)).cast("int")),
        "amount": money(cents),
        "tax": money(tax),
        "subtotal": money(cents - tax),
        "unit": money(F.floor(cents / 7).cast("long")),
        "quantity": (F.pmod(key, F.lit(48)) + 1).cast("string"),
        "commas": F.concat(
            F.when(thousands > 0, F.concat(thousands.cast("string"), F.lit(","))).otherwise(""),
            F.when(
                thousands > 0, F.lpad(F.pmod(F.floor(cents / 100), F.lit(1000)).cast("string"), 3, "0")
            ).otherwise(F.floor(cents / 100).cast("string")),
            F.lit("."),
            F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0"),
        ),
    }


def orders_with_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders"), "o_orderkey").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )


def business_documents(
    spark: SparkSession, sf_dir: str, kinds: list[str] = COMMERCIAL_KINDS
) -> DataFrame:
    """(doc_id, label, text, doc_date): one rendered document per order."""
    joined = orders_with_customers(spark, sf_dir)
    return render_documents(joined, F.col("o_orderkey"), order_fields(), kinds)


def transactions(docs: DataFrame, document_type: Column | None = None, today: Column | None = None) -> DataFrame:
    """One transaction row per document; type by the decision list unless given."""
    kind = (
        rules.decision_list(text.clean_text_multilingual(F.col("text")))
        if document_type is None
        else document_type
    )
    typed = docs.select("doc_id", "text", kind.alias("document_type"))
    built = amounts.transaction(
        F.col("text"), F.col("document_type"), F.col("doc_id").cast("string"), today if today is not None else as_of()
    )
    # a generated row is built once: filters on its fields do not rebuild it below
    return typed.select(F.inline(F.array(built)))


def labelled_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions of the business documents, their label taken as type."""
    return transactions(business_documents(spark, sf_dir), F.col("label"))


def evidence_scores(docs: DataFrame) -> DataFrame:
    """Documents with a score per rule type standing in for a model: squared rule points
    plus one, as shares. Every value derives from the document's own text.

    ``read`` holds the other answers of the same search of the text.
    """
    shares = docs.select("doc_id", "label", "text", rules.wording(F.col("text"), points=True).alias("read"))
    raw = ", ".join(
        f"'{k}', cast(read.points_{k} * read.points_{k} + 1 as double)" for k in rules.lx.RULE_KEYWORDS
    )
    return shares.select("doc_id", "label", "text", "read", rules.normalized(F.expr(f"map({raw})")).alias("scores"))
