"""Every registered query: (session, table folder) to DataFrame, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import amounts, dates, fields, labels, responses, rules, text
from folioscope.functions import lexicon as lx
from folioscope.plans.business_docs import (
    as_of,
    business_documents,
    evidence_scores,
    labelled_transactions,
    money,
    order_fields,
    orders_with_customers,
    table,
    transactions,
)
from folioscope.operators import corpus, detect, finance, quality, similarity, training
from folioscope.operators.joins import spread
from folioscope.session import kept, scratch_dir
from folioscope.sources import files
from folioscope.sources.templates import GENERAL_KINDS
from folioscope.streaming import ingest, totals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def joined(array: Column) -> Column:
    return F.array_join(array, "|")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = [f.name for f in df.schema if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.round(c, digits) for c in doubles})


# --- text -----------------------------------------------------------------------------------


@query
def clean_text_basic(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.clean_text_basic(F.col("text")).alias("text"))


@query
def clean_training_text(spark, sf_dir):
    return corpus.clean_training_corpus(documents(spark, sf_dir).select("doc_id", "text"))


@query
def clean_punctuation(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.clean_punctuation(F.col("text")).alias("text"))


@query
def clean_text_multilingual(spark, sf_dir):
    both = documents(spark, sf_dir).select("doc_id", "text").unionByName(
        business_documents(spark, sf_dir).select(F.col("doc_id") + 1_000_000_000, "text").toDF("doc_id", "text")
    )
    cleaned = both.select("doc_id", text.clean_text_multilingual(F.col("text")).alias("text"))
    return cleaned.withColumn("too_short", text.is_too_short(F.col("text")))


@query
def clean_for_excerpt(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.clean_for_excerpt(F.col("text")).alias("text"))


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label, text): two receipts in three are JSON objects, the rest plain text."""
    f = order_fields()
    key = F.col("o_orderkey")
    item = lambda i: F.concat(
        F.lit('{"name":"Item '), i.cast("string"), F.lit('","quantity":'), i.cast("string"),
        F.lit(',"price":"'), f["unit"], F.lit('"}'),
    )
    items = F.array_join(F.transform(F.sequence(F.lit(1), F.pmod(key, F.lit(13)) + 1), item), ",")
    as_json = F.concat(
        F.lit('{"company":"'), f["customer"], F.lit('","date":"'), f["date"], F.lit('","total":'),
        F.when(F.pmod(key, F.lit(2)) == 0, F.concat(F.lit('"'), f["amount"], F.lit('"'))).otherwise(f["quantity"]),
        F.lit(',"items":['), items, F.lit('],"cashier_name":"'), f["segment"], F.lit('","till":'),
        f["quantity"], F.lit(',"note":"","nested":{"a":1}}'),
    )
    plain = F.concat(F.lit("Receipt "), f["key"], F.lit(" Total "), f["amount"])
    broken = F.concat(F.lit('{"company": '), f["customer"])
    kind = F.pmod(key, F.lit(7))
    body = F.when(kind == 0, plain).when(kind == 1, broken).otherwise(as_json)
    return orders_with_customers(spark, sf_dir).select(
        key.alias("doc_id"), F.col("c_mktsegment").alias("label"), body.alias("text")
    )


@query
def json_receipt_to_text(spark, sf_dir):
    return receipts(spark, sf_dir).select("doc_id", text.json_receipt_to_text(F.col("text")).alias("text"))


@query
def apply_cleaned(spark, sf_dir):
    return receipts(spark, sf_dir).select(
        "doc_id", "label", text.apply_cleaned(F.col("text"), text.json_receipt_to_text(F.col("text"))).alias("text")
    )


@query
def unwrap_json_text(spark, sf_dir):
    kind = F.pmod("doc_id", F.lit(3))
    wrapped = F.when(kind == 0, F.to_json(F.struct("doc_id", "text"))).when(kind == 1, F.concat(F.lit('{"text" '), F.col("text")))
    return documents(spark, sf_dir).select(
        "doc_id", text.unwrap_json_text(wrapped.otherwise(F.col("text"))).alias("text")
    )


@query
def strip_accents(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.strip_accents(F.col("text")).alias("text"))


@query
def tokenize_filter(spark, sf_dir):
    clean = text.clean_text_multilingual(F.col("text"))
    return documents(spark, sf_dir).select(
        "doc_id", F.array_join(text.tokenize_filter(clean), " ").alias("tokens")
    )


@query
def boost_keywords(spark, sf_dir):
    return business_documents(spark, sf_dir).select("doc_id", text.boost_keywords(F.col("text")).alias("text"))


@query
def truncate_for_embedding(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.truncate_for_embedding(F.col("text")).alias("text"))


@query
def truncate_at_word(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.truncate_at_word(F.col("text"), 200).alias("text"))


@query
def prepare_report_text(spark, sf_dir):
    kept = documents(spark, sf_dir).filter(text.has_report_text(F.col("text")))
    return kept.select("doc_id", text.prepare_report_text(F.col("text")).alias("text"))


# --- labels ---------------------------------------------------------------------------------


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, raw): label-like strings put together from columns of part and orders."""
    kinds = F.array(*[F.lit(x) for x in (
        "Invoice ", "billing record", "Payment slip", "service agreement", "Purchase Order", "delivery_note",
        "bank statement", "Expense Report", "salary sheet", "Legal letter", "email form", "quotation", "",
    )])
    part = table(spark, sf_dir, "part")
    raw = F.concat_ws(" ", F.get(kinds, F.pmod("p_partkey", F.lit(13)).cast("int")), F.when(F.col("p_size") > 25, F.col("p_type")))
    return part.select(F.col("p_partkey").alias("id"), raw.alias("raw"))


@query
def map_label_standard(spark, sf_dir):
    return raw_labels(spark, sf_dir).select("id", "raw", labels.map_label_standard(F.col("raw")).alias("label"))


@query
def map_label_commercial(spark, sf_dir):
    return raw_labels(spark, sf_dir).select("id", labels.map_label_commercial(F.col("raw")).alias("label"))


@query
def map_label_company(spark, sf_dir):
    return raw_labels(spark, sf_dir).select("id", labels.map_label_company(F.col("raw")).alias("label"))


@query
def infer_label(spark, sf_dir):
    docs = business_documents(spark, sf_dir)
    kind = F.pmod("doc_id", F.lit(5))
    inferred = labels.infer_label(
        label=F.when(kind == 0, F.upper("label")),
        category=F.when(kind == 1, F.concat(F.lit(" "), F.col("label"))),
        file_name=F.when(kind == 2, F.concat(F.col("label"), F.lit("_17.PDF"))),
        text=F.col("text"),
    )
    return docs.select("doc_id", inferred.alias("label"))


@query
def merge_and_drop_small(spark, sf_dir):
    docs = raw_labels(spark, sf_dir).select(
        "id", F.when(F.col("raw") == "quotation", "purchase_orders").otherwise(F.col("raw")).alias("label")
    )
    return corpus.merge_and_drop_small(docs, min_rows=60)


@query
def lint_labels(spark, sf_dir):
    return quality.lint_labels(raw_labels(spark, sf_dir).select(F.col("raw").alias("label")))



# --- rules ----------------------------------------------------------------------------------


@query
def rule_score(spark, sf_dir):
    plain = business_documents(spark, sf_dir).select(
        "doc_id", rules.rule_points(text.strip_accents(F.col("text"))).alias("points")
    )
    return plain.select(
        "doc_id",
        *[F.col(f"points.{k}").alias(f"points_{k}") for k in lx.RULE_KEYWORDS],
        rules.best_rule(F.col("points")).alias("rule"),
    )


@query
def decision_list(spark, sf_dir):
    clean = text.clean_text_multilingual(F.col("text"))
    return business_documents(spark, sf_dir).select(
        "doc_id", "label", rules.decision_list(clean).alias("document_type")
    )


@query
def keyword_vote(spark, sf_dir):
    vote = rules.keyword_vote(F.col("text"))
    return business_documents(spark, sf_dir).select("doc_id", vote.alias("v")).select(
        "doc_id",
        "v.prediction",
        F.round("v.confidence", 6).alias("confidence"),
        *[F.round(F.col("v.confidence_scores")[c], 6).alias(f"score_{c}") for c in ("invoice", "purchase_order", "unknown")],
    )


def score_columns(scores: str = "scores") -> list[Column]:
    return [
        F.round(F.try_element_at(scores, F.lit(c)), 6).alias(f"score_{c}") for c in lx.COMMERCIAL_TYPES
    ]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence_scores(business_documents(spark, sf_dir))


@query
def adjust_scores(spark, sf_dir):
    adjusted = rules.adjust_scores(F.col("scores"), F.col("read"))
    return scored(spark, sf_dir).select("doc_id", adjusted.alias("scores")).select("doc_id", *score_columns())


@query
def threshold_and_restrict(spark, sf_dir):
    picked = rules.threshold_and_restrict(F.col("scores"))
    return scored(spark, sf_dir).select("doc_id", picked.alias("p")).select(
        "doc_id", "p.prediction", F.col("p.confidence_scores").alias("scores")
    ).select("doc_id", "prediction", *score_columns())


@query
def definitive_override(spark, sf_dir):
    top = rules.top_entry(F.col("scores"))["key"]
    return scored(spark, sf_dir).select(
        "doc_id", rules.definitive_override(F.col("text"), top, F.col("scores"), F.col("read")).alias("prediction")
    )


@query
def ambiguity_flag(spark, sf_dir):
    top = rules.top_entry(F.col("scores"))["key"]
    out = rules.ambiguity_flag(top, F.col("scores"), F.col("read"))
    return scored(spark, sf_dir).select("doc_id", out.alias("o")).select(
        "doc_id", "o.prediction", F.col("o.confidence_scores").alias("scores")
    ).select("doc_id", "prediction", *score_columns())


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label, text, prediction, confidence, confidence_scores) of the score steps."""
    return scored(spark, sf_dir).select(
        "doc_id", "label", "text", rules.predict(F.col("text"), F.col("scores"), read=F.col("read")).alias("p")
    ).select("doc_id", "label", "text", "p.*")


@query
def predict(spark, sf_dir):
    return predicted(spark, sf_dir).select(
        "doc_id", "prediction", F.round("confidence", 6).alias("confidence"), *score_columns("confidence_scores")
    )


@query
def hybrid_decision(spark, sf_dir):
    rule = rules.rule_score(text.strip_accents(F.col("text")))
    decided = rules.hybrid_decision(F.col("prediction"), F.col("confidence"), rule)
    return predicted(spark, sf_dir).select("doc_id", decided.alias("d")).select("doc_id", "d.*")


@query
def final_prediction(spark, sf_dir):
    listed = rules.decision_list(text.clean_text_multilingual(F.col("text")))
    rows = predicted(spark, sf_dir).withColumn("rule", listed)
    return rows.select(
        "doc_id",
        "rule",
        rules.final_prediction(
            F.col("rule"), F.col("prediction"), F.col("confidence"), F.col("confidence_scores")
        ).alias("final_prediction"),
    )


@query
def confidence_flag(spark, sf_dir):
    return predicted(spark, sf_dir).select(
        "doc_id",
        rules.confidence_flag(F.col("confidence")).alias("flag"),
        rules.confidence_flag_two_level(F.col("confidence")).alias("older_flag"),
    )


@query
def commercial_decision(spark, sf_dir):
    listed = rules.decision_list(text.clean_text_multilingual(F.col("text")))
    prediction, confidence = F.col("prediction"), F.col("confidence")
    rows = predicted(spark, sf_dir).withColumn("rule", listed)
    hybrid = rules.hybrid_decision(prediction, confidence, rules.rule_score(text.strip_accents(F.col("text"))))
    return rows.withColumn("hybrid", hybrid).select(
        "doc_id",
        rules.commercial_decision(F.col("rule"), prediction, confidence, F.col("hybrid")).alias("a"),
        rules.commercial_decision(F.col("rule"), prediction, confidence, None).alias("b"),
    ).select(
        "doc_id",
        F.col("a.document_type").alias("hybrid_type"),
        F.round("a.confidence", 6).alias("hybrid_confidence"),
        F.col("b.document_type").alias("model_type"),
        F.round("b.confidence", 6).alias("model_confidence"),
    )


# --- fields ---------------------------------------------------------------------------------


def spelled_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, raw): order dates in ten spellings, some of them unreadable."""
    day = F.col("o_orderdate").cast("date")
    f = order_fields()
    fmt = lambda p: F.date_format(day, p)
    spellings = F.array(
        f["date"], f["long_date"], fmt("MMMM d, yyyy"), f["iso_date"], f["french_date"],
        fmt("d.M.yy"), fmt("yyyy/MM/dd"), fmt("M/d/yyyy"), fmt("dd-MM-yyyy"), F.concat(F.lit("on "), f["date"]),
    )
    return orders_with_customers(spark, sf_dir).select(
        F.col("o_orderkey").alias("id"),
        F.get(spellings, F.pmod("o_orderkey", F.lit(10)).cast("int")).alias("raw"),
    )


@query
def normalize_date(spark, sf_dir):
    return spelled_dates(spark, sf_dir).select(
        "id",
        dates.normalize_date(F.col("raw")).alias("iso"),
        dates.normalize_date(F.col("raw"), True).alias("iso_full_months"),
    )


@query
def parse_date_formats(spark, sf_dir):
    parsed = dates.parse_date_formats(F.col("raw"), as_of())
    return spelled_dates(spark, sf_dir).select("id", F.date_format(parsed, "yyyy-MM-dd").alias("day"))


@query
def extract_client(spark, sf_dir):
    name, address = fields.extract_client(F.col("text"))
    return business_documents(spark, sf_dir).select(
        "doc_id", name.alias("client_name"), address.alias("client_address")
    )


@query
def response_projection(spark, sf_dir):
    name, address = fields.extract_client(F.col("text"))
    found = {"date": dates.extract_dates(F.col("text"))[0], "client_name": name, "client_address": address}
    return detect.response_projection(business_documents(spark, sf_dir), found).drop("text")


@query
def extract_dates(spark, sf_dir):
    date, due = dates.extract_dates(F.col("text"))
    return business_documents(spark, sf_dir).select("doc_id", date.alias("date"), due.alias("due_date"))


@query
def extract_fields_by_type(spark, sf_dir):
    found = fields.extract_fields_by_type(F.col("text"), F.col("label"))
    return business_documents(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in found.items()])


@query
def analyze_invoice(spark, sf_dir):
    cleaned = business_documents(spark, sf_dir).select(
        "doc_id", text.clean_text_multilingual(F.col("text")).alias("clean")
    )
    return cleaned.select("doc_id", *[c.alias(n) for n, c in fields.analyze_invoice(F.col("clean")).items()])


@query
def extract_key_info(spark, sf_dir):
    found = fields.extract_key_info(F.col("text"))
    return business_documents(spark, sf_dir).select("doc_id", *[joined(c).alias(n) for n, c in found.items()])


@query
def sentence_scores(spark, sf_dir):
    clean = documents(spark, sf_dir).select("doc_id", text.clean_for_excerpt(F.col("text")).alias("clean"))
    split = clean.select("doc_id", F.posexplode(fields.sentences(F.col("clean"))).alias("sentence_no", "sentence"))
    return split.select("doc_id", "sentence_no", "sentence", fields.sentence_score(F.col("sentence")).alias("score"))


@query
def smart_excerpt(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", fields.smart_excerpt(F.col("text")).alias("excerpt"))


@query
def extract_amount(spark, sf_dir):
    amount = amounts.extract_amount(F.col("text"))
    rows = business_documents(spark, sf_dir).select("doc_id", "text", amount.alias("found"))
    return rows.select(
        "doc_id",
        F.coalesce("found", F.lit(0.0)).alias("amount"),
        amounts.amount_currency(F.col("found"), F.col("text")).alias("currency"),
    )


@query
def identify_currency(spark, sf_dir):
    both = documents(spark, sf_dir).select("doc_id", "text").unionByName(
        business_documents(spark, sf_dir).select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), "text")
    )
    return both.select("doc_id", amounts.identify_currency(F.col("text")).alias("currency"))


@query
def extract_date(spark, sf_dir):
    day = dates.extract_date(F.col("text"), as_of())
    return business_documents(spark, sf_dir).select("doc_id", F.date_format(day, "yyyy-MM-dd").alias("day"))


@query
def categorize(spark, sf_dir):
    category, subcategory = amounts.categorize(F.col("label"))
    return business_documents(spark, sf_dir).select(
        "doc_id", category.alias("category"), subcategory.alias("subcategory")
    )


@query
def describe(spark, sf_dir):
    return business_documents(spark, sf_dir).select(
        "doc_id", amounts.describe(F.col("text"), F.col("label")).alias("description")
    )


@query
def extraction_confidence(spark, sf_dir):
    return labelled_transactions(spark, sf_dir).select(
        F.col("document_id").cast("bigint").alias("doc_id"), F.round("confidence", 4).alias("confidence")
    )


def plain_dates(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query
def to_transactions(spark, sf_dir):
    rows = transactions(business_documents(spark, sf_dir))
    return plain_dates(rows).withColumn("confidence", F.round("confidence", 4))


@query
def largest_amount(spark, sf_dir):
    f = order_fields()
    rows = orders_with_customers(spark, sf_dir).select(
        F.col("o_orderkey").alias("doc_id"),
        F.concat(F.lit("amount "), f["amount"], F.lit(" "), F.get(F.array(*[F.lit(c) for c in ("EUR", "usd", "TND", "dollars")]), F.pmod("o_orderkey", F.lit(4)).cast("int"))).alias("info"),
        F.concat(F.col("c_name"), F.when(F.pmod("o_orderkey", F.lit(3)) == 0, " , ").otherwise(" "), f["commas"]).alias("text"),
    )
    info = F.col("info")
    return rows.select(
        "doc_id",
        F.round(amounts.largest_amount(F.col("text"), info), 4).alias("amount"),
        F.round(amounts.largest_amount(F.col("text"), info, False), 4).alias("amount_commas_skipped"),
    )


def stored_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, response): order facts as model answers, well formed and broken in six ways."""
    f = order_fields()
    key = F.col("o_orderkey")

    def body(amount: Column, end: str = "}") -> Column:
        return F.concat(
            F.lit('{"document_type": "invoice", "amount": '), amount, F.lit(', "currency": "EUR", "date": "'),
            f["iso_date"], F.lit('", "description": "order '), f["key"],
            F.lit('", "category": "income", "subcategory": "sales_revenue", "confidence": 0.9' + end),
        )

    form = F.pmod(key, F.lit(7))
    thousandfold = F.format_number((F.round(F.col("o_totalprice") * 100) * 10).cast("decimal(20,2)"), 2)
    response = (
        F.when(form == 0, body(f["amount"]))
        .when(form == 1, F.concat(F.lit("Here it is:\n```json\n"), body(f["amount"]), F.lit("\n```")))
        .when(form == 2, body(f["commas"]))
        .when(form == 3, body(f["amount"], ",}"))
        .when(form == 4, F.replace(body(f["amount"]), F.lit('"'), F.lit("'")))
        .when(form == 6, body(thousandfold))
        .otherwise(body(f["amount"], ""))
    )
    return orders_with_customers(spark, sf_dir).select(key.alias("id"), response.alias("response"))


@query
def repair_json_response(spark, sf_dir):
    typed = responses.repair_json_response(F.col("response"), as_of())
    return stored_responses(spark, sf_dir).select("id", typed.alias("t")).select("id", "t.*")


def broken_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, response): report JSON cut off before its end."""
    f = order_fields()
    whole = F.split_part(f["amount"], F.lit("."), F.lit(1))
    return orders_with_customers(spark, sf_dir).select(
        F.col("o_orderkey").alias("id"),
        F.concat(
            F.lit('{"bilan_comptable": {"actif": {"total_actif": '), whole, F.lit('}, "passif": {"total_passif": '), whole,
            F.lit('}}, "compte_de_resultat": {"chiffre_affaires": '), f["commas"], F.lit(', "resultat_net": '), f["tax"],
            F.lit('}, "ratios_financiers": {"marge_nette_percent": '), f["quantity"], F.lit('.5, "liquidite_generale": 2},'),
            F.lit(' "points_forts": ["a '), f["key"], F.lit('", "b", "c", "d"], "points_faibles": [], "recommandations": ["x"],'),
            F.lit(' "details_transactions": [{"montant": '), f["subtotal"], F.lit(', "libelle": "'), f["customer"],
            F.lit('"}, {"montant": '), f["quantity"], F.lit(', "libelle": "second"}'),
        ).alias("response"),
    )


@query
def regex_report_fields(spark, sf_dir):
    found = responses.regex_report_fields(F.col("response"))
    rows = broken_reports(spark, sf_dir).select("id", *[c.alias(n) for n, c in found.items()])
    notes = {n: joined(F.col(n)) for n in lx.REPORT_NOTES}
    details = F.transform(
        "details_transactions", lambda t: F.concat_ws("/", t["document_id"], t["libelle"], F.round(t["montant"] * 100).cast("bigint"))
    )
    return rows.withColumns(notes).withColumn("details_transactions", joined(details))



# --- finance --------------------------------------------------------------------------------


@query
def period_filter(spark, sf_dir):
    recent = finance.period_filter(labelled_transactions(spark, sf_dir), as_of(), 365)
    return plain_dates(recent).select("document_id", "date", "amount", "currency")


@query
def category_totals(spark, sf_dir):
    return finance.category_totals(labelled_transactions(spark, sf_dir))


@query
def currency_breakdown(spark, sf_dir):
    return finance.currency_breakdown(labelled_transactions(spark, sf_dir))


@query
def type_summary(spark, sf_dir):
    return finance.type_summary(labelled_transactions(spark, sf_dir))


@query
def report_advice(spark, sf_dir):
    return finance.report_advice(labelled_transactions(spark, sf_dir)).select(
        joined(F.col("recommendations")).alias("recommendations")
    )


@query
def transaction_details(spark, sf_dir):
    return finance.transaction_details(labelled_transactions(spark, sf_dir))


def financial_report_by_rules(spark, sf_dir):
    docs = business_documents(spark, sf_dir)
    return finance.financial_report(transactions(docs), as_of(), 365)


@query
def financial_report(spark, sf_dir):
    def cents(c: Column) -> Column:
        return F.round(c * 100).cast("bigint").cast("string")

    by_currency = F.transform(
        F.map_entries("currency_breakdown"),
        lambda e: F.concat_ws("/", e["key"], *[cents(e["value"][k]) for k in ("income", "expense", "potential", "net")]),
    )
    by_type = F.transform(
        F.map_entries("document_analysis"),
        lambda e: F.concat_ws("/", e["key"], e["value"]["count"].cast("string"), cents(e["value"]["total_amount"])),
    )
    return financial_report_by_rules(spark, sf_dir).select(
        "summary.*",
        "transaction_count",
        joined(F.col("recommendations")).alias("recommendations"),
        joined(by_currency).alias("by_currency"),
        joined(by_type).alias("by_type"),
        F.date_format("period.start_date", "yyyy-MM-dd").alias("start_date"),
    )


@query
def keep_valid(spark, sf_dir):
    return finance.keep_valid(labelled_transactions(spark, sf_dir)).select("document_id", "amount")


@query
def simple_report(spark, sf_dir):
    return finance.simple_report(finance.keep_valid(labelled_transactions(spark, sf_dir)))


@query
def simple_advice(spark, sf_dir):
    return finance.simple_advice(labelled_transactions(spark, sf_dir)).select(
        joined(F.col("recommendations")).alias("recommendations")
    )


@query
def convert_to_tnd(spark, sf_dir):
    converted = finance.convert_to_tnd(labelled_transactions(spark, sf_dir))
    return converted.select("document_id", "currency", F.round("amount_tnd", 4).alias("amount_tnd"))


def nested_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, document_type, amounts): one document per order line."""
    price, key = F.col("l_extendedprice"), F.col("l_orderkey")

    def entry(amount: Column, kind: str, description: str) -> Column:
        return F.struct(
            amount.alias("amount"), F.lit("USD").alias("currency"), F.lit(kind).alias("type"),
            F.lit(description).alias("description"),
        )

    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", key.cast("string"), F.col("l_linenumber").cast("string")).alias("document_id"),
        F.when(F.col("l_returnflag") == "R", "receipt").otherwise("invoice").alias("document_type"),
        F.array(
            entry(price, "revenue", "line price"),
            entry(price * F.col("l_discount"), "expense", "discount"),
            entry(price * F.col("l_tax"), "tax", "tax"),
        ).alias("amounts"),
    )


@query
def flat_amounts(spark, sf_dir):
    flat = finance.flat_amounts(nested_amounts(spark, sf_dir))
    return flat.groupBy("type", "kind", "description").agg(
        F.count(F.lit(1)).alias("n"), F.round(finance.exact_sum(F.col("amount")), 2).alias("amount")
    )


@query
def revenue_expense_totals(spark, sf_dir):
    return finance.revenue_expense_totals(nested_amounts(spark, sf_dir))


def customer_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(customer, revenue, sheet): balance sheet estimated from each customer's orders."""
    revenue = (
        orders_with_customers(spark, sf_dir)
        .groupBy(F.col("c_custkey").alias("customer"))
        .agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")) / 100).alias("revenue"))
    )
    return revenue.withColumn("sheet", finance.estimated_balance_sheet(F.col("revenue")))


def sheet_columns() -> list[Column]:
    balance, income = "sheet.bilan_comptable", "sheet.compte_de_resultat"
    return [
        F.col(f"{balance}.actif.actif_courant.clients_et_comptes_rattaches").alias("receivables"),
        F.col(f"{balance}.actif.actif_courant.disponibilites").alias("cash"),
        F.col(f"{balance}.actif.total_actif").alias("assets"),
        F.col(f"{balance}.passif.capitaux_propres.capital_social").alias("capital"),
        F.col(f"{balance}.passif.capitaux_propres.total_capitaux_propres").alias("equity"),
        F.col(f"{balance}.passif.passif_courant.fournisseurs_et_comptes_rattaches").alias("suppliers"),
        F.col(f"{balance}.passif.passif_courant.total_passif_courant").alias("current_debt"),
        F.col(f"{balance}.passif.total_passif").alias("liabilities"),
        F.col(f"{income}.produits_exploitation.chiffre_affaires").alias("turnover"),
        F.col(f"{income}.charges_exploitation.achats_consommes").alias("purchases"),
        F.col(f"{income}.charges_exploitation.total_charges_exploitation").alias("charges"),
        F.col(f"{income}.resultat_net").alias("result"),
        *[F.col(f"sheet.ratios_financiers.{r}").cast("double").alias(r) for r in lx.REPORT_RATIOS],
    ]


@query
def estimated_balance_sheet(spark, sf_dir):
    return customer_sheets(spark, sf_dir).select("customer", *sheet_columns())


def turnover_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_reports(spark, sf_dir).select(
        "id", finance.estimated_from_turnover(F.col("response")).alias("sheet")
    )


@query
def estimated_from_turnover(spark, sf_dir):
    return turnover_sheets(spark, sf_dir).select("id", *sheet_columns())


@query
def check_balance(spark, sf_dir):
    both = customer_sheets(spark, sf_dir).select(F.col("customer").alias("id"), "sheet", F.lit("customer").alias("kind"))
    checked = finance.check_balance(both).select("kind", "id", "balanced", "empty")
    stated = turnover_sheets(spark, sf_dir).select("id", "sheet", F.lit("turnover").alias("kind"))
    return checked.unionByName(finance.check_balance(stated).select("kind", "id", "balanced", "empty"))


@query
def post_accounts(spark, sf_dir):
    return finance.post_accounts(labelled_transactions(spark, sf_dir))


@query
def documented_totals(spark, sf_dir):
    tax = F.when(F.col("document_type") == "invoice", F.round(F.col("amount") * 0.2, 2))
    found = finance.documented_totals(labelled_transactions(spark, sf_dir), tax)
    lists = ("currencies_found", "document_types_processed")
    return found.withColumns({c: joined(F.col(c)) for c in lists})


# --- quality profile ------------------------------------------------------------------------


def labelled(spark: SparkSession, sf_dir: str, label: str = "lang") -> DataFrame:
    """Documents with one of their columns as label."""
    return documents(spark, sf_dir).select("doc_id", "text", F.col(label).alias("label"), "source")


def with_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")


@query
def null_profile(spark, sf_dir):
    return rounded(quality.null_profile(with_quality(spark, sf_dir)))


@query
def short_text_profile(spark, sf_dir):
    return rounded(quality.short_text_profile(documents(spark, sf_dir)))


@query
def duplicate_count(spark, sf_dir):
    return quality.duplicate_count(documents(spark, sf_dir))


@query
def length_stats(spark, sf_dir):
    return rounded(quality.length_stats(documents(spark, sf_dir)))


@query
def nonprintable_count(spark, sf_dir):
    return quality.nonprintable_count(documents(spark, sf_dir))


@query
def meaningful_ratio(spark, sf_dir):
    return rounded(quality.meaningful_ratio(documents(spark, sf_dir)))


@query
def label_distribution(spark, sf_dir):
    return rounded(quality.label_distribution(labelled(spark, sf_dir)))


@query
def imbalance_ratio(spark, sf_dir):
    return rounded(quality.imbalance_ratio(labelled(spark, sf_dir)))


@query
def small_classes(spark, sf_dir):
    return quality.small_classes(labelled(spark, sf_dir, "source"), below=60)


@query
def source_profile(spark, sf_dir):
    return rounded(quality.source_profile(documents(spark, sf_dir)))


@query
def neighbour_similarity(spark, sf_dir):
    pairs = quality.neighbour_similarity(documents(spark, sf_dir))
    return rounded(pairs)


@query
def near_duplicate_pairs(spark, sf_dir):
    return rounded(quality.near_duplicate_pairs(documents(spark, sf_dir)))


@query
def near_duplicate_all(spark, sf_dir):
    return similarity.near_duplicate_all(table(spark, sf_dir, "documents"))


@query
def ocr_artifact_counts(spark, sf_dir):
    return quality.ocr_artifact_counts(documents(spark, sf_dir))


@query
def quality_grade(spark, sf_dir):
    graded = quality.quality_grade(labelled(spark, sf_dir))
    return rounded(graded.withColumns({c: joined(F.col(c)) for c in ("issues", "advice")}))


@query
def size_estimate(spark, sf_dir):
    return rounded(quality.size_estimate(documents(spark, sf_dir)))


@query
def rank_classes(spark, sf_dir):
    ranked = rounded(quality.rank_classes(labelled(spark, sf_dir, "source")))
    return ranked.withColumn("rank", F.coalesce("rank", F.lit(0)))


@query
def size_bands(spark, sf_dir):
    return quality.size_bands(labelled(spark, sf_dir))


@query
def balance_status(spark, sf_dir):
    return rounded(quality.balance_status(labelled(spark, sf_dir)))


@query
def training_readiness(spark, sf_dir):
    return rounded(quality.training_readiness(labelled(spark, sf_dir)))


@query
def compare_distributions(spark, sf_dir):
    before = labelled(spark, sf_dir, "source")
    after = corpus.first_of_each_text(before, ["doc_id"])
    return quality.compare_distributions(before, after)


@query
def validate_preserved(spark, sf_dir):
    before = receipts(spark, sf_dir)
    cleaned = text.apply_cleaned(F.col("text"), text.json_receipt_to_text(F.col("text")))
    return quality.validate_preserved(before, before.select("doc_id", "label", cleaned.alias("text")))


@query
def validate_ingest(spark, sf_dir):
    return rounded(quality.validate_ingest(labelled(spark, sf_dir)))


@query
def validate_samples(spark, sf_dir):
    return rounded(quality.validate_samples(labelled(spark, sf_dir)))


@query
def validate_cleaned(spark, sf_dir):
    found = quality.validate_cleaned(corpus.clean_training_corpus(labelled(spark, sf_dir)))
    return rounded(found.withColumn("issues", joined(F.col("issues"))))


@query
def top_n_with_others(spark, sf_dir):
    return rounded(quality.top_n_with_others(labelled(spark, sf_dir, "source")))


@query
def length_boxplot(spark, sf_dir):
    return rounded(quality.length_boxplot(labelled(spark, sf_dir, "source")))


@query
def growth_by_source(spark, sf_dir):
    return quality.growth_by_source(documents(spark, sf_dir))


@query
def dataset_summary(spark, sf_dir):
    return rounded(quality.dataset_summary(labelled(spark, sf_dir)))


@query
def cleaned_corpus_profile(spark, sf_dir):
    """Cleaned corpus, label counts and length statistics per language."""
    return rounded(quality.dataset_summary(corpus.clean_training_corpus(labelled(spark, sf_dir))))


# --- corpus ---------------------------------------------------------------------------------


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents by source, as an existing corpus and new arrivals."""
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("pos"), "text", F.col("lang").alias("label"), "source")
    existing = F.col("source") >= "src5"
    return rows.filter(existing), rows.filter(~existing).drop("source")


@query
def integrate_dedup(spark, sf_dir):
    return corpus.integrate_dedup(*halves(spark, sf_dir))


@query
def integration_report(spark, sf_dir):
    return corpus.integration_report(*halves(spark, sf_dir))


@query
def append_no_dedup(spark, sf_dir):
    return corpus.append_no_dedup(*halves(spark, sf_dir)).select("pos", "label", "source")


@query
def cap_per_class(spark, sf_dir):
    capped = corpus.cap_per_class(labelled(spark, sf_dir), n=200)
    return capped.select("doc_id", "label")


@query
def shuffle_rows(spark, sf_dir):
    return corpus.shuffle_rank(documents(spark, sf_dir)).select("doc_id", "shuffle_rank")


@query
def stratified_split(spark, sf_dir):
    return corpus.stratified_split(labelled(spark, sf_dir)).select("doc_id", "label", "split")


@query
def drop_rare_classes(spark, sf_dir):
    kept = corpus.drop_small_classes(labelled(spark, sf_dir), min_rows=130)
    return kept.select("doc_id", "label")


@query
def augment_min_samples(spark, sf_dir):
    rows = business_documents(spark, sf_dir).withColumnRenamed("doc_id", "pos")
    return corpus.augment_min_samples(rows, documents(spark, sf_dir).select("text", F.col("lang").alias("label")))


@query
def weighted_union(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "source")
    return corpus.weighted_union(rows, F.when(F.col("source").isin("src1", "src2"), 2).otherwise(1))


@query
def take_first_n(spark, sf_dir):
    return corpus.take_first_n(documents(spark, sf_dir), 300, "doc_id").select("doc_id", "text")


# --- detection and sources ------------------------------------------------------------------


def detected(df: DataFrame, name: str) -> DataFrame:
    stats = detect.column_stats(df)
    return stats.select(
        F.lit(name).alias("table_name"),
        "column",
        F.round("mean_length", 6).alias("mean_length"),
        F.round("distinct_ratio", 6).alias("distinct_ratio"),
        (F.col("column") == F.lit(detect.detect_text_column(df, stats))).alias("is_text"),
        F.coalesce(F.col("column") == F.lit(detect.detect_label_column(df, stats)), F.lit(False)).alias("is_label"),
    )


@query
def detect_text_column(spark, sf_dir):
    parts = [detected(table(spark, sf_dir, t), t) for t in ("documents", "customer", "part", "orders")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query
def detect_label_column(spark, sf_dir):
    return detected(table(spark, sf_dir, "pages"), "pages").unionByName(
        detected(table(spark, sf_dir, "nation"), "nation")
    ).unionByName(detected(table(spark, sf_dir, "events"), "events"))


@query
def coalesce_text(spark, sf_dir):
    part, docs = table(spark, sf_dir, "part"), documents(spark, sf_dir)
    return part.select(F.col("p_partkey").alias("id"), detect.coalesce_text(part).alias("text")).unionByName(
        docs.select(F.col("doc_id").alias("id"), detect.coalesce_text(docs).alias("text"))
    )


@query
def coalesce_label(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("category", F.when(F.col("p_size") > 10, "").otherwise(F.col("p_type")))
    part = part.withColumn("type", F.when(F.col("p_size") > 20, F.col("p_brand")))
    return part.select("p_partkey", detect.coalesce_label(part).alias("label"))


@query
def profile_schema(spark, sf_dir):
    return detect.profile_schema(documents(spark, sf_dir)).select("position", "column", "type", "n_rows")


@query
def flatten_company_record(spark, sf_dir):
    key = F.col("conv_id") + F.col("turn")
    messages = F.transform(F.split("text", "\n"), lambda line: F.struct(line.alias("content")))
    names = F.array(*[F.lit(n) for n in ("q3.Report.txt", "Invoice_9", "note", "Legal.contract.pdf")])
    records = spread(table(spark, sf_dir, "conversations"), "conv_id").select(
        F.when(F.pmod(key, F.lit(4)) == 0, F.col("text")).alias("file_content"),
        F.struct(F.when(F.pmod(key, F.lit(4)) == 1, F.col("text")).alias("text"), F.lit("").alias("content")).alias("extracted_data"),
        F.when(F.pmod(key, F.lit(4)) >= 2, messages).alias("chat_format"),
        F.get(names, F.pmod(key, F.lit(3)).cast("int")).alias("file_name"),
        F.when(F.pmod(key, F.lit(5)) == 0, F.col("role")).alias("document_type"),
    )
    return detect.flatten_company_record(records)


@query
def prune_sparse_columns(spark, sf_dir):
    rows = with_quality(spark, sf_dir).select(
        "doc_id", "text", F.col("lang").alias("label"), "source", F.col("quality").alias("word_count")
    )
    return detect.prune_sparse_columns(rows, ("doc_id", "label"))


@query
def render_documents(spark, sf_dir):
    return business_documents(spark, sf_dir, GENERAL_KINDS)


@query
def records_to_corpus(spark, sf_dir):
    return files.detected_records(documents(spark, sf_dir).drop("lang", "n_chars", "doc_id"), "CSV")


def digest(df: DataFrame) -> DataFrame:
    """Texts replaced by their MD5 and length, to compare long rows briefly."""
    return df.withColumns({"text_md5": F.md5("text"), "chars": F.length("text")}).drop("text")


@query
def scan_labelled_csv(spark, sf_dir):
    path = scratch_dir(spark, "csv")
    rows = documents(spark, sf_dir).select("text", F.concat(F.col("lang"), F.lit(" ")).alias("label"))
    rows.write.options(header="true", quote='"', escape='"', quoteAll="true").csv(path)
    return digest(files.scan_labelled_csv(spark, path))


def as_arrays(df: DataFrame) -> DataFrame:
    """Lines of one JSON array per partition from a column of JSON objects."""

    def lines(frames):
        import pandas

        separator = "["
        for frame in frames:
            out = []
            for value in frame["value"]:
                out.append(separator + value)
                separator = ","
            yield pandas.DataFrame({"value": out})
        yield pandas.DataFrame({"value": ["[]" if separator == "[" else "]"]})

    return df.mapInPandas(lines, "value string")


@query
def scan_json_records(spark, sf_dir):
    path = scratch_dir(spark, "json")
    records = F.to_json(F.struct(F.col("text").alias("body"), F.col("source").alias("category")))
    as_arrays(documents(spark, sf_dir).select(records.alias("value"))).write.text(path)
    return digest(files.scan_json_records(spark, path, schema="body string, category string"))


@query
def scan_csv_records(spark, sf_dir):
    path = scratch_dir(spark, "loose-csv")
    documents(spark, sf_dir).select("doc_id", F.col("text").alias("content"), F.col("source").alias("origin")).write.options(
        header="true", quote='"', escape='"', quoteAll="true"
    ).csv(path)
    return digest(files.scan_csv_records(spark, path))


#: Text in a file of ``scan_text_files``, and what stands around its documents.
TEXT_FILE_BYTES, TEXT_MARK = 16 << 20, "|"


@query
def scan_text_files(spark, sf_dir):
    """A source's text in files of bounded size, each a run of its documents by doc_id; their counts are put together again."""
    path = scratch_dir(spark, "text")
    rows = documents(spark, sf_dir).select("doc_id", "text", "source").filter("text is not null")
    ends = rows.groupBy(F.col("source").alias("of")).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    # the scan strips every file: marks keep the blanks between documents, only a source's ends have none
    mark = F.lit(TEXT_MARK)
    before, after = (F.when(F.col("doc_id") == F.col(c), F.lit("")).otherwise(mark) for c in ("first", "last"))
    marked = rows.join(ends, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "source", F.concat(before, "text", after).alias("text"), F.length(F.concat(before, after)).alias("marks")
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranged = marked.repartitionByRange(1 + size // TEXT_FILE_BYTES, "source", "doc_id").sortWithinPartitions("source", "doc_id")
    ranged.select("text", "source").write.partitionBy("source").text(path)
    folder = F.regexp_extract(F.input_file_name(), "/source=([^/]*)/", 1)
    found = digest(files.scan_text_files(spark, path).withColumn("folder", folder))
    # a source loses the line break after each file but its last
    per_source = found.groupBy("label", "folder").agg((F.sum("chars") + F.count(F.lit(1)) - 1).alias("chars"))
    marks = marked.agg(F.sum("marks").alias("marks"))
    return per_source.groupBy("label").agg(F.count(F.lit(1)).alias("files"), F.sum("chars").alias("chars")).join(
        F.broadcast(marks)
    ).select("label", "files", (F.col("chars") - F.col("marks")).alias("chars"))


@query
def scan_annotation_json(spark, sf_dir):
    path = scratch_dir(spark, "annotations")
    notes = F.transform(F.split("text", "\n"), lambda line: F.struct(line.alias("text")))
    documents(spark, sf_dir).select("lang", notes.alias("annotations")).write.partitionBy("lang").json(path)
    return digest(files.scan_annotation_json(spark, path, lines=True)).select("label", "text_md5", "chars")


@query
def inventory_sources(spark, sf_dir):
    """A tree with a file of counts per source, the kind of file by language."""
    path = scratch_dir(spark, "tree")
    counts = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).cast("string").alias("n"))
    lang = F.coalesce("lang", F.lit(""))
    for kind, wanted in (("csv", lang == "en"), ("json", lang == "fr"), ("text", ~lang.isin("en", "fr"))):
        counts.filter(wanted).select("n", "source").repartition("source").write.partitionBy("source").format(kind).save(f"{path}/{kind}")
    return files.inventory_sources(spark, path)


@query
def decode_bytes(spark, sf_dir):
    latin = F.encode(F.regexp_replace("text", "[^\\x00-\\xFF]", "?"), "ISO-8859-1")
    content = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.encode("text", "UTF-8")).otherwise(latin)
    return documents(spark, sf_dir).select("doc_id", files.decode_bytes(content).alias("text"))


@query
def versioned_save(spark, sf_dir):
    path = scratch_dir(spark, "versions")
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    files.versioned_save(docs, path)
    files.versioned_save(corpus.first_of_each_text(files.load_version(spark, path), ["doc_id"]), path)
    old, new = (files.load_version(spark, path, v) for v in files.saved_versions(spark, path))
    return old.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("version", F.lit(1)).unionByName(
        new.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("version", F.lit(2))
    )


# --- training and evaluation ----------------------------------------------------------------


@query
def tfidf_features(spark, sf_dir):
    return rounded(training.tfidf_features(documents(spark, sf_dir)))


@query
def tfidf_features_without_stopwords(spark, sf_dir):
    weights = training.tfidf_features(documents(spark, sf_dir), max_features=5_000, min_df=1, max_df=1.0, stopwords=lx.STOPWORDS)
    return rounded(weights)


@query
def class_weights(spark, sf_dir):
    return rounded(training.class_weights(labelled(spark, sf_dir)))


def rule_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = text.clean_text_multilingual(F.col("text"))
    return business_documents(spark, sf_dir).select(
        "label", rules.decision_list(clean).alias("prediction")
    )


@query
def classification_report(spark, sf_dir):
    return rounded(training.classification_report(rule_predictions(spark, sf_dir)))


@query
def confusion_matrix(spark, sf_dir):
    return training.confusion_matrix(rule_predictions(spark, sf_dir), lx.DOCUMENT_CLASSES)


@query
def confusion_matrix_shares(spark, sf_dir):
    return rounded(
        training.confusion_matrix(rule_predictions(spark, sf_dir), lx.COMMERCIAL_TYPES, normalize=True)
    )


def class_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.confidence_by_class(predicted(spark, sf_dir))


@query
def confidence_by_class(spark, sf_dir):
    return rounded(class_confidence(spark, sf_dir))


@query
def confidence_bands(spark, sf_dir):
    return training.confidence_bands(class_confidence(spark, sf_dir))


@query
def performance_ranking(spark, sf_dir):
    return rounded(training.performance_ranking(class_confidence(spark, sf_dir)))


def model_facts(scored: DataFrame) -> DataFrame:
    """What must hold of scores whatever the fit: shares of one, the arg max as prediction, better than the largest class."""
    values = F.map_values("confidence_scores")
    largest = scored.groupBy("label").count().agg((F.max("count") / F.sum("count")).alias("share")).scalar()
    right = scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("share")).scalar()
    return scored.select(
        "doc_id",
        "label",
        (F.abs(F.aggregate(values, F.lit(0.0), lambda a, v: a + v) - 1) < 1e-9).alias("shares_sum_to_one"),
        F.forall(values, lambda v: v.between(0, 1)).alias("shares_in_range"),
        (F.col("confidence") == F.array_max(values)).alias("prediction_is_top"),
        (right > largest).alias("beats_largest_class"),
    )


def trained_and_scored(spark: SparkSession, sf_dir: str, train) -> DataFrame:
    """The scores of the rows held out; they are stored, so what asks for them several times scores no text again."""
    rows = corpus.stratified_split(labelled(spark, sf_dir))
    scored = training.score_batch(train(rows.filter("split = 'train'")), rows.filter("split = 'test'"))
    return kept(scored.drop("text"), "scored")


@query
def train_linear_classifier(spark, sf_dir):
    return model_facts(trained_and_scored(spark, sf_dir, training.train_linear_classifier))


@query
def train_logistic(spark, sf_dir):
    return model_facts(trained_and_scored(spark, sf_dir, training.train_logistic))


@query
def score_batch(spark, sf_dir):
    scored = trained_and_scored(spark, sf_dir, training.train_logistic)
    known = F.col("prediction").isin(*[r.label for r in labelled(spark, sf_dir).select("label").distinct().collect()])
    return scored.select("doc_id", "label", known.alias("known_label"), F.size("confidence_scores").cast("long").alias("classes"))


@query
def classify_documents(spark, sf_dir):
    """Every business document through a model trained on four fifths of them, and through the rules."""
    rows = corpus.stratified_split(business_documents(spark, sf_dir))
    model = training.train_logistic(rows.filter("split = 'train'"), max_iter=100)
    done = training.classify_documents(model, rows)
    shares = F.aggregate(F.map_values("confidence_scores"), F.lit(0.0), lambda a, v: a + v)
    facts = done.select(
        "doc_id",
        "label",
        "split",
        "model_prediction",
        "rule",
        "rule_by_score",
        (F.abs(shares - 1) < 1e-9).alias("shares_sum_to_one"),
        F.expr("rule = 'unknown' or final_prediction = rule").alias("rule_goes_first"),
        F.expr("(hybrid.confidence_flag = 'ok') = (confidence >= 0.7 and prediction != 'unknown')").alias("trusted_if_sure"),
        F.expr("if(hybrid.confidence_flag = 'ok', decision.document_type = prediction, decision.document_type = rule)").alias("decision_follows"),
    )
    facts = kept(facts, "classified")  # every text is classified once, for the rows and for the share of right ones
    right = facts.filter("split = 'test'").agg(F.avg((F.col("model_prediction") == F.col("label")).cast("double"))).scalar()
    return facts.drop("split", "model_prediction").withColumn("held_out_right", right >= 0.95)


@query
def grid_search(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("doc_id", "text", "label")
    found = training.grid_results(rows, training.grid_search(rows))
    return found.select("setting", F.col("accuracy").between(0.5, 1).alias("learned"))


@query
def embed_documents(spark, sf_dir):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    return training.embed_documents(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), F.size("embedding").cast("long").alias("width"), (F.abs(norm - 1) < 1e-3).alias("unit_length")
    )


# --- streams --------------------------------------------------------------------------------


#: Loads of ``ingest_stream``: the first is the corpus it starts from, and comes in once more at the end.
LOADS = 10


def cleaned_and_mapped(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", text.clean_text_basic(F.col("text")).alias("text"), labels.map_label_standard(F.col("source")).alias("label"))


@query
def ingest_stream(spark, sf_dir):
    """Documents in loads by doc_id, cleaned and mapped; what the corpus holds after the last."""
    base = scratch_dir(spark, "ingest")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    ends = docs.agg(F.percentile_approx("doc_id", [k / LOADS for k in range(1, LOADS)], 10_000)).first()[0] or [0] * (LOADS - 1)
    bounds = [F.lit(True), *[F.col("doc_id") > e for e in ends]]
    bounds = [low & ~high for low, high in zip(bounds, [*bounds[1:], F.lit(False)])]
    ingest.start_corpus(cleaned_and_mapped(docs.filter(bounds[0])), f"{base}/corpus")
    for load in [*bounds[1:], bounds[0]]:  # loads that come in one after the other, each written by all tasks and taken in as one batch
        docs.filter(load).write.mode("append").parquet(f"{base}/loads")
        stream = spark.readStream.schema(docs.schema).parquet(f"{base}/loads")
        ingest.ingest_stream(stream, f"{base}/corpus", f"{base}/checkpoint", cleaned_and_mapped).awaitTermination()
    return digest(ingest.read_corpus(spark, f"{base}/corpus"))


@query
def stream_period_totals(spark, sf_dir):
    base = scratch_dir(spark, "totals")
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    kind = F.col("event_type")
    amounts_by_category = events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "purchase", "income").when(kind == "error", "expense").otherwise("potential_income").alias("category"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    )
    periods = totals.period_totals(amounts_by_category, "7 days")
    totals.write_period_totals(periods, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    spelled = {c: F.date_format(c, "yyyy-MM-dd") for c in ("period_start", "period_end")}
    return totals.read_period_totals(spark, f"{base}/out").withColumns(spelled)
