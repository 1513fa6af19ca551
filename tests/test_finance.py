import datetime as dt

import pytest
from pyspark.sql import functions as F

from folioscope.functions import lexicon as lx
from folioscope.operators import finance

SCHEMA = "document_id string, document_type string, amount double, currency string, category string, date date, description string"


@pytest.fixture(scope="module")
def tx(spark):
    day = dt.date(2024, 5, 20)
    return spark.createDataFrame(
        [
            ("1", "invoice", 100.0, "EUR", "income", day, "a"), ("2", "quote", 80.0, "USD", "potential_income", day, "b"),
            ("3", "quote", 10.0, "TND", "potential_income", day, "c"), ("4", "receipt", 0.0, "EUR", "expense", day, "d"),
            ("5", "payslip", 30.5, "EUR", "expense", dt.date(2024, 1, 1), "e"),
        ],
        SCHEMA,
    )


def as_of():
    return F.lit("2024-06-01").cast("date")


def test_totals(tx):
    row = finance.category_totals(tx).first()
    assert tuple(row) == (100.0, 30.5, 90.0, 69.5, 69.5)
    empty = finance.category_totals(tx.filter("false")).first()
    assert tuple(empty) == (0.0, 0.0, 0.0, 0.0, 0.0)


def test_period(tx):
    assert finance.period_filter(tx, as_of(), 30).count() == 4


def test_report_matches_its_parts(tx):
    report = finance.financial_report(tx, as_of(), 365).first()
    assert report.transaction_count == 5
    assert tuple(report.summary) == tuple(finance.category_totals(tx).first())
    parts = {r.currency: (r.income, r.expense, r.potential, r.net) for r in finance.currency_breakdown(tx).collect()}
    assert {k: tuple(v) for k, v in report.currency_breakdown.items()} == parts
    kinds = {r.document_type: (r["count"], r.total_amount, r.average_amount) for r in finance.type_summary(tx).collect()}
    assert {k: tuple(v) for k, v in report.document_analysis.items()} == kinds
    assert report.recommendations == finance.report_advice(tx).first().recommendations
    assert finance.financial_report(tx.filter("false"), as_of()).first().transaction_count == 0


def test_advice(tx):
    assert finance.report_advice(tx).first().recommendations == [lx.ADVICE_CASH, lx.ADVICE_POTENTIAL, lx.ADVICE_QUOTES, lx.ADVICE_CURRENCIES]
    few = finance.report_advice(tx.filter("category = 'expense'")).first().recommendations
    assert few == [lx.ADVICE_COSTS, lx.ADVICE_FEW_ROWS]
    assert finance.simple_advice(tx).first().recommendations == []


def test_valid_rows(tx):
    assert finance.keep_valid(tx).count() == 4
    with pytest.raises(ValueError):
        finance.require_rows(tx.filter("false"))


def test_conversion(tx):
    got = {r.document_id: r.amount_tnd for r in finance.convert_to_tnd(tx.withColumn("currency", F.when(F.col("document_id") == "1", "JPY").otherwise(F.col("currency")))).collect()}
    assert got["1"] is None and got["2"] == 80.0 * 3.1 and got["3"] == 10.0


def test_ledger(tx):
    got = sorted(tuple(r) for r in finance.post_accounts(tx).collect())
    assert got == [("1", "411", "debit", 100.0), ("1", "70X", "credit", 100.0), ("4", "60X-65X", "debit", 0.0), ("5", "43X", "credit", 30.5), ("5", "64X", "debit", 30.5)]


def test_documented_totals(tx):
    row = finance.documented_totals(tx, F.lit(1.0)).first()
    assert (row.total_tax_found, row.currencies_found, row.balance_status) == (5.0, ["EUR", "TND", "USD"], "unbalanced_insufficient_data")


def test_balance_sheets(spark):
    df = spark.createDataFrame([(1000.0,), (0.0,), (1.0,), (123456.78,)], "r double")
    sheets = df.withColumn("sheet", finance.estimated_balance_sheet(F.col("r")))
    rows = {r.r: r for r in finance.check_balance(sheets).collect()}
    assert rows[0.0].sheet is None
    s = rows[1000.0].sheet
    assert (s.bilan_comptable.actif.total_actif, s.bilan_comptable.passif.capitaux_propres.capital_social) == (900, 675)
    assert (s.compte_de_resultat.resultat_net, s.bilan_comptable.passif.passif_courant.total_passif_courant) == (80, 150)
    assert (s.ratios_financiers.marge_nette_percent, s.ratios_financiers.liquidite_generale) == (8.0, 6.2)
    assert all(rows[r].balanced for r in (1000.0, 1.0, 123456.78)) and not rows[1000.0].empty


def test_turnover_sheet(spark):
    df = spark.createDataFrame([('{"chiffre_affaires": 1000, ',), ("nothing",)], "t string")
    got = finance.check_balance(df.select(finance.estimated_from_turnover(F.col("t")).alias("sheet"))).collect()
    assert got[0].sheet.bilan_comptable.actif.total_actif == 1200 and got[0].balanced and not got[0].empty
    assert got[1].empty


def test_nested_amounts(spark):
    df = spark.sql(
        "SELECT 'a' AS document_id, 'invoice' AS document_type, array(named_struct('amount', 5.0D, 'currency', 'EUR', 'type', 'revenue', 'description', 'x'),"
        " named_struct('amount', 2.0D, 'currency', 'EUR', 'type', cast(null as string), 'description', cast(null as string))) AS amounts"
    )
    assert tuple(finance.revenue_expense_totals(df).first()) == (5.0, 2.0, 2)
