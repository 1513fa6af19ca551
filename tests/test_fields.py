import datetime as dt

from pyspark.sql import functions as F

from folioscope.functions import amounts, dates, fields, labels, responses

TODAY = dt.date(2024, 6, 1)


def today():
    return F.lit("2024-06-01").cast("date")


def test_dates_are_normalised(apply):
    rows = ["31/02/2023", "5.6.23", "15 May 2024", "May 15, 2024", "15 février 2024", "15 mai 2024", "2024-05-15", "none", "1/2/3/4", None]
    want = ["2023-02-31", "2023-06-05", "2024-05-15", "2024-05-15", None, "2024-05-15", "2024-05-15", None, None, None]
    assert apply(dates.normalize_date, rows) == want
    assert apply(lambda c: dates.normalize_date(c, True), ["15 février 2024"]) == ["2024-02-15"]


def test_document_and_due_dates(apply):
    rows = ["Invoice Date: 3 March 2024\nDue Date: 4 April 2024", "Paid 01/02/2024", "le 3 mai 2024", "nothing"]
    assert apply(lambda c: dates.extract_dates(c)[0], rows) == ["2024-03-03", "2024-02-01", "2024-05-03", None]
    assert apply(lambda c: dates.extract_dates(c)[1], rows) == ["2024-04-04", None, None, None]


def test_money_dates(apply):
    rows = ["date: 31/02/2023 then 05-06-23", "on 2024-05-15", "2024-13-45", "no date"]
    assert apply(lambda c: dates.extract_date(c, today()), rows) == [
        dt.date(2023, 6, 5), dt.date(2015, 5, 24), TODAY, TODAY,
    ]


def test_date_formats_in_order(apply):
    rows = ["2024-5-1", "03/04/2024", "12/31/2024", "31-12-2024", "x"]
    assert apply(lambda c: dates.parse_date_formats(c, today()), rows) == [
        dt.date(2024, 5, 1), dt.date(2024, 4, 3), dt.date(2024, 12, 31), dt.date(2024, 12, 31), TODAY,
    ]


def test_amounts(apply):
    rows = [
        "Subtotal: $1,000.00\nTotal: $1,200.00", "€ 50", "Total: 51.94 €", "Montant total: 1,5", "price: 12.5", "12 dt", "Total: $0 and amount 7 x",
        "no numbers", "montant total: ٥٠",
    ]
    assert apply(amounts.extract_amount, rows) == [1000.0, None, 51.94, 15.0, 12.5, 12.0, 7.0, None, 50.0]
    assert apply(lambda c: amounts.extract_amount(c, strict_total=True), rows[:1]) == [1200.0]


def test_currencies(apply):
    rows = ["fournisseur $5", "5 USD", "12 dinars", "£3", "nothing"]
    assert apply(amounts.identify_currency, rows) == ["EUR", "USD", "TND", "GBP", "EUR"]
    assert apply(lambda c: amounts.identify_currency(c, True), rows[:1]) == ["USD"]


def test_descriptions(apply):
    rows = [("Description: new desk\nmore", "quote"), ("\n  First line here  \nrest", "purchase_order"), ("  ", "receipt")]
    got = apply(amounts.describe, rows, "text string, kind string")
    assert got == ["new desk", "Purchase_Order: First line here...", "Receipt transaction"]


def test_transactions(apply):
    rows = [("Total: $12.00 on 03/05/2024", "invoice"), (None, "invoice"), ("hello", "unknown"), ("€5 le 01/06/2024 total: €5", "receipt")]
    got = apply(lambda t, k: amounts.transaction(t, k, F.lit("d"), today()), rows, "text string, kind string")
    assert (got[0].amount, got[0].currency, got[0].date, got[0].category) == (12.0, "USD", dt.date(2024, 5, 3), "income")
    assert round(got[0].confidence, 4) == 1.0
    assert (got[1].amount, got[1].confidence, got[1].category, got[1].date) == (0.0, 0.0, "unknown", None)
    assert (got[2].amount, got[2].currency, got[2].date, got[2].subcategory) == (0.0, "USD", TODAY, "unclassified")
    assert round(got[2].confidence, 4) == 0.4
    # a stated date that is today counts half
    assert round(got[3].confidence, 4) == 0.8


def test_largest_amount(apply):
    rows = [("costs 1,200.50 or 15", "in EUR"), ("one, 20", ""), ("5 and 9", "usd"), ("30", "dollars")]
    assert [v and round(v, 4) for v in apply(amounts.largest_amount, rows, "text string, info string")] == [3961.65, None, None, 93.0]
    assert apply(lambda t, i: amounts.largest_amount(t, i, False), rows[1:2], "text string, info string") == [20.0]


def test_clients(apply):
    rows = ["Bill To: Acme Ltd\n1 Main St\nParis\n\nTotal 5", "Destinataire : Jean", "none"]
    assert apply(lambda c: fields.extract_client(c)[0], rows) == ["Acme Ltd", "Jean", None]
    assert apply(lambda c: fields.extract_client(c)[1], rows) == ["1 Main St\nParis", None, None]


def test_fields_follow_the_type(apply):
    rows = [
        ("Facture n°: F-12\nTotal: 15.50", "invoice"), ("Devis #D1 validité: 30 jours", "quote"), ("Order PO-9", "purchase_order"),
        ("Livraison BL7 commande C-3", "delivery_note"), ("Payment method: card", "receipt"), ("Closing balance: $5.10", "bank_statement"),
        ("Employee: Jane", "expense_report"), ("Net pay: €9.50", "payslip"), ("Facture n°: F-12", "quote"),
    ]
    pick = lambda name: apply(lambda t, k: fields.extract_fields_by_type(t, k)[name], rows, "text string, kind string")
    assert pick("invoice_number")[0] == "F-12" and pick("amount")[0] == "15.50" and pick("invoice_number")[8] is None
    assert (pick("quote_number")[1], pick("validity")[1], pick("po_number")[2]) == ("D1", "30 jours", "PO-9")
    assert (pick("delivery_number")[3], pick("order_reference")[3]) == ("BL7", "C-3")
    assert (pick("payment_method")[4], pick("balance")[5], pick("employee")[6], pick("net_pay")[7]) == ("card", "5.10", "Jane", "9.50")


def test_invoice_analysis(apply):
    flags = apply(lambda c: fields.analyze_invoice(c)["is_invoice"], ["facture 12", "total and date", "hello"])
    assert flags == [True, True, False]
    assert apply(lambda c: fields.analyze_invoice(c)["invoice_number"], ["facture abc 12", "hello"]) == ["abc", None]


def test_key_information(apply):
    (got,) = apply(lambda c: F.struct(*[v.alias(k) for k, v in fields.extract_key_info(c).items()]), ["Facture: F1 total 12 € le 3/4/2024"])
    assert got.amounts == ["12", "12"] and got.dates == ["3/4/2024"] and got.invoice_numbers == ["F1"]


def test_labels(apply):
    assert apply(labels.map_label_standard, ["Invoice ", "my receipt", "Bank Statement", "Odd-Label!", "", None]) == [
        "invoice", "receipt", "bank_statement", "odd_label_", "document", "document",
    ]
    assert apply(labels.map_label_commercial, ["Billing", "wage list", "New Kind"]) == ["invoice", "payslip", "new_kind"]
    assert apply(labels.map_label_company, ["Invoice", "Legal note", "App Form", "New Kind"]) == ["receipt", "contract", "form", "new_kind"]
    assert apply(labels.label_problem, ["a b_c", "Abc", "a-b", "ok_1"]) == [
        "Mixed separators: 'a b_c'", "Not lowercase: 'Abc'", "Special characters: 'a-b'", None,
    ]


def test_label_inference_order(apply):
    rows = [("L ", "c", "x_invoice", "t"), ("", " Cat", "x_invoice", "t"), ("", "", "my_ORDER.pdf", "receipt"), ("", "", "x", "terms and conditions"), ("", "", "", "")]
    got = apply(lambda a, b, f, t: labels.infer_label(a, b, None, f, t), rows, "a string, b string, f string, t string")
    assert got == ["l", "cat", "purchase_order", "contract", "document"]


def test_responses(apply):
    rows = [
        'x {"document_type": "quote", "amount": 5.5, "confidence": 0.9} y', '{"amount": 1,200, "currency": "EUR"}', "{'amount': 3,}",
        '{"amount": 12,34}', '{"amount": 12,34,56}', '"amount": 7.5, "currency": "GBP", "document_type": "invoice"', "",
    ]
    got = apply(lambda c: responses.repair_json_response(c, today()), rows)
    assert [(r.amount, r.parsed) for r in got] == [(5.5, True), (1200.0, True), (3.0, True), (1234.0, True), (12.0, False), (7.5, False), (0.0, False)]
    assert (got[5].currency, got[5].document_type, got[5].confidence, got[5].date) == ("GBP", "invoice", 0.6, "2024-06-01")


def test_report_fields(apply):
    broken = '{"chiffre_affaires": 1,500, "points_forts": ["a", "b", "c", "d"], {"montant": 12.5, "x": 1, "libelle": "first"}'
    names = ("chiffre_affaires", "total_actif", "points_forts", "details_transactions")
    (got,) = apply(lambda c: F.struct(*[responses.regex_report_fields(c)[n].alias(n) for n in names]), [broken])
    assert (got.chiffre_affaires, got.total_actif, got.points_forts) == (1500.0, 0.0, ["a", "b", "c"])
    assert [(t.document_id, t.montant, t.libelle) for t in got.details_transactions] == [("doc1", 12.5, "first")]


def test_amounts_with_several_thousands_commas(apply):
    def amount(c):
        return responses.repair_json_response(c, F.lit("2024-01-01").cast("date"))["amount"]

    rows = ['{"amount": 1,234,567.89, "confidence": 0.5}', '{"amount": 9,876,543,210}', '{"amount": 1,234.5,}', '{"amount":12,345,"currency":"EUR"}', '{"amount": 999}']
    assert apply(amount, rows) == [1234567.89, 9876543210.0, 1234.5, 12345.0, 999.0]
