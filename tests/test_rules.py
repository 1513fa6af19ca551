from pyspark.sql import functions as F

from folioscope.functions import lexicon as lx
from folioscope.functions import rules
from folioscope.functions.text import clean_text_multilingual

SCHEMA = "text string, scores map<string,double>"


def listed(c):
    return rules.decision_list(clean_text_multilingual(c))


def test_decision_list_branches(apply):
    rows = {
        "Facture n° 12 montant 5": "invoice", "فاتورة المبلغ 5": "invoice", "invoice total 4": "invoice", "Invoice #\nA12": "invoice",
        "Devis pour une offre": "quote", "Commande n° 5": "purchase_order", "Bon de livraison 3": "delivery_note", "Reçu 12": "receipt",
        "agence et compte": "bank_statement", "solde crédit": "bank_statement", "note de frais": "expense_report",
        "salaire brut": "payslip", "hello world": "unknown", "Devis seul": "unknown", "facture et bon de livraison": "delivery_note",
    }
    assert apply(listed, list(rows)) == list(rows.values())


def test_rule_scores_and_ties(apply):
    assert apply(rules.rule_score, ["devis #", "stock", "hello", "avoir"]) == ["quote", "inventory_document", None, "credit_note"]
    # accented catalogue words never match accent-free text
    assert apply(rules.rule_score, ["conformite"]) == [None]


def test_keyword_vote(apply):
    got = apply(rules.keyword_vote, ["purchase order", "facture", "facture bc", "zzz"])
    assert [(r.prediction, r.confidence) for r in got] == [
        ("purchase_order", 0.7), ("invoice", 0.5), ("purchase_order", 0.5), ("invoice", 1.0 / 15),
    ]
    assert got[0].confidence_scores["quote"] == 0.1 and len(got[0].confidence_scores) == 15


def adjusted(apply, text, scores):
    (got,) = apply(lambda t, s: rules.adjust_scores(s, rules.evidence(t)), [(text, scores)], SCHEMA)
    assert abs(sum(got.values()) - 1) < 1e-9
    return got


def test_adjustments(apply):
    even = {"invoice": 0.25, "purchase_order": 0.25, "quote": 0.5}
    definitive = adjusted(apply, "montant ttc", even)
    assert round(definitive["invoice"] / definitive["purchase_order"], 6) == round(1.0 / 0.075, 6)
    order = adjusted(apply, "bon de commande", even)
    # strong order wording, then the heading rule on top
    assert round(order["purchase_order"] / order["invoice"], 6) == round(0.875 / (0.25 * 0.7 * 0.6), 6)
    weak_invoice = adjusted(apply, "the client", even)
    assert round(weak_invoice["invoice"] / weak_invoice["quote"], 6) == round(0.45 / 0.5, 6)
    untouched = adjusted(apply, "hello", {"quote": 1.0, "receipt": 1.0})
    assert untouched == {"quote": 0.5, "receipt": 0.5}


def test_threshold_and_supported_types(apply):
    pick = lambda scores: apply(lambda t, s: rules.threshold_and_restrict(s), [("", scores)], SCHEMA)[0]
    kept = pick({"contract": 0.6, "invoice": 0.1, "quote": 0.3})
    assert kept.prediction == "quote" and round(kept.confidence_scores["quote"], 6) == 0.75
    assert pick({"contract": 1.0}).confidence_scores == {k: 0.125 for k in lx.COMMERCIAL_TYPES}
    low = pick({"invoice": 0.09, "quote": 0.05})
    assert low.prediction == "invoice"  # unknown is not supported, so the best kept type is taken


def test_override_stops_at_the_current_prediction(apply):
    scores = {"invoice": 0.2, "purchase_order": 0.5, "payslip": 0.3}
    force = lambda t, p: apply(lambda t, s: rules.definitive_override(t, F.lit(p), s), [(t, scores)], SCHEMA)[0]
    assert force("payslip and facture n 1", "purchase_order") == "invoice"
    assert force("payslip", "purchase_order") == "purchase_order"
    assert force("payslip", "receipt") == "payslip"
    assert force("quotation", "receipt") == "receipt"  # no score for quotes


def test_ambiguity(apply):
    flag = lambda t, s: apply(lambda t, s: rules.ambiguity_flag(F.lit("invoice"), s, rules.evidence(t)), [(t, s)], SCHEMA)[0]
    close = flag("facture et commande", {"invoice": 0.4, "purchase_order": 0.35, "quote": 0.25})
    assert close.prediction == "unknown" and round(close.confidence_scores["invoice"], 6) == 0.4
    assert flag("facture et commande", {"invoice": 0.5, "purchase_order": 0.3}).prediction == "invoice"
    assert flag("facture", {"invoice": 0.4, "purchase_order": 0.35}).prediction == "invoice"


def test_sure_predictions_pass_unchanged(apply):
    (got,) = apply(rules.predict, [("facture n 1", {"contract": 0.8, "invoice": 0.2})], SCHEMA)
    assert (got.prediction, got.confidence, got.confidence_scores) == ("contract", 0.8, {"contract": 0.8, "invoice": 0.2})


def test_decisions(apply):
    hybrid = lambda p, c, r: tuple(apply(rules.hybrid_decision, [(p, c, r)], "p string, c double, r string")[0])
    assert hybrid("quote", 0.7, "invoice") == ("quote", "ok")
    assert hybrid("quote", 0.69, "invoice") == ("invoice", "needs_review")
    assert hybrid("unknown", 0.9, None) == ("unknown", "needs_review")
    final = lambda r, p, c, s: apply(rules.final_prediction, [(r, p, c, s)], "r string, p string, c double, s map<string,double>")[0]
    assert final("receipt", "quote", 0.9, {"quote": 0.9}) == "receipt"
    assert final("unknown", "quote", 0.21, {"quote": 0.3}) == "quote"
    assert final("unknown", "quote", 0.2, {"invoice": 0.26}) == "invoice"
    assert final("unknown", "quote", 0.2, {"invoice": 0.25}) == "unknown"
    assert apply(rules.confidence_flag, [0.8, 0.79, 0.5, 0.49], "c double") == ["high", "medium", "medium", "low"]
    assert apply(rules.confidence_flag_two_level, [0.7, 0.69], "c double") == ["high", "low"]


def test_commercial_decision(apply):
    schema = "r string, p string, c double, h struct<final_prediction:string,confidence_flag:string>"
    rows = [("unknown", "quote", 0.9, ("quote", "ok")), ("receipt", "quote", 0.5, ("receipt", "needs_review"))]
    got = apply(rules.commercial_decision, rows, schema)
    assert [tuple(r) for r in got] == [("quote", 0.9), ("receipt", 0.8)]
    got = apply(lambda r, p, c: rules.commercial_decision(r, p, c, None), [("unknown", "quote", 0.2), ("unknown", "contract", 0.9), ("receipt", "quote", 0.9)], "r string, p string, c double")
    assert [tuple(r) for r in got] == [("quote", 0.2), ("unknown", 0.1), ("receipt", 0.8)]
