"""Rule classification and the adjustments made to model scores.

Scores travel as ``map<string,double>`` columns, entries in class order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions import lexicon as lx
from folioscope.functions.patterns import (
    count_contained,
    let,
    let_sql,
    sql_contains,
    sql_has,
)
from folioscope.functions.wording import Question, asker

CONFIDENCE_THRESHOLD = 0.10


def rule_points(plain: Column) -> Column:
    """Struct of points per type on accent-free text: 1 per keyword, 2 per strong pattern.

    Catalogue words keep their accents, so accented ones never match.
    """
    return asker(point_questions())(plain)


def point_questions() -> dict[str, Question]:
    return {k: Question(words, lx.RULE_PATTERNS[k], 2) for k, words in lx.RULE_KEYWORDS.items()}


def best_rule(points: Column, min_score: int = 2) -> Column:
    """Type with most points, the earlier one on a tie; null below ``min_score``."""
    ranked = ", ".join(f"struct(p.{k} as s, {-i} as i, '{k}' as k)" for i, k in enumerate(lx.RULE_KEYWORDS))
    top = let_sql(points, f"array_max(array({ranked}))", "p")
    return let_sql(top, f"if(top.s >= {min_score}, top.k, null)", "top")


def rule_score(plain: Column) -> Column:
    return best_rule(rule_points(plain))


def decision_list(clean: Column) -> Column:
    """Type by ordered rules on text cleaned by ``clean_text_multilingual``."""
    word = lambda *words: sql_contains("t", words)
    flags = {name: sql_contains("t", words) for name, words in lx.INVOICE_INDICATORS.items()}
    score = "(" + " + ".join(f"cast({f} as int)" for f in flags.values()) + ")"
    both = lambda a, b: f"({a} and {b})"
    invoice = [
        both(word("facture"), word("tva", "ttc", "montant")),
        both(word("فاتورة"), word("ضريبة", "المبلغ", "أداء", "facture")),
        both(word("facture du mois"), word("montant total", "tva")),
        both(word("invoice"), word("total", "amount")),
        both(flags["tunisian"], flags["tax"]),
        both(flags["keyword"], f"{score} >= 3"),
        f"{score} >= 4",
        sql_has("t", lx.INVOICE_NUMBER_SHAPE, False),
    ]
    bank = [
        sql_contains("t", lx.BANK_PHRASES),
        both(word("solde"), word("crédit", "débit", "crediteur", "debiteur")),
        both(word("devise"), word("dirham")),
        both(word("agence"), word("compte")),
    ]
    ordered = {
        "invoice": " or ".join(invoice),
        "quote": both(word("devis"), word("offre", "prix estimatif")),
        "purchase_order": word("bon de commande", "commande n"),
        "delivery_note": word("bon de livraison"),
        "receipt": word("reçu", "justificatif de paiement"),
        "bank_statement": " or ".join(bank),
        "expense_report": word("note de frais", "remboursement", "justificatif"),
        "payslip": word("bulletin de paie", "salaire brut"),
    }
    branches = " ".join(f"when {test} then '{kind}'" for kind, test in ordered.items())
    return let_sql(clean, f"case {branches} else '{lx.UNKNOWN_TYPE}' end")


def keyword_vote(text: Column, classes: list[str] = lx.DOCUMENT_CLASSES) -> Column:
    """Purchase order against invoice by keyword counts, as a prediction struct."""

    def scores_for(winner: str, confidence: Column) -> Column:
        return F.create_map(
            *[x for c in classes for x in (F.lit(c), confidence if c == winner else F.lit(0.1))]
        )

    def vote(counts: Column) -> Column:
        orders, invoices = counts["orders"], counts["invoices"]

        def won(kind: str, count: Column) -> Column:
            sure = F.when((count > 1) & (orders != invoices), 0.7).otherwise(0.5)
            return F.struct(
                F.lit(kind).alias("prediction"),
                sure.alias("confidence"),
                scores_for(kind, sure).alias("confidence_scores"),
            )

        even = F.lit(1.0 / len(classes))
        undecided = F.struct(
            F.lit(classes[0]).alias("prediction"),
            even.alias("confidence"),
            F.create_map(*[x for c in classes for x in (F.lit(c), even)]).alias("confidence_scores"),
        )
        return (
            F.when((orders >= invoices) & (orders > 0), won("purchase_order", orders))
            .when(invoices > orders, won("invoice", invoices))
            .otherwise(undecided)
        )

    return let(
        F.struct(
            count_contained(F.lower(text), lx.VOTE_ORDER_WORDS).alias("orders"),
            count_contained(F.lower(text), lx.VOTE_INVOICE_WORDS).alias("invoices"),
        ),
        vote,
    )


def top_entry(scores: Column) -> Column:
    """Struct (key, value) of the highest score; the first entry wins a tie."""
    values = F.map_values(scores)
    # without any value the first entry stands
    at = F.coalesce(F.array_position(values, F.array_max(values)), F.lit(1))
    return F.struct(F.array_max(values).alias("value"), F.get(F.map_keys(scores), (at - 1).cast("int")).alias("key"))


def normalized(scores: Column) -> Column:
    """Scores divided by their sum; ``scores`` is worked out once."""
    return let(scores, normalized_bound)


def normalized_bound(scores: Column) -> Column:
    """``normalized`` of a value that is already bound."""
    total = F.aggregate(F.map_values(scores), F.lit(0.0), lambda a, v: a + v)
    return let(total, lambda t: F.transform_values(scores, lambda _, v: F.try_divide(v, t)))


def evidence_questions() -> dict[str, Question]:
    return {
        "definitive": Question(lx.DEFINITIVE_INVOICE_WORDS),
        "invoice": Question(lx.INVOICE_WORDS),
        "strong_invoice": Question([], lx.STRONG_INVOICE_PATTERNS),
        "order": Question(lx.ORDER_WORDS),
        "strong_order": Question([], lx.STRONG_ORDER_PATTERNS),
        "order_excluded": Question([], lx.ORDER_EXCLUSIONS),
        "order_heading": Question([], ["^bon de commande"]),
    }


def marker_questions() -> dict[str, Question]:
    """Forcing markers of a type, as ``marker_`` and its name."""
    return {f"marker_{kind}": Question([], patterns) for kind, patterns in lx.FORCING_MARKERS.items()}


def evidence(text: Column) -> Column:
    """Wording flags used by the score adjustments, as one struct of booleans."""
    return asker(evidence_questions(), flags=True)(F.lower(text))


def wording(text: Column, points: bool = False) -> Column:
    """Evidence flags and forcing markers, with the rule points on request, from one search of the text."""
    flags = evidence_questions() | marker_questions()
    given = {f"points_{k}": q for k, q in point_questions().items()} if points else {}
    return asker(given | flags, flags)(F.lower(text))


def adjust_scores(scores: Column, flags: Column) -> Column:
    """Raise or lower invoice and purchase-order scores by wording, then normalise."""

    def adjusted(s: Column) -> Column:
        m, f = s["m"], s["f"]
        has_invoice = F.map_contains_key(m, "invoice")
        has_order = F.map_contains_key(m, "purchase_order")
        definitive = f["definitive"] & has_invoice
        to_order = ~definitive & f["order"] & has_order & ~f["order_excluded"] & ~f["definitive"]
        to_invoice = (
            ~definitive & ~to_order & f["invoice"] & has_invoice & ~f["strong_order"] & ~f["definitive"]
        )

        def invoice_value(v: Column) -> Column:
            return (
                F.when(definitive, F.greatest(v * 4.0, F.lit(0.6)))
                .when(to_order & f["strong_order"], v * 0.7)
                .when(
                    to_invoice,
                    F.greatest(v * F.when(f["strong_invoice"], 3.0).otherwise(1.8), F.lit(0.35)),
                )
                .otherwise(v)
            )

        def order_value(v: Column) -> Column:
            return (
                F.when(definitive, v * 0.3)
                .when(
                    to_order,
                    F.greatest(v * F.when(f["strong_order"], 3.5).otherwise(2.0), F.lit(0.35)),
                )
                .when(to_invoice & f["strong_invoice"], v * 0.5)
                .otherwise(v)
            )

        heading = f["order_heading"] & has_order
        return F.transform_values(
            m,
            lambda k, v: F.when(
                k == "invoice", invoice_value(v) * F.when(heading, 0.6).otherwise(1.0)
            )
            .when(
                k == "purchase_order",
                F.when(heading, F.greatest(order_value(v), F.lit(0.5))).otherwise(order_value(v)),
            )
            .otherwise(v),
        )

    return normalized(let(F.struct(scores.alias("m"), flags.alias("f")), adjusted))


def threshold_and_restrict(
    scores: Column, threshold: float = CONFIDENCE_THRESHOLD, supported: list[str] = lx.COMMERCIAL_TYPES
) -> Column:
    """Keep supported types, renormalise (uniform if nothing is left), pick the prediction.

    A top score under the threshold means unknown, which is not a supported type and so is
    picked again among the kept ones.
    """
    uniform = F.create_map(*[x for k in supported for x in (F.lit(k), F.lit(1.0 / len(supported)))])

    def pick(s: Column) -> Column:
        first = F.when(s["top"]["value"] < threshold, F.lit(lx.UNKNOWN_TYPE)).otherwise(s["top"]["key"])
        return F.struct(
            F.when(first.isin(*supported), first).otherwise(top_entry(s["kept"])["key"]).alias("prediction"),
            s["kept"].alias("confidence_scores"),
        )

    def shares(kept: Column) -> Column:
        total = F.aggregate(F.map_values(kept), F.lit(0.0), lambda a, v: a + v)
        return F.when(total > 0, normalized_bound(kept)).otherwise(uniform)

    def bound(m: Column) -> Column:
        kept = let(F.map_filter(m, lambda k, _: k.isin(*supported)), shares)
        return let(F.struct(top_entry(m).alias("top"), kept.alias("kept")), pick)

    return let(scores, bound)


def definitive_override(text: Column, prediction: Column, scores: Column, read: Column | None = None) -> Column:
    """First type, in marker order, that has a marker in the text or is already predicted.

    ``read`` may hold the answers of ``wording`` on the text.
    """
    tests = [
        f"when map_contains_key(x.m, '{kind}') and (x.p = '{kind}' or x.r.marker_{kind}) then '{kind}'" for kind in lx.FORCING_MARKERS
    ]
    marks = asker(marker_questions(), flags=True)(F.lower(text)) if read is None else read
    given = F.struct(marks.alias("r"), prediction.alias("p"), scores.alias("m"))
    return let_sql(given, f"case {' '.join(tests)} else x.p end", "x")


def ambiguity_flag(prediction: Column, scores: Column, flags: Column) -> Column:
    """Invoice and purchase order both indicated and within 0.1: unknown, both at 0.5."""

    def flagged(x: Column) -> Column:
        m, f = x["m"], x["f"]
        invoice = F.try_element_at(m, F.lit("invoice"))
        order = F.try_element_at(m, F.lit("purchase_order"))
        unclear = F.coalesce(
            (F.abs(invoice - order) < 0.1) & (f["invoice"] | f["strong_invoice"]) & (f["order"] | f["strong_order"]),
            F.lit(False),
        )
        levelled = normalized(
            F.transform_values(m, lambda k, v: F.when(k.isin("invoice", "purchase_order"), 0.5).otherwise(v))
        )
        return let(
            unclear,
            lambda u: F.struct(
                F.when(u, F.lit(lx.UNKNOWN_TYPE)).otherwise(x["p"]).alias("prediction"),
                F.when(u, levelled).otherwise(m).alias("confidence_scores"),
            ),
        )

    return let(F.struct(prediction.alias("p"), scores.alias("m"), flags.alias("f")), flagged)


def predict(
    text: Column, scores: Column, model_prediction: Column | None = None, read: Column | None = None
) -> Column:
    """All score steps: struct (prediction, confidence, confidence_scores).

    Scores whose predicted class has 0.8 or more pass unchanged, all types included. ``read`` may hold the answers of
    ``wording`` on the text; it is asked here without.
    """

    def start(s: Column) -> Column:
        label = s["label"]
        sure = F.struct(
            label.alias("prediction"),
            F.try_element_at(s["m"], label).alias("confidence"),
            s["m"].alias("confidence_scores"),
        )
        return F.when(F.try_element_at(s["m"], label) >= 0.8, sure).otherwise(
            unsure(s["m"], s["flags"])
        )

    def unsure(m: Column, flags: Column) -> Column:
        return let(
            threshold_and_restrict(adjust_scores(m, flags)),
            lambda picked: let(
                ambiguity_flag(
                    definitive_override(text, picked["prediction"], picked["confidence_scores"], flags),
                    picked["confidence_scores"],
                    flags,
                ),
                lambda out: F.struct(
                    out["prediction"].alias("prediction"),
                    F.coalesce(
                        F.try_element_at(out["confidence_scores"], out["prediction"]),
                        F.array_max(F.map_values(out["confidence_scores"])),
                    ).alias("confidence"),
                    out["confidence_scores"].alias("confidence_scores"),
                ),
            ),
        )

    label = top_entry(scores)["key"] if model_prediction is None else model_prediction
    read = wording(text) if read is None else read
    return let(F.struct(scores.alias("m"), label.alias("label"), read.alias("flags")), start)


def hybrid_decision(prediction: Column, confidence: Column, rule: Column) -> Column:
    """Confident model, else rule, else model: struct (final_prediction, confidence_flag)."""
    trusted = (confidence >= 0.7) & (prediction != lx.UNKNOWN_TYPE)
    return F.struct(
        F.when(trusted, prediction).otherwise(F.coalesce(rule, prediction)).alias("final_prediction"),
        F.when(trusted, "ok").otherwise("needs_review").alias("confidence_flag"),
    )


def final_prediction(rule: Column, prediction: Column, confidence: Column, scores: Column) -> Column:
    """Rule type unless unknown; then model above 0.2; then best score above 0.25."""
    return let(
        top_entry(scores),
        lambda top: F.when(rule != lx.UNKNOWN_TYPE, rule)
        .when(confidence > 0.2, prediction)
        .when(top["value"] > 0.25, top["key"])
        .otherwise(lx.UNKNOWN_TYPE),
    )


def confidence_flag(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")


def confidence_flag_two_level(confidence: Column) -> Column:
    return F.when(confidence >= 0.7, "high").otherwise("low")


def commercial_decision(rule: Column, prediction: Column, confidence: Column, hybrid: Column | None) -> Column:
    """Rule type at 0.8 (unknown 0.1), overridden by a trusted hybrid result; without a
    hybrid result a commercial model type from 0.2 up replaces unknown."""
    base = F.when(rule == lx.UNKNOWN_TYPE, 0.1).otherwise(0.8)
    if hybrid is not None:
        ok = hybrid["confidence_flag"] == "ok"
        kind, level = hybrid["final_prediction"], confidence
    else:
        ok = (rule == lx.UNKNOWN_TYPE) & prediction.isin(*lx.COMMERCIAL_TYPES) & (confidence >= 0.2)
        kind, level = prediction, confidence
    return F.struct(
        F.when(ok, kind).otherwise(rule).alias("document_type"),
        F.when(ok, level).otherwise(base).alias("confidence"),
    )
