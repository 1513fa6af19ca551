"""Questions asked in Arrow batches give what every word and pattern by itself gives, and the steps around them hold."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions import amounts, patterns, rules, wording
from folioscope.functions import lexicon as lx
from folioscope.functions.text import clean_text_multilingual
from folioscope.plans.business_docs import evidence_scores


def texts(n=120):
    rng = random.Random(3)
    parts = [w for words in lx.RULE_KEYWORDS.values() for w in words] + lx.ORDER_WORDS + lx.INVOICE_WORDS
    parts += [" ", "\n", "n° 12", "#", ": 7", "po", " ", "ß", "\x1c", "٣٤", "K", "ſ", "𝔘"]
    out = ["".join(rng.choices(parts, k=rng.choice([1, 2, 5]))) for _ in range(n)]
    return [None, "", "b", "po", *out, " ".join(parts), "x" * 1200, "x" * 1200 + " order #4 stock"]


def test_counts_equal_those_of_single_expressions(apply):
    sums = ", ".join(
        f"{patterns.sql_count('t', words)} + 2 * {patterns.sql_hits('t', lx.RULE_PATTERNS[k])} as {k}" for k, words in lx.RULE_KEYWORDS.items()
    )
    rows = texts()
    want = apply(lambda c: patterns.let_sql(c, f"struct({sums})"), rows)
    assert apply(rules.rule_points, rows) == want


def test_flags_equal_those_of_single_expressions(apply):
    flags = {
        "definitive": patterns.sql_contains("t", lx.DEFINITIVE_INVOICE_WORDS), "invoice": patterns.sql_contains("t", lx.INVOICE_WORDS),
        "strong_invoice": patterns.sql_any("t", lx.STRONG_INVOICE_PATTERNS), "order": patterns.sql_contains("t", lx.ORDER_WORDS),
        "strong_order": patterns.sql_any("t", lx.STRONG_ORDER_PATTERNS), "order_excluded": patterns.sql_any("t", lx.ORDER_EXCLUSIONS),
        "order_heading": "startswith(t, 'bon de commande')",
    }
    rows = texts()
    want = apply(lambda c: patterns.let_sql(F.lower(c), f"struct({', '.join(f'({t}) as `{n}`' for n, t in flags.items())})"), rows)
    assert apply(rules.evidence, rows) == want


def test_a_text_is_not_searched_once_per_word(spark):
    plan = spark.range(1).select(rules.rule_points(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("contains(") == 0 and "ArrowEvalPython" in plan


@pytest.mark.parametrize("scores", [{}, {"a": None, "b": None}, {"a": 1.0, "b": 2.0, "c": 2.0}, {"a": float("nan"), "b": 3.0}, {"a": None, "b": 0.5}])
def test_top_entry_equals_the_largest_pair(apply, scores):
    (got,) = apply(lambda t, s: rules.top_entry(s), [("", scores)], "text string, scores map<string,double>")
    value = lambda v: -1 if v is None else 9 if v != v else v
    want = max(scores, key=lambda k: value(scores[k]), default=None)
    assert got.key == want


def test_amounts_and_words_keep_their_values(apply):
    def by_all_patterns(text):
        low = F.lower(text)
        first = lambda p: F.get(F.filter(F.transform(patterns.all_groups(low, p), lambda m: amounts.to_number(patterns.replace_all(m, r"[€$£\s]", ""))), lambda v: v > 0), F.lit(0))
        return F.coalesce(*[first(p) for p in lx.TOTAL_PATTERNS + lx.LOOSE_AMOUNT_PATTERNS])

    rows = ["Total: $5", "TOTAL 1,000.50 €", "grand total $ 7", "montant total 8", "prıx 9", "prix: 3 DT", "price 4", "total £ 6", "final amount: $2", "12 TND", "total", "", None, "amount due $ 0 total 3 $"]
    assert apply(amounts.extract_amount, rows) == apply(by_all_patterns, rows)
    step = lambda c: patterns.collapse_blanks(patterns.replace_all(F.lower(F.coalesce(c, F.lit(""))), r"[^\w\s\x{600}-\x{6FF}]", " "))
    rows = ["A  b c", " x!!\n y ", "½ é_", "\x1c.", "", None, "a​b"]
    assert apply(clean_text_multilingual, rows) == apply(step, rows)


def test_one_search_answers_points_flags_and_markers(apply):
    rows = texts()
    read = apply(lambda c: rules.wording(c, points=True), rows)
    points = apply(lambda c: rules.rule_points(F.lower(c)), rows)
    flags = apply(rules.evidence, rows)
    markers = {k: patterns.sql_any("t", p) for k, p in lx.FORCING_MARKERS.items()}
    marks = apply(lambda c: patterns.let_sql(F.lower(c), f"struct({', '.join(f'{t} as {k}' for k, t in markers.items())})"), rows)
    for r, p, f, m in zip(read, points, flags, marks):
        got = r.asDict() if r else {}
        want = {f"points_{k}": v for k, v in (p.asDict() if p else {}).items()} | (f.asDict() if f else {})
        want |= {f"marker_{k}": v for k, v in (m.asDict() if m else {}).items()}
        assert all(got.get(k) == v for k, v in want.items())


def test_all_score_steps_ask_one_question_of_a_text(spark):
    docs = spark.range(1).selectExpr("id as doc_id", "'a' as label", "cast(id as string) as text")
    rows = evidence_scores(docs).select(rules.predict(F.col("text"), F.col("scores"), read=F.col("read")).alias("p"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("arrowevalpython") == 1 and "rlike" not in plan
