import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions import patterns, text
from folioscope.functions.fields import sentence_score, smart_excerpt

PIECES = ["Facture", "é", "مبلغ", "x", " ", "  ", " ", "\n", "\t", "1,2,3,4", "[PAD]", "[unused7]", "[CLS]", "ABCDEFGHIJKL",
          "...", "....", "---", "-----", "€", "$5", "?!", "‏", "aaaa", "ß", "№", "fin.", "_", "\x07", ";", "ﬁ", "ABCDEFGHIJé"]
TEXTS = st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), min_size=30, max_size=60)
FEW = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def squeeze(t):
    return " ".join(t.split())


def plain_basic(t):
    t = "".join(c if " " <= c <= "~" or c in "\n\r\t" else " " for c in t)
    for p in (r"\b[A-Z]{10,}\b", r"\d+,\d+,\d+,\d+", r"\[PAD\]|\[unused\d+\]"):
        t = re.sub(p, " ", t)
    return squeeze(t)


def plain_multilingual(t):
    arabic = lambda c: "؀" <= c <= "ۿ"
    t = t.lower().replace("‏", " ").replace("‎", " ")
    out = []
    for i, c in enumerate(t):
        out.append(c)
        if i + 1 < len(t) and not c.isspace() and not t[i + 1].isspace() and arabic(c) != arabic(t[i + 1]):
            out.append(" ")
    return squeeze("".join(c if c.isalnum() or c == "_" or c.isspace() or arabic(c) else " " for c in out))


@FEW
@given(TEXTS)
def test_basic_cleaning_agrees_with_plain_rules(apply, texts):
    assert apply(text.clean_text_basic, texts) == [plain_basic(t) for t in texts]


@FEW
@given(TEXTS)
def test_multilingual_cleaning_agrees_with_plain_rules(apply, texts):
    assert [squeeze(t) for t in apply(text.clean_text_multilingual, texts)] == [plain_multilingual(t) for t in texts]


@FEW
@given(TEXTS)
def test_accents_are_stripped_like_unicodedata(apply, texts):
    import unicodedata

    want = ["".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower().strip() for t in texts]
    assert apply(text.strip_accents, texts) == want


@FEW
@given(TEXTS)
def test_word_cut_agrees_with_plain_rules(apply, texts):
    def plain(t, n=12):
        if len(t) <= n:
            return t
        at = t[:n].rfind(" ")
        return (t[:at] if at > n * 0.8 else t[: n - 3]) + "..."

    assert apply(lambda c: text.truncate_at_word(c, 12), texts) == [plain(t) for t in texts]


def test_training_cleaning_order(apply):
    got = apply(text.clean_training_text, ["Été [CLS] a....b ---- c 1,2,3,4 ABCDEFGHIJKL ~ `x`", None, "   "])
    assert got == ["t a b c x", "", ""]


def test_punctuation_cleaning(apply):
    got = apply(text.clean_punctuation, ["a ,b ;c", "wait.....now", "a------b", "é ~ ok"])
    assert got == ["a, b; c", "wait. . . now", "a---b", "é ok"]


def test_excerpt_cleaning_halves_repeats(apply):
    assert apply(text.clean_for_excerpt, ["aaaa bbb!!!!! 5 € ~", "  x  "]) == ["aa bbb!! 5 €", "x"]


def test_json_receipts(apply):
    rows = [
        '{"company":"ACME","date":"1/2/2020","total":"12.50","items":[{"name":"Tea","quantity":2,"price":"3"}],"tax_id":"X1","flag":null}',
        ' {"company":"ACME MARKET KL","total":12.5,"nested":{"a":1}}',
        '{"company":"ACME", "total":"RM5", "address":"somewhere long"}',
        '{"company": broken',
        '{"company":"A"}',
        "plain text",
    ]
    got = apply(text.json_receipt_to_text, rows)
    assert got[0] == "Company: ACME\nDate: 1/2/2020\nTotal: RM12.50\nItems:\n- Tea | Qty: 2 | Price: 3\nTax_Id: X1"
    assert got[1] == "Company: ACME MARKET KL\nTotal: 12.5"
    assert got[2] == "Company: ACME\nAddress: somewhere long\nTotal: RM5"
    assert got[3:] == [None, None, None]


def test_receipt_items_are_limited(apply):
    items = ",".join('{"name":"n%d"}' % i for i in range(15))
    (got,) = apply(lambda c: text.json_receipt_to_text(c, max_items=10), ['{"items":[%s]}' % items])
    assert got.count("- n") == 10


def test_unwrap(apply):
    rows = ['{"text": "inner"}', '{"other": 1}', '{"text": broken', "plain", '{"text": "a"} tail']
    assert apply(text.unwrap_json_text, rows) == ["inner", *rows[1:]]


def test_tokens_keep_keywords(apply):
    (got,) = apply(text.tokenize_filter, ["the invoice is due on date and total"])
    assert got == ["invoice", "due", "date", "total"]


def test_boost_prefers_purchase_orders(apply):
    order, invoice, neither = apply(text.boost_keywords, ["Bon de commande fournisseur", "Facture n° 12 montant", "hello"])
    assert order.endswith(" fournisseur" * 5) and invoice.endswith(" total" * 5) and neither == "hello"
    assert "facture facture facture facture facture" in invoice


def test_cuts(apply):
    assert apply(text.truncate_for_embedding, ["  " + "x" * 4000, None]) == ["x" * 3072, ""]
    assert apply(text.has_report_text, ["  0123456789  ", "0123456789a"]) == [False, True]
    assert apply(text.is_too_short, ["x" * 49, "x" * 50]) == [True, False]


def test_sentence_scores(apply):
    got = apply(sentence_score, ["Total 12 euros here now ok", "plain words only in here x", "short one"])
    assert got == [3.0 * 2 + 1.5 + 0.5 + 0.5, 0.5, -1.0]


def test_excerpts(apply):
    short = "as it is..."
    long = "Nothing much to see in this sentence here. The invoice total is 500 euros. " + "filler words go on and on " * 20
    got = apply(lambda c: smart_excerpt(c, 100), [short, long, "x" * 150, None])
    assert got[0] == short and got[3] is None
    assert got[1] == "The invoice total is 500 euros. Nothing much to see in this sentence here."
    assert got[2] == "xx"


def test_excerpt_truncates_a_long_best_sentence(apply):
    (got,) = apply(lambda c: smart_excerpt(c, 40), ["invoice total amount price tva order client " * 3])
    assert got.endswith("......") and len(got) <= 46


def test_required_literals_never_lose_matches(spark):
    from folioscope.functions import lexicon as lx

    lists = [*lx.RULE_PATTERNS.values(), *lx.FORCING_MARKERS.values(), lx.STRONG_INVOICE_PATTERNS, lx.STRONG_ORDER_PATTERNS]
    samples = ["facture n° 1234", "n°facture", "fac. no", "bon  de commande", "p.o. #", "releve d'identite bancaire", "bl n", "cb", "total ttc"]
    for p in {p for ps in lists for p in ps}:
        part = patterns.required_literal(p)
        for s in samples:
            if re.search(p, s):
                assert part in s, (p, part, s)


def test_strip_uses_unicode_blanks(apply):
    assert apply(patterns.strip, ["  a b \x1f\x85"]) == ["a b"]
    assert apply(lambda c: F.length(patterns.collapse_blanks(c)), ["　a \t b"]) == [3]


def test_long_texts_are_cleaned_whole(apply):
    long = "word " * 30_000 + "facture montant"
    assert apply(text.clean_text_multilingual, [long])[0].endswith("facture montant")
    assert len(apply(lambda c: text.clean_text_multilingual(c, 100), [long])[0]) == 100


def test_receipts_list_all_items(apply):
    items = ", ".join(f'{{"name": "i{k}", "quantity": 1, "price": 2}}' for k in range(13))
    receipt = f'{{"company": "c", "items": [{items}]}}'
    assert "i12" in apply(text.json_receipt_to_text, [receipt])[0]
    assert "i10" not in apply(lambda c: text.json_receipt_to_text(c, 10), [receipt])[0]
