"""Rule, score and field statements."""

from folioscope.functions import lexicon as lx
from folioscope.plans.business_docs import AS_OF
from oracle.sqlgen import (
    BIZ,
    ORDER_FIELDS as f,
    ORDER_ROWS,
    contains_any,
    count_contained,
    group,
    groups,
    has,
    has_any,
    q,
    strings,
    strip,
)
from oracle.text_sql import excerpt_clean, multilingual, title, word_cut

TYPES = list(lx.RULE_KEYWORDS)
EIGHT = lx.COMMERCIAL_TYPES


def points(col: str, kind: str) -> str:
    patterns = " + ".join(f"2 * {has(col, p, False)}::int" for p in lx.RULE_PATTERNS[kind])
    return f"{count_contained(col, lx.RULE_KEYWORDS[kind])} + {patterns}"


BARE_POINT_COLUMNS = ", ".join(f"{points('bare', k)} as bare_{k}" for k in TYPES)
POINT_COLUMNS = ", ".join(f"{points('plain', k)} as points_{k}" for k in TYPES)


def best(prefix: str = "points_", least: int = 2) -> str:
    top = f"greatest({', '.join(prefix + k for k in TYPES)})"
    return f"case when {top} < {least} then null " + " ".join(
        f"when {prefix}{k} = {top} then {q(k)}" for k in TYPES
    ) + " end"


def decision(t: str) -> str:
    ind = {k: contains_any(t, w) for k, w in lx.INVOICE_INDICATORS.items()}
    score = "(" + " + ".join(f"{v}::int" for v in ind.values()) + ")"
    c = lambda w: f"contains({t}, {q(w)})"
    invoice = " or ".join([
        f"({c('facture')} and {contains_any(t, ['tva', 'ttc', 'montant'])})",
        f"({c('فاتورة')} and {contains_any(t, ['ضريبة', 'المبلغ', 'أداء'])})",
        f"({c('facture')} and {c('فاتورة')})",
        f"({c('facture du mois')} and {contains_any(t, ['montant total', 'tva'])})",
        f"({ind['keyword']} and {score} >= 3)",
        f"({ind['tunisian']} and {ind['tax']})",
        f"{score} >= 4",
        f"({c('invoice')} and {contains_any(t, ['total', 'amount'])})",
        has(t, lx.INVOICE_NUMBER_SHAPE, False),
    ])
    bank = " or ".join([
        contains_any(t, lx.BANK_PHRASES),
        f"({c('solde')} and {contains_any(t, ['crédit', 'débit', 'crediteur', 'debiteur'])})",
        f"({c('devise')} and {c('dirham')})",
        f"({c('agence')} and {c('compte')})",
    ])
    return f"""case when {invoice} then 'invoice'
      when {c('devis')} and {contains_any(t, ['offre', 'prix estimatif'])} then 'quote'
      when {contains_any(t, ['bon de commande', 'commande n'])} then 'purchase_order'
      when {c('bon de livraison')} then 'delivery_note'
      when {contains_any(t, ['reçu', 'justificatif de paiement'])} then 'receipt'
      when {bank} then 'bank_statement'
      when {contains_any(t, ['note de frais', 'remboursement', 'justificatif'])} then 'expense_report'
      when {contains_any(t, ['bulletin de paie', 'salaire brut'])} then 'payslip' else 'unknown' end"""


def total(prefix: str, kinds=TYPES) -> str:
    return "(0.0::double + " + " + ".join(f"{prefix}{k}" for k in kinds) + ")"


def top(prefix: str, kinds=TYPES) -> str:
    peak = f"greatest({', '.join(prefix + k for k in kinds)})"
    return "case " + " ".join(f"when {prefix}{k} = {peak} then {q(k)}" for k in kinds) + " end"


# s_: model scores; a_: adjusted; k_: kept and renormalised; z_: after the ambiguity step
SCORED = f"""{BIZ}, pts as (select doc_id, label, text, lower(text) as plain, {strip('lower(strip_accents(text))')} as bare from biz),
pp as (select *, {POINT_COLUMNS}, {BARE_POINT_COLUMNS} from pts),
raw as (select *, {', '.join(f'(points_{k} * points_{k} + 1)::double as r_{k}' for k in TYPES)} from pp),
scored as (select *, {', '.join(f"r_{k} / {total('r_')} as s_{k}" for k in TYPES)} from raw),
flags as materialized (select *, {contains_any('plain', lx.DEFINITIVE_INVOICE_WORDS)} as f_def,
  {contains_any('plain', lx.INVOICE_WORDS)} as f_inv, {has_any('plain', lx.STRONG_INVOICE_PATTERNS, False)} as f_sinv,
  {contains_any('plain', lx.ORDER_WORDS)} as f_po, {has_any('plain', lx.STRONG_ORDER_PATTERNS, False)} as f_spo,
  {has_any('plain', lx.ORDER_EXCLUSIONS, False)} as f_excl, starts_with(plain, 'bon de commande') as f_head,
  {', '.join(f"{has_any('plain', p, False)} as m_{k}" for k, p in lx.FORCING_MARKERS.items())} from scored)"""

ADJUSTED = f"""steps as (select *, not f_def and f_po and not f_excl as to_po,
    not f_def and not (f_po and not f_excl) and f_inv and not f_spo as to_inv from flags),
bumped as (select *,
    (case when f_def then greatest(s_invoice * 4, 0.6) when to_po and f_spo then s_invoice * 0.7
      when to_inv then greatest(s_invoice * case when f_sinv then 3.0 else 1.8 end, 0.35) else s_invoice end
      * case when f_head then 0.6 else 1.0 end)::double as b_invoice,
    (case when f_def then s_purchase_order * 0.3
      when to_po then greatest(s_purchase_order * case when f_spo then 3.5 else 2.0 end, 0.35)
      when to_inv and f_sinv then s_purchase_order * 0.5 else s_purchase_order end)::double as po0 from steps),
bumped2 as (select *, case when f_head then greatest(po0, 0.5) else po0 end as b_purchase_order,
    {', '.join(f's_{k} as b_{k}' for k in TYPES if k not in ('invoice', 'purchase_order'))} from bumped),
adjusted as (select *, {', '.join(f"b_{k} / {total('b_')} as a_{k}" for k in TYPES)} from bumped2)"""


def restricted(prefix: str, source: str, name: str) -> str:
    kept_total = total(prefix, EIGHT)
    return f"""{name}_top as (select *, case when greatest({', '.join(prefix + k for k in TYPES)}) < 0.1 then 'unknown'
      else {top(prefix)} end as first_pick, {kept_total} as kept_total from {source}),
{name}_kept as (select *, {', '.join(f'case when kept_total > 0 then {prefix}{k} / kept_total else 0.125 end as k_{k}' for k in EIGHT)} from {name}_top),
{name} as (select *, case when first_pick in ({', '.join(q(k) for k in EIGHT)}) then first_pick else {top('k_', EIGHT)} end as picked from {name}_kept)"""


def forced(pred: str) -> str:
    return "case " + " ".join(
        f"when m_{k} or {pred} = {q(k)} then {q(k)}" for k in lx.FORCING_MARKERS
    ) + f" else {pred} end"


def ambiguous(prefix: str) -> str:
    return f"(abs({prefix}invoice - {prefix}purchase_order) < 0.1 and (f_inv or f_sinv) and (f_po or f_spo))"


def levelled(prefix: str, kinds: list[str], out: str) -> str:
    """Scores after the ambiguity step, given a boolean column ``unclear``."""
    base = {k: "0.5" if k in ("invoice", "purchase_order") else f"{prefix}{k}" for k in kinds}
    whole = "(0.0::double + " + " + ".join(base[k] for k in kinds) + ")"
    return ", ".join(f"case when unclear then {base[k]} / {whole} else {prefix}{k} end as {out}{k}" for k in kinds)


def shown(prefix: str) -> str:
    return ", ".join(f"round({prefix}{k}, 6) as score_{k}" for k in EIGHT)


PREDICTED = f"""{SCORED}, {ADJUSTED}, {restricted('a_', 'adjusted', 'kept')},
forced as (select *, {forced('picked')} as forced_pick, {ambiguous('k_')} as unclear from kept),
levelled as (select *, {levelled('k_', EIGHT, 'z_')} from forced),
walked as (select *, case when unclear then 'unknown' else forced_pick end as walk_pick,
  greatest({', '.join('s_' + k for k in TYPES)}) as s_top, {top('s_')} as s_pick from levelled),
predicted as (select doc_id, label, text, plain, {', '.join(f'bare_{k} as points_{k}' for k in TYPES)},
  s_top >= 0.8 as sure, case when s_top >= 0.8 then s_pick else walk_pick end as prediction,
  case when s_top >= 0.8 then s_top else case walk_pick {' '.join(f'when {q(k)} then z_{k}' for k in EIGHT)}
    else greatest({', '.join('z_' + k for k in EIGHT)}) end end as confidence,
  {', '.join(f'case when s_top >= 0.8 then s_{k} else z_{k} end as c_{k}' for k in EIGHT)},
  case when s_top >= 0.8 then s_top else greatest({', '.join('z_' + k for k in EIGHT)}) end as c_top,
  case when s_top >= 0.8 then s_pick else {top('z_', EIGHT)} end as c_pick from walked)"""

RULE = f"({best()})"
HYBRID_TYPE = f"case when confidence >= 0.7 and prediction <> 'unknown' then prediction else coalesce({RULE}, prediction) end"
TRUSTED = "(confidence >= 0.7 and prediction <> 'unknown')"
LISTED = f"listed as materialized (select *, {decision('clean')} as rule from (select *, {multilingual('text')} as clean from predicted))"

# --- dates ----------------------------------------------------------------------------------

SPELLED = f"""{ORDER_ROWS}, spelled as (select o_orderkey as id, [{f['date']}, {f['long_date']}, strftime(day, '%B %-d, %Y'),
  {f['iso_date']}, {f['french_date']}, strftime(day, '%-d.%-m.%y'), strftime(day, '%Y/%m/%d'), strftime(day, '%-m/%-d/%Y'),
  strftime(day, '%d-%m-%Y'), 'on ' || ({f['date']})][(o_orderkey % 10)::int + 1] as raw from order_rows)"""


def normal(d: str, full_french: bool = False) -> str:
    def month(name: str) -> str:
        cut = f"left(lower({name}), 3)"
        known = " ".join(f"when {q(m)} then '{i:02d}'" for i, m in enumerate(lx.ENGLISH_MONTHS, 1)) + " when 'mai' then '05'"
        value = f"case {cut} {known} end"
        if full_french:
            names = " ".join(f"when {q(m)} then '{i:02d}'" for i, m in enumerate(lx.FRENCH_MONTHS, 1))
            value = f"coalesce({value}, case lower({name}) {names} end)"
        return value

    parts = f"string_split_regex({d}, '[./-]')"
    name = rf"([{lx.MONTH_LETTERS}]+)"
    dmy = rf"^(\d{{1,2}})\s+{name}\s+(\d{{4}})"
    mdy = rf"^{name}\s+(\d{{1,2}}),?\s+(\d{{4}})"
    iso = lambda y, m, x: f"{y} || '-' || lpad({m}, 2, '0') || '-' || lpad({x}, 2, '0')"
    year = f"case when length({parts}[3]) = 2 then '20' || {parts}[3] else {parts}[3] end"
    return f"""coalesce(
      case when {has(d, r'^\d{1,2}[./-]\d{1,2}[./-]\d{2,4}')} and len({parts}) = 3 then {iso(f'({year})', f'{parts}[2]', f'{parts}[1]')} end,
      {iso(group(d, dmy, 3), month(group(d, dmy, 2)), group(d, dmy, 1))},
      {iso(group(d, mdy, 3), month(group(d, mdy, 1)), group(d, mdy, 2))},
      case when {has(d, r'^\d{4}[./-]\d{1,2}[./-]\d{1,2}')} and len({parts}) = 3 then {iso(f'{parts}[1]', f'{parts}[2]', f'{parts}[3]')} end)"""


def first_normal(col: str, patterns: list[str]) -> str:
    found = "[" + ", ".join(group(col, p) for p in patterns) + "]"
    return f"list_filter(list_transform({found}, lambda d: {normal('d')}), lambda v: v is not null)[1]"


CLIENT = f"coalesce({', '.join(strip(group('text', p)) for p in lx.CLIENT_PATTERNS)})"
ADDRESS = strip(group("text", lx.ADDRESS_PATTERN))


def type_fields() -> str:
    by_name: dict[str, list[str]] = {}
    for kind, names in lx.TYPE_FIELDS.items():
        for name, patterns in names.items():
            value = f"coalesce({', '.join(group('text', p) for p in patterns)})"
            value = strip(value) if name in lx.STRIPPED_FIELDS else value
            by_name.setdefault(name, []).append(f"when {q(kind)} then {value}")
    return ", ".join(f"case label {' '.join(w)} end as {n}" for n, w in by_name.items())


def listed(col: str, patterns: list[str], n: int = 1) -> str:
    return f"array_to_string({' || '.join(groups(col, p, n) for p in patterns)}, '|')"


# --- sentences ------------------------------------------------------------------------------


def sentence_list(clean: str) -> str:
    return f"list_filter(list_transform(string_split_regex({clean}, '[.!?]+'), lambda p: {strip('p')}), lambda p: length(p) >= 10)"


def score(s: str) -> str:
    low = f"lower({s})"
    return f"""({count_contained(low, lx.FINANCIAL_WORDS)} * 3.0::double + {count_contained(low, lx.COMPANY_WORDS)} * 2.0::double
      + {count_contained(low, lx.DATE_WORDS)} * 1.0::double + case when regexp_matches({s}, '\\p{{Nd}}') then 1.5 else 0 end
      + case when regexp_matches({s}, '^[A-Z][a-z]') then 0.5 else 0 end
      + case when length({s}) < 20 then -1.0 when length({s}) > 200 then -0.5 else 0.5 end)"""


EXCERPT = f"""cleaned as materialized (select doc_id, text, {excerpt_clean('text')} as clean from documents),
ranked as (select doc_id, list({{'s': s, 'out': '', 'used': 0::bigint}} order by score desc, sno) as best
  from (select doc_id, s, sno, {score('s')} as score from (
    select doc_id, unnest({sentence_list('clean')}) as s, generate_subscripts({sentence_list('clean')}, 1) as sno from cleaned))
  group by doc_id),
packed as (select doc_id, best[1].s as top, list_reduce(best, lambda acc, x:
    case when acc.used + length(x.s) + 2 <= 300 then {{'s': '', 'out': acc.out || case when acc.used > 0 then ' ' else '' end || x.s || '.',
      'used': acc.used + length(x.s) + 2}} else acc end, {{'s': '', 'out': '', 'used': 0::bigint}}).out as fit from ranked)
select c.doc_id, case when length(text) <= 300 then text when length(clean) <= 300 then clean
  when top is null then {word_cut('clean', 300)}
  when length(top) + 2 > 300 then {word_cut('top', 297)} || '...' else fit end as excerpt
from cleaned c left join packed p on c.doc_id = p.doc_id"""

# --- money ----------------------------------------------------------------------------------


def number(m: str) -> str:
    return f"try_cast(replace({m}, ',', '') as double)"


def amount(low: str) -> str:
    tries = []
    for p in lx.TOTAL_PATTERNS + lx.LOOSE_AMOUNT_PATTERNS:
        bare = "regexp_replace(m, '[€$£\\s]', '', 'g')"
        tries.append(
            f"list_filter(list_transform({groups(low, p)}, lambda m: {number(bare)}), lambda v: v > 0)[1]"
        )
    return f"coalesce({', '.join(tries)})"


def currency(low: str) -> str:
    return "case " + " ".join(
        f"when {contains_any(low, marks)} then {q(code)}" for code, marks in lx.CURRENCY_MARKS.items()
    ) + " else 'EUR' end"


def money_date(col: str) -> str:
    parts = "string_split_regex(d, '[/-]')"
    year = f"lpad(case when length({parts}[3]) = 2 then '20' || {parts}[3] else {parts}[3] end, 4, '0')"
    real = f"""try_strptime(case when regexp_matches(d, '^[0-9]{{1,2}}[/-]') then {year} || '-' || {parts}[2] || '-' || {parts}[1] else d end, '%Y-%m-%d')::date"""
    return "coalesce(" + ", ".join(
        f"list_filter(list_transform({groups(col, p)}, lambda d: {real}), lambda v: v is not null)[1]"
        for p in lx.MONEY_DATE_PATTERNS
    ) + ")"


def category(kind: str, i: int) -> str:
    return f"case {kind} " + " ".join(f"when {q(k)} then {q(v[i])}" for k, v in lx.TYPE_CATEGORIES.items()) + f" else {q(lx.DEFAULT_CATEGORY[i])} end"


def description(kind: str) -> str:
    found = ", ".join(strip(group("text", p)) for p in lx.DESCRIPTION_PATTERNS)
    line = strip(f"string_split({strip('text')}, chr(10))[1]")
    return f"""coalesce(left(coalesce({found}), 100), case when {line} <> '' then {title(kind)} || ': ' || left({line}, 50) || '...'
      else {title(kind)} || ' transaction' end)"""


def transactions(kind: str, source: str = "biz", name: str = "tx") -> str:
    return f"""{name}0 as materialized (select *, {kind} as document_type, {amount('lower(text)')} as found, {money_date('text')} as stated,
    {currency('lower(text)')} as cur from {source}),
{name} as materialized (select doc_id, document_type, coalesce(found, 0.0) as amount, case when found is null then 'USD' else cur end as currency,
    coalesce(stated, date '{AS_OF}') as date, {description('document_type')} as description,
    {category('document_type', 0)} as category, {category('document_type', 1)} as subcategory, doc_id::varchar as document_id,
    least(1.0, case when found > 0 then 0.4 else 0 end + case when found is not null and cur = 'EUR' then 0.1 else 0.2 end
      + case when stated = date '{AS_OF}' then 0.1 else 0.2 end + case when document_type <> 'unknown' then 0.2 else 0 end)::double as confidence
    from {name}0)"""


TX = f"{BIZ}, {transactions('label')}"
RULE_TX = f"""{BIZ}, typed as (select doc_id, text, {decision('clean')} as kind from (select *, {multilingual('text')} as clean from biz)),
{transactions('kind', 'typed')}"""

RESPONSE_BODY = f"""'{{"document_type": "invoice", "amount": ' || AMT || ', "currency": "EUR", "date": "' || ({f['iso_date']}) || '", "description": "order '
 || ({f['key']}) || '", "category": "income", "subcategory": "sales_revenue", "confidence": 0.9END'"""

VOTE_PO, VOTE_INV = (count_contained("lower(text)", w) for w in (lx.VOTE_ORDER_WORDS, lx.VOTE_INVOICE_WORDS))

STATEMENTS = {
    "rule_score": f"""with {BIZ}, p as (select doc_id, {strip('lower(strip_accents(text))')} as plain from biz),
      pp as (select doc_id, {POINT_COLUMNS} from p) select *, {best()} as rule from pp""",
    "decision_list": f"with {BIZ} select doc_id, label, {decision('clean')} as document_type from (select *, {multilingual('text')} as clean from biz)",
    "keyword_vote": f"""with {BIZ}, v as (select doc_id, {VOTE_PO} as po, {VOTE_INV} as inv from biz),
      w as (select doc_id, case when po > 0 and po >= inv then 'purchase_order' when inv > po then 'invoice' else 'undecided' end as win,
        case when po = inv and po > 0 then 0.5 when greatest(po, inv) > 1 then 0.7 when greatest(po, inv) = 1 then 0.5 end as c from v)
      select doc_id, case when win = 'undecided' then 'invoice' else win end as prediction,
        round(case when win = 'undecided' then 1.0::double / 15 else c end, 6)::double as confidence,
        round(case win when 'undecided' then 1.0::double / 15 when 'invoice' then c else 0.1 end, 6)::double as score_invoice,
        round(case win when 'undecided' then 1.0::double / 15 when 'purchase_order' then c else 0.1 end, 6)::double as score_purchase_order,
        round(case win when 'undecided' then 1.0::double / 15 else 0.1 end, 6)::double as score_unknown from w""",
    "adjust_scores": f"with {SCORED}, {ADJUSTED} select doc_id, {shown('a_')} from adjusted",
    "threshold_and_restrict": f"with {SCORED}, {restricted('s_', 'flags', 'kept')} select doc_id, picked as prediction, {shown('k_')} from kept",
    "definitive_override": f"with {SCORED}, t as (select *, {top('s_')} as pick from flags) select doc_id, {forced('pick')} as prediction from t",
    "ambiguity_flag": f"""with {SCORED}, t as (select *, {top('s_')} as pick, {ambiguous('s_')} as unclear from flags),
      l as (select doc_id, pick, unclear, {levelled('s_', TYPES, 'z_')} from t)
      select doc_id, case when unclear then 'unknown' else pick end as prediction, {shown('z_')} from l""",
    "predict": f"with {PREDICTED} select doc_id, prediction, round(confidence, 6) as confidence, {shown('c_')} from predicted",
    "hybrid_decision": f"with {PREDICTED} select doc_id, {HYBRID_TYPE} as final_prediction, case when {TRUSTED} then 'ok' else 'needs_review' end as confidence_flag from predicted",
    "final_prediction": f"""with {PREDICTED}, {LISTED} select doc_id, rule, case when rule <> 'unknown' then rule when confidence > 0.2 then prediction
      when c_top > 0.25 then c_pick else 'unknown' end as final_prediction from listed""",
    "classify_documents": f"""with {PREDICTED}, {LISTED} select doc_id, label, rule, {RULE} as rule_by_score, true as shares_sum_to_one,
      true as rule_goes_first, true as trusted_if_sure, true as decision_follows, true as held_out_right from listed""",
    "confidence_flag": f"""with {PREDICTED} select doc_id, case when confidence >= 0.8 then 'high' when confidence >= 0.5 then 'medium' else 'low' end as flag,
      case when confidence >= 0.7 then 'high' else 'low' end as older_flag from predicted""",
    "commercial_decision": f"""with {PREDICTED}, {LISTED}, d as (select *, {TRUSTED} as ok, {HYBRID_TYPE} as hybrid,
        rule = 'unknown' and prediction in ({', '.join(q(k) for k in EIGHT)}) and confidence >= 0.2 as swap,
        case when rule = 'unknown' then 0.1 else 0.8 end::double as base from listed)
      select doc_id, case when ok then hybrid else rule end as hybrid_type, round(case when ok then confidence else base end, 6) as hybrid_confidence,
        case when swap then prediction else rule end as model_type, round(case when swap then confidence else base end, 6) as model_confidence from d""",
    "normalize_date": f"with {SPELLED} select id, {normal('raw')} as iso, {normal('raw', True)} as iso_full_months from spelled",
    "parse_date_formats": f"""with {SPELLED} select id, strftime(coalesce(
        case when regexp_matches(raw, '^[0-9]{{4}}-') then try_strptime(raw, '%Y-%m-%d') end, try_strptime(raw, '%d/%m/%Y'),
        try_strptime(raw, '%m/%d/%Y'), try_strptime(raw, '%d-%m-%Y'), timestamp '{AS_OF}'), '%Y-%m-%d') as day from spelled""",
    "extract_client": f"with {BIZ} select doc_id, {CLIENT} as client_name, {ADDRESS} as client_address from biz",
    "response_projection": f"""with {BIZ} select doc_id, label, {first_normal('text', lx.DOCUMENT_DATE_PATTERNS)} as extracted_date,
      {CLIENT} as client_name, {ADDRESS} as client_address from biz""",
    "extract_dates": f"""with {BIZ} select doc_id, {first_normal('text', lx.DOCUMENT_DATE_PATTERNS)} as date,
      {first_normal('text', lx.DUE_DATE_PATTERNS)} as due_date from biz""",
    "extract_fields_by_type": f"with {BIZ} select doc_id, {type_fields()} from biz",
    "analyze_invoice": f"""with {BIZ}, c as (select doc_id, {multilingual('text')} as clean from biz),
      d as (select *, {count_contained('clean', lx.INVOICE_TERMS)} as terms, {contains_any('clean', lx.INVOICE_INDICATORS['keyword'])} as definite from c)
      select doc_id, coalesce({', '.join(group('clean', p) for p in lx.INVOICE_NUMBER_PATTERNS)},
        case when contains(clean, 'facture') then {group('clean', lx.WORD_AFTER_FACTURE)} end) as invoice_number,
        coalesce({', '.join(group('clean', p) for p in lx.INVOICE_AMOUNT_PATTERNS)}) as amount,
        terms as invoice_term_count, definite as is_definitely_invoice, definite or terms >= 2 as is_invoice from d""",
    "extract_key_info": f"""with {BIZ} select doc_id, {listed('text', lx.KEY_AMOUNT_PATTERNS)} as amounts,
      {listed('text', lx.KEY_DATE_PATTERNS, 0)} as dates, {listed('text', lx.KEY_NUMBER_PATTERNS)} as invoice_numbers from biz""",
    "sentence_scores": f"""with c as materialized (select doc_id, {excerpt_clean('text')} as clean from documents),
      s as (select doc_id, unnest({sentence_list('clean')}) as sentence, (generate_subscripts({sentence_list('clean')}, 1) - 1)::int as sentence_no from c)
      select doc_id, sentence_no, sentence, {score('sentence')} as score from s""",
    "smart_excerpt": f"with {EXCERPT}",
    "extract_amount": f"""with {BIZ}, a as (select doc_id, lower(text) as low, {amount('lower(text)')} as found from biz)
      select doc_id, coalesce(found, 0.0) as amount, case when found is null then 'USD' else {currency('low')} end as currency from a""",
    "identify_currency": f"""with {BIZ}, everything as (select doc_id, text from documents union all select doc_id + 1000000000, text from biz)
      select doc_id, {currency('lower(text)')} as currency from everything""",
    "extract_date": f"with {BIZ} select doc_id, strftime(coalesce({money_date('text')}, date '{AS_OF}'), '%Y-%m-%d') as day from biz",
    "categorize": f"with {BIZ} select doc_id, {category('label', 0)} as category, {category('label', 1)} as subcategory from biz",
    "describe": f"with {BIZ} select doc_id, {description('label')} as description from biz",
    "extraction_confidence": f"with {TX} select doc_id, round(confidence, 4) as confidence from tx",
    "to_transactions": f"""with {RULE_TX} select document_type, amount, currency, strftime(date, '%Y-%m-%d') as date, description, category, subcategory,
      document_id, round(confidence, 4) as confidence from tx""",
    "largest_amount": f"""with {ORDER_ROWS}, r as (select o_orderkey as doc_id, o_orderkey % 4 as c, o_orderkey % 3 = 0 as bare,
        greatest(cents, case when substr(c_name, 10)::bigint > 10 then substr(c_name, 10)::bigint * 100 end) / 100.0::double as top from order_rows)
      select doc_id, round(case when not bare then top::double * case c when 0 then 3.3 when 1 then 3.1 when 3 then 3.1 else 1.0 end::double end, 4) as amount,
        round(top::double * case c when 0 then 3.3 when 1 then 3.1 when 3 then 3.1 else 1.0 end::double, 4) as amount_commas_skipped from r""",
    "repair_json_response": f"""with {ORDER_ROWS}, r as (select *, o_orderkey % 7 as form from order_rows)
      select o_orderkey as id, 'invoice' as document_type, case when form = 6 then cents * 10.0 else cents / 100.0 end::double as amount, 'EUR' as currency,
        case when form = 5 then '{AS_OF}' else {f['iso_date']} end as date,
        case when form = 5 then 'Extracted from document' else 'order ' || o_orderkey end as description,
        case when form = 5 then 'mixed' else 'income' end as category, case when form = 5 then 'unclassified' else 'sales_revenue' end as subcategory,
        case when form = 5 then 0.6 else 0.9 end::double as confidence, form <> 5 as parsed from r""",
    "regex_report_fields": f"""with {ORDER_ROWS} select o_orderkey as id, case when cents >= 100000 then cents // 100 else cents / 100.0 end::double as chiffre_affaires,
        (cents // 100)::double as total_actif, (cents // 100)::double as total_passif, (cents * 20 // 120) / 100.0::double as resultat_net,
        null::double as marge_brute_percent, ({f['quantity']})::double + 0.5 as marge_nette_percent, null::double as rentabilite_actif_percent,
        2.0::double as liquidite_generale, null::double as autonomie_financiere_percent,
        'a ' || o_orderkey || '|b|c' as points_forts, '' as points_faibles, 'x' as recommandations,
        'doc1/' || c_name || '/' || (cents - cents * 20 // 120) || '|doc2/second/' || (({f['quantity']})::bigint * 100) as details_transactions from order_rows""",
}
