"""Text and label statements."""

from folioscope.functions import lexicon as lx
from oracle.sqlgen import (
    BIZ,
    ORDER_FIELDS as f,
    ORDER_ROWS,
    case_words,
    collapse,
    contains_any,
    has_any,
    pat,
    q,
    strings,
    strip,
    sub,
    subs,
)

UNPRINTABLE = (r"[^\x20-\x7E\n\r\t]", " ")
COORDINATES = (r"\d+,\d+,\d+,\d+", " ")
MARKS = (r"""[^\w\s.,!?\-:;()\[\]{}"'/@#$%&*+=]""", " ")


def _capitals(col: str) -> str:
    # the text is ASCII here, so the plain word edge is exact
    return f"regexp_replace({col}, '\\b[A-Z]{{10,}}\\b', ' ', 'g')"


def basic(col: str) -> str:
    first = _capitals(subs(f"coalesce({col}, '')", [UNPRINTABLE]))
    return collapse(subs(first, [COORDINATES, (r"\[PAD\]|\[unused\d+\]", " ")]))


def training(col: str) -> str:
    first = _capitals(subs(f"coalesce({col}, '')", [UNPRINTABLE]))
    steps = [
        (r"\s{2,}", " "), COORDINATES, (r"\[PAD\]|\[unused\d+\]|\[CLS\]|\[SEP\]", " "), MARKS,
        (r"\.{3,}", " "), (r"-{3,}", " "),
    ]
    return collapse(subs(first, steps))


def punctuation(col: str) -> str:
    steps = [MARKS, (r"\.{3,}", "..."), (r"-{3,}", "---"), (r"\s*([.,:;!?])\s*", r"\1 ")]
    return collapse(subs(collapse(f"coalesce({col}, '')"), steps))


def multilingual(col: str) -> str:
    lowered = f"replace(replace(lower(coalesce({col}, '')), chr(8207), ' '), chr(8206), ' ')"
    steps = [
        (r"([\x{600}-\x{6FF}])([^\x{600}-\x{6FF}\s])", r"\1 \2"),
        (r"([^\x{600}-\x{6FF}\s])([\x{600}-\x{6FF}])", r"\1 \2"),
        (r"[^\w\s\x{600}-\x{6FF}]", " "),
    ]
    return collapse(subs(lowered, steps))


def excerpt_clean(col: str) -> str:
    """Repeats of four or more cut to two, decided character by character."""
    kept = subs(f"coalesce({col}, '')", [(r"\s+", " "), (r"[^\w\s.,;:!?\-€$£¥₹()/]", "")])
    return strip(
        f"""array_to_string(list_transform([string_split({kept}, '')], lambda l: array_to_string(
        list_filter(l, lambda x, i: not (i > 2 and x = l[i - 1] and x = l[i - 2]
          and not ((i = 3 or l[i - 3] <> x) and coalesce(l[i + 1], '') <> x))), '')), '')"""
    )


def title(col: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({col}, '_'), lambda p: upper(p[1]) || p[2:]), '_')"
    )


def word_cut(col: str, n: int) -> str:
    at = f"({n} - strpos(reverse(left({col}, {n})), ' '))"
    return (
        f"case when length({col}) <= {n} then {col} "
        f"when contains(left({col}, {n}), ' ') and {at} > {n * 0.8!r} then left({col}, {at}) || '...' "
        f"else left({col}, {n - 3}) || '...' end"
    )


RECEIPTS = f"""{ORDER_ROWS}, receipts as (
  select o_orderkey as doc_id, c_mktsegment as label, o_orderkey % 7 as kind, *,
    case o_orderkey % 7 when 0 then 'Receipt ' || ({f['key']}) || ' Total ' || ({f['amount']})
      when 1 then '{{"company": ' || c_name else null end as plain,
    'Company: ' || c_name || chr(10) || 'Date: ' || ({f['date']}) || chr(10) || 'Total: ' ||
    case when o_orderkey % 2 = 0 then 'RM' || ({f['amount']}) else ({f['quantity']}) end || chr(10) || 'Items:' || chr(10) ||
    array_to_string(list_transform(range(1, o_orderkey % 13 + 2),
      lambda i: '- Item ' || i || ' | Qty: ' || i || ' | Price: ' || ({f['unit']})), chr(10)) || chr(10) ||
    'Cashier_Name: ' || c_mktsegment || chr(10) || 'Till: ' || ({f['quantity']}) as readable
  from order_rows)"""

KINDS = strings([
    "Invoice ", "billing record", "Payment slip", "service agreement", "Purchase Order", "delivery_note",
    "bank statement", "Expense Report", "salary sheet", "Legal letter", "email form", "quotation", "",
])
RAW = f"""raw_labels as (select p_partkey as id,
  {KINDS}[(p_partkey % 13)::int + 1] || case when p_size > 25 then ' ' || p_type else '' end as raw from part)"""

LOW = f"{strip('lower(raw)')}"
STANDARD = f"""case when raw = '' then 'document'
  when {LOW} in ({', '.join(q(k) for k in lx.STANDARD_LABELS)}) then
    case {LOW} {' '.join(f'when {q(k)} then {q(v)}' for k, v in lx.STANDARD_LABELS.items())} end
  else coalesce({case_words(LOW, [(v, [k]) for k, v in lx.STANDARD_LABELS.items()])},
    regexp_replace({LOW}, '[^a-z0-9_]', '_', 'g')) end"""

BOOST = f"""{BIZ}, base as (select doc_id, {multilingual('text')} as t from biz),
flags as (select doc_id, t, {has_any('t', lx.BOOST_INVOICE_PATTERNS, False)} as inv,
  list_reduce({strings(sorted(lx.KEPT_KEYWORDS))}, lambda acc, k:
    case when contains(' ' || acc, ' ' || k || ' ') then acc || ' ' || k || ' ' || k else acc end, t) as g from base),
more as (select *, {has_any('g', lx.BOOST_ORDER_PATTERNS, False)} as ord from flags)
select doc_id, case
  when ord and inv then replace(replace(folded, 'invoice invoice invoice', 'invoice'), 'facture facture facture', 'facture')
  when ord then folded
  when inv then g || {q(''.join(f' {w}' * 5 for w in lx.BOOST_INVOICE_WORDS))} else g end as text
from (select *, regexp_replace(regexp_replace(g || {q(''.join(f' {w}' * 5 for w in lx.BOOST_ORDER_WORDS))},
  '(invoice ){{3,}}', 'invoice ', 'g'), '(facture ){{3,}}', 'facture ', 'g') as folded from more)"""

PROBLEM = """case when contains(raw, ' ') and contains(raw, '_') then 'Mixed separators: ''' || raw || ''''
  when raw <> lower(raw) then 'Not lowercase: ''' || raw || ''''
  when regexp_matches(raw, '[^a-z0-9_\\s]') then 'Special characters: ''' || raw || '''' end"""

DROPPED = sorted((set(lx.STOPWORDS) - set(lx.KEPT_KEYWORDS)) | {"_"})

STATEMENTS = {
    "clean_text_basic": f"select doc_id, {basic('text')} as text from documents",
    "clean_training_text": f"select * from (select doc_id, {training('text')} as text from documents) where length(text) >= 30",
    "clean_punctuation": f"select doc_id, {punctuation('text')} as text from documents",
    "clean_text_multilingual": f"""with {BIZ}, everything as (select doc_id, text from documents
      union all select doc_id + 1000000000, text from biz)
      select doc_id, text, length(text) < 50 as too_short from (
      select doc_id, {multilingual('text')} as text from everything)""",
    "clean_for_excerpt": f"select doc_id, {excerpt_clean('text')} as text from documents",
    "json_receipt_to_text": f"with {RECEIPTS} select doc_id, case when kind > 1 then readable end as text from receipts",
    "apply_cleaned": f"with {RECEIPTS} select doc_id, label, case when kind > 1 then readable else plain end as text from receipts",
    "unwrap_json_text": """select doc_id, case when doc_id % 3 = 0 then json_extract_string(to_json({'text': text}), '$.text')
      when doc_id % 3 = 1 then '{"text" ' || text else text end as text from documents""",
    "strip_accents": f"select doc_id, {strip('lower(strip_accents(text))')} as text from documents",
    "tokenize_filter": f"""select doc_id, array_to_string(list_filter(regexp_extract_all({multilingual('text')},
      {pat(r'\w+', False)}), lambda t: not list_contains({strings(DROPPED)}, t)), ' ') as tokens from documents""",
    "boost_keywords": f"with {BOOST}",
    "truncate_for_embedding": f"select doc_id, left({strip('text')}, 3072) as text from documents",
    "truncate_at_word": f"select doc_id, {word_cut('text', 200)} as text from documents",
    "prepare_report_text": f"select doc_id, left(text, 3000) as text from documents where length({strip('text')}) > 10",
    "map_label_standard": f"with {RAW} select id, raw, {STANDARD} as label from raw_labels",
    "map_label_commercial": f"with {RAW} select id, coalesce({case_words('lower(raw)', lx.COMMERCIAL_LABEL_WORDS)}, replace(lower(raw), ' ', '_')) as label from raw_labels",
    "map_label_company": f"with {RAW} select id, coalesce({case_words('lower(raw)', lx.COMPANY_LABEL_WORDS)}, replace(lower(raw), ' ', '_')) as label from raw_labels",
    "infer_label": f"""with {BIZ} select doc_id, case when doc_id % 5 in (0, 1) then label else coalesce(
      case when doc_id % 5 = 2 then {case_words("label || '_17.pdf'", lx.FILE_NAME_LABEL_WORDS)} end,
      {case_words('lower(text)', lx.TEXT_LABEL_WORDS)}, 'document') end as label from biz""",
    "merge_and_drop_small": f"""with {RAW}, merged as (select id, case when raw = 'quotation' then 'purchase_order' else raw end as label from raw_labels)
      select id, label from merged where label in (select label from merged group by label having count(*) >= 60)""",
    "lint_labels": f"with {RAW} select distinct raw as label, {PROBLEM} as problem from raw_labels where ({PROBLEM}) is not null",
}
