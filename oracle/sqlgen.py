"""Small helpers that write DuckDB expressions."""

from __future__ import annotations

from collections.abc import Iterable

from folioscope.functions.patterns import BLANK_CHARS, portable
from folioscope.functions.lexicon import FRENCH_MONTHS
from folioscope.sources.templates import COMMERCIAL_KINDS, TEMPLATES, template_parts


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pat(pattern: str, ic: bool = True) -> str:
    return q(("(?i)" if ic else "") + portable(pattern))


def has(col: str, pattern: str, ic: bool = True) -> str:
    return f"regexp_matches({col}, {pat(pattern, ic)})"


def has_any(col: str, patterns: Iterable[str], ic: bool = True) -> str:
    return "(" + " or ".join(has(col, p, ic) for p in patterns) + ")"


def contains_any(col: str, words: Iterable[str]) -> str:
    return "(" + " or ".join(f"contains({col}, {q(w)})" for w in words) + ")"


def count_contained(col: str, words: Iterable[str]) -> str:
    return "(" + " + ".join(f"contains({col}, {q(w)})::int" for w in words) + ")"


def group(col: str, pattern: str, n: int = 1, ic: bool = True) -> str:
    return f"nullif(regexp_extract({col}, {pat(pattern, ic)}, {n}), '')"


def groups(col: str, pattern: str, n: int = 1, ic: bool = True) -> str:
    return f"regexp_extract_all({col}, {pat(pattern, ic)}, {n})"


def sub(col: str, pattern: str, to: str, ic: bool = False) -> str:
    return f"regexp_replace({col}, {pat(pattern, ic)}, {q(to)}, 'g')"


def subs(col: str, steps: list[tuple[str, str]]) -> str:
    for p, to in steps:
        col = sub(col, p, to)
    return col


def strip(col: str) -> str:
    return f"trim({col}, {q(BLANK_CHARS)})"


def collapse(col: str) -> str:
    return strip(sub(col, r"\s+", " "))


def strings(words: Iterable[str]) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def money(cents: str) -> str:
    return f"(({cents}) // 100)::varchar || '.' || lpad((({cents}) % 100)::varchar, 2, '0')"


ORDER_FIELDS = {
    "key": "o_orderkey::varchar",
    "date": "strftime(day, '%d/%m/%Y')",
    "due_date": "strftime(day + 30, '%d/%m/%Y')",
    "iso_date": "strftime(day, '%Y-%m-%d')",
    "long_date": "strftime(day, '%-d %B %Y')",
    "due_long": "strftime(day + 30, '%-d %B %Y')",
    "french_date": f"day(day)::varchar || ' ' || {strings(FRENCH_MONTHS)}[month(day)] || ' ' || year(day)::varchar",
    "customer": "c_name",
    "segment": "c_mktsegment",
    "address": "(c_nationkey + 1)::varchar || ' Rue ' || c_mktsegment",
    "country": "'Zone ' || c_nationkey::varchar",
    "symbol": "['$', '€', '£', 'TND'][(o_orderkey % 4)::int + 1]",
    "amount": money("cents"),
    "tax": money("cents * 20 // 120"),
    "subtotal": money("cents - cents * 20 // 120"),
    "unit": money("cents // 7"),
    "quantity": "(o_orderkey % 48 + 1)::varchar",
    "commas": "case when cents >= 100000 then (cents // 100000)::varchar || ',' || lpad((cents // 100 % 1000)::varchar, 3, '0')"
    " else (cents // 100)::varchar end || '.' || lpad((cents % 100)::varchar, 2, '0')",
}

ORDER_ROWS = """order_rows as (
  select o.*, c.*, cast(o_orderdate as date) as day, cast(round(o_totalprice * 100) as bigint) as cents
  from orders o join customer c on o_custkey = c_custkey)"""


def documents_cte(name: str = "biz", kinds: list[str] = COMMERCIAL_KINDS) -> str:
    n = len(kinds)
    cases = []
    for i, kind in enumerate(kinds):
        for v, template in enumerate(TEMPLATES[kind]):
            text = " || ".join(
                f"({ORDER_FIELDS[p]})" if is_field else q(p) for p, is_field in template_parts(template)
            )
            cases.append(
                f"when o_orderkey % {n} = {i} and (o_orderkey // {n}) % {len(TEMPLATES[kind])} = {v} then {text}"
            )
    return (
        f"{ORDER_ROWS},\n{name} as (select o_orderkey as doc_id, "
        f"{strings(kinds)}[(o_orderkey % {n})::int + 1] as label, case {' '.join(cases)} end as text from order_rows)"
    )


BIZ = documents_cte()


def case_words(col: str, table: list[tuple[str, list[str]]]) -> str:
    return "case " + " ".join(f"when {contains_any(col, words)} then {q(to)}" for to, words in table) + " end"
