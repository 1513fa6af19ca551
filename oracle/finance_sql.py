"""Finance statements."""

from folioscope.functions import lexicon as lx
from folioscope.plans.business_docs import AS_OF
from oracle.rule_sql import RULE_TX, TX
from oracle.sqlgen import ORDER_ROWS, q


def when(category: str, value: str = "amount") -> str:
    return f"coalesce(sum({value}::decimal(20,6)) filter (where category = {q(category)}), 0)::double"


SUMS = f"{when('income')} as income, {when('expense')} as expense, {when('potential_income')} as potential"
SUMMARY = """round(income, 2) as total_income, round(expense, 2) as total_expenses, round(potential, 2) as potential_income,
  round(income - expense, 2) as net_result, round(case when income > 0 then (income - expense) / income * 100 else 0 end, 2)::double as profit_margin_percent"""


def advice(limit: int = 5) -> str:
    checks = [
        ("expense > income", lx.ADVICE_COSTS),
        ("expense <= income and income > expense * 2", lx.ADVICE_CASH),
        ("potential > income * 0.5", lx.ADVICE_POTENTIAL),
        ("quotes > invoices", lx.ADVICE_QUOTES),
        ("currencies > 2", lx.ADVICE_CURRENCIES),
        ("n < 5", lx.ADVICE_FEW_ROWS),
    ]
    found = ", ".join(f"case when {c} then {q(m)} end" for c, m in checks)
    return f"array_to_string(list_filter([{found}], lambda m: m is not null)[1:{limit}], '|')"


FACTS = f"""facts as (select {SUMS}, count(*) filter (where document_type = 'quote') as quotes,
  count(*) filter (where document_type = 'invoice') as invoices, count(distinct currency) as currencies, count(*) as n from SOURCE)"""

LEDGER = " union all ".join(
    f"select document_id, {q(account)} as account, {q(side)} as side, amount from tx where document_type = {q(kind)}"
    for kind, pair in lx.LEDGER_ACCOUNTS.items()
    for side, account in zip(("debit", "credit"), pair)
    if account
)

LINES = """lines as (select l_orderkey || '-' || l_linenumber as document_id, case when l_returnflag = 'R' then 'receipt' else 'invoice' end as type,
  unnest([{'kind': 'revenue', 'amount': l_extendedprice, 'description': 'line price'},
    {'kind': 'expense', 'amount': l_extendedprice * l_discount, 'description': 'discount'},
    {'kind': 'tax', 'amount': l_extendedprice * l_tax, 'description': 'tax'}], recursive := true) from lineitem)"""

SHEET = f"""{ORDER_ROWS}, rev as (select c_custkey as customer, sum(cents)::bigint / 100.0::double as r from order_rows group by c_custkey),
  a as (select *, trunc(r * 0.65)::bigint as receivables, trunc(r * 0.25)::bigint as cash, trunc(r * 0.08)::bigint as profit,
    trunc(r * 0.15)::bigint as tax from rev),
  b as (select *, receivables + cash as assets, trunc((receivables + cash) * 0.75)::bigint as capital from a),
  c as (select *, assets - capital - profit - tax as other from b)"""

TURNOVER = f"{ORDER_ROWS}, t as (select o_orderkey as id, (cents // 100)::double as r from order_rows)"

share = lambda s: f"trunc(r * {s})::bigint"

STATEMENTS = {
    "period_filter": f"with {TX} select document_id, strftime(date, '%Y-%m-%d') as date, amount, currency from tx where date >= date '{AS_OF}' - 365",
    "category_totals": f"with {TX}, s as (select {SUMS} from tx) select {SUMMARY} from s",
    "currency_breakdown": f"""with {TX}, s as (select currency, {SUMS} from tx group by currency)
      select currency, round(income, 2) as income, round(expense, 2) as expense, round(potential, 2) as potential, round(income - expense, 2) as net from s""",
    "type_summary": f"""with {TX} select document_type, count(*) as count, round(sum(amount::decimal(20,6))::double, 2) as total_amount,
      round(sum(amount::decimal(20,6))::double / count(*), 2) as average_amount from tx group by document_type""",
    "report_advice": f"with {TX}, {FACTS.replace('SOURCE', 'tx')} select {advice()} as recommendations from facts",
    "transaction_details": f"""with {TX} select document_id, document_type as type, round(amount, 2) as montant,
      case when category = 'income' then '701' else '607' end as compte_comptable, description as libelle, strftime(date, '%Y-%m-%d') as date from tx""",
    "financial_report": f"""with {RULE_TX}, recent as materialized (select * from tx where date >= date '{AS_OF}' - 365),
      {FACTS.replace('SOURCE', 'recent')},
      cur as (select currency, {SUMS} from recent group by currency),
      typ as (select document_type, count(*) as n, sum(amount::decimal(20,6))::double as total from recent group by document_type)
      select {SUMMARY}, n as transaction_count, {advice()} as recommendations,
        (select string_agg(currency || '/' || round(income * 100)::bigint || '/' || round(expense * 100)::bigint || '/' || round(potential * 100)::bigint
          || '/' || round((income - expense) * 100)::bigint, '|' order by currency) from cur) as by_currency,
        (select string_agg(document_type || '/' || n || '/' || round(total * 100)::bigint, '|' order by document_type) from typ) as by_type,
        strftime(date '{AS_OF}' - 365, '%Y-%m-%d') as start_date from facts""",
    "keep_valid": f"with {TX} select document_id, amount from tx where amount > 0",
    "simple_report": f"""with {TX} select currency, category, round(sum(amount::decimal(20,6))::double, 2) as total, count(*) as count
      from tx where amount > 0 group by grouping sets ((currency), (category), ())""",
    "simple_advice": f"""with {TX}, f as (select count(*) as n, count(*) filter (where amount > 1000) as high from tx)
      select array_to_string(list_filter([case when n > 10 then {q(lx.ADVICE_TRACKING)} end,
        case when high > 0 then 'Review ' || high || ' high-value transactions for accuracy' end], lambda m: m is not null), '|') as recommendations from f""",
    "convert_to_tnd": f"""with {TX} select document_id, currency, round(amount * case currency when 'EUR' then 3.3::double when 'USD' then 3.1::double
      when 'TND' then 1.0::double end, 4) as amount_tnd from tx""",
    "flat_amounts": f"with {LINES} select type, kind, description, count(*) as n, round(sum(amount::decimal(20,6))::double, 2) as amount from lines group by all",
    "revenue_expense_totals": f"""with {LINES} select round(sum(amount::decimal(20,6)) filter (where kind = 'revenue')::double, 2) as total_revenue,
      round(sum(amount::decimal(20,6)) filter (where kind <> 'revenue')::double, 2) as total_expenses, count(*) as transactions from lines""",
    "estimated_balance_sheet": f"""with {SHEET} select customer, receivables, cash, assets, capital, capital + profit as equity, greatest(0, other) as suppliers,
        tax + greatest(0, other) as current_debt, assets as liabilities, trunc(r)::bigint as turnover, {share(0.6)} as purchases, {share(0.92)} as charges,
        profit as result, round(profit / r * 100, 1) as marge_brute_percent, round(profit / r * 100, 1) as marge_nette_percent,
        round(coalesce(profit / nullif(assets, 0) * 100, 0), 1) as rentabilite_actif_percent,
        round(case when tax + other > 0 then assets / (tax + other) else 0 end, 1) as liquidite_generale,
        round(coalesce((capital + profit) / nullif(assets, 0) * 100, 0), 1) as autonomie_financiere_percent from c""",
    "estimated_from_turnover": f"""with {TURNOVER} select id, {share(0.7)} as receivables, {share(0.3)} as cash, {share(1.2)} as assets, {share(0.9)} as capital,
        {share(0.98)} as equity, {share(0.1)} as suppliers, {share(0.25)} as current_debt, {share(1.2)} as liabilities, trunc(r)::bigint as turnover,
        {share(0.6)} as purchases, {share(0.92)} as charges, {share(0.08)} as result, 40.0::double as marge_brute_percent, 8.0::double as marge_nette_percent,
        6.7::double as rentabilite_actif_percent, 4.0::double as liquidite_generale, 81.7::double as autonomie_financiere_percent from t""",
    "check_balance": f"""with {SHEET} select 'customer' as kind, customer as id, true as balanced, trunc(r) = 0 and assets = 0 as empty from c
      union all select 'turnover', o_orderkey, true, trunc(cents // 100 * 1.2) = 0 from order_rows""",
    "post_accounts": f"with {TX} {LEDGER}",
    "documented_totals": f"""with {TX} select round({when('income')}, 2) as total_revenue_found, round({when('expense')}, 2) as total_expenses_found,
      round(sum(case when document_type = 'invoice' then round(amount * 0.2::double, 2) end::decimal(20,6))::double, 2) as total_tax_found,
      array_to_string(list_sort(list(distinct currency)), '|') as currencies_found,
      array_to_string(list_sort(list(distinct document_type)), '|') as document_types_processed,
      case when count(*) filter (where document_type = 'bank_statement') > 0 and {when('income')} > 0 then 'balanced_from_documents'
        else 'unbalanced_insufficient_data' end as balance_status from tx""",
}
