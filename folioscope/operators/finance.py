"""Financial roll-ups of transactions and estimated balance sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import lexicon as lx
from folioscope.functions.patterns import let
from folioscope.functions.responses import stated_turnover


def exact_sum(amount: Column) -> Column:
    """Sum to six decimals that does not depend on the order rows arrive in."""
    return F.sum(amount.cast("decimal(20,6)")).cast("double")


def _sum_if(condition: Column) -> Column:
    return F.coalesce(exact_sum(F.when(condition, F.col("amount"))), F.lit(0.0))


def _category_sums() -> list[Column]:
    category = F.col("category")
    return [
        _sum_if(category == "income").alias("income"),
        _sum_if(category == "expense").alias("expense"),
        _sum_if(category == "potential_income").alias("potential"),
    ]


def _money(name: str) -> Column:
    return F.round(F.col(name), 2).alias(name)


def period_filter(df: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Transactions dated within the last ``days`` days."""
    return df.filter(F.col("date") >= F.date_sub(as_of, days))


def category_totals(df: DataFrame) -> DataFrame:
    """Income, expense, potential income, net result and margin over all currencies."""
    sums = df.agg(*_category_sums())
    net = F.col("income") - F.col("expense")
    return sums.select(
        F.round("income", 2).alias("total_income"),
        F.round("expense", 2).alias("total_expenses"),
        F.round("potential", 2).alias("potential_income"),
        F.round(net, 2).alias("net_result"),
        F.round(F.when(F.col("income") > 0, net / F.col("income") * 100).otherwise(0.0), 2).alias(
            "profit_margin_percent"
        ),
    )


def currency_breakdown(df: DataFrame) -> DataFrame:
    return df.groupBy("currency").agg(*_category_sums()).select(
        "currency",
        _money("income"),
        _money("expense"),
        _money("potential"),
        F.round(F.col("income") - F.col("expense"), 2).alias("net"),
    )


def type_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("document_type").agg(
        F.count(F.lit(1)).alias("count"),
        F.round(exact_sum(F.col("amount")), 2).alias("total_amount"),
        F.round(exact_sum(F.col("amount")) / F.count(F.lit(1)), 2).alias("average_amount"),
    )


def _messages(checks: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in checks]))


def _advice(currencies: Column, n: Column) -> Column:
    """Messages from the columns income, expense, potential, quotes, invoices and two counts."""
    income, expense = F.col("income"), F.col("expense")
    return _messages(
        [
            (expense > income, lx.ADVICE_COSTS),
            ((expense <= income) & (income > expense * 2), lx.ADVICE_CASH),
            (F.col("potential") > income * 0.5, lx.ADVICE_POTENTIAL),
            (F.col("quotes") > F.col("invoices"), lx.ADVICE_QUOTES),
            (currencies > 2, lx.ADVICE_CURRENCIES),
            (n < 5, lx.ADVICE_FEW_ROWS),
        ]
    )


def report_advice(df: DataFrame, limit: int = 5) -> DataFrame:
    """One row with up to five messages."""
    kind = F.col("document_type")
    facts = df.agg(
        *_category_sums(),
        F.count_if(kind == "quote").alias("quotes"),
        F.count_if(kind == "invoice").alias("invoices"),
        F.count_distinct("currency").alias("currencies"),
        F.count(F.lit(1)).alias("n"),
    )
    advice = _advice(F.col("currencies"), F.col("n"))
    return facts.select(F.slice(advice, 1, limit).alias("recommendations"))


def transaction_details(df: DataFrame) -> DataFrame:
    return df.select(
        "document_id",
        F.col("document_type").alias("type"),
        F.round(F.col("amount"), 2).alias("montant"),
        F.when(F.col("category") == "income", "701").otherwise("607").alias("compte_comptable"),
        F.col("description").alias("libelle"),
        F.date_format("date", "yyyy-MM-dd").alias("date"),
    )


def financial_report(df: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """One row: period, summary, breakdowns by currency and type, advice.

    One pass folds the transactions to a cell per (currency, type, category); the report is
    put together from those few cells in a single row.
    """
    cells = (
        period_filter(df, as_of, days)
        .groupBy("currency", "document_type", "category")
        .agg(exact_sum(F.col("amount")).alias("amount"), F.count(F.lit(1)).alias("rows"))
        .agg(F.collect_list(F.struct("currency", "document_type", "category", "amount", "rows")).alias("cells"))
    )

    def total(field: str, zero: Column, keep) -> Column:
        return F.aggregate(F.filter("cells", keep), zero, lambda acc, c: acc + c[field])

    def money(keep) -> Column:
        return total("amount", F.lit(0.0), keep)

    def rows(keep) -> Column:
        return total("rows", F.lit(0).cast("bigint"), keep)

    def names(field: str) -> Column:
        return F.array_sort(F.array_distinct(F.transform("cells", lambda c: c[field])))

    def in_category(name: str, currency: Column | None = None):
        if currency is None:
            return lambda c: c["category"] == name
        return lambda c: (c["category"] == name) & (c["currency"] == currency)

    def currency_entry(currency: Column) -> Column:
        parts = {
            out: money(in_category(name, currency))
            for out, name in (("income", "income"), ("expense", "expense"), ("potential", "potential_income"))
        }
        return F.struct(
            *[F.round(v, 2).alias(k) for k, v in parts.items()],
            F.round(parts["income"] - parts["expense"], 2).alias("net"),
        )

    def type_entry(kind: Column) -> Column:
        amount, n = money(lambda c: c["document_type"] == kind), rows(lambda c: c["document_type"] == kind)
        return F.struct(
            n.alias("count"), F.round(amount, 2).alias("total_amount"), F.round(amount / n, 2).alias("average_amount")
        )

    facts = cells.select(
        money(in_category("income")).alias("income"),
        money(in_category("expense")).alias("expense"),
        money(in_category("potential_income")).alias("potential"),
        rows(lambda c: c["document_type"] == "quote").alias("quotes"),
        rows(lambda c: c["document_type"] == "invoice").alias("invoices"),
        rows(lambda c: F.lit(True)).alias("transaction_count"),
        names("currency").alias("currencies"),
        F.map_from_arrays(names("currency"), F.transform(names("currency"), currency_entry)).alias("currency_breakdown"),
        F.map_from_arrays(names("document_type"), F.transform(names("document_type"), type_entry)).alias("document_analysis"),
    )
    income, expense = F.col("income"), F.col("expense")
    advice = _advice(F.size("currencies"), F.col("transaction_count"))
    net = income - expense
    return facts.select(
        F.struct(F.lit(days).alias("days"), F.date_sub(as_of, days).alias("start_date"), as_of.alias("end_date")).alias("period"),
        F.struct(
            F.round(income, 2).alias("total_income"),
            F.round(expense, 2).alias("total_expenses"),
            F.round("potential", 2).alias("potential_income"),
            F.round(net, 2).alias("net_result"),
            F.round(F.when(income > 0, net / income * 100).otherwise(0.0), 2).alias("profit_margin_percent"),
        ).alias("summary"),
        "currency_breakdown",
        "document_analysis",
        "transaction_count",
        F.slice(advice, 1, 5).alias("recommendations"),
    )


def simple_report(df: DataFrame) -> DataFrame:
    """(currency, category, total, count): totals per currency, per category and overall,
    the level told by which of the two columns is null."""
    grouped = df.groupingSets(
        [["currency"], ["category"], []], F.col("currency"), F.col("category")
    )
    return grouped.agg(
        F.round(exact_sum(F.col("amount")), 2).alias("total"), F.count(F.lit(1)).alias("count")
    )


def simple_advice(df: DataFrame) -> DataFrame:
    facts = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("amount") > 1000).alias("high"))
    review = F.concat(
        F.lit("Review "), F.col("high").cast("string"), F.lit(" high-value transactions for accuracy")
    )
    return facts.select(
        F.array_compact(
            F.array(
                F.when(F.col("n") > 10, F.lit(lx.ADVICE_TRACKING)), F.when(F.col("high") > 0, review)
            )
        ).alias("recommendations")
    )


def keep_valid(df: DataFrame) -> DataFrame:
    """Rows with an amount above zero."""
    return df.filter(F.col("amount") > 0)


def require_rows(df: DataFrame) -> DataFrame:
    """``df`` itself, or an error if it is empty."""
    if df.isEmpty():
        raise ValueError("no valid financial documents")
    return df


def convert_to_tnd(df: DataFrame, rates: dict[str, float] = lx.TND_RATES) -> DataFrame:
    """Adds ``amount_tnd``; currencies without a rate give null."""
    table = F.create_map(*[F.lit(x) for kv in rates.items() for x in kv])
    return df.withColumn("amount_tnd", F.col("amount") * F.try_element_at(table, F.col("currency")))


def flat_amounts(df: DataFrame) -> DataFrame:
    """(document_id, type, amount, kind, description) from nested ``amounts``."""
    return df.select("document_id", "document_type", F.explode("amounts").alias("a")).select(
        "document_id",
        F.col("document_type").alias("type"),
        F.coalesce("a.amount", F.lit(0.0)).alias("amount"),
        F.col("a.type").alias("kind"),
        F.coalesce("a.description", F.lit("")).alias("description"),
    )


def revenue_expense_totals(df: DataFrame) -> DataFrame:
    """Revenue against every other kind of amount."""
    revenue = F.coalesce(F.col("kind") == "revenue", F.lit(False))
    return flat_amounts(df).agg(
        F.round(_sum_if(revenue), 2).alias("total_revenue"),
        F.round(_sum_if(~revenue), 2).alias("total_expenses"),
        F.count(F.lit(1)).alias("transactions"),
    )


def _whole(value: Column) -> Column:
    """Truncated to a whole number."""
    return value.cast("bigint")


def _sheet(assets: dict, liabilities: dict, income: dict, ratios: dict) -> Column:
    def pack(tree) -> Column:
        if not isinstance(tree, dict):
            return tree if isinstance(tree, Column) else F.lit(tree)
        return F.struct(*[pack(v).alias(k) for k, v in tree.items()])

    return pack(
        {
            "bilan_comptable": {"actif": assets, "passif": liabilities},
            "compte_de_resultat": income,
            "ratios_financiers": ratios,
        }
    )


_ZERO = 0


def _income_statement(revenue: Column, result: Column) -> dict:
    share = lambda s: _whole(revenue * s)
    return {
        "produits_exploitation": {
            "chiffre_affaires": _whole(revenue),
            "production_immobilisee": _ZERO,
            "subventions_exploitation": _ZERO,
            "autres_produits_exploitation": _ZERO,
            "total_produits_exploitation": _whole(revenue),
        },
        "charges_exploitation": {
            "achats_consommes": share(0.6),
            "charges_personnel": share(0.2),
            "dotations_amortissements": share(0.05),
            "autres_charges_exploitation": share(0.07),
            "total_charges_exploitation": share(0.92),
        },
        "resultat_exploitation": result,
        "resultat_financier": _ZERO,
        "resultat_exceptionnel": _ZERO,
        "resultat_avant_impot": result,
        "impot_sur_benefices": _ZERO,
        "resultat_net": result,
    }


_NO_FIXED_ASSETS = {
    "immobilisations_corporelles": _ZERO,
    "immobilisations_incorporelles": _ZERO,
    "immobilisations_financieres": _ZERO,
    "total_actif_non_courant": _ZERO,
}
_NO_LONG_DEBT = {
    "emprunts_dettes_financieres_lt": _ZERO,
    "provisions_lt": _ZERO,
    "total_passif_non_courant": _ZERO,
}


def estimated_balance_sheet(revenue: Column) -> Column:
    """Balance sheet, income statement and ratios estimated from revenue; null without any."""

    def parts(r: Column) -> Column:
        return F.struct(
            r.alias("r"),
            _whole(r * 0.65).alias("receivables"),
            _whole(r * 0.25).alias("cash"),
            _whole(r * 0.08).alias("profit"),
            _whole(r * 0.15).alias("tax"),
        )

    def rest(p: Column) -> Column:
        assets = p["receivables"] + p["cash"]
        capital = _whole(assets * 0.75)
        return F.struct(
            *[p[k].alias(k) for k in ("r", "receivables", "cash", "profit", "tax")],
            assets.alias("assets"),
            capital.alias("capital"),
            (assets - capital - p["profit"] - p["tax"]).alias("other"),
        )

    def sheet(p: Column) -> Column:
        current_debt = p["tax"] + p["other"]
        percent = lambda a, b: F.round(F.coalesce(F.try_divide(a, b) * 100, F.lit(0.0)), 1)
        margin = percent(p["profit"], p["r"])
        return _sheet(
            {
                "actif_non_courant": _NO_FIXED_ASSETS,
                "actif_courant": {
                    "stocks_et_en_cours": _ZERO,
                    "clients_et_comptes_rattaches": p["receivables"],
                    "autres_creances": _ZERO,
                    "disponibilites": p["cash"],
                    "total_actif_courant": p["assets"],
                },
                "total_actif": p["assets"],
            },
            {
                "capitaux_propres": {
                    "capital_social": p["capital"],
                    "reserves": _ZERO,
                    "resultat_net_exercice": p["profit"],
                    "total_capitaux_propres": p["capital"] + p["profit"],
                },
                "passif_non_courant": _NO_LONG_DEBT,
                "passif_courant": {
                    "fournisseurs_et_comptes_rattaches": F.greatest(F.lit(0), p["other"]),
                    "dettes_fiscales_et_sociales": p["tax"],
                    "autres_dettes_ct": _ZERO,
                    "total_passif_courant": p["tax"] + F.greatest(F.lit(0), p["other"]),
                },
                "total_passif": p["assets"],
            },
            _income_statement(p["r"], p["profit"]),
            {
                "marge_brute_percent": margin,
                "marge_nette_percent": margin,
                "rentabilite_actif_percent": percent(p["profit"], p["assets"]),
                "liquidite_generale": F.round(
                    F.when(current_debt > 0, p["assets"] / current_debt).otherwise(0.0), 1
                ),
                "autonomie_financiere_percent": percent(p["capital"] + p["profit"], p["assets"]),
            },
        )

    return F.when(revenue > 0, let(let(let(revenue, parts), rest), sheet))


def estimated_from_turnover(response: Column) -> Column:
    """Second set of shares, applied to the turnover named in a broken response."""

    def sheet(turnover: Column) -> Column:
        share = lambda s: _whole(turnover * s)
        return _sheet(
            {
                "actif_non_courant": _NO_FIXED_ASSETS,
                "actif_courant": {
                    "stocks_et_en_cours": _ZERO,
                    "clients_et_comptes_rattaches": share(0.7),
                    "autres_creances": _ZERO,
                    "disponibilites": share(0.3),
                    "total_actif_courant": share(1.0),
                },
                "total_actif": share(1.2),
            },
            {
                "capitaux_propres": {
                    "capital_social": share(0.9),
                    "reserves": _ZERO,
                    "resultat_net_exercice": share(0.08),
                    "total_capitaux_propres": share(0.98),
                },
                "passif_non_courant": _NO_LONG_DEBT,
                "passif_courant": {
                    "fournisseurs_et_comptes_rattaches": share(0.1),
                    "dettes_fiscales_et_sociales": share(0.15),
                    "autres_dettes_ct": _ZERO,
                    "total_passif_courant": share(0.25),
                },
                "total_passif": share(1.2),
            },
            _income_statement(turnover, share(0.08)),
            lx.TURNOVER_RATIOS,
        )

    return let(stated_turnover(response), sheet)


def check_balance(df: DataFrame, sheet: str = "sheet", tolerance: float = 0.01) -> DataFrame:
    """Adds ``balanced`` and ``empty`` (turnover and assets both zero)."""
    assets = F.col(f"{sheet}.bilan_comptable.actif.total_actif")
    liabilities = F.col(f"{sheet}.bilan_comptable.passif.total_passif")
    turnover = F.col(f"{sheet}.compte_de_resultat.produits_exploitation.chiffre_affaires")
    return df.withColumns(
        {
            "balanced": F.abs(assets - liabilities) < tolerance,
            "empty": (turnover == 0) & (assets == 0),
        }
    )


def post_accounts(df: DataFrame) -> DataFrame:
    """(document_id, account, side, amount): ledger lines by document type."""
    table = F.create_map(
        *[
            x
            for kind, (debit, credit) in lx.LEDGER_ACCOUNTS.items()
            for x in (F.lit(kind), F.array(F.lit(debit), F.lit(credit)))
        ]
    )
    return (
        df.withColumn("_accounts", F.try_element_at(table, F.col("document_type")))
        .select("document_id", F.posexplode("_accounts").alias("_i", "account"), "amount")
        .filter("account is not null")
        .select(
            "document_id", "account", F.when(F.col("_i") == 0, "debit").otherwise("credit").alias("side"), "amount"
        )
    )


def documented_totals(df: DataFrame, tax: Column) -> DataFrame:
    """Only what the documents state: revenue, expense and tax sums, what was seen, status.

    A balance needs bank statements (cash) and revenue together.
    """
    category = F.col("category")
    seen = lambda c: F.sort_array(F.collect_set(c))  # noqa: E731  (a few fixed names)
    return df.agg(
        F.round(_sum_if(category == "income"), 2).alias("total_revenue_found"),
        F.round(_sum_if(category == "expense"), 2).alias("total_expenses_found"),
        F.round(F.coalesce(exact_sum(tax), F.lit(0.0)), 2).alias("total_tax_found"),
        seen("currency").alias("currencies_found"),
        seen("document_type").alias("document_types_processed"),
        F.count_if(F.col("document_type") == "bank_statement").alias("_bank"),
    ).withColumn(
        "balance_status",
        F.when((F.col("_bank") > 0) & (F.col("total_revenue_found") > 0), "balanced_from_documents").otherwise(
            "unbalanced_insufficient_data"
        ),
    ).drop("_bank")
