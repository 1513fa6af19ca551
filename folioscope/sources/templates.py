"""Documents rendered from table columns through text templates."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame

# Placeholders are the fields of plans.business_docs.order_fields.
TEMPLATES = {
    "invoice": [
        "INVOICE #: INV-{key}\nInvoice Date: {long_date}\nDue Date: {due_long}\nBill To: {customer}\n{address}\n{country}\nSubtotal: {symbol}{subtotal}\nAmount Due: ${commas}",
        "Facture N°: FAC-{key}\nDate: {date}\nClient: {customer}\n{address}\nMontant HT: {subtotal} {symbol}\nTVA: {tax} {symbol}\nTotal TTC: {amount} {symbol}",
        "فاتورة رقم: {key}\nتاريخ: {date}\nالعميل: {customer}\nالمبلغ الإجمالي: {amount} دينار\nMontant total: {amount} TND",
        "Invoice\nDescription: services for {segment}\nInvoice number: {key}\nDate: {iso_date}\nCustomer: {customer}\nTotal: {symbol} {commas}\nPayment due on {due_date}",
    ],
    "quote": [
        "DEVIS N° DV-{key}\nDate: {date}\nClient: {customer}\nObjet: offre de prix pour {segment}\nPrix estimatif: {amount} €\nValidité: 30 jours",
        "QUOTATION #{key}\nDate: {long_date}\nCustomer: {customer}\nItem: estimate for {segment}\nPrice: {symbol}{commas}\nValid until {due_date}",
    ],
    "purchase_order": [
        "BON DE COMMANDE N° BC-{key}\nDate: {date}\nFournisseur: {customer}\n{address}\nArticles commandés: {quantity}\nPrix unitaire: {unit} {symbol}\nTotal: {amount} €",
        "Purchase Order PO #{key}\nOrder date: {iso_date}\nSupplier: {customer}\nDelivery date: {due_date}\nTotal amount: ${commas}",
    ],
    "delivery_note": [
        "BON DE LIVRAISON BL n° {key}\nDate de livraison: {date}\nDestinataire: {customer}\nRéférence commande: CMD-{key}\nQuantité livrée: {quantity}\nMontant: {amount} {symbol}",
        "DELIVERY NOTE DN #{key}\nShipped on {long_date}\nCarrier: {segment} freight\nOrder PO-{key}\nPrice: {unit} DT",
    ],
    "receipt": [
        "Reçu de paiement n° {key}\nDate: {date}\nPaiement par: virement bancaire\nMontant payé: {amount} {symbol}\nMerci pour votre paiement",
        "RECEIPT #{key}\nDate: {date}\nItem: {quantity} x {segment}\nPayment method: card\nTotal: ${amount}\nThank you for your payment",
    ],
    "bank_statement": [
        "RELEVÉ BANCAIRE\nCompte n° {key}\nPériode: {date}\nAgence: {segment}\nSolde initial: {subtotal}\nCrédit: {amount}\nDevise: dirham\nDate: {due_date}",
        "BANK STATEMENT\nAccount #: {key} ****\nPeriod: {long_date}\nClosing balance: {symbol}{amount}\nOpening balance: {symbol}{subtotal}",
    ],
    "expense_report": [
        "NOTE DE FRAIS {key}\nEmployé: Jean {segment}\nDate: {date}\nTransport et repas\nMontant à rembourser: {amount} €",
        "EXPENSE REPORT {key}\nEmployee: Jane {segment}\nExpense type: travel\nDate: {long_date}\nTotal: £{commas}\nReimbursement request",
    ],
    "payslip": [
        "BULLETIN DE PAIE {key}\nEmployé: Jean {segment}\nPériode: {french_date}\nSalaire brut: {subtotal} €\nCotisations sociales: {tax} €\nNet à payer: {amount} €",
        "PAYSLIP {key}\nEmployee: Jane {segment}\nPeriod: {long_date}\nGross salary: {symbol}{subtotal}\nNet pay: {symbol}{amount}",
    ],
    "contract": [
        "CONTRACT AGREEMENT\n{customer} (client) and {segment} Holdings (supplier) sign on {date}.\nStart: {long_date}. Runs for {quantity} months unless ended by either side.",
        "CONTRAT DE SERVICES\nLe {french_date}, entre {customer} et la société {segment}. Durée: {quantity} mois.\nLes parties conviennent des conditions ci-dessous.",
    ],
    "id_card": [
        "IDENTIFICATION CARD\nHolder {customer}\nCard no. {key}\nValid from {date} to {due_date}",
        "EMPLOYEE BADGE\n{customer}\nDepartment: {segment}\nIssued: {iso_date}",
    ],
    "resume": [
        "RESUME\n{customer}\nExperience: {quantity} years in {segment}\nAvailable from {long_date}",
    ],
    "certificate": [
        "CERTIFICATE no. {key}\nAwarded on {date} to {customer} for finishing the {segment} course.",
    ],
    "report": [
        "QUARTERLY REPORT\nPrepared for: {customer}\nDate: {date}\nRevenue: {symbol}{commas}\nExpenses: {symbol}{subtotal}",
        "PROJECT REPORT\nProject: {segment}\nSubmission Date: {iso_date}\nBudget: {amount} {symbol}",
    ],
    "letter": [
        "Dear {customer},\n\nI am writing about order {key} of {long_date}.\n\nSincerely,\n{segment} desk",
    ],
    "form": [
        "APPLICATION FORM\nApplicant Name: {customer}\nAddress: {address}\nSignature: _________\nDate: {date}",
        "REGISTRATION FORM\nRegistrant: {customer}\nID Number: ID-{key}\nPayment Status: paid",
    ],
}

COMMERCIAL_KINDS = [
    "invoice", "quote", "purchase_order", "delivery_note", "receipt", "bank_statement",
    "expense_report", "payslip", "contract",
]
GENERAL_KINDS = [
    "invoice", "contract", "id_card", "resume", "certificate", "receipt", "report", "letter", "form",
]


def template_parts(template: str) -> list[tuple[str, bool]]:
    """(piece, is placeholder) in order."""
    out = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            out.append((literal, False))
        if field:
            out.append((field, True))
    return out


def fill_sql(template: str) -> str:
    """SQL that fills a template from columns named like its placeholders, with a prefix."""
    parts = [f"f_{p}" if is_field else sql_string(p) for p, is_field in template_parts(template)]
    return f"concat({', '.join(parts)})"


def sql_string(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def render_documents(
    df: DataFrame, key: Column, fields: dict[str, Column], kinds: list[str]
) -> DataFrame:
    """(doc_id, label, text): class by ``key`` modulo, template by the rest of ``key``.

    Choices are functions of the key, so a re-run of a lost task renders the same text.
    """
    n = len(kinds)
    used = {p for k in kinds for t in TEMPLATES[k] for p, is_field in template_parts(t) if is_field}
    rows = df.select(key.alias("doc_id"), *[c.alias(f"f_{name}") for name, c in fields.items() if name in used])
    branches = []
    for i, kind in enumerate(kinds):
        variants = TEMPLATES[kind]
        for v, template in enumerate(variants):
            chosen = f"pmod(doc_id, {n}) = {i} and pmod(doc_id div {n}, {len(variants)}) = {v}"
            branches.append(f"when {chosen} then {fill_sql(template)}")
    names = ", ".join(sql_string(k) for k in kinds)
    return rows.selectExpr(
        "doc_id",
        f"array({names})[cast(pmod(doc_id, {n}) as int)] as label",
        f"case {' '.join(branches)} end as text",
    )
