"""Word lists, rule patterns, label tables, rates and thresholds.

Everything here is data that results depend on; the logic that uses it lives elsewhere.
"""

from __future__ import annotations

# --- fixed values: document classes -------------------------------------------------------

DOCUMENT_CLASSES = [
    "invoice", "quote", "purchase_order", "delivery_note", "receipt", "bank_statement",
    "expense_report", "payslip", "credit_note", "debit_note", "tax_declaration",
    "fixed_asset_document", "inventory_document", "journal_entry", "unknown",
]
COMMERCIAL_TYPES = [
    "invoice", "quote", "purchase_order", "delivery_note", "receipt", "bank_statement",
    "expense_report", "payslip",
]

# --- fixed values: rule catalogue (type -> keywords worth 1, strong patterns worth 2) ------

RULE_KEYWORDS = {
    "invoice": [
        "facture", "invoice", "فاتورة", "montant", "tva", "ttc", "tax", "vat", "total", "amount",
        "payment", "paiement", "due", "customer", "client", "échéance", "مبلغ", "ضريبة", "تاريخ",
        "إجمالي", "دفع", "مستحق", "عميل", "رقم الفاتورة", "فاتورة رقم", "montant total",
        "total amount", "المبلغ الإجمالي", "facture n°", "invoice #", "invoice number",
        "numéro de facture", "facture du mois", "فاتورة الشهر", "facture proforma",
        "proforma invoice", "facture fournisseur", "facture client",
    ],
    "quote": [
        "devis", "quotation", "quote", "estimate", "proposal", "validité", "valid until", "offer",
        "offre", "offre de prix", "prix estimatif", "conditions de vente", "référence devis",
        "valable jusqu'au",
    ],
    "purchase_order": [
        "bon de commande", "purchase order", "order", "commande", "po", "bc", "fournisseur",
        "vendor", "supplier", "delivery date", "date de livraison", "commande n°",
        "articles commandés", "quantité", "prix unitaire",
    ],
    "delivery_note": [
        "bon de livraison", "delivery note", "livraison", "delivered", "delivery", "carrier",
        "transporteur", "shipped", "shipping", "bl", "dn", "réception", "quantité livrée",
        "date de livraison", "conformité", "référence commande",
    ],
    "receipt": [
        "reçu", "receipt", "payment received", "paiement reçu", "thank you for your payment",
        "merci pour votre paiement", "paid", "payé", "justificatif de paiement", "montant payé",
        "mode de paiement", "transaction", "virement", "cb",
    ],
    "bank_statement": [
        "relevé bancaire", "bank statement", "account", "compte", "balance", "solde",
        "transactions", "opérations", "credits", "debits", "period", "période",
        "relevé de compte", "crédit", "débit", "date", "attijariwafa", "bmce", "cih",
        "banque populaire", "crédit agricole", "société générale", "bnp paribas", "virement",
        "prélèvement", "chèque", "espèces", "versement", "paiement", "crediteur", "debiteur",
        "devise", "dirham", "euro", "dollar", "agence", "releve d'identite bancaire", "rib",
        "iban", "swift", "bic",
    ],
    "expense_report": [
        "note de frais", "expense report", "remboursement", "reimbursement", "expenses",
        "dépenses", "justificatif", "receipts", "transport", "repas", "hébergement",
        "montant à rembourser", "ticket",
    ],
    "payslip": [
        "bulletin de paie", "payslip", "salary", "salaire", "pay", "net à payer", "net pay",
        "gross", "brut", "deductions", "cotisations", "employer", "employeur", "fiche de paie",
        "congés", "heures",
    ],
    "credit_note": ["credit note", "note de crédit", "avoir", "crédit client"],
    "debit_note": ["debit note", "note de débit", "débiter", "débit client"],
    "tax_declaration": [
        "tax declaration", "déclaration fiscale", "impôt", "taxe", "déclaration de revenus",
    ],
    "fixed_asset_document": [
        "fixed asset", "immobilisation", "asset register", "registre des immobilisations",
    ],
    "inventory_document": [
        "inventory", "inventaire", "stock", "inventory report", "rapport d'inventaire",
    ],
    "journal_entry": [
        "journal entry", "écriture comptable", "journal comptable", "entry number",
    ],
}

RULE_PATTERNS = {
    "invoice": [
        r"facture\s*[#:n°]", r"invoice\s*[#:n°]", r"facture\s+.*\s+n[o°]", r"n[o°]\s*facture",
        r"fac\.?\s*n[o°]", r"facture\s*du\s*mois", r"facture\s*n.*\s*\d+",
        r"invoice\s*n.*\s*\d+", r"montant\s*(ht|ttc)", r"total\s*(amount|ttc|ht)",
        r"amount\s*due", r"فاتورة\s*رقم", r"رقم\s*الفاتورة", r"فاتورة\s*الشهر",
        r"مبلغ\s*إجمالي", r"المبلغ\s*الإجمالي", r"ضريبة\s*القيمة\s*المضافة",
        r"montant\s*total\s*hors", r"total\s*tva", r"facture.*\d{4,}",
    ],
    "quote": [
        r"devis\s*[#:n°]", r"quotation\s*[#:n°]", r"quote\s*[#:n°]", r"estimate\s*[#:n°]",
        r"valid\s*until", r"validité", r"valable\s*jusqu", r"offre\s*de\s*prix",
        r"prix\s*estimatif", r"conditions\s*de\s*vente", r"référence\s*devis",
    ],
    "purchase_order": [
        r"bon\s*de\s*commande", r"purchase\s*order", r"\bpo\s*[#:n°]", r"\bbc\s*[#:n°]",
        r"order\s*[#:n°]", r"commande\s*[#:n°]", r"commande\s*n[o°]", r"articles\s*commandés",
        r"prix\s*unitaire", r"purchase\s*order\s*number",
    ],
    "delivery_note": [
        r"bon\s*de\s*livraison", r"delivery\s*note", r"bl\s*[#:n°]", r"dn\s*[#:n°]",
        r"delivery\s*[#:n°]", r"livraison\s*[#:n°]", r"quantité\s*livrée",
        r"date\s*de\s*livraison", r"conformité", r"référence\s*commande",
    ],
    "receipt": [
        r"reçu\s*[#:n°]", r"receipt\s*[#:n°]", r"payment\s*receipt", r"reçu\s*de\s*paiement",
        r"thank\s*you\s*for\s*your\s*payment", r"merci\s*pour\s*votre\s*paiement",
        r"justificatif\s*de\s*paiement", r"montant\s*payé", r"mode\s*de\s*paiement",
        r"transaction", r"virement", r"cb",
    ],
    "bank_statement": [
        r"relevé\s*bancaire", r"relevé\s*de\s*compte\s*bancaire",
        r"releve\s*de\s*compte\s*bancaire", r"bank\s*statement", r"account\s*[#:n°]",
        r"compte\s*[#:n°]", r"solde\s*initial", r"solde\s*final", r"solde\s*depart",
        r"opening\s*balance", r"closing\s*balance", r"solde\s*et\s*(crédit|débit)",
        r"crédit\s*et\s*débit", r"crediteur\s*debit", r"total\s*mouvements",
        r"releve\s*d.identite\s*bancaire", r"relevé\s*d.identité\s*bancaire",
        r"attijariwafa\s*bank", r"devise\s*:\s*dirham", r"agence\s*:", r"virement\s*(recu|emis)",
        r"paiement\s*cheque", r"versement\s*espece", r"prelevement\s*en\s*fav",
    ],
    "expense_report": [
        r"note\s*de\s*frais", r"expense\s*report", r"demande\s*de\s*remboursement",
        r"reimbursement\s*request", r"frais\s*professionnels", r"business\s*expenses",
        r"montant\s*à\s*rembourser", r"justificatif\s*de\s*frais",
        r"ticket\s*de\s*(transport|repas|hébergement)",
    ],
    "payslip": [
        r"bulletin\s*de\s*paie", r"fiche\s*de\s*paie", r"payslip", r"salaire\s*brut",
        r"gross\s*salary", r"net\s*à\s*payer", r"net\s*pay", r"cotisations\s*sociales",
        r"congés\s*payés", r"heures\s*travaillées",
    ],
    "credit_note": [r"credit\s*note", r"note\s*de\s*crédit", r"avoir"],
    "debit_note": [r"debit\s*note", r"note\s*de\s*débit"],
    "tax_declaration": [r"tax\s*declaration", r"déclaration\s*fiscale", r"impôt"],
    "fixed_asset_document": [r"fixed\s*asset", r"immobilisation", r"asset\s*register"],
    "inventory_document": [r"inventory", r"inventaire", r"stock"],
    "journal_entry": [r"journal\s*entry", r"écriture\s*comptable", r"journal\s*comptable"],
}

# --- fixed values: ordered decision list (texts are lower-cased and cleaned) ---------------

UNKNOWN_TYPE = "unknown"
INVOICE_INDICATORS = {
    "keyword": ["facture", "invoice", "فاتورة"],
    "number": [
        "facture n", "facture du mois", "فاتورة رقم", "n° facture", "facture #", "facture n°",
    ],
    "tax": ["tva", "tax", "vat", "ضريبة", "أداء", "أداء على القيمة المضافة"],
    "amount": [
        "montant", "total", "amount", "مبلغ", "المبلغ", "montant total", "montant ht",
        "montant ttc",
    ],
    "arabic_amount": ["المبلغ الإجمالي", "مجموع", "أداء على القيمة المضافة"],
    "tunisian": ["facture du mois (dt)", "فاتورة الشهر", "montant total hors"],
}
INVOICE_NUMBER_SHAPE = r"invoice\s*[#:n°\n\r\s]+\w+"
BANK_PHRASES = [
    "relevé de compte", "releve de compte", "relevé bancaire", "releve bancaire",
    "bank statement", "attijariwafa bank", "total mouvements",
]

# --- fixed values: keyword vote between purchase orders and invoices -----------------------

VOTE_ORDER_WORDS = [
    "purchase order", "bon de commande", "po", "bc", "order", "commande", "supplier",
    "fournisseur",
]
VOTE_INVOICE_WORDS = ["invoice", "facture", "فاتورة", "montant", "total"]

# --- fixed values: indicators used when adjusting model scores -----------------------------

DEFINITIVE_INVOICE_WORDS = [
    "facture n", "invoice #", "فاتورة رقم", "facture du mois", "فاتورة الشهر", "montant ttc",
    "montant ht", "facture proforma", "ضريبة القيمة المضافة", "n° facture", "invoice number",
    "facture n°", "paid invoice", "فاتورة مدفوعة",
]
INVOICE_WORDS = [
    "facture", "montant", "tva", "ttc", "échéance", "client", "date", "montant ht",
    "montant ttc", "total tva", "facture du mois", "facture proforma", "n° facture",
    "numéro de facture", "invoice", "payment", "due", "total", "tax", "subtotal", "customer",
    "amount", "paid", "invoice number", "proforma invoice", "vat", "balance due", "فاتورة",
    "تاريخ", "مبلغ", "ضريبة", "إجمالي", "دفع", "مستحق", "عميل", "فاتورة رقم", "فاتورة الشهر",
    "المبلغ الإجمالي", "ضريبة القيمة المضافة", "factura", "factur", "inv", "فاتوره", "فواتير",
    "فكتورة", "فاتورة#", "invoice#", "facture#", "رقم الفاتورة", "رقم الفاتوره",
]
STRONG_INVOICE_PATTERNS = [
    r"facture\s*[#:n°]", r"invoice\s*[#:n°]", r"فاتورة\s*رقم", r"رقم\s*الفاتورة",
    r"facture\s*du\s*mois", r"facture\s*n.*\s*\d+", r"invoice\s*n.*\s*\d+", r"فاتورة\s*الشهر",
    r"مبلغ\s*إجمالي", r"المبلغ\s*الإجمالي", r"ضريبة\s*القيمة\s*المضافة",
    r"montant\s*total\s*hors", r"total\s*tva", r"facture.*\d{4,}", r"invoice number",
    r"n[°o]?\s*facture", r"facture n[°o]?", r"proforma invoice", r"paid invoice",
    r"فاتورة مدفوعة", r"فاتورة ضريبية", r"فاتورة مبيعات", r"فاتورة مشتريات",
]
ORDER_WORDS = [
    "bon de commande", "commande", "fournisseur", "acheteur", "référence",
    "modalité de paiement", "délai de livraison", "articles", "conditions",
    "numéro de commande", "purchase order", "order", "p.o.", "po", "supplier", "buyer",
    "reference", "order number", "payment terms", "delivery date", "item", "items", "quantity",
    "أمر شراء", "طلب شراء", "رقم أمر الشراء", "المورد", "المشتري", "رقم الطلب", "شروط الدفع",
    "تاريخ التسليم", "كمية", "مواد", "b.c.", "bc", "p.o", "p o", "بون دي كوموند", "امر شراء",
    "امر توريد", "رقم امر الشراء",
]
STRONG_ORDER_PATTERNS = [
    r"bon\s+de\s+commande", r"purchase\s+order", r"p\.?o\.?\s*[#:n°]", r"b\.?c\.?\s*[#:n°]",
    r"commande\s*[#:n°]", r"order\s*[#:n°]", r"bon\s+de\s+commande\s+n[o°]",
    r"numéro\s*:\s*bc-", r"numéro\s*de\s*commande",
    r"pour\s+le\s+fournisseur.*pour\s+le\s+client", r"fournisseur\s*:.*client\s*:",
    r"أمر\s*شراء", r"طلب\s*شراء", r"رقم\s*أمر\s*الشراء",
]
ORDER_EXCLUSIONS = [
    r"facture\s+acquitt[ée]", r"paid\s+invoice", r"reçu\s+de\s+paiement", r"payment\s+receipt",
    r"فاتورة", r"invoice",
]

# Markers that force a type, in the order the types are tried.
FORCING_MARKERS = {
    "invoice": [
        r"facture\s*[#:n°]", r"invoice\s*[#:n°]", r"فاتورة\s*رقم", r"facture du mois",
        r"فاتورة الشهر", r"montant\s*ttc", r"montant\s*ht", r"facture proforma",
        r"ضريبة القيمة المضافة", r"n[°o]?\s*facture", r"invoice number", r"facture n[°o]?",
        r"فاتورة\s*الشهر", r"facture.*\d{4,}",
    ],
    "purchase_order": [
        r"bon\s+de\s+commande\s*[#:n°]?", r"purchase order\s*[#:n°]?", r"\bp\.?o\.?\s*[#:n°]",
        r"bc\s*n[°o]?", r"b\.c\.\s*n[°o]?", r"numéro\s*de\s*commande", r"order number",
        r"bon de commande", r"purchase order", r"bon de commande n[°o]?",
        r"purchase order n[°o]?",
    ],
    "quote": [
        r"devis\s*n[°o]?", r"quotation\s*[#:n°]?", r"quote\s*[#:n°]?", r"devis numéro",
        r"numéro de devis", r"offre de prix", r"proposition commerciale",
    ],
    "delivery_note": [
        r"bon de livraison", r"delivery note", r"b\.l\.\s*n[°o]?", r"bl\s*n[°o]?",
        r"bon de livraison n[°o]?", r"delivery note n[°o]?", r"numéro de bon de livraison",
    ],
    "receipt": [
        r"reçu\s*n[°o]?", r"receipt\s*[#:n°]?", r"reçu de paiement", r"payment receipt",
        r"numéro de reçu", r"reçu de caisse",
    ],
    "bank_statement": [
        r"relevé bancaire", r"bank statement", r"relevé de compte bancaire",
        r"releve de compte bancaire", r"statement\s*[#:n°]?", r"relevé\s*n[°o]?",
        r"bank statement n[°o]?", r"attijariwafa bank", r"releve d.identite bancaire",
        r"relevé d.identité bancaire", r"total mouvements", r"solde depart", r"solde final",
        r"crediteur", r"devise\s*:\s*dirham",
    ],
    "expense_report": [
        r"note de frais", r"expense report", r"note de frais\s*n[°o]?",
        r"expense report\s*[#:n°]?", r"expense report n[°o]?",
    ],
    "payslip": [
        r"bulletin de paie", r"payslip", r"fiche de paie", r"payslip\s*[#:n°]?",
        r"bulletin de salaire", r"fiche de paie n[°o]?", r"payslip n[°o]?",
    ],
}

# --- fixed values: label tables ------------------------------------------------------------

STANDARD_LABELS = {
    "invoice": "invoice", "receipt": "receipt", "purchase_order": "purchase_order",
    "delivery_note": "delivery_note", "contract": "contract", "quote": "quote",
    "report": "report", "statement": "bank_statement",
}
COMMERCIAL_LABEL_WORDS = [
    ("invoice", ["invoice", "bill", "billing"]),
    ("receipt", ["receipt", "payment"]),
    ("contract", ["contract", "agreement"]),
    ("purchase_order", ["purchase order", "order"]),
    ("delivery_note", ["delivery", "shipping"]),
    ("quote", ["quote", "quotation", "estimate"]),
    ("bank_statement", ["bank", "statement"]),
    ("expense_report", ["expense", "report"]),
    ("payslip", ["payslip", "salary", "wage"]),
]
COMPANY_LABEL_WORDS = [
    ("receipt", ["invoice", "bill", "receipt"]),
    ("contract", ["contract", "agreement", "legal"]),
    ("report", ["report", "financial", "statement"]),
    ("letter", ["letter", "correspondence", "email"]),
    ("form", ["form", "application", "document"]),
]
FILE_NAME_LABEL_WORDS = [
    ("invoice", ["invoice"]), ("receipt", ["receipt"]), ("contract", ["contract"]),
    ("purchase_order", ["order"]),
]
TEXT_LABEL_WORDS = [
    ("invoice", ["invoice", "bill", "billing"]),
    ("receipt", ["receipt", "payment received"]),
    ("contract", ["contract", "agreement", "terms and conditions"]),
    ("purchase_order", ["purchase order", "order form"]),
    ("delivery_note", ["delivery note", "shipping"]),
]
COMPANY_FILE_NAME_WORDS = [
    ("invoice", ["invoice"]), ("contract", ["contract"]), ("report", ["report"]),
    ("letter", ["letter"]),
]
TEXT_FIELDS = ["text", "content", "document", "body", "description", "message"]
TEXT_COLUMNS = ["text", "content", "document", "body", "description"]
LABEL_FIELDS = ["label", "category", "type", "class", "document_type"]

# --- fixed values: keyword boosting and token filter ---------------------------------------

KEPT_KEYWORDS = [
    "invoice", "bill", "payment", "due", "amount", "total", "tax", "vat", "receipt", "order",
    "customer", "service", "quantity", "price", "date", "paid", "subtotal", "facture",
    "montant", "paiement", "client", "tva", "numéro", "échéance", "prix", "quantité", "hors",
    "taxes", "ttc", "ht", "reçu", "envoyé", "modalités", "règlement", "remise", "réduction",
    "acquitté", "versement", "acompte", "facture du mois", "facture n°", "فاتورة", "مبلغ",
    "ضريبة", "تاريخ", "إجمالي", "دفع", "مستحق", "عميل", "رقم الفاتورة", "فاتورة رقم",
    "المبلغ الإجمالي", "فاتورة الشهر", "ضريبة القيمة المضافة", "الحساب", "سعر", "كمية",
    "المبلغ", "دون", "bon", "commande", "purchase", "po", "bc", "supplier", "fournisseur",
    "delivery", "livraison", "référence", "reference", "acheteur", "buyer", "articles",
    "modalité", "emis", "conditions", "délai", "vendeur", "seller", "commander",
    "bon de commande", "purchase order", "emetteur", "issuer", "destinataire",
    "numéro de commande", "order number", "order no", "bc-", "ref", "conditions de paiement",
]
BOOST_INVOICE_PATTERNS = [
    r"facture\s*[#:n°]", r"invoice\s*[#:n°]", r"فاتورة\s*رقم", r"facture\s*du\s*mois",
    r"فاتورة\s*الشهر", r"montant\s*ttc",
]
BOOST_ORDER_PATTERNS = [
    r"bon\s*de\s*commande", r"purchase\s*order", r"po\s*[#:n°]", r"bc\s*[#:n°]",
    r"order\s*[#:n°]", r"commande\s*[#:n°]", r"order number", r"numéro de commande",
    r"vendeur", r"buyer", r"supplier", r"fournisseur", r"articles", r"délai de livraison",
]
BOOST_ORDER_WORDS = [
    "purchase order", "bon de commande", "po", "bc", "order", "commande", "supplier",
    "fournisseur",
]
BOOST_INVOICE_WORDS = ["facture", "invoice", "فاتورة", "montant", "total"]

# The usual English stopword list of text toolkits.
STOPWORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself "
    "yourselves he him his himself she she's her hers herself it it's its itself they them "
    "their theirs themselves what which who whom this that that'll these those am is are was "
    "were be been being have has had having do does did doing a an the and but if or because "
    "as until while of at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own "
    "same so than too very s t can will just don don't should should've now d ll m o re ve y "
    "ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven "
    "haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn "
    "shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()

# --- fixed values: sentence scoring --------------------------------------------------------

FINANCIAL_WORDS = [
    "facture", "invoice", "montant", "amount", "total", "prix", "price", "tva", "tax", "ht",
    "ttc", "devis", "quote", "commande", "order", "€", "$", "£", "eur", "usd", "gbp",
]
COMPANY_WORDS = [
    "société", "company", "sarl", "sas", "ltd", "inc", "corp", "client", "customer",
    "fournisseur", "supplier",
]
DATE_WORDS = [
    "date", "janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août",
    "septembre", "octobre", "novembre", "décembre", "january", "february", "march", "april",
    "may", "june", "july", "august", "september", "october", "november", "december", "2024",
    "2025", "2023",
]

# --- fixed values: dates -------------------------------------------------------------------

ENGLISH_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
FRENCH_MONTHS = [
    "janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre",
    "octobre", "novembre", "décembre",
]
FRENCH_MONTH_CUTS = [
    "janv", "févr", "mars", "avr", "mai", "juin", "juil", "août", "sept", "oct", "nov", "déc",
]
ENGLISH_MONTH_NAMES = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september",
    "october", "november", "december",
]
MONTH_LETTERS = "a-zA-Zéèêëàâçîïôöûüù"

_EN = "|".join(ENGLISH_MONTHS)
_FR = "|".join(FRENCH_MONTHS)
_CUT = "|".join(FRENCH_MONTH_CUTS)
DOCUMENT_DATE_PATTERNS = [
    rf"(?:invoice|facture)\s+date\s*:?\s*(\d{{1,2}}\s+(?:{_EN})[a-z]*\s+\d{{4}})",
    rf"date\s*:?\s*(\d{{1,2}}\s+(?:{_EN})[a-z]*\s+\d{{4}})",
    rf"due\s+date\s*:?\s*(\d{{1,2}}\s+(?:{_EN})[a-z]*\s+\d{{4}})",
    rf"(\d{{1,2}}\s+(?:{_EN})[a-z]*\s+\d{{4}})",
    r"(\d{1,2}[./-]\d{1,2}[./-]\d{2,4})",
    rf"(\d{{1,2}}\s+(?:{_FR})\s+\d{{4}})",
    rf"(?:le\s+)?(\d{{1,2}}\s+(?:{_FR})\s+\d{{4}})",
    rf"(?:le\s+)?(\d{{1,2}}\s+(?:{_CUT})\.?\s+\d{{4}})",
]
DUE_DATE_PATTERNS = [
    rf"due\s+date\s*:?\s*(\d{{1,2}}\s+(?:{_EN})[a-z]*\s+\d{{4}})",
    rf"date\s+d'échéance\s*:?\s*(\d{{1,2}}\s+(?:{_FR})\s+\d{{4}})",
    rf"échéance\s*:?\s*(\d{{1,2}}\s+(?:{_FR})\s+\d{{4}})",
    rf"date\s+de\s+paiement\s*:?\s*(\d{{1,2}}\s+(?:{_FR})\s+\d{{4}})",
]

# --- fixed values: field patterns ----------------------------------------------------------

CLIENT_PATTERNS = [
    r"(?:bill to|client|customer)\s*:?\s*([^\n]+)",
    r"destinataire\s*:?\s*([^\n]+)",
]
ADDRESS_PATTERN = r"(?:bill to|client|customer)\s*:?\s*[^\n]+\n([^\n]+(?:\n[^\n]+){0,3})"

# type -> field -> patterns in order; the listed fields are blank-stripped afterwards
TYPE_FIELDS = {
    "invoice": {
        "invoice_number": [
            r"facture\s*[#:n°]*\s*([a-z0-9\-]+)", r"invoice\s*[#:n°]*\s*([a-z0-9\-]+)",
        ],
        "amount": [
            r"total\s*:?\s*(\d+[.,]\d+)", r"montant\s*:?\s*(\d+[.,]\d+)",
            r"ttc\s*:?\s*(\d+[.,]\d+)",
        ],
    },
    "quote": {
        "quote_number": [
            r"devis\s*[#:n°]*\s*([a-z0-9\-]+)", r"quote\s*[#:n°]*\s*([a-z0-9\-]+)",
            r"quotation\s*[#:n°]*\s*([a-z0-9\-]+)",
        ],
        "validity": [r"valid(?:ité)?\s*:?\s*(\d+\s*(?:jours|days|months|mois))"],
    },
    "purchase_order": {
        "po_number": [
            r"commande\s*[#:n°]*\s*([a-z0-9\-]+)", r"order\s*[#:n°]*\s*([a-z0-9\-]+)",
            r"po\s*[#:n°]*\s*([a-z0-9\-]+)",
        ],
    },
    "delivery_note": {
        "delivery_number": [
            r"livraison\s*[#:n°]*\s*([a-z0-9\-]+)", r"delivery\s*[#:n°]*\s*([a-z0-9\-]+)",
            r"bl\s*[#:n°]*\s*([a-z0-9\-]+)",
        ],
        "order_reference": [r"(?:commande|order|po)\s*[#:n°]*\s*([a-z0-9\-]+)"],
    },
    "receipt": {
        "payment_method": [
            r"(?:payment|paiement)\s*(?:method|mode|via|par)\s*:?\s*([a-zA-Z\s]+)",
        ],
    },
    "bank_statement": {
        "account_number": [r"(?:account|compte)\s*[#:n°]*\s*([a-zA-Z0-9\s\*]+)"],
        "period": [r"(?:period|période)\s*:?\s*([\w\s\-/]+)"],
        "balance": [r"(?:closing|final)\s*balance\s*:?\s*[$€£]?\s*(\d+[.,]\d+)"],
    },
    "expense_report": {
        "employee": [r"(?:employee|employé)\s*:?\s*([a-zA-Z\s]+)"],
        "expense_type": [r"(?:expense|dépense)\s*(?:type|catégorie)\s*:?\s*([a-zA-Z\s]+)"],
    },
    "payslip": {
        "employee": [r"(?:employee|employé)\s*:?\s*([a-zA-Z\s]+)"],
        "period": [r"(?:period|période)\s*:?\s*([\w\s\-/]+)"],
        "net_pay": [r"(?:net\s*(?:pay|à\s*payer))\s*:?\s*[$€£]?\s*(\d+[.,]\d+)"],
    },
}
STRIPPED_FIELDS = ["payment_method", "account_number", "period", "employee", "expense_type"]

INVOICE_NUMBER_PATTERNS = [
    r"facture\s*[#:n°]*\s*([a-z0-9\-]+)",
    r"facture\s+à\s+envoyer\s+à\s+facture.*\s+n[o°][^a-z0-9]*([a-z0-9\-]+)",
    r"invoice\s*[#:n°]*\s*([a-z0-9\-]+)",
    r"[#:]?\s*([a-z0-9\-]{6,})",
    r"n[o°]\s*(?:facture)?[^a-z0-9]*([a-z0-9\-]+)",
    r"fac\.?\s*n[o°][^a-z0-9]*([a-z0-9\-]+)",
    r"reference\s*:?\s*([a-z0-9\-]+)",
    r"référence\s*:?\s*([a-z0-9\-]+)",
    r"numéro\s*:?\s*([a-z0-9\-]+)",
    r"n°\s*([a-z0-9\-]+)",
]
WORD_AFTER_FACTURE = r"facture\s*[^\w]*(\w+)"
INVOICE_AMOUNT_PATTERNS = [
    r"total\s*:?\s*(\d+[.,]\d+)", r"total\s+ttc\s*:?\s*(\d+[.,]\d+)",
    r"montant\s*:?\s*(\d+[.,]\d+)", r"montant\s+ttc\s*:?\s*(\d+[.,]\d+)",
    r"ttc\s*:?\s*(\d+[.,]\d+)", r"à\s+payer\s*:?\s*(\d+[.,]\d+)",
    r"amount\s*:?\s*(\d+[.,]\d+)", r"price\s*:?\s*(\d+[.,]\d+)", r"prix\s*:?\s*(\d+[.,]\d+)",
]
INVOICE_TERMS = [
    "facture", "invoice", "total", "montant", "date", "client", "number", "numéro", "payment",
    "paiement", "amount", "echéance", "tva", "tax", "vat", "ttc", "ht", "prix", "price",
]
KEY_AMOUNT_PATTERNS = [
    r"(\d+[,.]?\d*)\s*€", r"€\s*(\d+[,.]?\d*)", r"(\d+[,.]?\d*)\s*EUR",
    r"total[:\s]+(\d+[,.]?\d*)", r"montant[:\s]+(\d+[,.]?\d*)",
]
KEY_DATE_PATTERNS = [
    r"\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4}",
    rf"\d{{1,2}}\s+(?:{_FR})\s+\d{{4}}",
    rf"(?:{'|'.join(ENGLISH_MONTH_NAMES)})\s+\d{{1,2}},?\s+\d{{4}}",
]
KEY_NUMBER_PATTERNS = [
    r"(?:facture|invoice|n°|#)\s*:?\s*([A-Z0-9\-]+)", r"(?:devis|quote)\s*:?\s*([A-Z0-9\-]+)",
]

# --- fixed values: money -------------------------------------------------------------------

TOTAL_PATTERNS = [
    r"total[:\s]*\$\s*([\d,]+\.?\d*)",
    r"total[:\s]*([\d,]+\.?\d*)\s*\$",
    r"grand\s+total[:\s]*\$\s*([\d,]+\.?\d*)",
    r"amount\s+due[:\s]*\$\s*([\d,]+\.?\d*)",
    r"final\s+amount[:\s]*\$\s*([\d,]+\.?\d*)",
    r"total[:\s]*€\s*([\d,]+\.?\d*)",
    r"total[:\s]*([\d,]+\.?\d*)\s*€",
    r"montant\s+total[:\s]*€?\s*([\d,]+\.?\d*)",
    r"total[:\s]*£\s*([\d,]+\.?\d*)",
]
# A symbol-first pattern ("€ 50") belongs here too but captures the symbol, never a number.
LOOSE_AMOUNT_PATTERNS = [
    r"montant[:\s]*([€$£]?\s*[\d,]+\.?\d*)\s*([€$£TND DT]*)",
    r"amount[:\s]*([€$£]?\s*[\d,]+\.?\d*)\s*([€$£TND DT]*)",
    r"prix[:\s]*([€$£]?\s*[\d,]+\.?\d*)\s*([€$£TND DT]*)",
    r"price[:\s]*([€$£]?\s*[\d,]+\.?\d*)\s*([€$£TND DT]*)",
    r"([\d,]+\.?\d*)\s*([€$£TND DT]+)",
]
CURRENCY_MARKS = {
    "EUR": ["€", "eur", "euro"],
    "USD": ["$", "usd", "dollar"],
    "TND": ["tnd", "dt", "dinar"],
    "GBP": ["£", "gbp", "pound"],
}
MONEY_DATE_PATTERNS = [
    r"date[:\s]*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
    r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
    r"(\d{4}-\d{2}-\d{2})",
]
DESCRIPTION_PATTERNS = [
    r"description[:\s]*(.+)", r"objet[:\s]*(.+)", r"subject[:\s]*(.+)", r"item[:\s]*(.+)",
]
TYPE_CATEGORIES = {
    "invoice": ("income", "sales_revenue"),
    "quote": ("potential_income", "quoted_sales"),
    "purchase_order": ("expense", "purchases"),
    "receipt": ("expense", "operational_expense"),
    "bank_statement": ("mixed", "bank_transaction"),
    "expense_report": ("expense", "operational_expense"),
    "payslip": ("expense", "salary_expense"),
    "delivery_note": ("income", "delivered_goods"),
    "unknown": ("mixed", "unclassified"),
}
DEFAULT_CATEGORY = ("mixed", "unclassified")
TND_RATES = {"EUR": 3.3, "USD": 3.1, "TND": 1.0}

# document type -> (debit account, credit account); R marks a range of accounts
LEDGER_ACCOUNTS = {
    "invoice": ("411", "70X"),
    "purchase_order": ("60X", "401"),
    "bank_statement": ("512", None),
    "payslip": ("64X", "43X"),
    "receipt": ("60X-65X", None),
}

# --- fixed values: report messages ---------------------------------------------------------

ADVICE_COSTS = "⚠️ Expenses exceed income. Consider cost reduction strategies."
ADVICE_CASH = "💰 Strong cash flow. Consider investment opportunities."
ADVICE_POTENTIAL = "📈 High potential income from quotes. Focus on conversion."
ADVICE_QUOTES = "📋 More quotes than invoices. Improve quote-to-invoice conversion."
ADVICE_CURRENCIES = "💱 Multiple currencies detected. Consider currency risk management."
ADVICE_FEW_ROWS = "📊 Limited transaction data. More documents needed for better analysis."
ADVICE_TRACKING = "Consider implementing automated expense tracking"

GRADES = ["A+ (Excellent)", "A (Good)", "B (Fair)", "C (Needs Improvement)"]
OCR_PATTERNS = {
    "coordinates": r"\d+,\d+,\d+,\d+",
    "model_tokens": r"\[PAD\]|\[unused\d+\]",
    "long_capitals": r"[A-Z]{10,}",
    "long_blanks": r"\s{5,}",
}

# --- fixed values: stored report responses -------------------------------------------------

REPORT_RATIOS = [
    "marge_brute_percent", "marge_nette_percent", "rentabilite_actif_percent",
    "liquidite_generale", "autonomie_financiere_percent",
]
REPORT_AMOUNTS = ["chiffre_affaires", "total_actif", "total_passif", "resultat_net"]
REPORT_NOTES = ["points_forts", "points_faibles", "recommandations"]
TURNOVER_RATIOS = {
    "marge_brute_percent": 40.0, "marge_nette_percent": 8.0, "rentabilite_actif_percent": 6.7,
    "liquidite_generale": 4.0, "autonomie_financiere_percent": 81.7,
}

# --- fixed values: single stored responses ---------------------------------------------------
# field -> pattern that finds it in a response that cannot be parsed; then what it is without one
RESPONSE_PATTERNS = {
    "document_type": r'"document_type":\s*"([^"]+)"',
    "amount": r'"amount":\s*([0-9.]+)',
    "currency": r'"currency":\s*"([A-Z]{3})"',
}
RESPONSE_DEFAULTS = {
    "document_type": "unknown",
    "amount": 0.0,
    "currency": "USD",
    "description": "Extracted from document",
    "category": "mixed",
    "subcategory": "unclassified",
    "confidence": 0.6,
}
# shapes of values in report JSON that cannot be parsed
REPORT_AMOUNT_SHAPE = r"\d+(?:[,.]\d+)?"
REPORT_RATIO_SHAPE = r"\d+(?:\.\d+)?"
REPORT_TRANSACTION_SHAPE = r'"montant":\s*(\d+(?:[,.]\d+)?)[^}]*"libelle":\s*"([^"]+)"'
REPORT_TRANSACTION_ACCOUNT = "701"
REPORT_NOTES_KEPT = 3
