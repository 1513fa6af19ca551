"""All statements by query name."""

from oracle import corpus_sql, finance_sql, rule_sql, text_sql

STATEMENTS: dict[str, str] = {}
for _module in (text_sql, rule_sql, finance_sql, corpus_sql):
    STATEMENTS |= _module.STATEMENTS
