r"""One spelling of a text pattern for two regex engines.

Rules are written with ``\w``, ``\s`` and ``\d`` meaning Unicode letters, blanks and digits.
Java (Spark) reads the shorthands as ASCII and so does RE2, so they are spelled out as
property classes that both engines read alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
BLANK = r"\s\x0B\x1C-\x1F\x85\p{Z}"
DIGIT = r"\p{Nd}"

# Characters that Unicode-aware stripping removes from both ends of a string.
BLANK_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

_SHORTHAND = {"w": WORD, "s": BLANK, "d": DIGIT}


def portable(pattern: str) -> str:
    """Spell out the Unicode shorthands of ``pattern``; a leading word edge becomes a class."""
    if pattern.startswith(r"\b"):
        pattern = rf"(?:^|[^{WORD}])" + pattern[2:]
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            body = _SHORTHAND.get(nxt)
            if body is None:
                out.append(ch + nxt)
            else:
                out.append(body if in_class else f"[{body}]")
            i += 2
            # property classes such as \p{L} keep their braces
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return "".join(out)


def java(pattern: str, ignore_case: bool = True) -> str:
    """Pattern text for Spark; ``(?d)`` keeps newline the only character ``.`` skips."""
    return ("(?diu)" if ignore_case else "(?d)") + portable(pattern)


def python(pattern: str) -> str:
    """Pattern text for Python, whose shorthands are Unicode's; a leading word edge becomes a class as in :func:`portable`."""
    return r"(?:^|[^\w])" + pattern[2:] if pattern.startswith(r"\b") else pattern


def required_literal(pattern: str) -> str:
    """Longest plain text that every match of ``pattern`` contains ('' if none is sure)."""
    outside, depth = [], 0
    for part in re.findall(r"\\.|\[[^]]*\]|.", pattern):
        if part == "|" and depth == 0:
            return ""
        if part in "()":
            depth += 1 if part == "(" else -1
            part = "\0"
        outside.append(part if depth == 0 and (part.isalpha() or part in " ?*{") else "\0")
    runs = re.findall(r"[^\0?*{]+(?![?*{])|[^\0?*{]+(?=[?*{])", "".join(outside))
    # a letter under a quantifier may be absent
    sure = [r if not re.search(re.escape(r) + r"[?*{]", "".join(outside)) else r[:-1] for r in runs]
    return max(sure, key=len, default="")


def may_have(col: Column, pattern: str) -> Column:
    """A substring test that holds wherever ``pattern`` matches the lower-case ``col`` ignoring case; true without one.

    The letters i, s and k are left out: the dotless i, the long s and the Kelvin sign match them, too.
    """
    part = max(re.split("[isk]", required_literal(pattern)), key=len)
    return col.contains(part) if len(part) > 1 else F.lit(True)


def has(col: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Whether ``pattern`` matches; a plain substring test goes first where it can decide."""
    matched = col.rlike(java(pattern, ignore_case))
    part = "" if ignore_case else required_literal(pattern)
    return col.contains(part) & matched if len(part) > 1 else matched


def sql_text(value: str) -> str:
    """Raw SQL string literal."""
    if "'" not in value:
        return f"r'{value}'"
    if '"' not in value:
        return f'r"{value}"'
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_has(name: str, pattern: str, ignore_case: bool = True) -> str:
    matched = f"{name} rlike {sql_text(java(pattern, ignore_case))}"
    part = "" if ignore_case else required_literal(pattern)
    return f"(contains({name}, {sql_text(part)}) and {matched})" if len(part) > 1 else f"({matched})"


def by_literal(patterns: Iterable[str]) -> dict[str, list[str]]:
    """Patterns under the plain text that each needs ('' if none is sure)."""
    groups: dict[str, list[str]] = {}
    for p in patterns:
        part = required_literal(p)
        groups.setdefault(part if len(part) > 1 else "", []).append(p)
    return groups


def sql_any(name: str, patterns: Iterable[str]) -> str:
    """Whether any pattern matches; those that need the same text share one test for it."""
    tests = []
    for part, group in by_literal(patterns).items():
        matched = " or ".join(f"{name} rlike {sql_text(java(p, False))}" for p in group)
        tests.append(f"(contains({name}, {sql_text(part)}) and ({matched}))" if part else f"({matched})")
    return "(" + " or ".join(tests) + ")"


def sql_hits(name: str, patterns: Iterable[str]) -> str:
    """How many patterns match; those that need the same text share one test for it."""
    sums = []
    for part, group in by_literal(patterns).items():
        hits = " + ".join(f"cast({name} rlike {sql_text(java(p, False))} as int)" for p in group)
        sums.append(f"if(contains({name}, {sql_text(part)}), {hits}, 0)" if part else f"({hits})")
    return "(" + " + ".join(sums) + ")"


def sql_contains(name: str, words: Iterable[str]) -> str:
    return "(" + " or ".join(f"contains({name}, {sql_text(w)})" for w in words) + ")"


def sql_count(name: str, words: Iterable[str]) -> str:
    return "(" + " + ".join(f"cast(contains({name}, {sql_text(w)}) as int)" for w in words) + ")"


def let_sql(value: Column, body: str, name: str = "t") -> Column:
    """Evaluate ``value`` once and hand it to a SQL expression under ``name``.

    Word lists and pattern lists become one expression text instead of thousands of column
    objects, and long ones stay out of generated code, whose methods are limited in size.
    """
    return F.get(F.call_function("transform", F.array(value), F.expr(f"{name} -> {body}")), F.lit(0))


def has_any(col: Column, patterns: Iterable[str], ignore_case: bool = True) -> Column:
    if not ignore_case:
        return let_sql(col, sql_any("t", patterns))
    return let_sql(col, " or ".join(sql_has("t", p) for p in patterns))


def contains_any(col: Column, words: Iterable[str]) -> Column:
    return let_sql(col, sql_contains("t", words))


def count_contained(col: Column, words: Iterable[str]) -> Column:
    """How many of ``words`` occur in ``col``."""
    return let_sql(col, sql_count("t", words))


def first_group(col: Column, pattern: str, group: int = 1, ignore_case: bool = True) -> Column:
    """Captured text of the first match, null without one."""
    return F.nullif(F.regexp_extract(col, java(pattern, ignore_case), group), F.lit(""))


def all_groups(col: Column, pattern: str, group: int = 1, ignore_case: bool = True) -> Column:
    return F.regexp_extract_all(col, F.lit(java(pattern, ignore_case)), F.lit(group))


def replace_all(col: Column, pattern: str, replacement: str, ignore_case: bool = False) -> Column:
    return F.regexp_replace(col, java(pattern, ignore_case), replacement)


def strip(col: Column) -> Column:
    """Blanks off both ends, Unicode ones included."""
    return F.btrim(col, F.lit(BLANK_CHARS))


def collapse_blanks(col: Column) -> Column:
    return strip(replace_all(col, r"\s+", " "))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``: a one-element array transform."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
