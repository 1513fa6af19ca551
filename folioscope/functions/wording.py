"""Many words and patterns looked for in one text, in Arrow batches.

The rule catalogue asks some 350 questions of every text, each a search of its own as an expression. Here a word is looked for
once, and only where a shorter one that it holds has been found; words beyond ASCII only in texts beyond ASCII.
"""

from __future__ import annotations

from collections.abc import Collection
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.patterns import by_literal, python


class Question(NamedTuple):
    """Words and patterns; the answer is how many of them are in the text, a pattern counting ``weight``."""

    words: list[str] = []
    patterns: list[str] = []
    weight: int = 1


def asker(questions: dict[str, Question], flags: bool | Collection[str] = False):
    """Arrow UDF: a struct with the count per question, or with whether it is above zero; null texts give nulls.

    ``flags`` is true for all questions, or names those answered by whether. Questions of one asker share the search of a text.

    The worker imports only the standard library and pyarrow, so the function can be shipped without this package.
    """
    names = list(questions)
    whether = [flags if isinstance(flags, bool) else n in flags for n in names]
    # what each word, or plain text that patterns need, adds to which question
    adds: dict[str, list[tuple[int, int]]] = {}
    opens: dict[str, list[tuple[int, int, str]]] = {}
    for k, q in enumerate(questions.values()):
        for w in q.words:
            adds.setdefault(w, []).append((k, 1))
        for part, group in by_literal(q.patterns).items():
            opens.setdefault(part, []).extend((k, q.weight, python(p)) for p in group)
    always = opens.pop("", [])
    needles = sorted({*adds, *opens})
    held = {w: max((v for v in needles if v != w and v in w), key=len, default="") for w in needles}
    within: dict[str, list[str]] = {}
    for w, v in held.items():
        within.setdefault(v, []).append(w)
    roots = within.get("", [])
    plain = [w for w in roots if w.isascii()]

    kinds = ["boolean" if w else "int" for w in whether]

    @F.arrow_udf(f"struct<{', '.join(f'`{n}`: {k}' for n, k in zip(names, kinds))}>")
    def ask(texts: pa.Array) -> pa.Array:
        import re

        import pyarrow as pa

        searches = {part: [(k, n, re.compile(p).search) for k, n, p in group] for part, group in {**opens, "": always}.items()}
        none = ()
        rows = []
        for t in texts.to_pylist():
            if t is None:
                rows.append([None] * len(names))
                continue
            found = [w for w in (plain if t.isascii() else roots) if w in t]
            for w in found:  # grows by longer words
                if w in within:
                    found += [v for v in within[w] if v in t]
            counts = [0] * len(names)
            for w in found:
                for k, n in adds.get(w, none):
                    counts[k] += n
            for w in (*found, ""):
                for k, n, search in searches.get(w, none):
                    if search(t):
                        counts[k] += n
            rows.append(counts)
        columns = zip(*rows) if rows else [()] * len(names)
        arrays = [pa.array(c, pa.int32()) for c in columns]
        return pa.StructArray.from_arrays([a.cast(pa.bool_()) if w else a for a, w in zip(arrays, whether)], names)

    return ask
