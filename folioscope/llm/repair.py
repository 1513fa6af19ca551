"""Conversations brought to a legal order of roles by generalised LR repair.

A conversation's role initials have to derive from a grammar: a system turn or none, then pairs of a user and an
assistant turn, or nothing at all. Rows are kept, deleted or given another role, and empty rows are inserted, at the least cost and, among
equal costs, with the ASCII-least string of edits (one letter an edit: Keep, Rerole, Delete, Insert).

The parser is the grammar's LR(0) automaton, run over all edits at once. Its stacks are linked cells that share their lower
parts, and stacks of one top are merged into the one of least (cost, audit): a top's state tells which roles can
follow. A string of edits that is a proper prefix of another one costs less, so the lesser of two equally
dear strings stays the lesser whatever is appended: the merge loses nothing.

What a run of rows does to every stack it may meet is worked out on its own and put together afterwards, so rows of one
conversation are parsed in many tasks.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import kept

#: Production left and right side; small letters are role initials.
GRAMMAR = (("S", ""), ("S", "sP"), ("S", "P"), ("P", "PX"), ("P", "X"), ("X", "ua"))
START = "S"
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
LEGAL = ("su", "ua", "au")
#: Neighbouring rows that are parsed together.
SEGMENT = 256
BLANKS = " \t\n\x0b\x0c\r"

Item = tuple[int, int]  # production, place in its right side
Stack = tuple  # (state, the stack below it or None)


class RoleParser:
    """The LR(0) automaton of a grammar, and what each kind of row does to each stack.

    A kind of row is one letter: the role's initial, ``x`` for any other; a capital for a truncated row; ``d`` for one that
    has to be deleted.
    """

    def __init__(self, grammar=GRAMMAR, start: str = START):
        self.grammar = (("", start), *grammar)
        self.letters = sorted({c for _, right in grammar for c in right if c.islower()})
        first = self._closed({(0, 0)})
        states, self.moves = [first], {}
        for state in states:
            for symbol in sorted({self.grammar[p][1][k] for p, k in state if k < len(self.grammar[p][1])}):
                after = self._closed({(p, k + 1) for p, k in state if self.grammar[p][1][k : k + 1] == symbol})
                if after not in states:
                    states.append(after)
                self.moves[states.index(state), symbol] = states.index(after)
        self.ended = [[p for p, k in sorted(s) if k == len(self.grammar[p][1])] for s in states]
        empty = (0, None)
        begun = self._with_inserts({0: (0, "", empty)})
        # all stacks that rows can lead to, and what each kind of row makes of them
        self.stacks: list[Stack] = [empty]
        self.table: list[dict[str, list[tuple[str, int, int]]]] = []
        kinds = [*"xX", *self.letters, *(c.upper() for c in self.letters), "d"]
        self.begun = [(cost, audit, self._number(s)) for cost, audit, s in begun.values()]
        for stack in self.stacks:
            effects = {}
            for kind in kinds:
                tops = self._with_inserts(self._edited(stack, kind))
                effects[kind] = [(audit, cost, self._number(s)) for cost, audit, s in tops.values()]
            self.table.append(effects)
        self.accepted = [self._accepts(s) for s in self.stacks]
        self.expects = [next(ROLES[c] for c in ROLES if (s[0], c) in self.moves) for s in self.stacks]

    def _closed(self, items: set[Item]) -> frozenset[Item]:
        found = list(items)
        for p, k in found:
            symbol = self.grammar[p][1][k : k + 1]
            found += [(q, 0) for q, (left, _) in enumerate(self.grammar) if left and left == symbol and (q, 0) not in found]
        return frozenset(found)

    def _reduced(self, stack: Stack) -> list[Stack]:
        """The stack and all that reductions make of it."""
        found = [stack]
        for s in found:
            for p in self.ended[s[0]]:
                left, right = self.grammar[p]
                below = s
                for _ in right:
                    below = below[1]
                if left and (after := self.moves.get((below[0], left))) is not None:
                    found.append((after, below))
        return found

    def _shifted(self, stack: Stack, letter: str) -> list[Stack]:
        """The stacks after a role, reduced, that another role can follow."""
        to = self.moves.get((stack[0], letter))
        if to is None:
            return []
        return [s for s in self._reduced((to, stack)) if any((s[0], c) in self.moves for c in self.letters)]

    def _accepts(self, stack: Stack) -> bool:
        return any(0 in self.ended[s[0]] for s in self._reduced(stack))

    def _number(self, stack: Stack) -> int:
        if stack not in self.stacks:
            self.stacks.append(stack)
        return self.stacks.index(stack)

    @staticmethod
    def _merge(tops: dict, cost: int, audit: str, stack: Stack) -> bool:
        better = stack[0] not in tops or (cost, audit) < tops[stack[0]][:2]
        if better:
            tops[stack[0]] = (cost, audit, stack)
        return better

    def _with_inserts(self, tops: dict) -> dict:
        work = list(tops.values())
        for cost, audit, stack in work:
            for letter in ROLES:
                for s in self._shifted(stack, letter):
                    if self._merge(tops, cost + INSERT, audit + "I", s):
                        work.append((cost + INSERT, audit + "I", s))
        return tops

    def _edited(self, stack: Stack, kind: str) -> dict:
        tops: dict = {}
        self._merge(tops, DELETE, "D", stack)
        if kind != "d":
            extra = TRUNCATED if kind.isupper() else 0
            for s in self._shifted(stack, kind.lower()):
                self._merge(tops, extra, "K", s)
            for letter in ROLES:
                for s in self._shifted(stack, letter):
                    self._merge(tops, extra + REROLE, "R", s)
        return tops

    def run(self, frontier: list[tuple[int, str, int]], kinds: str) -> list[tuple[int, str, int]]:
        """Tops ``(cost, audit, stack number)`` after rows."""
        for kind in kinds:
            tops: dict = {}
            for cost, audit, number in frontier:
                for letters, more, to in self.table[number][kind]:
                    top, found = self.stacks[to][0], (cost + more, audit + letters, to)
                    if top not in tops or found < tops[top]:
                        tops[top] = found
            frontier = list(tops.values())
        return frontier


@lru_cache(1)
def parser() -> RoleParser:
    return RoleParser()


def digest(text: str) -> F.Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def arranged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, n, at, segment``: rows in the order of ``at``, equal rows as one with a count."""
    clean = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    counted = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *clean).groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    order = ["conv_id", "turn", "role", "text"]  # ascending, so that nulls come first
    placed = counted.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return kept(placed.withColumn("segment", F.expr(f"at div {SEGMENT}")), "turns")


def with_faults(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, at, segment, n, initial, blank, seen, cut``: what is wrong with each row.

    Its first of equal role and text in a conversation is found by grouping and told by its own place, so a
    repeated text is never a join key.
    """
    firsts = rows.groupBy("conv_id", "role", digest("text").alias("digest")).agg(F.min("at").alias("at")).select("at", F.lit(False).alias("seen"))
    text = F.btrim("text", F.lit(BLANKS))
    told = rows.select(
        "conv_id", "turn", "at", "segment", "n", F.substring("role", 1, 1).alias("initial"),
        (text == "").alias("blank"), (~F.right(text, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    return told.join(firsts, "at", "left").withColumn("seen", F.coalesce("seen", F.lit(True)))


def counted_faults(faults: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated`` per conversation."""
    n = F.col("n")
    good = ~F.col("blank")
    return faults.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        F.sum(F.when(F.col("blank"), n).otherwise(0)).alias("blank"),
        F.sum(F.when(good, F.when(F.col("seen"), n).otherwise(n - 1)).otherwise(0)).alias("duplicate"),
        F.sum((good & ~F.col("seen") & F.col("cut")).cast("long")).alias("truncated"),
    )


def segments(faults: DataFrame) -> DataFrame:
    """``conv_id, segment, kinds, initials, whole``: the rows of a segment as strings of one letter a row; ``whole`` tells
    that the conversation surely begins in the segment."""
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    lost = F.col("blank") | F.col("seen")
    kind = F.when(lost, "d").when(F.col("cut"), F.upper(initial)).otherwise(initial)
    row = F.struct(
        "at",
        F.concat(kind, F.expr("repeat('d', cast(n - 1 as int))")).alias("kinds"),
        F.expr("repeat(initial, cast(n as int))").alias("initials"),
    )
    rows = faults.withColumn("initial", initial).groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return rows.select(
        "conv_id", "segment",
        F.array_join("rows.kinds", "").alias("kinds"), F.array_join("rows.initials", "").alias("initials"),
        (F.col("rows")[0]["at"] % SEGMENT != 0).alias("whole"),
    )


def illegal(initials: str) -> int:
    return sum(initials[k : k + 2] not in LEGAL for k in range(len(initials) - 1))


def summaries(rows: DataFrame) -> DataFrame:
    """``conv_id, segment, effects, first, last, illegal``: what a segment makes of every stack that may come before it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser()
        for batch in batches:
            kinds, initials, whole = (batch.column(c).to_pylist() for c in ("kinds", "initials", "whole"))
            before = [sorted({s for _, _, s in p.begun}) if w else range(len(p.stacks)) for w in whole]
            effects = [{s: p.run([(0, "", s)], k) for s in some} for some, k in zip(before, kinds)]
            columns = [
                batch.column("conv_id"), batch.column("segment"), pa.array([zlib.compress(json.dumps(e).encode(), 1) for e in effects]),
                pa.array([i[0] for i in initials]), pa.array([i[-1] for i in initials]), pa.array([illegal(i) for i in initials], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "segment", "effects", "first", "last", "illegal"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"conv_id {kind}, segment long, effects binary, first string, last string, illegal long")


class Walk:
    """The tops of one conversation, segment by segment. A top holds its cost, its edits since the last segment that all
    tops agree on, its stack and the chain of its segments since then."""

    def __init__(self, p: RoleParser):
        self.p, self.chained, self.illegal, self.last = p, 0, 0, ""
        self.tops = [(cost, audit, stack, None) for cost, audit, stack in p.begun]

    def add(self, segment: int, effects: dict, first: str, last: str, inside: int) -> list[tuple[int, str, str]]:
        """Take a segment; returns ``(segment, expects, audit)`` of those that are settled."""
        self.illegal += inside + (self.last != "" and self.last + first not in LEGAL)
        self.last = last
        best: dict = {}
        for cost, tail, stack, chain in self.tops:
            for more, audit, to in effects[str(stack)]:
                own = (tail + audit, self.p.expects[0]) if chain is None and not self.chained else (audit, self.p.expects[stack])
                found = (cost + more, tail + audit, to, (segment, own, chain))
                top = self.p.stacks[to][0]
                if top not in best or found[:2] < best[top][:2]:
                    best[top] = found
        self.tops, self.chained = list(best.values()), self.chained + 1
        return self.settle()

    def settle(self) -> list[tuple[int, str, str]]:
        level, depth = {id(t[3]): t[3] for t in self.tops}, 0
        while len(level) > 1:
            level, depth = {id(c[2]): c[2] for c in level.values()}, depth + 1
        (shared,) = level.values()
        if shared is None:
            return []
        done = []
        chain = shared
        while chain:
            segment, (audit, expects), chain = chain
            done.append((segment, expects, audit))
        tops = []
        for cost, _, stack, chain in self.tops:
            cells = []
            while chain is not shared:
                cells.append(chain[:2])
                chain = chain[2]
            for segment, own in reversed(cells):
                chain = (segment, own, None if chain is shared else chain)
            tops.append((cost, "".join(own[0] for _, own in reversed(cells)), stack, None if chain is shared else chain))
        self.tops = tops
        return done[::-1]

    def end(self) -> tuple[list[tuple[int, str, str]], int, int]:
        """The rest, the cost and the illegal neighbours."""
        self.tops = [min((t for t in self.tops if self.p.accepted[t[2]]), key=lambda t: t[:2])]
        return self.settle(), self.tops[0][0], self.illegal


def decisions(found: DataFrame) -> DataFrame:
    """``conv_id, segment, expects, audit, cost, illegal``: the edits of each segment; the last two stand in a
    conversation's last segment. Conversations are walked through segment by segment, with little held at a time."""
    names = ["conv_id", "segment", "expects", "audit", "cost", "illegal"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser()
        walk, at, rows = None, None, []

        def close():
            settled, cost, wrong = walk.end()
            rows.extend([at, *s, None, None] for s in settled)
            return cost, wrong

        def taken(kind: pa.DataType) -> pa.RecordBatch:
            types = [kind, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        kind = None
        for batch in batches:
            kind = batch.column("conv_id").type
            for conv, segment, effects, first, last, inside in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if walk is None or conv != at:
                    if walk is not None:
                        rows.append([at, None, None, None, *close()])
                    walk, at = Walk(p), conv
                settled = walk.add(segment, json.loads(zlib.decompress(effects)), first, last, inside)
                rows.extend([at, *s, None, None] for s in settled)
            yield taken(kind)
        if walk is not None:
            rows.append([at, None, None, None, *close()])
            yield taken(kind)

    conv = found.schema["conv_id"].dataType.simpleString()
    in_order = found.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return in_order.mapInArrow(work, f"conv_id {conv}, segment long, expects string, audit string, cost long, illegal long")


def ends_of(audit: str, n: int) -> int:
    """How much of an audit ``n`` rows take: all up to the n-th letter that is no insert."""
    k = 0
    while n:
        n -= audit[k] != "I"
        k += 1
    return k


def applied(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """``conv_id, at, step, edits, role, text``: every row's edits; role and text are null where it is deleted.

    A segment's decision comes before its rows, which are streamed past it.
    """
    given = decided.select("conv_id", "segment", F.lit(-1).cast("long").alias("at"), F.col("expects").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("n"))
    both = given.unionByName(rows.select("conv_id", "segment", "at", "role", "text", "n"))
    streamed = both.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "at")
    edit = re.compile("D+|.")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        state = {"conv": None, "at": None, "left": "", "role": "", "step": 0}

        def put(letters: str, role, text) -> None:
            out.append((state["conv"], state["at"], state["step"], letters, role, text))
            state["step"] += 1
            if role is not None:
                state["role"] = ROLES["a"] if role[:1] == "u" else ROLES["u"]

        def inserts(letters: str) -> None:
            for _ in letters:
                put("I", state["role"], "")

        def emitted(kind: pa.DataType) -> pa.RecordBatch:
            types = [kind, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "at", "step", "edits", "role", "text"])

        kind = None
        for batch in batches:
            kind = batch.column("conv_id").type
            for conv, _, at, role, text, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "at", "role", "text", "n"))):
                if at < 0:
                    inserts(state["left"])
                    state.update(conv=conv, role=role, left=text)
                    continue
                state.update(at=at, step=0)
                upto = ends_of(state["left"], n)
                own, state["left"] = state["left"][:upto], state["left"][upto:]
                for letters in edit.findall(own):
                    if letters == "I":
                        inserts(letters)
                    elif letters[0] == "D":
                        put(letters, None, None)
                    else:
                        put(letters, role if letters == "K" else state["role"], text)
            if kind is not None and len(out) > 0:
                yield emitted(kind)
        inserts(state["left"])
        if out:
            yield emitted(kind)

    conv = rows.schema["conv_id"].dataType.simpleString()
    return streamed.mapInArrow(work, f"conv_id {conv}, at long, step long, edits string, role string, text string")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repair all conversations of ``turns`` (``conv_id, turn, role, text``); returns ``(edited, totals)``.

    ``edited``: ``conv_id, at, step, edits, role, text``, in a conversation's order by ``at`` and ``step``; the rows whose role is
    not null are the repaired conversation, all ``edits`` in order are its audit. ``totals``: ``conv_id, gaps, blank, duplicate,
    truncated, illegal, cost``, one row per conversation.

    A row's first fault counts: blank (nothing but ASCII blanks), duplicate (role and text stand earlier in the conversation),
    truncated (its last character that is no blank is not ``.``, ``!`` or ``?``). Blank and duplicate rows are deleted; a
    truncated row that stays costs one more. Rows are ordered by turn (nulls first), role and text; null roles and texts
    are one space; rows with a null conv_id are one conversation. Roles are told by their first letter; a role other than system,
    user or assistant is never kept. Equal rows are repeats of each other. An empty table gives empty tables; other
    columns are ignored.

    Texts are moved three times (counted, ordered, edited) and never gathered: a segment holds ``SEGMENT`` rows as letters, and the segments of
    a conversation go through one task as the effects on at most a handful of stacks.
    """
    rows = arranged(turns)
    faults = kept(with_faults(rows), "faults")
    decided = kept(decisions(summaries(segments(faults))), "decisions")
    ends = decided.filter("cost is not null").select("conv_id", "illegal", "cost")
    counts = counted_faults(faults)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    all_counts = counts.unionByName(ends, allowMissingColumns=True)  # grouped, since a join would lose the null conv_id
    totals = all_counts.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in names])
    return applied(rows, decided.filter("segment is not null")), totals


def digests(edited: DataFrame) -> DataFrame:
    """``conv_id, audit, repaired_sha256`` from the edited rows.

    A checksum of a whole conversation needs its texts one after the other, so its rows are streamed through
    one task, in which nothing but the audit is held.
    """
    streamed = edited.repartition("conv_id").sortWithinPartitions("conv_id", "at", "step")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began, at, audit, digest_, rows, kind = False, None, [], None, [], None

        def emitted() -> pa.RecordBatch:
            ids, audits, sums = zip(*rows) if rows else ((), (), ())
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(ids), kind), pa.array(list(audits), pa.string()), pa.array(list(sums), pa.string())], ["conv_id", "audit", "repaired_sha256"])

        for batch in batches:
            kind = batch.column("conv_id").type
            for conv, edits, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edits", "role", "text"))):
                if not began or conv != at:
                    if began:
                        rows.append((at, "".join(audit), digest_.hexdigest()))
                    began, at, audit, digest_, any_ = True, conv, [], hashlib.sha256(), False
                audit.append(edits)
                if role is not None:
                    digest_.update((("\n" if any_ else "") + f"{role}:{text}").encode())
                    any_ = True
            yield emitted()
        if began:
            rows.append((at, "".join(audit), digest_.hexdigest()))
            yield emitted()

    conv = edited.schema["conv_id"].dataType.simpleString()
    return streamed.mapInArrow(work, f"conv_id {conv}, audit string, repaired_sha256 string")
