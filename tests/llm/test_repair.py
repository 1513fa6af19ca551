import hashlib
import heapq
import random
import re

import duckdb
import pytest

from folioscope.llm import queries, repair, statements

LEGAL = re.compile(r"(s?(ua)+)?")
BLANK = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """``(cost, audit, repaired)`` by a search over all edit strings, dearest last."""
    heap, seen = [(0, "", 0, ())], set()
    while True:
        cost, audit, i, out = heapq.heappop(heap)
        shape = "".join(role[:1] for role, _ in out)
        if i == len(rows) and LEGAL.fullmatch(shape):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
        if (i, shape) in seen or not re.fullmatch(r"s?(ua)*u?", shape):
            continue
        seen.add((i, shape))
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", i, (*out, (role, ""))))
        if i < len(rows):
            role, text, lost, cut = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, out))
            if not lost:
                if role[:1] in ("s", "u", "a"):
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, (*out, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, (*out, (new, text))))


def brute_force(rows):
    """Rows ``(conv_id, turn, role, text)`` to ``conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha)``."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        told, counts, before = [], [0, 0, 0], set()
        for _, role, text in own:
            blank, seen = not text.strip(BLANK), (role, text) in before
            cut = not blank and not seen and text.strip(BLANK)[-1] not in ".!?"
            counts = [a + b for a, b in zip(counts, (blank, not blank and seen, cut))]
            before.add((role, text))
            told.append((role, text, blank or seen, int(cut)))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        wrong = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, repaired = cheapest(told)
        out[conv] = (gaps, *counts, wrong, cost, audit, hashlib.sha256(repaired.encode()).hexdigest())
    return out


def repaired(df):
    edited, totals = repair.repair(df)
    ends = {r.conv_id: (r.audit, r.repaired_sha256) for r in repair.digests(edited).collect()}
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, *ends[r.conv_id]) for r in totals.collect()}


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randrange(1, longest + 1)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No", "", " \t", None, "Grün!", "why?\n", f"Text {turn}.", f"Cut {turn}", "x" * 30 + "."])
            rows += [(conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text)] * rng.choice([1, 1, 1, 2])
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("segment", [1, 3, 256])
def test_equals_a_search_over_all_edits(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = random_rows(segment, 60, 7)
    rows += [(None, 1, "user", "No conversation."), (None, None, "assistant", "None."), (-5, 1, "assistant", "")]
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA + ", audit string, n int").repartition(3)
    assert repaired(df) == brute_force(rows)


def test_long_conversation_in_many_segments(spark, monkeypatch):
    """One conversation holds most rows; its segments are parsed apart, and the table's SQL form gives the same."""
    rng = random.Random(8)
    rows = [(1, k, rng.choice(["user", "assistant", "system"]), rng.choice([f"t {k}.", f"cut {k}", "same.", ""])) for k in range(1500)]
    rows += [(2, 0, "user", "Hello.")] + [(3, 5, "user", "copied.")] * 400
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    monkeypatch.setattr(repair, "SEGMENT", 16)
    short = repaired(df)
    monkeypatch.setattr(repair, "SEGMENT", 1024)
    assert short == repaired(df)
    assert short[3][1:] == (0, 399, 0, 399, 2 + 3 * 399, "K" + "D" * 399 + "I", hashlib.sha256(b"user:copied.\nassistant:").hexdigest())
    parsed, role = short[1][6], [r[2][0] for r in rows]
    kept = [r for r, e in zip(role, parsed.replace("I", "")) if e != "D"]
    assert len(parsed.replace("I", "")) == 1500 and len(kept) > 500


def test_edited_rows_follow_the_audit(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hi"), (1, 2, "assistant", "Hello."), (1, 3, "user", "  ")]
    edited, _ = repair.repair(spark.createDataFrame(rows, SCHEMA))
    got = [(r.edits, r.role, r.text) for r in edited.orderBy("at", "step").collect()]
    assert got == [("K", "system", "Be kind."), ("R", "user", "Hi"), ("K", "assistant", "Hello."), ("D", None, None)]


def test_query_equals_its_sql_on_odd_rows(spark, tmp_path):
    rows = random_rows(77, 40, 9) + [(None, 4, "user", "A."), (None, 5, "user", None), (901, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_repair(spark, str(tmp_path))
    db = duckdb.connect()
    db.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = db.sql(statements.STATEMENTS["op13_repair"])
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    assert sorted(map(tuple, got.select(names).collect()), key=str) == sorted(want.select(*names).fetchall(), key=str)


def test_empty_table_and_very_long_texts(spark):
    empty = spark.createDataFrame([], SCHEMA)
    edited, totals = repair.repair(empty)
    assert edited.collect() == [] and totals.collect() == [] and repair.digests(edited).collect() == []
    rows = [(1, 0, "user", "word " * 200_000 + "."), (1, 1, "assistant", "word " * 200_000)]
    assert repaired(spark.createDataFrame(rows, SCHEMA)) == brute_force(rows)


def test_stacks_with_one_top_can_be_continued_alike():
    p = repair.parser()
    tops: dict = {}
    for number, stack in enumerate(p.stacks):
        shape = (p.accepted[number], p.expects[number], {k: sorted((a, c, p.accepted[to], p.expects[to]) for a, c, to in e) for k, e in p.table[number].items()})
        assert tops.setdefault(stack[0], shape) == shape
