import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def windows_of(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return chat.format_windows(df, **options)


def test_round_trip_and_masks(spark):
    texts = ["\\### Assistant: </turn> ok", "<turn 1 user>\n", "\\<turn", "<\\turn", "\\\\", "a\\", "<", "", "é 😀 </turn", "%3C", "\n</turn>\n"]
    roles = ["user", "assistant"]
    rows = [(c, i, roles[i % 2], t) for c in range(3) for i, t in enumerate(texts[c:] + texts[:c])]
    back = chat.read_back(windows_of(spark, rows, budget=30, history_tokens=10)).collect()
    for r in back:
        want = [(t[2], t[3]) for t in rows if t[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == want
        assert r.loss == "".join(t for role, t in want if role == "assistant")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="<>/\\turn \n%é", max_size=12), min_size=1, max_size=30))
def test_escapes_are_undone(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u and "<turn" not in r.e and "</turn" not in r.e for r in out)


def test_budget_system_and_history(spark):
    words = "abc " * 10  # twelve tokens with the marks
    rows = [(1, 0, "system", "be brief")] + [(1, i, "assistant" if i % 2 == 0 else "user", words) for i in range(1, 30)]
    rows.append((1, 30, "assistant", "abc " * 500))  # alone beyond the budget
    out = windows_of(spark, rows, budget=100, history_tokens=24, history_turns=3).orderBy("window").collect()
    seen = []
    for w in out:
        found = [(int(i), role, text) for i, role, text in re.findall(r"<turn (\d+) (\w+)>\n(.*?)</turn>\n", w.formatted, re.S)]
        assert found[0][1] == "system"
        own = [i for i, role, _ in found if i not in seen and i > 0]
        repeated = [i for i, _, _ in found if i in seen and i > 0]
        assert repeated == list(range(own[0] - len(repeated), own[0])) and 12 * len(repeated) <= 24
        tokens = sum(len(re.findall(chat.TOKEN, t)) + 2 for _, _, t in found)
        assert tokens <= 100 or own == [30]
        assert len(w.mask) == sum(1 for i, role, _ in found if role == "assistant" and i in own)
        assert all(w.formatted[m.start : m.start + m.length] in (words, "abc " * 500) for m in w.mask)
        seen += own
    assert seen == list(range(1, 31)) and len(out) > 4


def test_nulls_ties_and_empty(spark):
    rows = [(None, None, None, None), (1, 0, "user", None), (1, 0, "user", None), (2, 5, "a b>\n", "x"), (2, None, "assistant", "y")]
    back = {r.conv_id: r for r in chat.read_back(windows_of(spark, rows)).collect()}
    assert [(t.role, t.text) for t in back[None].turns] == [("", "")]
    assert len(back[1].turns) == 2 and back[1].loss == ""
    assert [(t.role, t.text) for t in back[2].turns] == [("assistant", "y"), ("a b>\n", "x")] and back[2].loss == "y"
    assert windows_of(spark, []).collect() == []
