"""Conversations as training windows under a token budget, with loss masks; native expressions only.

Template, one block per turn::

    <turn IDX ROLE>
    TEXT</turn>

Inside texts a backslash is doubled and the two marks ``<turn`` and ``</turn`` get a backslash after
``<``; roles are URL-encoded. Both are undone exactly by ``unescaped`` and ``url_decode``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY_TOKENS = 192
HISTORY_TURNS = 2
#: A token is at most six characters that are not blanks.
TOKEN = r"[^ \t\n\r]{1,6}"
MARKS = 2  # tokens counted for a turn's two marks


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("</turn"), F.lit("<\\/turn")), F.lit("<turn"), F.lit("<\\turn"))


def unescaped(text: Column) -> Column:
    opened = F.replace(F.replace(text, F.lit("<\\turn"), F.lit("<turn")), F.lit("<\\/turn"), F.lit("</turn"))
    return F.replace(opened, F.lit("\\\\"), F.lit("\\"))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)) + F.lit(MARKS)


def format_windows(
    turns: DataFrame,
    budget: int = BUDGET,
    history_tokens: int = HISTORY_TOKENS,
    history_turns: int = HISTORY_TURNS,
    loss_role: str = "assistant",
) -> DataFrame:
    """``(conv_id, turn, role, text)`` to ``(conv_id, window, formatted, mask)``.

    A conversation's leading turn is its system turn if its role is ``system``. With P the prefix
    sum of the tokens of the turns before a turn, the window of a turn is ``P div stride``, so spans
    start and end between turns. The stride is what the budget leaves after the system turn, the history
    and the conversation's longest turn; so a window keeps to the budget unless one turn alone does
    not fit, which then has a window of its own. A later window begins with the system turn and with
    up to ``history_turns`` turns before its span that hold at most ``history_tokens``.

    ``mask`` lists ``(start, length)`` in characters of ``formatted``: the texts of ``loss_role`` turns of the
    span. Repeated history is never in a mask, so each target is trained on once.

    Turns are ordered by turn, role, text; repeated rows count as turns of their own. Null text and
    null role are empty; rows with a null conv_id form one conversation; null turns come first; an
    empty table gives no windows; other columns are ignored. Only a window is ever gathered into
    one row; a conversation is worked through by window functions, which spill.
    """
    by_conv = W.partitionBy("conv_id")
    order = by_conv.orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("idx", (F.row_number().over(order) - 1).cast("long"))
    is_system = (F.col("idx") == 0) & (F.col("role") == "system")
    head = F.concat(F.lit("<turn "), F.col("idx"), F.lit(" "), F.url_encode("role"), F.lit(">\n"))
    rows = rows.select(
        "conv_id", "idx", is_system.alias("is_system"), (F.col("role") == loss_role).alias("is_target"),
        token_count(F.col("text")).cast("long").alias("tokens"), head.alias("head"), escaped(F.col("text")).alias("body"),
    )
    counted = F.when(~F.col("is_system"), F.col("tokens")).otherwise(0)
    along = by_conv.orderBy("idx")
    before = along.rowsBetween(W.unboundedPreceding, -1)
    block = F.concat("head", "body", F.lit("</turn>\n"))
    earlier = [F.lag(F.struct("is_system", "tokens", block.alias("block")), i).over(along) for i in range(history_turns, 0, -1)]
    rows = rows.select(
        "*",
        F.coalesce(F.sum(counted).over(before), F.lit(0)).alias("prefix"),
        F.max(counted).over(by_conv).alias("longest"),
        F.max(F.when(F.col("is_system"), F.col("tokens")).otherwise(0)).over(by_conv).alias("system_tokens"),
        F.first(F.when(F.col("is_system"), block)).over(along).alias("system_block"),
        F.array(*earlier).alias("earlier"),
    )
    stride = F.greatest(F.lit(budget) - F.lit(history_tokens) - F.col("system_tokens") - F.col("longest"), F.lit(1))
    rows = rows.withColumn("window", F.when(F.col("is_system"), F.lit(0)).otherwise(F.floor(F.col("prefix") / stride)).cast("long"))
    in_window = W.partitionBy("conv_id", "window")
    rows = rows.withColumn("first", F.col("idx") == F.min("idx").over(in_window))
    # the history's turns from the latest back, while their sum keeps to the limit
    latest_first = F.filter(F.reverse("earlier"), lambda t: t.isNotNull() & ~t["is_system"])
    taken = F.aggregate(
        latest_first,
        F.struct(F.lit(0).cast("long").alias("sum"), F.lit("").alias("blocks")),
        lambda acc, t: F.when(
            acc["sum"] + t["tokens"] <= history_tokens,
            F.struct((acc["sum"] + t["tokens"]).alias("sum"), F.concat(t["block"], acc["blocks"]).alias("blocks")),
        ).otherwise(F.struct(F.lit(history_tokens + 1).cast("long").alias("sum"), acc["blocks"].alias("blocks"))),
    )["blocks"]
    repeated = F.concat(F.coalesce("system_block", F.lit("")), taken)
    piece = F.struct("idx", F.when(F.col("first") & (F.col("window") > 0), repeated).otherwise("").alias("context"), "head", "body", "is_target")
    windows = rows.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    walked = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("mask")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(F.concat(p["context"], p["head"], p["body"])) + len("</turn>\n")).alias("at"),
            F.when(
                p["is_target"],
                F.concat(
                    acc["mask"],
                    F.array(F.struct((acc["at"] + F.length(p["context"]) + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"))),
                ),
            )
            .otherwise(acc["mask"])
            .alias("mask"),
        ),
    )["mask"]
    formatted = F.array_join(F.transform("pieces", lambda p: F.concat(p["context"], p["head"], p["body"], F.lit("</turn>\n"))), "")
    return windows.select("conv_id", "window", formatted.alias("formatted"), walked.alias("mask"))


def read_back(windows: DataFrame) -> DataFrame:
    """``(conv_id, turns, loss, formatted_chars)`` from the output alone: the turns as ``(idx, role, text)`` in
    order, each once however often it is repeated, the unescaped texts under the masks in order, and
    the length of all windows."""
    # a text holds no unescaped mark, so every "</turn>\n" ends a block
    blocks = F.filter(F.split("formatted", "</turn>\n"), lambda b: b != "")
    header = r"^<turn (\d+) ([^>]*)>\n"
    turns = F.transform(
        blocks,
        lambda b: F.struct(
            F.regexp_extract(b, header, 1).cast("long").alias("idx"),
            F.url_decode(F.regexp_extract(b, header, 2)).alias("role"),
            unescaped(F.substring(b, F.locate("\n", b) + 1, F.length(b))).alias("text"),
        ),
    )
    loss = F.transform("mask", lambda m: unescaped(F.substring(F.col("formatted"), m["start"] + 1, m["length"])))
    parsed = windows.select("conv_id", "window", turns.alias("turns"), F.array_join(loss, "").alias("loss"), F.length("formatted").alias("chars"))
    whole = parsed.groupBy("conv_id").agg(
        F.collect_list("turns").alias("turns"),
        F.sort_array(F.collect_list(F.struct("window", "loss"))).alias("loss"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    return whole.select(
        "conv_id",
        F.array_sort(F.array_distinct(F.flatten("turns"))).alias("turns"),
        F.array_join(F.transform("loss", lambda x: x["loss"]), "").alias("loss"),
        "formatted_chars",
    )
