"""Chat formatting from each participant's perspective, in DataFrame expressions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Template:
    """open + role (+ name) + newline + content + close + newline makes a message; content and close of the perspective are trained on."""

    open: str = "<|im_start|>"
    close: str = "<|im_end|>"


def plain(value: Column, template: Template) -> Column:
    """value with a space within each mark of the template that it holds, so that no content can start or end a message."""
    for mark in (template.open, template.close):
        value = F.replace(value, F.lit(mark), F.lit(f"{mark[0]} {mark[1:]}"))
    return value


def perspectives(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, perspective, text, mask, n_messages, n_trained): each whole dialogue once for each participant.

    The participant speaks as the assistant, all others as users with their names, and system messages stay. mask has
    start:end of the characters to train on, comma-joined: the assistant's contents with their end marks. Messages
    come in order of turn, then speaker, then text. Marks of the template within contents and names get a space, and
    line breaks in names become spaces. Places come from running sums in which everyone is a user: a participant's own
    earlier messages shorten or lengthen them by the difference of the two heads, each by the same number of characters.

    A dialogue is a row, as long as it may be, and so are a conversation's messages in one task, for each of its rows
    holds them all. A null text is empty, a null role is the participant `unknown`, null turns come last, and a null
    conv_id is a conversation. Repeated rows are repeated messages. Conversations of system messages alone have no
    perspective and give no row; an empty table gives none. Other columns are ignored.
    """
    template = template or Template()
    name = F.regexp_replace(plain(F.coalesce("role", F.lit("unknown")), template), r"[\r\n]", " ")
    messages = conversations.select("conv_id", F.coalesce("turn", F.lit(2**63 - 1)).alias("turn"), name.alias("speaker"), plain(F.coalesce("text", F.lit("")), template).alias("content"))
    user = lambda who: F.when(who == "system", F.lit("system")).otherwise(F.concat(F.lit("user name="), who))
    around = len(template.open) + 1 + len(template.close) + 1
    order = ["turn", "speaker", "content"]
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = messages.withColumn("at", F.coalesce(F.sum(F.length(user(F.col("speaker"))) + F.length("content") + around).over(before), F.lit(0)).cast("long"))
    placed = placed.withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "speaker").orderBy(*order)) - 1)
    begin = F.col("at") - F.col("k") * (F.length(user(F.col("speaker"))) - len("assistant")) + len(template.open) + len("assistant") + 1
    end = begin + F.length("content") + len(template.close)
    spans = placed.where("speaker <> 'system'").select("conv_id", "speaker", begin.alias("begin"), end.alias("end"))
    spans = spans.groupBy("conv_id", F.col("speaker").alias("perspective")).agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"), F.sum(F.col("end") - F.col("begin")).alias("n_trained"))
    dialogues = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("ms"))
    each = dialogues.alias("d").join(spans.alias("s"), F.expr("d.conv_id <=> s.conv_id")).selectExpr("d.conv_id", "perspective", "ms", "spans", "n_trained")
    role = lambda m: F.when(m["speaker"] == F.col("perspective"), F.lit("assistant")).otherwise(user(m["speaker"]))
    text = F.array_join(F.transform("ms", lambda m: F.concat(F.lit(template.open), role(m), F.lit("\n"), m["content"], F.lit(template.close + "\n"))), "")
    mask = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["begin"].cast("string"), x["end"].cast("string"))), ",")
    return each.select("conv_id", "perspective", text.alias("text"), mask.alias("mask"), F.size("ms").cast("long").alias("n_messages"), "n_trained")
