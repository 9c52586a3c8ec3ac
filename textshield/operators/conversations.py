"""Chat histories: rewrite what users wrote and pair it with the reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textshield.fixed_values import CHAT_KEYWORDS, CHAT_NOTICE, CHAT_RULE, NO_REPLY
from textshield.functions.text import filtered_keywords


BLOCK = 4096  # turn numbers in one window


def conversation_pairs(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv_id, turn, message, reply`` of every user turn; the reply is the next turn if the assistant's.

    Numbers may have gaps. A conversation is cut into blocks of ``block`` turn numbers, so one of any
    length spreads over all tasks; the last turn of a block is followed by the first of the next
    block that has any, of which only one row a block is put in order.
    """
    rows = turns.select("conv_id", "turn", "role", "text", F.floor(F.col("turn") / block).alias("_block"))
    said = F.struct("role", "text")
    inside = Window.partitionBy("conv_id", "_block").orderBy("turn")
    firsts = rows.groupBy("conv_id", "_block").agg(F.min_by(said, "turn").alias("_first"))
    after = F.lead("_first").over(Window.partitionBy("conv_id").orderBy("_block"))
    edges = firsts.select("conv_id", "_block", after.alias("_after"))
    followed = rows.withColumn("_next", F.lead(said).over(inside)).where(F.col("role") == "user")
    following = F.coalesce("_next", "_after")
    return followed.join(edges, ["conv_id", "_block"], "left").select(
        "conv_id", "turn", F.col("text").alias("message"), F.when(following["role"] == "assistant", following["text"]).alias("reply"))


def sanitize_conversations(turns: DataFrame, rewrite: Column, **keyword_options) -> DataFrame:
    """Pairs with the rewritten message.

    ``rewrite`` is a column over ``message``. Keywords are listed, and the notice that precedes
    the reply is made, only where the rewrite changed the message; a missing reply becomes an apology.
    """
    pairs = conversation_pairs(turns).withColumn("sanitized", F.coalesce(rewrite, F.col("message")))
    changed = F.col("sanitized") != F.col("message")
    keywords = F.when(changed, filtered_keywords(F.col("message"), **keyword_options))
    reply = F.coalesce(F.nullif("reply", F.lit("")), F.lit(NO_REPLY))
    listed = F.when(F.size("keywords") > 0, F.format_string(CHAT_KEYWORDS, F.concat_ws(", ", "keywords"))).otherwise("")
    notice = F.concat(F.format_string(CHAT_NOTICE, F.col("message"), F.col("sanitized")), listed, F.lit(CHAT_RULE))
    return (
        pairs.withColumn("changed", changed)
        .withColumn("keywords", keywords)
        .withColumn("response", F.when(F.col("changed"), F.concat(notice, reply)).otherwise(reply))
        .drop("reply")
    )
