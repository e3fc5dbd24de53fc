"""Messages from packed items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kind, role, order, merged, prefix.
SECTIONS = [
    ("system", "system", 0, True, ""),
    ("instruction", "system", 1, False, ""),
    ("tool", "system", 2, False, ""),
    ("schema", "system", 3, False, ""),
    ("example", "system", 10, False, "[Example]\n"),
    ("memory", "system", 20, False, "[Memory]\n"),
    ("retrieval", "system", 30, False, "[Retrieved]\n"),
    ("history", "user", 40, False, ""),
    ("conversation", "user", 50, False, ""),
    ("tool-result", "user", 90, False, ""),
    ("query", "user", 100, False, ""),
]


def to_messages(packed: DataFrame, sections=SECTIONS) -> DataFrame:
    """(pack_id, section, first, role, content, tokens) of packed(pack_id, ord, kind, content, tokens).

    One message per item, or one per section where the section merges (texts by ord, two line
    ends between). Items of no section are the user's and come last (section 999). Messages of
    a pack follow (section, first). What is gathered is a pack's selection, so the budget bounds it.
    """
    # "kind" as a key of a map of constants: no join
    pairs = [x for kind, role, order, merged, prefix in sections for x in (F.lit(kind), F.struct(F.lit(role).alias("role"), F.lit(order).alias("order"), F.lit(merged).alias("merged"), F.lit(prefix).alias("prefix")))]
    rule = F.try_element_at(F.create_map(*pairs), F.coalesce("kind", F.lit("")))
    rows = packed.select("pack_id", "ord", "tokens", F.coalesce("content", F.lit("")).alias("content"), rule.alias("r"))
    merged = F.coalesce("r.merged", F.lit(False))
    text = F.concat(F.coalesce("r.prefix", F.lit("")), F.col("content"))
    keyed = rows.select(
        "pack_id", "ord", "tokens", text.alias("content"), F.coalesce("r.role", F.lit("user")).alias("role"), F.coalesce("r.order", F.lit(999)).alias("section"), F.when(~merged, F.col("ord")).alias("own")
    )
    gathered = F.array_sort(F.collect_list(F.struct("ord", "content")))
    return keyed.groupBy("pack_id", "section", "role", "own").agg(
        F.min("ord").alias("first"), F.array_join(F.transform(gathered, lambda x: x["content"]), "\n\n").alias("content"), F.sum("tokens").alias("tokens")
    ).drop("own")


def system_and_turns(messages: DataFrame) -> DataFrame:
    """Per pack: the system text (messages joined by two line ends) and the other messages in order."""
    part = F.struct("section", "first", "role", "content")
    out = messages.groupBy("pack_id").agg(F.array_sort(F.collect_list(part)).alias("m"))
    system = F.array_join(F.transform(F.filter("m", lambda x: x["role"] == "system"), lambda x: x["content"]), "\n\n")
    turns = F.transform(F.filter("m", lambda x: x["role"] != "system"), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return out.select("pack_id", system.alias("system"), turns.alias("messages"))


def role_tokens(messages: DataFrame) -> DataFrame:
    """Per pack of to_messages(): tokens in all and by role."""
    roles = ("system", "user", "assistant")
    return messages.groupBy("pack_id").agg(F.sum("tokens").alias("total_tokens"), *[F.coalesce(F.sum(F.when(F.col("role") == r, F.col("tokens"))), F.lit(0)).alias(f"{r}_tokens") for r in roles])


def flat_messages(messages: DataFrame) -> DataFrame:
    """(pack_id, position, role, content): each message on its own, the system's ones too, in order."""
    from pyspark.sql import Window as W

    at = F.row_number().over(W.partitionBy("pack_id").orderBy("section", "first")) - 1
    return messages.select("pack_id", at.alias("position"), "role", "content")


def with_turns(turns: DataFrame, messages: DataFrame) -> DataFrame:
    """(pack_id, position, role, content): the turns(pack_id, turn, role, text) of a conversation first, tools as the user, then the messages of its items."""
    from pyspark.sql import Window as W

    role = F.when(F.col("role") == "tool", "user").otherwise(F.col("role"))
    said = turns.select("pack_id", F.lit(0).alias("_p"), F.lit(0).alias("_s"), F.col("turn").cast("long").alias("_f"), role.alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    rows = said.unionByName(messages.select("pack_id", F.lit(1).alias("_p"), F.col("section").alias("_s"), F.col("first").cast("long").alias("_f"), "role", "content"))
    at = F.row_number().over(W.partitionBy("pack_id").orderBy("_p", "_s", "_f")) - 1
    return rows.select("pack_id", at.alias("position"), "role", "content")
