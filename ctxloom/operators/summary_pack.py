"""Packing with variants and, where none fits, a summarizer that is asked for many packs at once.

Items have their turn by score, recency and ord; one is taken whole, else in its largest variant
that fits, else in a summary for what is left. What is left when an item has its turn depends on
those before it, so packs go on in rounds: each folds its next `width` items until one needs a
summary, and names it and up to `ahead` more that would; one call of the model for each Arrow
batch answers for all packs; the folds go on with the answers. Where answers left the room as it
was, up to four times as many are named in the next round, so a pack that stands still is done
in few rounds. Only items that fit in no variant are asked about.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.hooks import Summarize, summaries
from .scratch import dropped, stored

WIDTH = 1000
AHEAD = 8


def _fold(ahead: int):
    """One pack's next items in; for each that is settled or asked about a row out."""

    def run(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: (-r["score"], -r["recency"], r["ord"]))
        left, out, asked, quiet = rows[0]["left"], [], 0, 0
        for r in rows:
            form = r["tokens"] if r["tokens"] <= left else max((v for v in r["sizes"] if v <= left), default=None)
            if asked:
                # the state stands still: only name those that would need a summary as well
                if form is not None or asked >= max(ahead, 4 * quiet):
                    break
                if r["answered"] != left:
                    asked += 1
                    out.append((r["ord"], "ask", None, left))
                continue
            if form is not None:
                out.append((r["ord"], "include" if form == r["tokens"] else "compress", form, left))
                left -= form
                quiet = quiet if form == 0 else 0
            elif left <= 0 or r["answered"] == left:
                small = r["summary_tokens"] if left > 0 else None
                out.append((r["ord"], "exclude" if small is None else "summarize", small, left))
                left -= small or 0
                quiet = 0 if small else quiet + 1
            else:
                asked = 1
                out.append((r["ord"], "ask", None, left))
        columns = list(zip(*out, strict=True))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.table([pa.array([rows[0]["pack_id"]] * len(out), table.schema.field("pack_id").type), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["pack_id", "ord", "decision", "taken_tokens", "room"])

    return run


def summary_pack(items: DataFrame, summarize: Summarize, width: int = WIDTH, ahead: int = AHEAD) -> DataFrame:
    """items(pack_id, ord, content, tokens, sizes, score, recency, budget) with decision (include, compress, summarize, exclude), taken_tokens and summary.

    sizes are the tokens of an item's variants, null or empty for none. A summary counts if its
    tokens are within what is left; none is asked for once nothing is left, nor for null texts.
    ords are unique in a pack; null scores and recencies count 0; an empty table gives no rows.
    A task sees `width` items of a pack at a time; texts move only to be summarized.
    """
    none = F.array().cast("array<long>")
    keys = items.select(
        "pack_id", F.col("ord").cast("long").alias("ord"), F.col("tokens").cast("long").alias("tokens"), F.filter(F.coalesce(F.col("sizes").cast("array<long>"), none), lambda v: v.isNotNull()).alias("sizes"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), F.coalesce(F.col("recency").cast("double"), F.lit(0.0)).alias("recency"), F.col("content").isNotNull().alias("_told"),
    )
    budgets = items.groupBy("pack_id").agg(F.greatest(F.max("budget").cast("long"), F.lit(0)).alias("left"))
    nothing = [F.lit(None).cast("long").alias("answered"), F.lit(None).cast("long").alias("summary_tokens")]
    open_ = stored(keys.join(budgets, "pack_id").select("*", *nothing))
    kind = items.schema["pack_id"].dataType.simpleString()
    turn = W.partitionBy("pack_id").orderBy(F.desc("score"), F.desc("recency"), "ord")
    settled, texts, garbage = None, None, []
    while not open_.isEmpty():
        # a null text has no summary: that is known beforehand
        near = open_.withColumn("_n", F.row_number().over(turn)).where(F.col("_n") <= width).withColumn("answered", F.when(F.col("_told"), F.col("answered")).otherwise(F.col("left")))
        # what is left stays as it is until the first item is settled, so this holds for those alone that wait at its head
        step = stored(near.drop("_n", "_told").groupBy("pack_id").applyInArrow(_fold(ahead), f"pack_id {kind}, ord long, decision string, taken_tokens long, room long"))
        done = step.where("decision <> 'ask'")
        asked = items.select("pack_id", F.col("ord").cast("long").alias("ord"), "content").join(step.where("decision = 'ask'").select("pack_id", "ord", "room"), ["pack_id", "ord"])
        answers = stored(summaries(asked, "content", "room", summarize).select("pack_id", "ord", F.col("room").alias("_room"), "summary", "summary_tokens"))
        garbage += [step, answers]
        settled = done if settled is None else settled.unionByName(done)
        texts = answers if texts is None else texts.unionByName(answers)
        used = done.groupBy("pack_id").agg(F.sum(F.coalesce("taken_tokens", F.lit(0))).alias("_used"))
        rest = open_.join(done.select("pack_id", "ord"), ["pack_id", "ord"], "left_anti").join(used, "pack_id", "left").withColumn("left", F.col("left") - F.coalesce("_used", F.lit(0)))
        fresh = answers.select("pack_id", "ord", F.col("_room").alias("_a"), F.col("summary_tokens").alias("_s"))
        rest = rest.join(fresh, ["pack_id", "ord"], "left")
        rest = rest.select("pack_id", "ord", "tokens", "sizes", "score", "recency", "_told", "left", F.coalesce("_a", "answered").alias("answered"), F.when(F.col("_a").isNotNull(), F.col("_s")).otherwise(F.col("summary_tokens")).alias("summary_tokens"))
        last, open_ = open_, stored(rest)
        dropped(last)
    dropped(open_)
    if settled is None:
        return items.withColumns({"decision": F.lit(""), "taken_tokens": F.lit(0).cast("long"), "summary": F.lit("")}).limit(0)
    said = texts.withColumnRenamed("_room", "room").select("pack_id", "ord", "room", "summary")
    out = stored(settled.join(said, ["pack_id", "ord", "room"], "left").select("pack_id", F.col("ord").alias("_ord"), "decision", "taken_tokens", F.when(F.col("decision") == "summarize", F.col("summary")).alias("summary")))
    dropped(*garbage)
    return items.withColumn("_ord", F.col("ord").cast("long")).join(out, ["pack_id", "_ord"]).drop("_ord")
