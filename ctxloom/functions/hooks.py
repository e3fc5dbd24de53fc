"""What a caller may put in place of a built-in: expressions of columns, or pandas functions where a model is called."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Hooks:
    """Named estimators, scorers, tokenizers, summarizers and evaluators: functions from Column to Column (an evaluator gives an aggregate)."""

    KINDS = ("estimator", "scorer", "tokenizer", "summarizer", "evaluator")

    def __init__(self):
        self._known: dict[tuple[str, str], Callable[..., Column]] = {}

    def register(self, kind: str, name: str, f: Callable[..., Column]) -> None:
        if kind not in self.KINDS:
            raise ValueError(f"no hook {kind}; there are {', '.join(self.KINDS)}")
        self._known[kind, name] = f

    def use(self, kind: str, name: str) -> Callable[..., Column]:
        if (kind, name) not in self._known:
            raise ValueError(f"no {kind} {name}")
        return self._known[kind, name]


def embedded(rows: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]], name: str = "embedding") -> DataFrame:
    """rows with vectors of their text where `name` is missing or null, from embed(texts), called once for each Arrow batch."""
    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(embed(texts.fillna("").tolist())))

    have = name in rows.columns
    if not have:
        return rows.withColumn(name, vectors(F.col(text)))
    # only rows without a vector go to Python
    old = rows.where(F.col(name).isNotNull())
    new = rows.where(F.col(name).isNull()).withColumn(name, vectors(F.col(text)).cast(rows.schema[name].dataType))
    return old.unionByName(new)


def merged(ours: DataFrame, theirs: DataFrame, key: str, resolve: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """A merge by the caller's resolver, held to the columns of ours and one row a key: of several the one whose JSON is least."""
    from pyspark.sql import Window as W

    out = resolve(ours, theirs).select(*ours.columns)
    nth = F.row_number().over(W.partitionBy(key).orderBy(F.to_json(F.struct(*[F.col(c) for c in ours.columns]))))
    return out.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def evaluated(rows: DataFrame, group: str, evaluate: Callable[[DataFrame], Column]) -> DataFrame:
    """(group, quality) by the caller's aggregate expression."""
    return rows.groupBy(group).agg(evaluate(rows).alias("quality"))


def council(members: list[str], question: DataFrame, respond: Callable[[DataFrame], DataFrame], rounds: int, enough: float = 0.9) -> DataFrame:
    """Rounds of responses to question(council, text): respond(rows of council, round, member, prompt) adds `response`.

    In later rounds a member sees the others' last responses. A council stops once its
    responses are alike enough. (council, round, member, response)
    """
    from ..operators.retrieval import convergence
    from .text import word_set

    asked = question.select("council", F.lit(1).alias("round"), F.explode(F.array(*[F.lit(m) for m in members])).alias("member"), F.col("text").alias("prompt"))
    done = None
    for n in range(1, rounds + 1):
        said = respond(asked).select("council", "round", "member", "response")
        done = said if done is None else done.unionByName(said)
        if n == rounds:
            break
        alike = convergence(said.select("council", word_set(F.col("response")).alias("words")), ["council"])
        open_ = said.join(alike.where(F.col("convergence") < enough).select("council"), "council", "left_semi")
        seen = open_.groupBy("council").agg(F.array_sort(F.collect_list(F.struct("member", "response"))).alias("all"))
        others = F.array_join(F.transform(F.filter("all", lambda x: x["member"] != F.col("member")), lambda x: F.concat(x["member"], F.lit(": "), x["response"])), "\n")
        prompt = F.concat(F.col("text"), F.lit("\n\nOther answers:\n"), others)
        asked = open_.select("council", "member").join(seen, "council").join(question, "council").select("council", F.lit(n + 1).alias("round"), "member", prompt.alias("prompt"))
    return done


#: A model that shortens texts: (text, tokens that are left) pairs in, for each a text and its tokens (None: estimated), or None.
Summarize = Callable[[list[tuple[str, int]]], list[tuple[str, int | None] | None]]


def summaries(rows: DataFrame, text: str, room: str, summarize: Summarize, names: tuple[str, str] = ("summary", "summary_tokens")) -> DataFrame:
    """rows with a summary of `text` in at most `room` tokens, and its tokens; both null where there is none or it does not fit.

    summarize() gets the rows of a whole Arrow batch in one call. Null texts, and rows with no
    room, are not handed to it.
    """
    from .text import estimate_tokens

    @F.pandas_udf("struct<body:string,tokens:long>")
    def made(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, rooms in batches:
            asked = [(i, t, int(r)) for i, (t, r) in enumerate(zip(texts, rooms, strict=True)) if t is not None and pd.notna(r) and r > 0]
            out = [(None, None)] * len(texts)
            if asked:
                for (i, _, _), got in zip(asked, summarize([(t, r) for _, t, r in asked]), strict=True):
                    out[i] = got or (None, None)
            yield pd.DataFrame({"body": pd.Series([b for b, _ in out], dtype="object"), "tokens": pd.Series([t for _, t in out], dtype="Int64")})

    said = rows.withColumn("_said", made(F.col(text), F.col(room).cast("long")))
    tokens = F.when(F.col("_said.body").isNotNull(), F.coalesce("_said.tokens", estimate_tokens(F.col("_said.body")).cast("long")))
    fits = tokens <= F.col(room)
    return said.withColumns({names[0]: F.when(fits, F.col("_said.body")), names[1]: F.when(fits, tokens)}).drop("_said")
