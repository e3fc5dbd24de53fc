"""The logical tables that the queries run over, from the data at hand, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens
from ..operators.packing import greedy, score
from ..operators.scratch import only, stored

NOW = "2024-02-01 00:00:00"
BUDGET = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark, sf_dir, content: bool = False, docs: DataFrame | None = None) -> DataFrame:
    """One row per document, or per row of docs; a pack is a source."""
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    kind = F.when(F.col("lang") == "en", "retrieval").when(F.col("lang") == "fr", "memory").when(F.col("lang") == "de", "system").when(F.col("lang") == "es", "query")
    rows = docs.select(
        F.col("doc_id").alias("id"), F.col("source").alias("pack_id"), kind.alias("kind"), (F.col("doc_id") % 11).cast("double").alias("priority"),
        ((F.col("doc_id") * 7 % 101) / F.lit(10.0)).alias("recency"), estimate_tokens(F.col("text")).alias("tokens"), F.col("doc_id").alias("ord"),
        *([F.col("text").alias("content")] if content else []),
    )
    rows = rows.join(labels.withColumnRenamed("doc_id", "id"), "id", "left")
    rows = rows.withColumn("salience", F.coalesce(F.col("quality").cast("double"), F.lit(0.0))).drop("quality")
    return rows.withColumn("score", score()).withColumn("budget", F.lit(BUDGET).cast("long"))


def decided(spark, sf_dir) -> DataFrame:
    """The items without their texts, with `chosen`, stored: texts are read once, for their tokens."""
    return stored(greedy(stored(items(spark, sf_dir)), ["pack_id"]))


def chosen_texts(spark, sf_dir, packed: DataFrame) -> DataFrame:
    """The chosen rows of decided() with their texts, which only these are read again for."""
    chosen = packed.where("chosen")
    few = only(table(spark, sf_dir, "documents"), stored(chosen.select(F.col("id").alias("doc_id")).distinct()), ["doc_id"], "left_semi")
    # rows of one id are told apart as in the packing: by pack, and whether they have tokens
    taken = chosen.where("tokens > 0").select("pack_id", "ord").distinct().withColumn("_taken", F.lit(True))
    rows = items(spark, sf_dir, content=True, docs=few).join(taken, ["pack_id", "ord"], "left")
    return stored(rows.where("_taken or (tokens <= 0 and budget >= 0)").drop("_taken").withColumn("chosen", F.lit(True)))


WORDS = r"regexp_split_to_array(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\s+')"


def sql_tokens(text: str, factor: float = 1.3) -> str:
    return rf"case when regexp_replace({text}, '^\s+|\s+$', '', 'g') = '' then 0 else greatest(1, ceil(len({WORDS.format(text)}) * {factor}::double)) end::bigint"


ITEMS = f"""lab as (select doc_id, max(quality) as quality from labels group by 1),
raw as (select d.doc_id as id, d.source as pack_id, d.text as content,
  case d.lang when 'en' then 'retrieval' when 'fr' then 'memory' when 'de' then 'system' when 'es' then 'query' end as kind,
  (d.doc_id % 11)::double as priority, (d.doc_id * 7 % 101)::double / 10.0::double as recency,
  {sql_tokens('d.text')} as tokens, d.doc_id as ord, coalesce(l.quality::double, 0) as salience, {BUDGET}::bigint as budget
  from documents d left join lab l on d.doc_id = l.doc_id),
items as (select *, priority * 1.0::double + recency * 0.7::double + salience * 0.5::double as score from raw)"""


def sql_greedy(source: str, group: str, name: str = "g", order: str = "score desc, recency desc, ord") -> str:
    """CTEs ending in `name`(all columns of source, chosen): the greedy choice, one row a step."""
    return f"""{name}_r as (select *, row_number() over (partition by {group} order by {order}) as rn from {source}),
{name}_s as (select {group}, rn, ord, tokens <= budget as chosen, case when tokens <= budget then budget - tokens else budget end as left_
  from {name}_r where rn = 1
  union all select r.{group}, r.rn, r.ord, r.tokens <= s.left_, case when r.tokens <= s.left_ then s.left_ - r.tokens else s.left_ end
  from {name}_s s join {name}_r r on r.{group} = s.{group} and r.rn = s.rn + 1),
{name} as (select r.*, s.chosen from {name}_r r join {name}_s s on r.{group} = s.{group} and r.rn = s.rn)"""
