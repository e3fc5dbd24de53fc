"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections, in DataFrame functions only.

Leaves are pieces of a paragraph (a line): up to and with the next of . ! ? | and at most
160 characters. A leaf's digest hashes the piece; a paragraph's hashes its leaves' digests, a
section's its paragraphs', the root's its sections'. So the root proves every leaf, and equal
roots mean equal texts. A section ends after a paragraph whose digest ends in 0 or 1, so an
edit moves no later boundary.

A fingerprint is the whole tree, "root/section;section;...", where a section is
"digest:paragraph,paragraph," and a paragraph "digest=leaves" (leaves end to end). Digests are
the first 16 hexadecimal digits of SHA-256, the root's all 64. Likeness of two fingerprints is
the Dice coefficient of their sets of leaf digests; 1 if both roots are equal. locate_edits()
descends from differing roots through the differing branches alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import expand, global_rank, materialize, release

LEAF = r"[^.!?|]{1,160}[.!?|]*\x20*|[.!?|]+\x20*"


def _digest(x: Column) -> Column:
    return F.substring(F.sha2(x, 256), 1, 16)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add `name`, the fingerprint of a text column without nulls, and `name`_leaves, its distinct leaf digests.

    Each level of the tree is a column of its own, so it is made once.
    """
    lines = df.withColumn(
        "_leaves", F.transform(F.split(F.col(text), "\n"), lambda line: F.transform(F.regexp_extract_all(line, F.lit(LEAF), F.lit(0)), _digest))
    )
    lines = lines.withColumn("_p", F.transform("_leaves", lambda x: F.array_join(x, "")))
    lines = lines.withColumn("_d", F.transform("_p", _digest))
    end = F.transform("_d", lambda d: F.when(d.rlike("[01]$"), ";").otherwise(","))
    lines = lines.withColumn("_p", F.zip_with(F.zip_with("_d", "_p", lambda d, p: F.concat(d, F.lit("="), p)), end, lambda x, y: F.concat(x, y)))
    lines = lines.withColumn("_s", F.filter(F.split(F.array_join("_p", ""), ";"), lambda s: s != ""))
    lines = lines.withColumn("_d", F.transform("_s", lambda s: _digest(F.regexp_replace(s, "=[0-9a-f]*", ""))))
    tree = F.array_join(F.zip_with("_d", "_s", lambda d, s: F.concat(d, F.lit(":"), s)), ";")
    out = lines.withColumn(name, F.concat(F.sha2(F.array_join("_d", "."), 256), F.lit("/"), tree))
    return out.withColumn(f"{name}_leaves", F.array_distinct(F.flatten("_leaves"))).drop("_leaves", "_p", "_d", "_s")


def likeness(a: str, b: str) -> Column:
    """Of two fingerprint columns that with_fingerprint() made."""
    x, y = F.col(f"{a}_leaves"), F.col(f"{b}_leaves")
    total = F.size(x) + F.size(y)
    same = F.substring_index(a, "/", 1) == F.substring_index(b, "/", 1)
    return F.when(same, 1.0).when(total == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / total)


def locate_edits(df: DataFrame, before: str, after: str) -> DataFrame:
    """df's rows times `edits`: the leaves of fingerprint `after` that `before` lacks, as (section, paragraph, leaf, digest), counted from 0.

    Equal roots end it at once. Only sections whose digest the other side lacks are opened, in
    these only paragraphs that its opened sections lack, and in these only leaves that its
    opened paragraphs lack. Rows without an edit come out with nulls. A null fingerprint has no
    branches. What was removed is located by changing the sides.
    """
    same = F.coalesce(F.substring_index(before, "/", 1) == F.substring_index(after, "/", 1), F.lit(False))

    def sections(c):
        return F.transform(F.split(F.substring_index(c, "/", -1), ";"), lambda s, i: F.struct(i.alias("section"), F.substring_index(s, ":", 1).alias("digest"), F.substring_index(s, ":", -1).alias("body")))

    def opened(items, digests):
        return F.filter(items, lambda x: ~F.array_contains(digests, x["digest"]))

    def paragraphs(c):
        def of(s):
            return F.transform(
                F.filter(F.split(s["body"], ","), lambda p: p != ""),
                lambda p, j: F.struct(s["section"].alias("section"), j.alias("paragraph"), F.substring_index(p, "=", 1).alias("digest"), F.substring_index(p, "=", -1).alias("body")),
            )

        return F.flatten(F.transform(c, of))

    def leaves(c):
        def of(p):
            return F.transform(
                F.regexp_extract_all(p["body"], F.lit("[0-9a-f]{16}"), F.lit(0)), lambda x, k: F.struct(p["section"].alias("section"), p["paragraph"].alias("paragraph"), k.alias("leaf"), x.alias("digest"))
            )

        return F.flatten(F.transform(c, of))

    none = F.array().cast("array<struct<section:int,digest:string,body:string>>")
    out = df.withColumn("_a", F.when(same, none).otherwise(F.coalesce(sections(F.col(before)), none))).withColumn("_b", F.when(same, none).otherwise(F.coalesce(sections(F.col(after)), none)))
    for level in (None, paragraphs, leaves):
        if level is not None:
            out = out.withColumns({"_a": level("_a"), "_b": level("_b")})
        digests = {c: F.transform(c, lambda x: x["digest"]) for c in ("_a", "_b")}
        out = out.withColumns({"_x": digests["_a"], "_y": digests["_b"]})
        out = out.withColumns({"_a": opened(F.col("_a"), F.col("_y")), "_b": opened(F.col("_b"), F.col("_x"))})
    return out.withColumn("edits", F.explode_outer("_b")).drop("_a", "_b", "_x", "_y")


def with_next(docs: DataFrame, block: int = 1000) -> DataFrame:
    """(doc_id, text, next_text, times) of docs(doc_id, text without nulls): each different row, the text next in descending doc_id, and how many rows have it.

    The last row's next is the first. Null ids come last; rows of one id follow a hash of the
    text; of equal rows each is followed by its equal, the last one by the next row. Equal rows are
    counted, not carried. Rows are ranked by a distributed sort of ids and hashes, and dealt by
    rank into blocks, each with a copy of the first row of the block after it; so blocks are
    equal however the ids lie.
    """
    keyed = docs.select(
        F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text"
    )
    keys = ["i", "no_id", "h1", "h2"]
    ids = materialize(keyed.groupBy(*keys).agg(F.count("*").alias("m")), "ids")
    ranked = global_rank(ids, [F.col("no_id"), F.col("i").desc(), F.col("h1"), F.col("h2")], "rank")
    release(ids)
    blocks = max(1, -(-ranked.count() // block))
    # one row for all equal rows; it stays where the grouping put it for the join
    rows = keyed.groupBy(*keys).agg(F.any_value("text").alias("text")).join(ranked, keys)
    own = F.floor(F.col("rank") / block)
    at = F.array(F.struct(own.alias("block"), F.lit(0).alias("copy")), F.when(F.col("rank") % block == 0, F.struct(F.pmod(own - 1, F.lit(blocks)).alias("block"), F.lit(1).alias("copy"))))
    dealt = rows.withColumn("at", F.explode(F.array_compact(at))).select("i", "no_id", "text", "m", "rank", "at.block", "at.copy")
    w = W.partitionBy("block").orderBy("copy", "rank")
    led = dealt.withColumn("next_text", F.lead("text").over(w)).where("copy = 0")
    both = F.array(F.struct(F.col("next_text"), F.lit(1).cast("long").alias("times")), F.struct(F.col("text").alias("next_text"), (F.col("m") - 1).alias("times")))
    led = led.withColumn("n", F.explode(F.filter(both, lambda x: x["times"] > 0)))
    return led.select(F.when(~F.col("no_id"), F.col("i")).alias("doc_id"), "text", "n.next_text", "n.times")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): fingerprints of the text and of its edited text, and likenesses.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many
    (or all) of the next document. Null texts count as empty; the empty text is one empty
    paragraph without leaves. A table of one row is its own next; an empty table gives no rows.
    Repeated rows follow one another. Other columns are not carried.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    led = with_next(own).withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring(F.col("next_text"), F.lit(1), third))
    full = led.withColumn("edited", edited)
    for text, name in (("text", "fingerprint"), ("edited", "edited_fingerprint"), ("next_text", "next_fingerprint")):
        full = with_fingerprint(full, text, name)
    made = full.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
        "times",
    )
    # only repeated rows come more than once
    most = own.groupBy("doc_id", F.xxhash64("text")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return made.drop("times") if most <= 1 else expand(made, "times", most).drop("times", "_nth")


#: The same rows in SQL.
_L = LEAF.replace("'", "''")
SQL = rf"""with d as (select row_number() over (order by doc_id desc nulls last) as r, count(*) over () as c, doc_id, coalesce(text, '') as t from documents),
e as (select d.doc_id, d.t, x.t as nt, length(d.t) as n, left(d.t, length(d.t) - length(d.t) // 3) || left(x.t, length(d.t) // 3) as ed from d join d x on x.r = d.r % d.c + 1),
u as (select t from e union select ed from e),
l as (select t, list_transform(string_split(t, chr(10)), lambda x: list_transform(regexp_extract_all(x, '{_L}'), lambda y: left(sha256(y), 16))) as l from u),
p as (select t, l, list_transform(l, lambda x: array_to_string(x, '')) as p from l),
j as (select t, l, array_to_string(list_transform(p, lambda x: left(sha256(x), 16) || '=' || x || case when substr(sha256(x), 16, 1) in ('0', '1') then ';' else ',' end), '') as j from p),
s as (select t, l, list_filter(string_split(j, ';'), lambda x: x <> '') as s from j),
g as (select t, l, s, list_transform(s, lambda x: left(sha256(regexp_replace(x, '=[0-9a-f]*', '', 'g')), 16)) as g from s),
f as (select t, list_distinct(flatten(l)) as l, sha256(array_to_string(g, '.')) || '/' || array_to_string(list_transform(range(1, len(s) + 1), lambda i: g[i] || ':' || s[i]), ';') as f from g)
select doc_id, n::bigint as n_chars, sha256(ed) as edited_sha256, a.f as fingerprint, b.f as edited_fingerprint,
case when a.f = b.f then 1.0::double when len(a.l) + len(b.l) = 0 then 0.0::double else 2.0::double * len(list_intersect(a.l, b.l)) / (len(a.l) + len(b.l)) end as near_edited,
case when a.f = c.f then 1.0::double when len(a.l) + len(c.l) = 0 then 0.0::double else 2.0::double * len(list_intersect(a.l, c.l)) / (len(a.l) + len(c.l)) end as near_next
from e join f a on a.t = e.t join f b on b.t = e.ed join f c on c.t = e.nt"""
