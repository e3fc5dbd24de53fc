"""Sharding by jump consistent hashing, in DataFrame functions only.

A row's shard depends on its key and the number of shards, nothing else; there is no
ring table. One more shard takes rows only into itself, about 1/(n+1) of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank

_STEP = 2862933555777941757  # multiplier of the generator in the published algorithm
_LIMBS = [(_STEP >> (16 * i)) & 0xFFFF for i in range(4)]
_MASK = 0xFFFFFFFF


def _next_state(state: Column) -> Column:
    """state * _STEP + 1 modulo 2**64, in 16-bit limbs, as bigint products may not overflow."""
    lo = state.bitwiseAND(F.lit(_MASK))
    hi = F.shiftrightunsigned(state, 32)
    c0, c1, c2, c3 = (F.lit(x).cast("long") for x in _LIMBS)
    low16 = F.lit(0xFFFF).cast("long")
    low = lo * c0 + F.shiftleft((lo * c1).bitwiseAND(low16), 16) + 1
    high = F.shiftrightunsigned(low, 32) + F.shiftrightunsigned(lo * c1, 16) + lo * c2
    high = high + F.shiftleft((lo * c3).bitwiseAND(low16), 16) + hi * c0 + F.shiftleft((hi * c1).bitwiseAND(low16), 16)
    return F.shiftleft(high.bitwiseAND(F.lit(_MASK)), 32).bitwiseOR(low.bitwiseAND(F.lit(_MASK)))


def _jumps(key: Column, shards: int, steps: int) -> Column:
    """struct(state, shard, ahead): the last jump below `shards` and the first at or beyond it, after at most `steps`."""

    def step(acc, _):
        # the new state is needed twice: transform binds it to one variable
        moved = F.transform(
            F.array(_next_state(acc["state"])),
            lambda s: F.struct(
                s.alias("state"),
                acc["ahead"].alias("shard"),
                F.floor((acc["ahead"] + 1) * (F.lit(2147483648.0) / (F.shiftrightunsigned(s, 33) + 1))).cast("long").alias("ahead"),
            ),
        )[0]
        return F.when(acc["ahead"] >= shards, acc).otherwise(moved)

    start = F.struct(key.cast("long").alias("state"), F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("ahead"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)


def jump_hash(key: Column, shards: int) -> Column:
    """struct(shard, ahead) for a 64-bit key. `ahead` is the first jump at or beyond `shards`.

    A jump moves on by one at least, so `shards` steps always end; few rows need more than
    a small multiple of the logarithm, and only those run the long loop.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    few = min(shards, 8 + 4 * math.ceil(math.log(shards + 1)))
    short = _jumps(key, shards, few)
    if few == shards:
        return short
    return F.when(short["ahead"] >= shards, short).otherwise(_jumps(key, shards, shards))


def _key(column: str) -> Column:
    """32 hexadecimal digits of any key's text; null is as empty."""
    return F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")))


def shard_rows(df: DataFrame, key: str, shards: int, *, shard: str = "shard", grown: str | None = None) -> DataFrame:
    """Add the shard of each row (and, as `grown`, the shard when one more is appended).

    Keys are mixed by the last 64 bits of the MD5 of their text first, so integers, strings and
    null keys are all spread evenly; equal keys always meet. Null keys share one shard, as equal
    keys do. No shuffle.
    """
    out = df.withColumn("_jump", jump_hash(F.conv(F.substring(_key(key), 17, 16), 16, -10).cast("long"), shards))
    cols = [F.col(c) for c in df.columns] + [F.col("_jump.shard").cast("int").alias(shard)]
    if grown:
        # the sequence of jumps does not depend on the number of shards: the next jump decides
        cols.append(F.when(F.col("_jump.ahead") == shards, F.lit(shards)).otherwise(F.col("_jump.shard")).cast("int").alias(grown))
    return out.select(*cols)


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per row of docs(doc_id, text): its size, checksum, shard and slot.

    size is the UTF-8 length plus one (null text: 1); text_crc32 of a null text is that of the
    empty string. slot counts from 0 without gaps in each shard, in the order of the first 32
    bits of the doc_id's MD5, by ranges that no single task has to sort. A null doc_id is a key
    like any other; repeated rows get slots of their own; an empty table gives no rows. Other
    columns are not carried.
    """
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    dealt = shard_rows(sized, "doc_id", shards, grown="grown_shard")
    spread = F.conv(F.substring(_key("doc_id"), 1, 8), 16, 10).cast("long")
    ranked = gapless_rank(dealt, ["shard"], ["doc_id", "size", "text_crc32"], "slot", spread)
    return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _crc_table() -> list[int]:
    """Remainders of the sixteen half bytes for the reflected polynomial of CRC-32."""
    out = []
    for x in range(16):
        for _ in range(4):
            x = (x >> 1) ^ 0xEDB88320 if x & 1 else x >> 1
        out.append(x)
    return out


def crc_sql(text: str) -> str:
    """SQL of the unsigned CRC-32 of the UTF-8 bytes of a text expression, by half bytes."""
    size = f"octet_length(encode({text}))"
    digits = f"list_transform(string_split(hex(encode({text})), ''), lambda x: instr('0123456789ABCDEF', x) - 1)"
    return f"""case when {size} = 0 then 0::bigint else xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, 2 * {size}), lambda i: {digits}[case when i % 2 = 0 then i + 2 else i end]::bigint)),
lambda a, x: xor(a >> 4, {_crc_table()}[(xor(a, x) & 15) + 1])), 4294967295::bigint) end"""


#: The same rows in SQL: the checksum by half bytes, the jumps one a step.
SQL = f"""with recursive d as (select row_number() over () as r, doc_id, coalesce(text, '') as t, md5(coalesce(doc_id::varchar, '')) as m from documents),
c as (select r, doc_id, m, t, octet_length(encode(t)) as n, list_transform(string_split(hex(encode(t)), ''), lambda x: instr('0123456789ABCDEF', x) - 1) as h from d),
s as (select r, doc_id, m, (n + 1)::bigint as size, case when n = 0 then 0::bigint else xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, 2 * n), lambda i: h[case when i % 2 = 0 then i + 2 else i end]::bigint)),
lambda a, x: xor(a >> 4, {_crc_table()}[(xor(a, x) & 15) + 1])), 4294967295::bigint) end as text_crc32 from c),
j as (select r, ('0x' || substr(m, 17, 16))::uhugeint as state, -1::bigint as shard, 0::bigint as ahead from s union all
select r, x, ahead, floor((ahead + 1) * (2147483648.0::double / ((x >> 33)::bigint + 1)::double))::bigint from (select r, ahead, (state * {_STEP}::uhugeint + 1) % 18446744073709551616::uhugeint as x from j where ahead < 16)),
k as (select r, shard, ahead from j where ahead >= 16)
select doc_id, size, text_crc32, 'key' as law, shard::int as shard, row_number() over (partition by shard order by substr(m, 1, 8), doc_id nulls first, size, text_crc32) - 1 as slot, case when ahead = 16 then 16 else shard end::int as grown_shard from s join k on k.r = s.r"""
