"""Grouping of spelling variants by bands of letter-parity bitmasks.

A word's mask has one bit for each letter, set where the letter occurs an odd number of times.
One inserted or deleted code point flips one bit, one replaced code point two or none. The bits are
split into three bands: of a replaced pair at least one band is equal in both masks, of an
inserted or deleted one at least two are. Words meet where a band, the length class and one half of
the word are equal (an edit leaves the code points before or behind the middle as they are, so
this splits crowded bands and loses nothing); those whose masks differ by more than two bits go,
the others are verified. A crowded meeting place is split into cells of bounded size, and each pair
is given once, at the first place where it meets.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release
from .sharding import crc_sql

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Distinct words that a task counts before it hands them on.
HELD = 500_000
#: Words of a block; a cell holds one block or two.
BLOCK = 2000
#: Bit i is in band i % 3.
BANDS = tuple(sum(1 << i for i in range(j, 64, 3)) for j in range(3))
#: The meeting places of words of equal length, and those of a shorter and a longer one.
SAME, SHORT, LONG = 0, 1, 2


def _count(every: int, shortest: int):
    def out(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches):
        counts: dict[str, int] = {}
        for b in batches:
            for doc, text in zip(b.column("doc").to_pylist(), b.column("text"), strict=True):
                if not text.is_valid:
                    continue
                start = zlib.crc32(f"{doc}:".encode())
                # bytes are lower-cased in A-Z alone
                for word, n in Counter(RUN.findall(text.as_buffer().to_pybytes().lower().decode())).items():
                    if len(word) < shortest:
                        continue
                    h = zlib.crc32(word.encode(), start)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < shortest:
                            continue
                    counts[word] = counts.get(word, 0) + n
                if len(counts) >= HELD:
                    yield out(counts)
                    counts = {}
        yield out(counts)

    return run


def count_words(docs: DataFrame, shortest: int = 5, least: int = 3, every: int = 97) -> DataFrame:
    """(word, n): the words of docs(doc_id, text) of at least `shortest` code points and `least` occurrences.

    A run whose checksum with its doc_id `every` divides stands without one of its code points. A
    null doc_id is as empty.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "text")
    return rows.mapInArrow(_count(every, shortest), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def letter_mask(word: str) -> int:
    """Parities of the letters: a to z have bits of their own, all others share the bits from 26 on."""
    mask = 0
    for c in word:
        i = ord(c) - 97
        mask ^= 1 << (i if 0 <= i < 26 else 26 + ord(c) % 38)
    return mask


def _key(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode(), digest_size=8).digest(), "little", signed=True)


def meeting_places(word: str, mask: int):
    """(key, role, place) of each place where a word meets others; place numbers the band and the half."""
    n, half = len(word), len(word) // 2
    for band in range(3):
        value = mask & BANDS[band]
        for side, part in enumerate((word[:half], word[half:])):
            yield _key(0, n, band, value, side, part), SAME, 2 * band + side
        if band == 2:  # an insertion leaves two bands equal, so one of the first two
            continue
        for side, part in enumerate((word[:half], word[half:])):
            yield _key(1, n, band, value, side, part), SHORT, 2 * band + side
        short = (n - 1) // 2
        for side, part in enumerate((word[:short], word[short + 1 :])):
            yield _key(1, n - 1, band, value, side, part), LONG, 2 * band + side


def _places(batches):
    for b in batches:
        keys, roles, places, words, counts, masks = [], [], [], [], [], []
        for word, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
            mask = letter_mask(word)
            signed = mask - (1 << 64) if mask >> 63 else mask
            for key, role, place in meeting_places(word, mask):
                keys.append(key)
                roles.append(role)
                places.append(place)
                words.append(word)
                counts.append(n)
                masks.append(signed)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(roles, pa.int8()), pa.array(places, pa.int8()), pa.array(words, pa.string()), pa.array(counts, pa.int64()), pa.array(masks, pa.int64())],
            ["key", "role", "place", "word", "n", "mask"],
        )


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point tells a and b apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _first_place(a: str, b: str, mask_a: int, mask_b: int) -> int:
    """The first place at which two words of one edit meet."""
    band = next(j for j in range(3) if not (mask_a ^ mask_b) & BANDS[j])
    half = min(len(a), len(b)) // 2
    return 2 * band + (a[:half] != b[:half])


#: Pairs of rows that are held against each other at once, about.
PAIRS = 1 << 20


def _pairs(cell: np.ndarray, role: np.ndarray, place: np.ndarray, block: np.ndarray, cross: np.ndarray, masks: np.ndarray, words: list[str]):
    """Positions (i, j) of the pairs one edit apart that first meet in these cells; rows of a cell stand together."""
    n = len(cell)
    end = np.searchsorted(cell, cell, side="right")
    later = end - np.arange(n) - 1
    done = np.concatenate([[0], np.cumsum(later)])
    begin = 0
    while begin < n:
        stop = max(begin + 1, int(np.searchsorted(done, done[begin] + PAIRS, side="right")) - 1)
        left = np.repeat(np.arange(begin, stop), later[begin:stop])
        right = left + 1 + np.arange(len(left)) - np.repeat(done[begin:stop] - done[begin], later[begin:stop])
        same = role[left] == SAME
        near = np.bitwise_count(masks[left] ^ masks[right]) <= np.where(same, 2, 1)
        near &= (role[left] != role[right]) | same
        near &= place[left] == place[right]
        # pairs inside a block are its own cell's
        near &= ~cross[left] | (block[left] != block[right])
        for i, j in zip(left[near].tolist(), right[near].tolist(), strict=True):
            x, y = words[i], words[j]
            if one_edit(x, y) and _first_place(x, y, int(masks[i]), int(masks[j])) == place[i]:
                yield i, j
        begin = stop


def _near(batches):
    """Rows sorted by cell in; (word, near, near_n) in both directions out."""

    def out(rows: pa.Table):
        column = lambda name: rows.column(name).to_numpy()
        words, counts = rows.column("word").to_pylist(), column("n")
        found = list(_pairs(column("cell"), column("role"), column("place"), column("block"), column("cross"), column("mask").view(np.uint64), words))
        both = found + [(j, i) for i, j in found]
        return pa.RecordBatch.from_arrays(
            [pa.array([words[i] for i, _ in both], pa.string()), pa.array([words[j] for _, j in both], pa.string()), pa.array(counts[np.array([j for _, j in both], np.int64)])], ["word", "near", "near_n"]
        )

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cells = b.column("cell").to_numpy()
        # the last cell of a batch may go on in the next
        last = int(np.searchsorted(cells, cells[-1]))
        if last or (held and held[-1].column("cell")[-1].as_py() != cells[0]):
            held.append(b.slice(0, last))
            yield out(pa.Table.from_batches(held))
            held = [b.slice(last)]
        else:
            held.append(b)
    if held:
        yield out(pa.Table.from_batches(held))


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): each ordered pair of words(word, n) that one edit tells apart, once."""
    places = materialize(words.mapInArrow(_places, "key long, role byte, place byte, word string, n long, mask long"), "places")
    full = places.groupBy("key").agg(F.count("*").alias("size"), F.count_if(F.col("role") == SHORT).alias("short")).where("size > 1 and (short = 0 or short < size)")
    met = places.join(full.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "key")
    dealt = met.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.withColumn("cell", F.xxhash64("key", F.least("block", "_o"), F.greatest("block", "_o"))).withColumn("cross", F.col("block") != F.col("_o"))
    cells = cells.select("cell", "role", "place", "block", "cross", "word", "n", "mask")
    found = materialize(cells.repartition("cell").sortWithinPartitions("cell", "word").mapInArrow(_near, "word string, near string, near_n long"), "near")
    release(places)
    return found


def group_variants(docs: DataFrame, shortest: int = 5, least: int = 3, every: int = 97) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per word of docs(doc_id, text); see count_words() for the words.

    A word's form is the most frequent of the words one edit away (ties: the smallest in code-point
    order), if it is at least twice as frequent; root follows the forms to the last, and is the
    word itself if it has none. Null and empty texts have no words; repeated rows count each; an
    empty table gives no rows; other columns are not carried.
    """
    words = materialize(count_words(docs, shortest, least, every), "words")
    near = near_words(words)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("low"), F.col("near").alias("near"))).alias("b"))
    known = words.join(best, "word", "left").withColumn("strong", -F.col("b.low") >= 2 * F.col("n"))
    formed = materialize(
        known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("strong"), F.col("b.near")).alias("form"), F.when(F.col("strong"), -F.col("b.low")).alias("form_n")), "forms"
    )
    release(near, words)
    # counts double at least from a word to its form, so paths are short, and each round halves them
    at = materialize(formed.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.join(at.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        last, at = at, materialize(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        release(last)
        if at.where("moved").isEmpty():
            break
    return formed.join(at.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same rows in SQL: pairs share what deleting one code point leaves.
SQL = rf"""with recursive r as (select doc_id, run, count(*) as c from (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) as run from documents) group by 1, 2),
h as (select run, c, {crc_sql("coalesce(doc_id::varchar, '') || ':' || run")} as h from r where length(run) >= 5),
w as (select case when h % 97 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, c from h),
v as (select word, sum(c)::bigint as n from w where length(word) >= 5 group by 1 having sum(c) >= 3),
d as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from v)),
p as (select a.word, b.word as near, b.n from d a join d b on a.rest = b.rest and a.i = b.i and a.word <> b.word union
select d.word, v.word, v.n from d join v on d.rest = v.word union select v.word, d.word, d.n from d join v on d.rest = v.word),
k as (select *, row_number() over (partition by word order by n desc, near) as place, count(*) over (partition by word) as n_near from p),
f as (select v.word, v.n, coalesce(k.n_near, 0)::bigint as n_near, case when k.n >= 2 * v.n then near end as form, case when k.n >= 2 * v.n then k.n end as form_n from v left join (select * from k where place = 1) k on k.word = v.word),
o as (select word, word as root, 0 as step from v union all select o.word, f.form, step + 1 from o join f on f.word = o.root where f.form is not null)
select f.word, form, z.root, n, n_near, form_n from f join (select word, arg_max(root, step) as root from o group by 1) z on z.word = f.word"""
