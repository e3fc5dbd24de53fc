"""Near-duplicate groups by circulant MinHash.

Two permutations of the 32-bit integers: `sigma` spreads shingles once, and `pi`, shifted by
k around the circle, gives coordinate k of the signature: min over the set of
pi((sigma(x) + k * SHIFT) mod 2**32). Bands of a signature propose links; every link is
confirmed on the full shingle sets.

Nothing emits all pairs of a bucket. Equal sets are one node. Round 1 holds each node
against the least node of each of its buckets. Where a bucket then still spans several
components, round 2 looks inside it, in cells of bounded bytes, and returns at most the links
that join components. Buckets of the same members are looked into once, and of two members
only if their signatures agree often enough for the threshold (see _least_agreement).
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release
from .components import components
from .hashing import grams, slices, text_bytes, word_hashes

ROWS = 4
BANDS = 24
COORDINATES = ROWS * BANDS
_SHIFT = 2654435769  # odd: the shifts of all coordinates differ
#: Rows and bytes of sets that a block of a bucket holds, about; a cell is one block or two.
BLOCK = 1000
BLOCK_BYTES = 1 << 24
BROADCAST_IDS = 1_000_000


def _permute(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A bijection of the 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(first)
    x ^= x >> np.uint32(15)
    x *= np.uint32(second)
    x ^= x >> np.uint32(16)
    return x


def signatures(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """uint32 [sets, COORDINATES] for sets end to end, each not empty."""
    sigma = _permute((shingles >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    out = np.empty((len(starts), COORDINATES), dtype=np.uint32)
    for k in range(COORDINATES):
        turned = sigma + np.uint32(k * _SHIFT & 0xFFFFFFFF)
        out[:, k] = np.minimum.reduceat(_permute(turned, 0x9E3779B1, 0x85EBCA77), starts)
    return out


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; a text of fewer words is one shingle."""
    data, offsets = text_bytes(texts)
    hashes, rows, _ = word_hashes(data, offsets)
    made, of = grams(hashes, rows, width)
    ends = np.searchsorted(of, np.arange(len(texts) + 1))
    words = np.searchsorted(rows, np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        s = made[ends[i] : ends[i + 1]]
        if not len(s) and words[i] < words[i + 1]:
            own = hashes[words[i] : words[i + 1]]
            s = grams(own, np.zeros(len(own), np.int64), len(own))[0] if len(own) > 1 else own
        out.append(np.unique(s))
    return out


def _set_key(members: np.ndarray) -> bytes | None:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest() if len(members) else None


def _load(width: int):
    """Rows (rep, set_key, text) in; the sets with that key out, each once a task."""

    def run(batches):
        seen = set()
        for part in slices(batches):
            reps, keys, sets = [], [], []
            for rep, key, members in zip(part.column("rep").to_pylist(), part.column("set_key").to_pylist(), shingle_sets(part.column("text"), width), strict=True):
                if (rep, key) not in seen and _set_key(members) == key:
                    seen.add((rep, key))
                    reps.append(rep)
                    keys.append(key)
                    sets.append(members.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["rep", "set_key", "members"])

    return run


def _sign(width: int):
    def run(batches):
        for part in slices(batches):
            sets = shingle_sets(part.column("text"), width)
            ids = part.column("doc_id")
            full = [i for i, s in enumerate(sets) if len(s)]
            starts = np.cumsum([0] + [len(sets[i]) for i in full])[:-1]
            signed = signatures(np.concatenate([sets[i] for i in full]), starts) if full else []
            sig: list[bytes | None] = [None] * len(sets)
            for i, row in zip(full, signed, strict=True):
                sig[i] = row.tobytes()
            key = [_set_key(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())],
                ["doc_id", "n_shingles", "set_key", "sig"],
            )

    return run


def _least_agreement(percent: int) -> int:
    """Coordinates that a pair at the threshold shares, less 6.5 standard deviations."""
    t = percent / 100
    return max(0, math.floor(COORDINATES * t - 6.5 * math.sqrt(COORDINATES * t * (1 - t))))


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _alike(least: int):
    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.frombuffer(b"".join(b.column("sig_a").to_pylist()), np.uint32).reshape(-1, COORDINATES)
                y = np.frombuffer(b"".join(b.column("sig_b").to_pylist()), np.uint32).reshape(-1, COORDINATES)
                keep = pa.array((x == y).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    return run


def _confirm(percent: int):
    def run(batches):
        for b in batches:
            pairs = zip(b.column("set_a"), b.column("set_b"), strict=True)
            keep = pa.array([_linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in pairs], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    return run


def _links_inside(sig: np.ndarray, sets: list[np.ndarray], rep: list[int], comp: list[int], percent: int) -> list[tuple[int, int]]:
    """Links between components in one cell (a bucket, or two blocks of it), at most one for each joining."""
    least = _least_agreement(percent)
    parent = {c: c for c in comp}

    def root(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    found, left = [], len(parent)
    for i in range(1, len(rep)):
        if left == 1:
            break
        for j in np.flatnonzero((sig[:i] == sig[i]).sum(axis=1) >= least):
            x, y = root(comp[i]), root(comp[j])
            if x != y and _linked(sets[i], sets[j], percent):
                parent[max(x, y)] = min(x, y)
                left -= 1
                found.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
    return found


def _inside(percent: int):
    """Rows sorted by cell in; the links inside each cell out."""

    def links(rows):
        sig = np.frombuffer(b"".join(r[3] for r in rows), np.uint32).reshape(-1, COORDINATES)
        return _links_inside(sig, [np.frombuffer(r[4], np.uint64) for r in rows], [r[1] for r in rows], [r[2] for r in rows], percent)

    def out(pairs):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches):
        rows, found = [], []
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("cell", "rep", "component", "sig", "members")), strict=True):
                if rows and rows[0][0] != r[0]:
                    found += links(rows)
                    rows = []
                rows.append(r)
            if len(found) >= 1024:
                yield out(found)
                found = []
        if rows:
            found += links(rows)
        yield out(found)

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of docs(doc_id, text).

    Sets of `width`-word shingles (words lower-cased A-Z) are linked where 100 * intersection
    >= percent * union; component_id is the least doc_id reachable, kept whether it is the row's
    own. Null and empty texts, and texts without words, have an empty set and are linked with
    nothing. Rows with equal doc_id share its component; rows with a null doc_id are in the
    component of their set, and are their own (null, kept) if nothing else is in it. An empty
    table gives no rows; other columns are not carried.
    """
    source = docs.select("doc_id", "text")
    signed = materialize(source.mapInArrow(_sign(width), "doc_id long, n_shingles long, set_key binary, sig binary"), "signed")
    full = signed.where("set_key is not null").groupBy("set_key")
    reps = materialize(full.agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig"), F.min("n_shingles").alias("n")).where("rep is not null"), "reps")
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.col("sig").substr(i * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    bands = reps.select("rep", F.explode(keys).alias("band"))
    buckets = bands.groupBy("band").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1").select("band", "a")
    bands = materialize(bands.join(buckets, "band"), "bands")
    stars = bands.where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    sigs = reps.select("rep", "sig")
    tried = stars.join(sigs.withColumnsRenamed({"rep": "b", "sig": "sig_b"}), "b").join(sigs.withColumnsRenamed({"rep": "a", "sig": "sig_a"}), "a")
    alike = materialize(tried.select("a", "b", "sig_a", "sig_b").mapInArrow(_alike(_least_agreement(percent)), "a long, b long"), "alike")

    loaded = _sets_of(source, reps.join(bands.select("rep").distinct(), "rep", "left_semi").select("rep", "set_key"), width)
    sets = loaded.select("rep", "members")
    held = alike.join(sets.withColumnsRenamed({"rep": "b", "members": "set_b"}), "b").join(sets.withColumnsRenamed({"rep": "a", "members": "set_a"}), "a")
    links = materialize(held.select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a long, b long"), "links")
    first = components(links)

    labelled = bands.join(first.withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", F.coalesce("component", "rep").alias("component"))
    labelled = materialize(labelled.join(reps.select("rep", F.col("n").alias("size")), "rep"), "labelled")
    hashed = [F.sum(F.xxhash64("rep", F.lit(k)).cast("decimal(38,0)")).alias(f"h{k}") for k in (1, 2)]
    mixed = labelled.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n"), F.sum("size").alias("size"), *hashed).where("x <> y")
    # of buckets with the same members one is enough
    once = mixed.groupBy("n", "size", "h1", "h2").agg(F.min("band").alias("band"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("size") * 8 / BLOCK_BYTES)).cast("int")
    members = labelled.drop("size").join(once.select("band", blocks.alias("blocks")), "band")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    # a row goes to every cell (i, j), i <= j, that has its block
    cells = members.withColumn("_b", block).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64("band", F.least("_b", "_o"), F.greatest("_b", "_o")).alias("cell")
    filled = cells.select(cell, "rep", "component").distinct().join(sigs, "rep").join(sets, "rep")
    dealt = filled.repartition("cell").sortWithinPartitions("cell", "rep")
    more = materialize(dealt.select("cell", "rep", "component", "sig", "members").mapInArrow(_inside(percent), "a long, b long"), "more")
    joined = components(links.unionByName(more))
    release(bands, alike, loaded, links, first, labelled, more)

    # empty sets are linked with nothing and join nothing, so that they meet in no task
    own = signed.where("set_key is not null").join(reps.select("set_key", "rep"), "set_key", "left")
    named = own.join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
    empty = signed.where("set_key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    # rows of one doc_id belong together whatever their texts
    return named.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _sets_of(source: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(rep, set_key, members): the sets of wanted(rep, set_key), one row for each. Few are broadcast, many are joined by shuffle.

    A doc_id may stand on many rows, with this text or others: a task hands on one row of it that
    has the set, and where several tasks do, one of theirs stays.
    """
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    found = source.join(wanted, source["doc_id"] == wanted["rep"]).select("rep", "set_key", "text")
    sets = materialize(found.mapInArrow(_load(width), "rep long, set_key binary, members binary"), "sets")
    if sets.groupBy("rep", "set_key").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return sets
    single = materialize(sets.dropDuplicates(["rep", "set_key"]), "sets")
    release(sets)
    return single


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _numbered(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """(row, doc, text, number) of docs; number is unique: the doc_id where it is on one row; rows that share one, or have none, are written once with numbers beyond all ids."""
    beyond = docs.agg(F.max("doc_id")).first()[0]
    beyond = 0 if beyond is None else max(beyond + 1, 0)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("doc"), "text")
    ids = _few(shared.select(F.col("doc_id").alias("id")))
    same = F.col("doc").eqNullSafe(F.col("id"))
    others = materialize(rows.join(ids, same, "left_semi").withColumn("number", F.monotonically_increasing_id() + F.lit(beyond).cast("long")), "numbered")
    return rows.join(ids, same, "left_anti").withColumn("number", F.col("doc").cast("long")).unionByName(others)


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near-duplicates (of the least doc_id, null last), columns of any name unchanged.

    Rows are judged by their text alone: repeated rows, rows that share a doc_id and rows without
    one are in the group of their text like any other. Texts without words (null, empty, blank)
    are in no group and stay. An empty table gives no rows.
    """
    shared = materialize(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id"), "shared")
    if shared.isEmpty():
        gone = near_duplicates(docs, width, percent).where("not kept").select("doc_id").distinct()
        return docs.join(_few(gone), "doc_id", "left_anti").select(*docs.columns)
    rows = _numbered(docs, shared)
    found = near_duplicates(rows.select(F.col("number").alias("doc_id"), "text"), width, percent)
    found = materialize(found.select(F.col("doc_id").alias("number"), "component_id").join(rows.select("number", "doc"), "number"), "found")
    stays = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "number")).alias("s")).select("s.number")
    gone = found.select("number").join(stays, "number", "left_anti")
    return rows.join(_few(gone), "number", "left_anti").select("row.*")


def sql(width: int, percent: int) -> str:
    """The rows of near_duplicates() in SQL: all pairs of different sets that share a shingle."""
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(width))
    return rf"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, list_sort(list_distinct(case when len(w) >= {width} then list_transform(range(1, len(w) - {width - 2}), lambda i: {shingle}) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as s from w),
k as (select doc_id, s, case when len(s) > 0 then min(doc_id) over (partition by s) else doc_id end as rep from s),
x as (select doc_id, unnest(s) as t, len(s) as n from k where doc_id = rep),
p as (select a.doc_id as a, b.doc_id as b from x a join x b on a.t = b.t and a.doc_id < b.doc_id group by 1, 2 having 100 * count(*) >= {percent} * (any_value(a.n) + any_value(b.n) - count(*))),
e as (select a, b from p union all select b, a from p), r as (select a as rep, a as node from e union select r.rep, e.b from r join e on e.a = r.node),
c as (select rep, min(node) as lo from r group by 1)
select doc_id, len(s)::bigint as n_shingles, coalesce(lo, k.rep) as component_id, doc_id = coalesce(lo, k.rep) as kept from k left join c on c.rep = k.rep"""
