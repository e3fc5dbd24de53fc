"""Ranked lexical search by block-max WAND over posting blocks of variable length.

Documents are indexed in shards of bounded size, each one row on disk. In a shard, dynamic
programming cuts every posting list into blocks so that the sum of (largest impact of the block
less impact of the posting), plus a fixed cost for each block, is least. A query is answered
shard by shard: the ends of its terms' blocks cut the shard's documents into intervals, inside
which the sum of the block maxima bounds every score. Intervals are read in order of falling
bound, as long as the bound reaches the k-th best score so far; the postings of all other blocks
are skipped. The best of each shard meet in one ranking.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, release
from .hashing import slices, text_bytes, word_hashes

#: Bytes between terms: ASCII other than letters and digits.
BREAKS = np.ones(256, bool)
BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: A shard ends with the slice of texts that fills one of these.
SHARD_DOCS = 8192
SHARD_POSTINGS = 1 << 20
#: Postings of a block at most, and what a block costs, in standard deviations of its list's impacts.
LONGEST = 64
BLOCK_COST = 16.0
#: Distinct terms of the queries up to which the index leaves all others out; term and weight pairs that one task takes in.
VOCABULARY = 1_000_000
PAIRS = 200_000

_INDEX = "shard long, doc_ids array<long>, n binary, terms binary, starts binary, docs binary, tfs binary, with_terms long, total long"


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each term, in order, and the row that it is in."""
    data, offsets = text_bytes(texts)
    hashes, rows, _ = word_hashes(data, offsets, space=BREAKS)
    return hashes, rows


def _postings(hashes: np.ndarray, rows: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term's place in `terms`, row, occurrences) of the terms that are in sorted `terms`."""
    if not len(terms):
        return (np.zeros(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    known = terms[at] == hashes
    pairs, tf = np.unique(rows[known] * len(terms) + at[known], return_counts=True)
    return pairs % len(terms), pairs // len(terms), tf


def _indexer(vocabulary: np.ndarray | None):
    def shard(number: int, ids: list, sizes: list, found: list) -> pa.RecordBatch:
        n, of = np.concatenate(sizes), np.concatenate([x[0] for x in found])
        docs, tfs = np.concatenate([x[1] for x in found]), np.concatenate([x[2] for x in found])
        order = np.lexsort((docs, of))
        terms, starts = np.unique(of[order], return_index=True)
        columns = n.astype(np.int64), terms, np.append(starts, len(of)).astype(np.int64), docs[order].astype(np.int32), tfs[order].astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([ids], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in columns), pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])],
            [x.split()[0] for x in _INDEX.split(", ")],
        )

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        ids, sizes, found, held = [], [], [], 0
        for part in slices(batches):
            hashes, rows = term_hashes(part.column("text"))
            sizes.append(np.bincount(rows, minlength=part.num_rows))
            terms = np.unique(hashes) if vocabulary is None else vocabulary
            of, docs, tf = _postings(hashes, rows, terms)
            found.append((terms[of], docs + len(ids), tf))
            ids += part.column("doc_id").to_pylist()
            held += len(of)
            if len(ids) >= SHARD_DOCS or held >= SHARD_POSTINGS:
                yield shard(number, ids, sizes, found)
                number += 1
                ids, sizes, found, held = [], [], [], 0
        if ids:
            yield shard(number, ids, sizes, found)

    return run


def _frequencies(batches):
    for b in batches:
        for terms, starts in zip(b.column("terms"), b.column("starts"), strict=True):
            at = np.frombuffer(terms.as_buffer(), np.uint64)
            df = np.diff(np.frombuffer(starts.as_buffer(), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(df)], ["term", "df"])


def _item_terms(batches):
    for part in slices(batches):
        hashes, rows = term_hashes(part.column("text"))
        terms = np.unique(hashes)
        of, rows, times = _postings(hashes, rows, terms)
        items = part.column("item").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(items[rows]), pa.array(terms[of].view(np.int64)), pa.array(times.astype(np.int64))], ["item", "term", "times"])


def block_ends(impacts: np.ndarray, starts: np.ndarray, longest: int = LONGEST, cost: float = BLOCK_COST) -> list[np.ndarray]:
    """Ends of the blocks of each list that are least in bound error plus `cost` standard deviations a block.

    impacts of all lists end to end; list i is impacts[starts[i]:starts[i + 1]]. All lists advance
    together, one posting a step; of each only the last `longest` possible block starts are open.
    """
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    begin, length = starts[:-1][order], sizes[order]
    impacts = impacts.astype(np.float64)
    number = len(order)
    sums = np.add.reduceat(impacts, starts[:-1]) if number else np.zeros(0)
    squares = np.add.reduceat(np.square(impacts), starts[:-1]) if number else np.zeros(0)
    spread = np.sqrt(np.maximum(squares / np.maximum(sizes, 1) - np.square(sums / np.maximum(sizes, 1)), 0))
    price = np.maximum(cost * spread, 1.0)[order]
    back = np.zeros(len(impacts), np.int16)
    top = np.zeros((number, longest))
    # the least cost up to the start of the block in each slot, and the sum of impacts before it
    base = np.full((number, longest), np.inf)
    before = np.zeros(number)
    best = np.zeros(number)
    slots = np.arange(longest)
    active = number
    for i in range(int(length[0]) if number else 0):
        while length[active - 1] <= i:
            active -= 1
        slot = i % longest
        top[:active, slot] = 0
        base[:active, slot] = best[:active] + price[:active] + before[:active]
        x = impacts[begin[:active] + i]
        np.maximum(top[:active], x[:, None], out=top[:active])
        before[:active] += x
        width = ((slot - slots) % longest + 1).astype(np.float64)
        total = top[:active] * width
        total += base[:active]
        choice = total.argmin(axis=1)
        best[:active] = total[np.arange(active), choice] - before[:active]
        back[begin[:active] + i] = width[choice]
    out: list[np.ndarray] = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        ends, at = [], b
        while at > a:
            ends.append(at)
            at -= int(back[at - 1])
        out.append(np.array(ends[::-1], np.int64))
    return out


class Shard:
    """Posting lists of some documents: impacts, blocks and their maxima."""

    def __init__(self, terms: np.ndarray, starts: np.ndarray, docs: np.ndarray, impacts: np.ndarray, number: int):
        self.terms, self.starts, self.docs, self.impacts, self.number = terms, starts, docs, impacts, number
        self.read = 0  # postings that searches have read
        self.edges, self.bounds = [], []
        for (a, b), ends in zip(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True), block_ends(impacts, starts), strict=True):
            heads = np.concatenate([[a], ends[:-1]])
            # a block reaches from its first document to its last; between blocks nothing is to be had
            edge = np.empty(2 * len(ends), np.int64)
            edge[0::2], edge[1::2] = docs[heads], docs[ends - 1] + 1
            bound = np.zeros(2 * len(ends), np.int64)
            bound[0::2] = np.maximum.reduceat(impacts[a:b], heads - a)
            self.edges.append(edge)
            self.bounds.append(bound)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all that have a score above 0 of at least the k-th best."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(self.terms, terms)
        there = at < len(self.terms)
        there[there] = self.terms[at[there]] == terms[there]
        lists, weights = at[there], weights[there]
        if not len(lists):
            return none
        edges = np.unique(np.concatenate([self.edges[t] for t in lists]))
        bound = np.zeros(len(edges), np.int64)
        for t, w in zip(lists, weights, strict=True):
            place = np.searchsorted(self.edges[t], edges, side="right") - 1
            bound += np.where(place >= 0, self.bounds[t][place], 0) * w
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        ends = np.append(edges[1:], self.number)
        least, got, reach = 1, none, 4 * k
        while len(order):
            # so many intervals as hold about `reach` documents
            take = int(np.searchsorted(np.cumsum((ends - edges)[order]), reach)) + 1
            chosen, order = np.sort(order[:take]), order[take:]
            score = np.zeros(self.number, np.int64)
            for t, w in zip(lists, weights, strict=True):
                a, b = self.starts[t], self.starts[t + 1]
                own = self.docs[a:b]
                first, last = np.searchsorted(own, edges[chosen]), np.searchsorted(own, ends[chosen])
                count = last - first
                here = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                self.read += len(here)
                score[own[here]] += self.impacts[a + here] * w
            docs = np.flatnonzero(score >= least)
            docs, score = np.concatenate([got[0], docs]), np.concatenate([got[1], score[docs]])
            if len(docs) >= k:
                least = max(least, int(np.partition(score, len(score) - k)[len(score) - k]))
                docs, score = docs[score >= least], score[score >= least]
            got = docs, score
            order = order[bound[order] >= least]
            reach *= 2
        return got


def _search(documents: int, total: int, k: int):
    def run(key, table):
        row = table.slice(0, 1)
        read = lambda name, kind: np.frombuffer(row.column(name)[0].as_buffer(), kind)
        terms, starts, docs, tfs, n = read("terms", np.uint64), read("starts", np.int64), read("docs", np.int32).astype(np.int64), read("tfs", np.int32).astype(np.int64), read("n", np.int64)
        items, item_starts, wanted, weights = read("items", np.int64), read("item_starts", np.int64), read("item_terms", np.uint64), read("weights", np.int64)
        used = np.flatnonzero(np.isin(terms, wanted))
        if len(used) < len(terms):
            keep = np.repeat(np.isin(np.arange(len(terms)), used), np.diff(starts))
            starts = np.concatenate([[0], np.cumsum(np.diff(starts)[used])])
            terms, docs, tfs = terms[used], docs[keep], tfs[keep]
        length = 100 - 25 + (25 * n[docs] * documents) // total
        shard = Shard(terms, starts, docs, 1_000_000_000 * tfs // (1000 * tfs + 12 * length), len(n))
        ids = row.column("doc_ids")[0].values.to_pylist()
        out: list[list] = [[], [], []]
        for i, item in enumerate(items.tolist()):
            a, b = item_starts[i], item_starts[i + 1]
            found, scores = shard.search(wanted[a:b], weights[a:b], k)
            best = sorted(zip((-scores).tolist(), ((ids[d] is None, ids[d] or 0) for d in found.tolist()), found.tolist(), strict=True))[:k]
            out[0] += [item] * len(best)
            out[1] += [ids[d] for _, _, d in best]
            out[2] += [-s for s, _, _ in best]
        return pa.table([pa.array(x, pa.int64()) for x in out], ["item", "doc_id", "score"])

    return run


def _pack_items(key, table):
    item = table.column("item").to_numpy()
    term, weight = table.column("term").to_numpy().view(np.uint64), table.column("weight").to_numpy()
    order = np.argsort(item, kind="stable")
    items, starts = np.unique(item[order], return_index=True)
    columns = items, np.append(starts, len(item)).astype(np.int64), term[order], weight[order]
    return pa.table([pa.array([key[0].as_py()]), *(pa.array([x.tobytes()], pa.binary()) for x in columns)], ["block", "items", "item_starts", "item_terms", "weights"])


def search_items(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items(item_id, text) its k best rows of docs(doc_id, text).

    Terms are runs of ASCII letters, digits and all characters beyond ASCII, lower-cased A-Z.
    Scores are integers as the weights and lengths define them; only those above 0 are given, ties
    go to the smaller doc_id, null ids last. Null and empty texts have no terms: such a document is
    in no result and not counted, such an item has no rows. Repeated documents are ranked each by
    itself; items that share an item_id are ranked each by itself too. Terms are told apart by 64
    bits of their hash. Empty tables give no rows; other columns are not carried.
    """
    asked = materialize(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
    pairs = materialize(asked.select("item", "text").mapInArrow(_item_terms, "item long, term long, times long"), "item-terms")
    distinct = pairs.select("term").distinct()
    vocabulary = None
    if distinct.count() <= VOCABULARY:
        vocabulary = np.sort(np.array([r[0] for r in distinct.collect()], np.int64).view(np.uint64))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index = materialize(source.mapInArrow(_indexer(vocabulary), _INDEX), "index")
    documents, total = index.agg(F.coalesce(F.sum("with_terms"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    df = index.select("terms", "starts").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((2.0 * documents + 2) / (2.0 * F.col("df") + 1))) * F.col("times")
    weighed = materialize(pairs.join(df, "term").select("item", "term", weight.cast("long").alias("weight")), "weights")
    blocks = max(1, math.ceil(weighed.count() / PAIRS))
    packed = weighed.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("long")).groupBy("block").applyInArrow(
        _pack_items, "block long, items binary, item_starts binary, item_terms binary, weights binary"
    )
    packed = materialize(packed, "item-blocks")
    found = None
    for b in range(blocks):
        # one block of items at a time, of about PAIRS pairs, meets all shards
        both = index.withColumn("block", F.lit(b).cast("long")).join(F.broadcast(packed.where(F.col("block") == b)), "block")
        new = both.groupBy("shard").applyInArrow(_search(documents, max(1, total), k), "item long, doc_id long, score long")
        found = new if found is None else found.unionByName(new)
    best = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = materialize(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "ranked")
    out = ranked.join(asked.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
    release(pairs, index, weighed, packed)
    return out


#: The same rows in SQL.
SQL = r"""with t as (select doc_id, row_number() over () as r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
d as (select r, doc_id, w, len(w)::hugeint as n from t where len(w) > 0), a as (select count(*)::hugeint as big_n, sum(n)::hugeint as big_l from d),
o as (select r, term, count(*)::hugeint as tf from (select r, unnest(w) as term from d) group by 1, 2),
f as (select term, floor(1000 * ln((2 * big_n + 2)::double / (2 * count(*) + 1)::double))::hugeint as w from o, a group by term, big_n),
q as (select item_id, term, count(*)::hugeint as times from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by 1, 2),
s as (select item_id, d.doc_id, d.r, sum(times * f.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l)))) as score from q join f using (term) join o using (term) join d using (r), a group by 1, 2, 3),
k as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from s where score > 0)
select item_id, rank::int as rank, doc_id, score::bigint as score from k where rank <= 20"""
