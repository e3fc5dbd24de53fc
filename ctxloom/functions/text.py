"""Text scalars as Columns: token estimates, tokenizers, set similarity."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words that results must agree on.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "had", "has", "have", "he", "her", "his",
    "how", "i", "if", "in", "into", "is", "it", "its", "just", "me", "my", "no", "nor", "not", "of", "on", "or", "our",
    "out", "own", "she", "so", "some", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this",
    "to", "too", "up", "us", "was", "we", "were", "what", "when", "which", "who", "will", "with", "would", "you", "your",
]


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def estimate_tokens(text: Column, factor: float = 1.3) -> Column:
    """Words times a factor above 0, rounded up; 0 for blank or null text."""
    return tokens_of(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")), factor)


def tokens_of(words: Column, factor: float = 1.3) -> Column:
    """estimate_tokens() of a text with so many white-space words."""
    return F.ceil(words * F.lit(float(factor))).cast("long")


def estimate_chars(text: Column) -> Column:
    """A quarter of the trimmed length, rounded up."""
    return F.ceil(F.length(trimmed(F.coalesce(text, F.lit("")))) / F.lit(4.0)).cast("long")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of two or more characters."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda x: F.length(x) > 1)


def keywords(text: Column) -> Column:
    return F.array_except(F.array_distinct(tokens(text)), F.array(*[F.lit(w) for w in STOPWORDS]))


def word_set(text: Column, longer_than: int = 2) -> Column:
    """Distinct lower-cased white-space words longer than the given length."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: F.length(x) > longer_than))


def word_hashes(text: Column, longer_than: int = 0) -> Column:
    """A struct: how many white-space words the text has (`words`), and 64-bit hashes of the lower-cased ones longer than the given length, in order (`hashes`); none for null text.

    The different words of many texts are hashed at once, each once.
    """

    def run(texts: pa.Array) -> pa.Array:
        words = pc.ascii_split_whitespace(pc.utf8_lower(texts.fill_null("")))
        flat, ends = words.flatten(), np.append(0, np.cumsum(words.value_lengths().to_numpy()))
        length = pc.utf8_length(flat).to_numpy()
        known = flat.dictionary_encode()
        hashes = pd.util.hash_array(known.dictionary.to_numpy(zero_copy_only=False), categorize=False).view(np.int64)
        held = length > longer_than
        offsets = np.append(0, np.cumsum(held))[ends].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes[known.indices.to_numpy()[held]]))
        # white space at either end leaves an empty word
        counts = np.diff(np.append(0, np.cumsum(length > 0))[ends])
        return pa.StructArray.from_arrays([pa.array(counts), lists], ["words", "hashes"])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "words long, hashes array<long>")(text)


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for differing lengths or a zero norm."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def half_up(x: Column, digits: int) -> Column:
    """Rounding half up on the double."""
    k = float(10**digits)
    return F.floor(x * k + 0.5) / F.lit(k)


def bpe_tokens(text: Column, encoding) -> Column:
    """Tokens by a given encoding (an object with encode_ordinary, such as one of tiktoken's); 0 for blank or null text.

    The encoding is the caller's: without one, estimate_tokens() is the fallback.
    """
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: len(encoding.encode_ordinary(t)) if t.strip() else 0)

    return count(text)


def fingerprint_tokens(text: Column) -> Column:
    """A quarter of the length, rounded up, not trimmed."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / F.lit(4.0)).cast("long")


def keyword_relevance(query: Column, item: Column) -> Column:
    """Share of the query's keywords (an array) that the item's (an array) have; 0 without any."""
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, item)) / F.size(query)).otherwise(0.0)


def embedding_relevance(a: Column, b: Column) -> Column:
    """Cosine, but not below 0; 0 where a vector is missing."""
    return F.coalesce(F.greatest(F.lit(0.0), cosine(a, b)), F.lit(0.0))


def own_bm25(query: Column, item: Column, k1: float = 1.2) -> Column:
    """BM25 of an item against an index of itself alone, from arrays of tokens; repeated query tokens count repeatedly.

    The tokens of many rows are numbered and counted at once, so the work grows with the tokens and not with query times item.
    """
    idf = math.log((1 - 1 + 0.5) / (1 + 0.5) + 1)

    def flat(lists: pa.Array, codes: np.ndarray):
        rows = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
        held = codes >= 0
        return rows[held], codes[held]

    @F.arrow_udf("double")
    def score(q: pa.Array, t: pa.Array) -> pa.Array:
        asked, given = q.flatten(), t.flatten()
        known = pa.concat_arrays([asked, given]).dictionary_encode()
        codes = known.indices.fill_null(-1).to_numpy().astype(np.int64)
        size = len(known.dictionary) + 1
        rows, own = flat(q, codes[: len(asked)])
        of, words = flat(t, codes[len(asked) :])
        keys, times = np.unique(of * size + words, return_counts=True)
        at = np.searchsorted(keys, rows * size + own)
        there = at < len(keys)
        there[there] = keys[at[there]] == (rows * size + own)[there]
        tf = np.zeros(len(rows))
        tf[there] = times[at[there]]
        out = np.bincount(rows, weights=idf * tf * (k1 + 1) / (tf + k1), minlength=len(q))
        missing = q.is_null().to_numpy(zero_copy_only=False) | (t.is_null().to_numpy(zero_copy_only=False) & (q.value_lengths().fill_null(0).to_numpy() > 0))
        return pa.array(out, pa.float64(), mask=missing)

    return score(query, item)


def squashed(score: Column) -> Column:
    return score / (score + 1)


def relevance(query_vector: Column, vector: Column, query_tokens: Column, item_tokens: Column) -> Column:
    """Cosine where both have a vector, else the item's own BM25, squashed."""
    both = query_vector.isNotNull() & vector.isNotNull()
    return F.when(both, embedding_relevance(query_vector, vector)).otherwise(squashed(own_bm25(query_tokens, item_tokens)))


def ascii_words(text: Column) -> Column:
    """Distinct lower-cased runs of ASCII letters, digits and underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9_]+"), F.lit(0)))


def keyword_overlap(a: Column, b: Column) -> Column:
    """Jaccard of the sets of runs of ASCII letters, digits and underscores; 0 if both are empty."""
    return jaccard(ascii_words(a), ascii_words(b))


def topic(text: Column) -> Column:
    """The first sentence without leading marks of a heading, at most 60 characters, trimmed."""
    bare = trimmed(F.regexp_replace(F.coalesce(text, F.lit("")), r"^#+\s*", ""))
    return trimmed(F.substring(F.get(F.split(bare, r"[.!?\n]"), F.lit(0)), 1, 60))


def opposite(text: Column) -> Column:
    """The topic turned round: use to avoid, always to never, enable to disable, else "not" before it."""
    t = topic(text)
    low, out = F.lower(t), F.concat(F.lit("not "), F.lower(t))
    # What is turned into what, the first that occurs counts.
    for a, b in reversed((("use ", "avoid "), ("always ", "never "), ("enable ", "disable "))):
        at = F.instr(low, a)
        turned = F.concat(F.substring(t, F.lit(1), at - 1), F.lit(b), F.substring(t, at + len(a), F.length(t)))
        out = F.when(at > 0, turned).otherwise(out)
    return out


# First and last character of each script.
SCRIPTS = ["A-ɏ", "一-鿿", "؀-ۿ", "Ѐ-ӿ", "ऀ-ॿ", "぀-ゟ", "゠-ヿ", "가-힯", "฀-๿", "֐-׿"]


def scripts(text: Column) -> Column:
    """How many of ten scripts the text has a character of."""
    return sum((F.coalesce(text, F.lit("")).rlike(f"[{r}]").cast("int") for r in SCRIPTS), F.lit(0))


def script_bits(text: Column) -> Column:
    """The scripts that the text has a character of, one bit each.

    A text is read to its first Latin letter for Latin, and once for all others: they are looked for in what is left without Latin.
    """
    text = F.coalesce(text, F.lit(""))
    latin = text.rlike(f"[{SCRIPTS[0]}]").cast("int")

    def others(rest: Column) -> Column:
        return sum((F.shiftleft(rest.rlike(f"[{r}]").cast("int"), i) for i, r in enumerate(SCRIPTS[1:], 1)), F.lit(0))

    # as an array's one element, what is left is made once and not for each script
    rest = F.array(F.regexp_replace(text, rf"[\x00-{SCRIPTS[0][-1]}]+", ""))
    return latin + F.transform(rest, others)[0]


def perplexity(log_probabilities: Column) -> Column:
    """exp of the negative mean of an array; null for an empty one."""
    n = F.size(log_probabilities)
    return F.when(n > 0, F.exp(-F.aggregate(log_probabilities, F.lit(0.0), lambda s, x: s + x.cast("double")) / n))


def quotes(claim: Column, source: Column) -> Column:
    """Whether the source holds the claim, white space and case aside; an empty claim is not held."""
    def plain(x):
        return F.lower(trimmed(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")))

    return (plain(claim) != "") & F.contains(plain(source), plain(claim))


_LOW = (1 << 32) - 1


def _times32(a: Column, b: Column) -> Column:
    """Product modulo 2**32 of two bigints below it: by halves, as the whole one overflows."""
    high = F.shiftrightunsigned(b, 16)
    return (a * b.bitwiseAND(F.lit(0xFFFF)) + F.shiftleft((a * high).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_LOW))


def random32(seed: Column, k: Column) -> Column:
    """The k-th draw (from 1) of the published 32-bit generator mulberry32, as a double below 1; a function of its position, so rows draw side by side."""
    def xor_shift(x, n):
        return x.bitwiseXOR(F.shiftrightunsigned(x, n))

    s = (seed.cast("long") + k.cast("long") * F.lit(0x6D2B79F5)).bitwiseAND(F.lit(_LOW))
    t = _times32(xor_shift(s, 15), s.bitwiseOR(F.lit(1).cast("long")))
    u = (t + _times32(xor_shift(t, 7), t.bitwiseOR(F.lit(61).cast("long")))).bitwiseAND(F.lit(_LOW))
    t = t.bitwiseXOR(u)
    return xor_shift(t, 14).cast("double") / F.lit(4294967296.0)


def priority_bucket(priority: Column) -> Column:
    """0 (most urgent) to 4 from a priority of 0 to 10; 5 where it is null."""
    return F.greatest(F.lit(0), F.least(F.lit(4), 4 - F.floor(F.coalesce(priority, F.lit(5.0)) / 10 * 4))).cast("int")


def bucket_priority(bucket: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((4 - bucket) / 4.0 * 10 + 0.5)).cast("int")


def utilization(total: Column, capacity: Column) -> Column:
    """Per cent to two digits; 0 without a capacity."""
    return F.when(capacity > 0, F.floor(total / capacity * 10000 + 0.5) / 100.0).otherwise(0.0)


# What of an advertised window is effective.
CAPACITY = {"claude": 0.7, "gpt4": 0.65, "default": 0.7}


def effective_budget(advertised: Column, model: str = "default") -> Column:
    return F.floor(advertised * F.lit(CAPACITY.get(model, CAPACITY["default"]))).cast("long")


def adaptive_budget(text: Column, depth: Column, least: int = 512, most: int = 8192) -> Column:
    """A budget from the request: 1024 more above 500 tokens, 2048 more for a demanding word, all of it for an exhaustive depth."""
    # The demanding words.
    asked = ["analyze", "debug", "compare", "refactor", "summarize everything"]
    low = F.lower(F.coalesce(text, F.lit("")))
    hard = F.lit(False)
    for w in asked:
        hard = hard | F.contains(low, F.lit(w))
    b = F.lit(least) + F.when(estimate_tokens(text) > 500, 1024).otherwise(0) + F.when(hard, 2048).otherwise(0)
    return F.when(depth == "exhaustive", F.lit(most)).otherwise(F.least(b, F.lit(most))).cast("long")


def segment_text(content: Column, index: Column, total: Column, parent: Column) -> Column:
    """A segment with a line that says which one it is, and a last line unless it is the last."""
    of = F.when(F.coalesce(parent, F.lit("")) != "", F.concat(F.lit(" of '"), parent, F.lit("'"))).otherwise("")
    head = F.concat(F.lit("[Segment "), (index + 1).cast("string"), F.lit("/"), total.cast("string"), of, F.lit("]\n"))
    return F.concat(head, content, F.when(index < total - 1, "\n[...CONTINUED IN NEXT SEGMENT...]").otherwise(""))


def truncated(content: Column, budget: Column) -> Column:
    """content, or the longest beginning of it that is, with three dots, at most `budget` quarters of a character; null if nothing fits."""
    t = trimmed(F.coalesce(content, F.lit("")))
    room = (budget * 4 - 3).cast("int")
    return F.when(estimate_chars(content) <= budget, content).when(room > 0, F.concat(F.regexp_replace(F.substring(t, F.lit(1), room), r"\s+$", ""), F.lit("...")))


#: What a cut must not fall into: dates, identifiers, versions, names in camel case, constants.
PROTECTED = r"\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2})?|[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|v?\d+\.\d+\.\d+(?:-\w+)?|[A-Z][a-z]+(?:[A-Z][a-z]+)+|\b[A-Z0-9_]{3,}\b"


def protected_zones(text: Column, entities: list[str] = ()) -> Column:
    """Array of (start, end) of the protected runs, in characters from 0. entities: whole words that are protected too."""
    import re

    found = PROTECTED + (r"|\b(?:" + "|".join(re.escape(e) for e in entities) + r")\b" if entities else "")
    runs = F.regexp_extract_all(text, F.lit(f"({found})"), F.lit(1))
    between = F.split(text, found)
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc, p):
        start = acc["at"] + F.length(p["gap"])
        end = start + F.length(p["run"])
        return F.struct(end.alias("at"), F.concat(acc["zones"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("zones"))

    pairs = F.zip_with(runs, F.slice(between, 1, F.size(runs)), lambda r, g: F.struct(r.alias("run"), g.alias("gap")))
    return F.when(F.size(runs) == 0, none).otherwise(F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("zones")), step, lambda acc: acc["zones"]))


def safe_cut(zones: Column, at: Column) -> Column:
    """Whether a cut before the `at`-th character (from 0) falls into none of protected_zones()."""
    return ~F.exists(zones, lambda z: (z["start"] < at) & (at < z["end"]))


def hash64(text: Column) -> Column:
    """Two 32-bit hashes of the characters end to end in base 36: by 31, and FNV-1a. Characters are code points."""
    codes = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    low = F.lit(_LOW)
    first = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(low))
    second = F.aggregate(codes, F.lit(0x811C9DC5).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(0x01000193).cast("long")).bitwiseAND(low))
    return F.lower(F.concat(*[F.conv(h.cast("string"), 10, 36) for h in (first, second)]))


def content_text(content: Column) -> Column:
    """The text of a message's content as JSON: a string itself, of an array the texts of its text blocks on a line each, of an object its JSON; anything else, and what is no JSON, as it stands, and null empty."""
    known = F.try_parse_json(content)
    blocks = F.try_variant_get(known, "$", "array<variant>")

    def text(b):
        return F.when(F.try_variant_get(b, "$.type", "string") == "text", F.try_variant_get(b, "$.text", "string"))

    joined = F.array_join(F.filter(F.transform(blocks, text), lambda t: t.isNotNull()), "\n")
    own = F.ltrim(content)
    return F.coalesce(F.when(own.startswith("["), joined).when(own.startswith('"'), F.try_variant_get(known, "$", "string")), content, F.lit(""))


def alphabetical(text: Column) -> Column:
    """A key that sorts as dictionaries do, not by code points."""
    return F.collate(text, "UNICODE")


# What words of a candidate count for and against it, and what makes its context urgent.
FOR = {"contain": 0.22, "targeted": 0.14, "rollback": 0.18, "monitor": 0.1, "idempotency": 0.2, "isolate": 0.18, "priority": 0.12, "safe": 0.2}
AGAINST = {"delay": 0.35, "wait": 0.3, "monitor-only": 0.5}
URGENT = ["critical", "incident", "compromise", "containment", "outage", "fraud", "patient safety"]


def candidate_score(candidate: Column, context: Column) -> Column:
    """From 0.5: a word for the candidate counts, half as much again if the context has it too; a word against it counts in an urgent context; 0 at least."""
    c, x = F.lower(candidate), F.lower(context)
    urgent = F.lit(False)
    for w in URGENT:
        urgent = urgent | F.contains(x, F.lit(w))
    score = F.lit(0.5)
    for w, k in FOR.items():
        score = score + F.when(F.contains(c, F.lit(w)), F.when(F.contains(x, F.lit(w)), k * 1.5).otherwise(k)).otherwise(0.0)
    for w, k in AGAINST.items():
        score = score - F.when(F.contains(c, F.lit(w)) & urgent, k).otherwise(0.0)
    return F.greatest(F.lit(0.0), score)
